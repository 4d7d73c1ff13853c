r"""Text columns: tokens, fuzzy key, trimming, HTML and URL clean-up.

Every pattern carries ``(?U)`` where it uses ``\s \w \d \b``, so that Java reads
them as Unicode classes. ``\x1c-\x1f`` are whitespace too, which Java leaves out.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = r"[\s\x1c-\x1f]"
# The characters of ``SPACE``.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Legal suffixes that end a company name.
LEGAL_SUFFIXES = (
    "inc", "llc", "ltd", "corp", "co", "corporation", "incorporated",
    "company", "plc", "gmbh", "limited",
)


def text(col: Column) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim Unicode whitespace at both ends; NULL becomes ''.

    Not by a pattern: that would try every character of the text. Texts that begin and end with
    a visible ASCII character stay as they are.
    """
    raw = text(col)
    bare = F.substring(raw, 1, 1).between("!", "~") & F.substring(raw, -1, 1).between("!", "~")
    return F.when(bare, raw).otherwise(F.btrim(raw, F.lit(SPACES)))


def words(col: Column) -> Column:
    """Lower-case a-z0-9 words, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text(col)), "[^a-z0-9]+", " "))


def tokens(col: Column) -> Column:
    """The same words as an array; no words give an empty array."""
    w = words(col)
    return F.when(w == "", F.array().cast("array<string>")).otherwise(F.split(w, " "))


def company_part(col: Column) -> Column:
    suffixes = "|".join(LEGAL_SUFFIXES)
    return F.regexp_replace(words(col), rf"(?:(?:^| )(?:{suffixes}))+\z", "")


def title_part(col: Column) -> Column:
    """Sorted words, so that word order and punctuation do not matter."""
    return F.array_join(F.sort_array(F.split(words(col), " ")), " ")


def city_part(col: Column) -> Column:
    return words(F.substring_index(text(col), ",", 1))


def fuzzy_key(company: Column, title: Column, location: Column) -> Column:
    """Identity of a role across listings; NULL if company or title has no words."""
    c = F.nullif(company_part(company), F.lit(""))
    t = F.nullif(title_part(title), F.lit(""))
    return F.concat(c, F.lit("|"), t, F.lit("|"), city_part(location))


def flag_text(col: Column) -> Column:
    """Lower-case; line breaks end a sentence; whitespace runs become one space."""
    lines = F.regexp_replace(F.lower(text(col)), rf"(?U){SPACE}*\n{SPACE}*", ". ")
    return F.trim(F.regexp_replace(lines, rf"(?U){SPACE}+", " "))


# The UDFs are made inside functions so that workers get them by value and need
# no copy of this package.


def _unescape(col: Column) -> Column:
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(unescape, StringType())(col)


def _unescape_each(col: Column) -> Column:
    def unescape(lists: pd.Series) -> pd.Series:
        def each(items):
            return [None if x is None else html.unescape(x) for x in items]

        return lists.map(each, na_action="ignore")

    return F.pandas_udf(unescape, ArrayType(StringType()))(col)


TAG = "<[^>]+>"


def strip_html(col: Column) -> Column:
    """Entities first, then tags to a space. Only texts with '&' go to Python."""
    raw = text(col)
    plain = F.coalesce(_unescape(F.when(raw.contains("&"), raw)), raw)
    return F.regexp_replace(plain, TAG, " ")


def strip_html_each(col: Column) -> Column:
    """``strip_html`` on every item of an array of strings."""
    with_entity = F.exists(col, lambda x: x.contains("&"))
    plain = F.coalesce(_unescape_each(F.when(with_entity, col)), col)
    return F.transform(plain, lambda x: F.regexp_replace(text(x), TAG, " "))


def percent_decode(col: Column) -> Column:
    """Decode %XX; a stray '%' and a plus sign stay as they are."""
    safe = F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def slug_clean(col: Column) -> Column:
    return F.regexp_replace(col, r"[.]+\z", "")
