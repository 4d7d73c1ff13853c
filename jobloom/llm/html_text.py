"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the "
    "their they this to was we were which with you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einen einer er es für "
    "hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von war wie wir zu "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus "
    "pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella en era es esta este fue ha la las lo los más muy no o para pero por se si sin su "
    "sus también un una y ya"
).split())

# What elements and their names stand for.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav aside svg math canvas audio video object template select option button dialog datalist".split())
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul"
).split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent contentinfo cookie cookies "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notification notifications overlay pager "
    "pagination popup promo promoted promotion share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toc toolbar topbar widget"
).split())
#: Names that stand for asides as well as for what an article is about.
VAGUE_NAMES = frozenset("complementary copyright legal notice notices recommended related search".split())
#: Elements of these names are never read, nor are articles inside them.
CLOSED_NAMES = frozenset((
    "ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored"
).split())
#: Readers' remarks, where such a word starts or ends a name.
REMARK = re.compile(
    r"comments?(?:list|form|box|area|body|text|thread|section|wrap|wrapper|container|feed|meta|count)?|disqus|replies|reply|respond")
#: Before such a word a name says what is not there, or how the page is laid out.
LAYOUT = frozenset("with without has have no not non hide hidden show open closed is toggle".split())
#: Beside such a name another is only in doubt.
ARTICLE_NAMES = frozenset("article body content entry main page post story text".split())
#: What an open element is ended by when it is not closed: the next of these, up to the container.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "td": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
    "th": (frozenset(["td", "th", "tr"]), frozenset(["table"])), "tr": (frozenset(["tr", "tbody", "tfoot"]), frozenset(["table"])),
}

#: Below these characters a block is short; above this share of link text it is a menu.
SHORT, LINKS = 70, 0.5
#: Share of stop words from which a long block is text, and up to which it is not.
DENSE, SPARSE = 0.2, 0.08
#: Share of stop words in all words of a page below which its language is none of the four.
KNOWN = 0.03
#: Characters that take the place of SHORT in scripts that write no spaces.
SHORT_UNSPACED = 25
#: Blocks in doubt go if the others hold this share of their dense text.
DOUBT = 0.25

# comments; declarations; tags, by quoted values or, with a quote left open, up to the next ">"; a tag cut short
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+|[^>]*+)>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int
    heading: bool
    article: bool
    doubt: bool = False  # a name that only holds an aside's name, as in "comment-list" or "has-toc"


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; quoted values are never taken for names."""
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw) if m[1]}


def named(value: str) -> tuple[set[str], bool, bool]:
    """The names that whole classes or ids are or end in; whether one stands for remarks; whether others are in doubt."""
    sure: set[str] = set()
    remark = doubt = False
    for one in value.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", one) if p]
        if not parts or not LAYOUT.isdisjoint(parts):
            doubt = doubt or not (ASIDE_NAMES | VAGUE_NAMES).isdisjoint(parts)
        elif REMARK.fullmatch(parts[0]) or REMARK.fullmatch(parts[-1]):
            remark = True
        elif parts[-1] in ASIDE_NAMES or parts[-1] == "header":
            sure.add(parts[-1])
        elif not (ASIDE_NAMES | VAGUE_NAMES).isdisjoint(parts):
            doubt = True
    return sure, remark, doubt


def kind_of(tag: str, raw: str, article: bool, by_name: bool = True) -> str:
    """'hard' or 'soft' for an element that holds no article text, 'doubt' or '' for others.

    An article or main element opened inside a soft one is read after all. A class or id counts
    if it is such a name or ends in it; if it only holds one, or stands beside a name for the article,
    its blocks are in doubt. Without ``by_name`` only remarks and hidden elements go by their attributes.
    """
    if tag in DROPPED or tag == "footer" or (tag == "header" and not article):
        return "hard"
    if tag == "form":
        return "soft"
    if not raw or tag in HEADINGS or tag in ("html", "body"):
        return ""
    names: set[str] = set()
    doubt = remark = False
    own = attributes_of(raw)
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return "hard"
    for name in ("class", "id", "role"):
        sure, remarks, some = named(own.get(name, ""))
        names |= sure
        remark, doubt = remark or remarks, doubt or some
    if remark and tag not in ("article", "main"):
        return "hard"
    if tag in ("article", "main") or not by_name:
        return ""
    if not ARTICLE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", f"{own.get('class', '')} {own.get('id', '')}")) and not names & CLOSED_NAMES:
        return "doubt" if names & ASIDE_NAMES or doubt else ""
    if names & CLOSED_NAMES:
        return "hard"
    if names & ASIDE_NAMES or ("header" in names and not article):
        return "soft"
    return "doubt" if doubt else ""


def blocks(page: str, by_name: bool = True) -> list[Block]:
    """Blocks of the page in order, without those of elements that never hold the article.

    Elements whose end tags may be left out end where HTML says so.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, kind of what is dropped, inside an article, in doubt
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = 0
    breaks = 0
    heading = False

    def end_block() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, min(linked, len(text)), heading, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))
        parts.clear()
        linked, heading = 0, False

    def close(name: str) -> None:
        while True:
            tag = stack.pop()[0]
            opened[tag] -= 1
            if tag == name:
                return

    def end_open(tag: str) -> None:
        """End the elements that ``tag`` ends when it opens."""
        if opened["p"] and tag in BLOCKS:  # what is open inside a p holds no blocks
            close("p")
        for own in ("li", "dt", "dd", "td", "th", "tr"):
            by, within = ENDED_BY[own]
            if opened[own] and tag in by:
                for name in (x[0] for x in reversed(stack)):
                    if name in within:
                        break
                    if name == own:
                        close(own)
                        break

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if not raw or (stack and stack[-1][1]):
            return
        text = html.unescape(raw)
        parts.append(text)
        if not text.isspace():
            breaks = 0
        if opened["a"]:
            linked += len(" ".join(text.split()))

    while match := TAG.search(page, at):
        add(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = match.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:  # an empty line parts two blocks
                end_block()
            continue
        if tag in BLOCKS:
            end_block()
            breaks = 0
        if closing:
            if opened[tag]:
                close(tag)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        end_open(tag)
        if tag in VOID or attributes.endswith("/"):
            continue
        _, kind, article, doubt = stack[-1] if stack else ("", "", False, False)
        own = kind_of(tag, attributes, article, by_name)
        if own == "doubt":
            own, doubt = "", True
        if tag in ("article", "main") and not own:
            kind, article = ("" if kind == "soft" else kind), True
        elif 'role="main"' in attributes:
            article = True
        stack.append((tag, kind if kind == "hard" else own or kind, article, doubt))
        opened[tag] += 1
        if tag in HEADINGS:
            heading = True
    add(page[at:])
    end_block()
    return out


def density(block: Block) -> float:
    """Share of stop words."""
    words = WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def known(found: list[Block]) -> bool:
    """Whether the page is in a language whose stop words are known."""
    words = [w for b in found if b.linked <= LINKS * len(b.text) for w in WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) >= KNOWN * len(words)


def is_short(block: Block) -> bool:
    spaced = len(block.text) < 12 * (1 + block.text.count(" "))
    return len(block.text) < (SHORT if spaced else SHORT_UNSPACED)


def is_dense(block: Block, by_words: bool) -> bool:
    """Long, not mostly links, and of many stop words, if the page's language is ``known``."""
    return not is_short(block) and block.linked <= LINKS * len(block.text) and (not by_words or density(block) >= DENSE)


def first_pass(block: Block, by_words: bool = True) -> bool | None:
    """True for text, False for the rest, None where a short or middling block can't tell.

    A long block of an article needs fewer stop words to be text, and with few it can't tell. In
    a language whose stop words are not known, length and links decide.
    """
    if block.linked > LINKS * len(block.text) and not block.heading:
        return False
    if is_short(block):
        return None
    if not by_words:
        return True
    share = density(block)
    if block.article:
        return True if share > SPARSE else None
    return True if share >= DENSE else False if share <= SPARSE else None


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided one.

    At equal distance a heading looks ahead; other blocks are text if either neighbour is.
    With no decided block at all, all undecided ones are text.
    """
    n, out = len(found), []
    last: tuple[int, bool | None] = (-1, None)
    following: list[tuple[int, bool | None]] = [(n, None)] * (n + 1)
    for i in range(n - 1, -1, -1):
        following[i] = (i, labels[i]) if labels[i] is not None else following[i + 1]
    for i, block in enumerate(found):
        if labels[i] is not None:
            last = (i, labels[i])
            out.append(bool(labels[i]))
            continue
        (a, before), (b, after) = last, following[i]
        if before is None or after is None:
            out.append(bool(after if before is None else before) if (before, after) != (None, None) else True)
        elif i - a != b - i:
            out.append(bool(before if i - a < b - i else after))
        else:
            out.append(bool(after if block.heading else before or after))
    return out


def weights(found: list[Block], inside: list[bool], by_words: bool) -> tuple[int, int]:
    """Characters of dense text inside and outside; of all text that is not links, if none is dense."""
    dense = [is_dense(b, by_words) for b in found]
    sizes = [len(b.text) * d if any(dense) else len(b.text) - b.linked for b, d in zip(found, dense, strict=True)]
    within = sum(n for n, i in zip(sizes, inside, strict=True) if i)
    return within, sum(sizes) - within


def main_text(page: str | None) -> str:
    """The article's blocks, one a line. Empty for an empty or null page.

    Blocks in doubt are left out if the others hold a quarter as much dense text, and blocks
    outside of article and main elements if these hold as much as they do. The two passes decide
    on the rest. A page of which nothing is left is read once more without the names of its elements.
    """
    for by_name in (True, False):
        found = blocks(page or "", by_name)
        by_words = known(found)
        for inside, least in ((lambda b: not b.doubt, DOUBT), (lambda b: b.article, 1.0)):
            flags = [inside(b) for b in found]
            if any(flags) and not all(flags):
                own, others = weights(found, flags, by_words)
                found = [b for b, f in zip(found, flags, strict=True) if f] if own >= least * others else found
        labels = second_pass(found, [first_pass(b, by_words) for b in found])
        text = "\n".join(b.text for b, good in zip(found, labels, strict=True) if good)
        if text:
            break
    return text


@F.arrow_udf(StringType())
def extracted(pages: pa.Array) -> pa.Array:
    """A column function from whole html to main text, page by page; repeated pages give equal texts."""
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())
