"""Benchmark leaks by template windows, re-parameterised questions among them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.spread import small
from jobloom.session import written

#: Tokens in a window.
WINDOW = 8
#: Share of an item's windows that a document must hold.
COVER = 0.5
#: Consecutive words of an item that are a leak whatever their share of it.
RUN = 13

# What counts as a unit right after a number.
UNITS = (
    "%", "€", "£", r"\$", "°C", "°F", "km", "cm", "mm", "m", "kg", "mg", "g", "ml", "l", "ms", "s", "h", "kWh", "kW",
    "W", "V", "A", "Hz", "kHz", "MHz", "GHz", "KB", "MB", "GB", "TB", "mph", "inch(?:es)?", "feet", "foot", "ft",
    "yards?", "miles?", "ounces?", "oz", "pounds?", "lbs?", "tons?", "lit(?:er|re)s?", "met(?:er|re)s?", "grams?",
    "kilograms?", "kilomet(?:er|re)s?", "seconds?", "minutes?", "hours?", "days?", "weeks?", "months?", "years?",
    "dollars?", "euros?", "cents?", "percent", "degrees?",
)

#: Words of a window that must stand for themselves, so that lists of numbers or names are no templates.
LITERALS = 3

#: A private-use character before each placeholder.
#: After the mark comes the kind: n number, u unit, p proper name, o a capitalised word that opens a sentence.
#: Any run of white space but a single space.
SPACE = r"[\s\p{Z}&&[^ ]][\s\p{Z}]*+| [\s\p{Z}]++"
MARK = "\ue000"
NAME = r"\p{Lu}(?<=[\p{Ll},;:0-9] \p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
NUMBER = r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*+(?:[.,:/][0-9]++)*+"
OPENING = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+(?![\p{L}\p{N}])"
UNIT = rf"({MARK}n[0-9.,:/]++) (?: ?({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
TOKEN = rf"{MARK}n[0-9]++(?:[.,:/][0-9]++)*+|{MARK}?[\p{{L}}\p{{N}}]++"


def tokens(text: Column) -> Column:
    """The words of a whole text in lower case, with a mark and a kind before each number, unit and name.

    A number is a run of digits with inner points, commas, colons or slashes; a unit is one of
    UNITS right after a number; a name is a capitalised word, told apart by whether it opens a
    sentence. Runs of white space count as one space. Null counts as empty. Kinds don't change where
    words begin and end, so all that is made of the tokens has the same places.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.replace(t, F.lit(MARK), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, SPACE, " "), NAME, f"{MARK}p$0")
    t = F.regexp_replace(F.regexp_replace(t, OPENING, f"{MARK}o$0"), NUMBER, f" {MARK}n$0 ")
    t = F.lower(F.regexp_replace(t, UNIT, f"$1 {MARK}u$2 "))
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def bare(word: Column) -> Column:
    """A token without mark and kind."""
    return F.when(word.startswith(MARK), F.substring(word, 3, 1 << 30)).otherwise(word)


def values_of(some: Column, opening: bool = False) -> Column:
    """Tokens; a placeholder keeps its mark, kind and value. Opening words are names only with ``opening``."""
    opens = f"{MARK}o"
    one = lambda w: F.when(w.startswith(opens), F.concat(F.lit(f"{MARK}p"), F.substring(w, 3, 1 << 30)) if opening else bare(w)).otherwise(w)
    return F.transform(some, one)


def template_of(some: Column, opening: bool = False) -> Column:
    """The same tokens, but a placeholder is only its mark and kind."""
    opens = f"{MARK}o"
    own = F.lit(f"{MARK}p") if opening else None
    return F.transform(some, lambda w: F.when(
        w.startswith(MARK), F.when(w.startswith(opens), bare(w) if own is None else own).otherwise(F.substring(w, 1, 2))).otherwise(w))


def plain_of(some: Column) -> Column:
    """Lower-case words without placeholders: the same for any case and line breaks."""
    return F.transform(some, bare)


def values(text: Column, opening: bool = False) -> Column:
    return values_of(tokens(text), opening)


def template(text: Column, opening: bool = False) -> Column:
    return template_of(tokens(text), opening)


def plain(text: Column) -> Column:
    return plain_of(tokens(text))


def windowed_each(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``rows`` with the array columns in ``sizes`` replaced by the hashes of all their runs of so many words.

    A text of fewer words has one window, the whole; a text of none has none. Hashes of runs
    double in length until two of them, overlapping, cover a window. The columns are made step by
    step, side by side, so that each is computed once.
    """
    names = [c for c in rows.columns if c not in sizes]
    hashes = {c: F.transform(c, lambda x: F.xxhash64(x)).alias(f"__h_{c}") for c in sizes}
    out = rows.select(*names, *hashes.values(), *[F.xxhash64(c).alias(f"__all_{c}") for c in sizes], *[F.size(c).alias(f"__n_{c}") for c in sizes])
    done = dict.fromkeys(sizes, 1)
    while any(done[c] < size for c, size in sizes.items()):
        made = {}
        for c, size in sizes.items():
            step = min(done[c], size - done[c])
            if step > 0:
                left = F.greatest(F.col(f"__n_{c}") - done[c] - step + 1, F.lit(0))
                h = f"__h_{c}"
                made[h] = F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(1 + step), left), lambda x, y: F.xxhash64(x, y))
                done[c] += step
        out = out.withColumns(made)
    none = F.expr("CAST(array() AS array<bigint>)")
    whole = {c: F.when(F.col(f"__n_{c}") >= size, F.col(f"__h_{c}")).when(F.col(f"__n_{c}") > 0, F.array(f"__all_{c}")).otherwise(none) for c, size in sizes.items()}
    return out.select(*names, *[w.alias(c) for c, w in whole.items()])


def windowed(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """``rows`` with ``windows``, the hashes of all runs of ``size`` words of ``template``."""
    return windowed_each(rows, {"template": size}).withColumnRenamed("template", "windows")


def items(benchmark: DataFrame, size: int = WINDOW, opening: bool = False) -> DataFrame:
    """(item_id, words, windows) of each item. Rows without an item_id are left out."""
    rows = benchmark.filter("item_id IS NOT NULL").select("item_id", "text").distinct()
    return windowed(rows.select("item_id", values(F.col("text"), opening).alias("words"), template(F.col("text"), opening).alias("template")), size)


def places_of(known: DataFrame, size: int, literals: int) -> DataFrame:
    """(item_id, place, window) of the items' windows in which ``literals`` of ``size`` words stand for themselves.

    Of a window that is shorter, as many as that share of its words.
    """
    rows = known.select("item_id", "words", F.posexplode("windows").alias("place", "window"))
    held = F.slice("words", F.col("place") + 1, F.lit(size))
    own = F.size(F.filter(held, lambda w: ~w.startswith(MARK)))
    return rows.filter(own * size >= F.least(F.size(held), F.lit(size)) * literals).select("item_id", "place", "window")


def hits(
    docs: DataFrame, known: DataFrame, size: int = WINDOW, cut: Callable[[Column], Column] = template, literals: int = 0,
) -> DataFrame:
    """(doc_id, version, at, item_id, place): every window of a document that equals one of an item.

    ``version`` tells the texts of one doc_id apart. ``known`` is the output of ``items``, or has the
    windows of words that ``cut`` gives. Its windows are broadcast if counted to be few, so that
    documents are not shuffled.
    """
    marks = places_of(known, size, literals)
    marks, _ = small(marks, "benchmark-windows", 32)
    # posexplode would add a filter on the array, and with it compute all windows once more
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), cut(F.col("text")).alias("template"))
    return windowed(rows, size).select("doc_id", "version", F.posexplode_outer("windows").alias("at", "window")).join(marks, "window").drop("window")


def slots(docs: DataFrame, known: DataFrame, found: DataFrame, size: int = WINDOW, opening: bool = False) -> DataFrame:
    """(doc_id, version, item_id, shift, asked, given): the values behind each placeholder of a hit.

    Texts are read again only for documents with hits on items that have placeholders. Their
    ids are broadcast if they are few.
    """
    typed = known.filter(F.exists("words", lambda x: x.startswith(MARK))).select("item_id", "words")
    of_typed = found.join(typed.select("item_id").distinct(), "item_id", "left_semi")
    ids, _ = small(of_typed.select("doc_id").distinct(), "documents-with-slots")
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").distinct()
    given = texts.select("doc_id", F.xxhash64("text").alias("version"), values(F.col("text"), opening).alias("given"))
    near = of_typed.groupBy("doc_id", "version", "item_id").agg(F.collect_set(F.struct("at", "place")).alias("hits"))
    rows = near.join(given, ["doc_id", "version"]).join(typed, "item_id")

    def behind(hit: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(
            (hit["at"] - hit["place"]).alias("shift"),
            F.get(F.col("words"), hit["place"] + k).alias("asked"), F.get(F.col("given"), hit["at"] + k).alias("given")))
        return F.filter(each, lambda s: s["asked"].startswith(MARK))

    pairs = rows.select("doc_id", "version", "item_id", F.explode(F.array_distinct(F.flatten(F.transform("hits", behind)))).alias("s"))
    return pairs.select("doc_id", "version", "item_id", "s.*")


def leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER, opening: bool = False, literals: int = 0,
) -> DataFrame:
    """(doc_id, item_id, windows, covered, slots, changed, reparameterised) of all leaked items.

    An item leaks into a document that holds ``cover`` or more of its template windows, counted
    over the windows whose slots are filled consistently: at one shift between positions in
    document and item, each value of the item stands for one value of the document. Windows
    that touch a value that stands for several do not count; others of the shift do. ``changed`` counts the item's values that stand for others; then the question is
    re-parameterised. An item or document of fewer than ``size`` tokens has one window, all of
    it, so a short item only leaks into documents that consist of it. With ``opening`` words that
    open sentences are names too. Only windows with ``literals`` words that are no placeholders count.

    Null and empty texts have no windows. Rows without an id are left out, repeated rows
    count once, and rows that share a doc_id count as one document. Other columns are left out.
    """
    known = written(items(benchmark, size, opening), "benchmark-items")
    found = written(hits(docs, known, size, lambda t: template(t, opening), literals), "benchmark-hits")
    return settled(docs, known, found, size, cover, opening, literals)


def settled(docs: DataFrame, known: DataFrame, found: DataFrame, size: int, cover: float, opening: bool, literals: int) -> DataFrame:
    """The output of ``leaks`` from ``hits``: slots are checked, and what they leave is held against ``cover``."""
    filled = written(slots(docs, known, found, size, opening), "benchmark-slots")
    per_value = filled.groupBy("doc_id", "version", "item_id", "shift", "asked").agg(
        F.min("given").alias("low"), F.max("given").alias("high"))
    per_place = per_value.groupBy("doc_id", "version", "item_id", "shift").agg(
        F.collect_set(F.when(F.col("low") != F.col("high"), F.col("asked"))).alias("mixed"), F.count("*").alias("slots"),
        F.sum(((F.col("low") != F.col("asked")) | (F.col("high") != F.col("asked"))).cast("int")).alias("changed"))
    words = known.select("item_id", F.posexplode("words").alias("pos", "word")).filter(F.col("word").startswith(MARK))
    words = words.groupBy("item_id").agg(F.collect_set(F.struct("pos", "word")).alias("words"))
    of_mixed = F.filter("words", lambda w: F.array_contains(F.col("mixed"), w["word"]))
    per_place = per_place.join(words, "item_id").withColumn("mixed", F.transform(of_mixed, lambda w: w["pos"])).drop("words")
    places = found.select("doc_id", "version", "item_id", "place", (F.col("at") - F.col("place")).alias("shift"))
    sound = places.join(per_place, ["doc_id", "version", "item_id", "shift"], "left")
    touched = F.exists("mixed", lambda at: at.between(F.col("place"), F.col("place") + size - 1))
    sound = sound.filter(~F.coalesce(touched, F.lit(False)))
    total = places_of(known, size, literals).groupBy("item_id").agg(F.count_distinct("place").alias("windows"))
    total = total.withColumn("windows", F.col("windows").cast("int"))
    out = sound.groupBy("doc_id", "item_id").agg(
        F.count_distinct("place").alias("covered"), F.coalesce(F.max("slots"), F.lit(0)).alias("slots"),
        F.coalesce(F.min("changed"), F.lit(0)).alias("changed")).join(total, "item_id")
    out = out.filter(F.col("covered") >= cover * F.col("windows"))
    return out.select("doc_id", "item_id", "windows", "covered", "slots", "changed", (F.col("changed") > 0).alias("reparameterised"))


def plain_items(benchmark: DataFrame, size: int = WINDOW) -> list[tuple[int, DataFrame]]:
    """(length, items): items by the length of their windows of plain words, ``size`` or that of a shorter item."""
    rows = benchmark.filter("item_id IS NOT NULL").select("item_id", plain(F.col("text")).alias("template")).distinct()
    rows = rows.withColumns({"__words": F.size("template"), "words": F.col("template")}).filter("__words > 0")
    lengths = sorted(r[0] for r in rows.select(F.least("__words", F.lit(size))).distinct().collect())  # at most ``size``
    out = [(n, windowed(rows.filter(F.least("__words", F.lit(size)) == n).drop("__words"), n)) for n in lengths]
    return out or [(size, windowed(rows.drop("__words"), size))]


def copied(held: DataFrame, total: DataFrame, size: int, cover: float, run: int) -> DataFrame:
    """(doc_id, item_id, windows, covered) of plain windows that hold ``cover`` of an item, or ``run`` words in a row."""
    places = held.groupBy("doc_id", "version", "item_id", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.array_sort(F.collect_set("place")).alias("places"))
    ahead = max(run - size, 0)  # so many windows follow the first of a run
    in_a_row = F.exists(F.sequence(F.lit(0), F.size("places") - 1), lambda i: F.get("places", i + ahead) == F.get("places", i) + ahead)
    runs = places.filter(in_a_row).select("doc_id", "item_id").distinct().withColumn("run", F.lit(True))
    out = held.groupBy("doc_id", "item_id").agg(F.count_distinct("place").alias("covered")).join(total, "item_id")
    out = out.join(runs, ["doc_id", "item_id"], "left").filter(F.col("run").isNotNull() | (F.col("covered") >= cover * F.col("windows")))
    return out.select("doc_id", "item_id", "windows", "covered")


def all_hits(docs: DataFrame, marks: DataFrame, cuts: dict[int, tuple[int, Callable[[Column], Column]]]) -> DataFrame:
    """(doc_id, version, way, at, item_id, place): hits of several ways to cut the same tokens, in one pass.

    ``cuts`` has per way the size of its windows and what it makes of the tokens; ``marks`` has way,
    item_id, place and window.
    """
    marks, _ = small(marks, "benchmark-windows", 40)
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), tokens(F.col("text")).alias("__tokens"))
    rows = rows.select("doc_id", "version", *[cut(F.col("__tokens")).alias(f"w{way}") for way, (_, cut) in cuts.items()])
    rows = windowed_each(rows, {f"w{way}": size for way, (size, _) in cuts.items()})
    ways = F.array(*[F.struct(F.lit(way).alias("way"), F.col(f"w{way}").alias("windows")) for way in cuts])
    rows = rows.select("doc_id", "version", F.explode_outer(ways).alias("w")).select("doc_id", "version", "w.way", "w.windows")
    return rows.select("doc_id", "version", "way", F.posexplode_outer("windows").alias("at", "window")).join(marks, ["way", "window"]).drop("window")


def found(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, cover: float = COVER, run: int = RUN, literals: int = LITERALS,
) -> DataFrame:
    """The columns of ``leaks``, one row for each (document, item) found in any of three ways.

    These are ``leaks`` with windows of ``literals`` words that are no placeholders; the same with names
    that open sentences; and items copied word for word, whatever the case or line breaks: a
    document holds ``cover`` or more of an item's windows of lower-case words, or ``run`` of its words in
    a row. There an item of fewer than ``size`` words is one window of its own length, and is found
    anywhere in a document. The first way that finds a pair gives its figures; a copy has no
    slots. Each text is tokenized once for all ways. Rows are left out as in ``leaks``; an empty
    table gives no rows.
    """
    known = [written(items(benchmark, size, opening), "benchmark-items") for opening in (False, True)]
    words = [(n, written(rows, "benchmark-plain")) for n, rows in plain_items(benchmark, size)]
    cuts = {0: (size, template_of), 1: (size, lambda t: template_of(t, True))} | {2 + i: (n, plain_of) for i, (n, _) in enumerate(words)}
    marks = [places_of(k, size, literals).withColumn("way", F.lit(way)) for way, k in enumerate(known)]
    marks += [rows.select("item_id", F.posexplode("windows").alias("place", "window")).withColumn("way", F.lit(2 + i)) for i, (_, rows) in enumerate(words)]
    held = written(all_hits(docs, functools.reduce(DataFrame.unionByName, marks), cuts), "benchmark-hits")
    of_way = lambda way: held.filter(F.col("way") == way).drop("way")
    total = functools.reduce(DataFrame.unionByName, [rows.select("item_id", F.size("windows").alias("windows")) for _, rows in words])
    word = copied(held.filter("way >= 2").drop("way"), total.groupBy("item_id").agg(F.min("windows").alias("windows")), size, cover, run)
    word = word.withColumns({"slots": F.lit(0).cast("long"), "changed": F.lit(0).cast("long"), "reparameterised": F.lit(False)})
    ways = [settled(docs, known[way], of_way(way), size, cover, bool(way), literals) for way in (0, 1)] + [word]
    figures = ["windows", "covered", "slots", "changed", "reparameterised"]
    each = [w.select("doc_id", "item_id", F.struct(F.lit(i).alias("way"), *figures).alias("f")) for i, w in enumerate(ways)]
    best = functools.reduce(DataFrame.unionByName, each).groupBy("doc_id", "item_id").agg(F.min("f").alias("f"))
    return best.select("doc_id", "item_id", *[F.col("f")[c].alias(c) for c in figures])
