"""Leaks against a plain-loop version, re-parameterised questions among them."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from jobloom.llm import templates as tp

ITEM = ("A train leaves Paris at 9:30 and drives 120 km to reach Lyon; it stops 3 times before Lyon. "
        "How long does the trip from Paris take?")
CONSISTENT = ("Intro words. A train leaves Berlin at 7:15 and drives 340 km to reach Hamburg; it stops 5 times before Hamburg. "
              "How long does the trip from Berlin take? More.")


def brute(spark, docs, bench, size=8, cover=0.5, literals=0, opening=False):
    """Word by word in Python over the words that Spark cut."""

    def cut(rows):
        df = spark.createDataFrame([r for r in rows if r[0] is not None], "i long, text string").distinct()
        out = df.select("i", tp.values(F.col("text"), opening).alias("v"), tp.template(F.col("text"), opening).alias("t")).collect()
        assert all(len(r.v) == len(r.t) for r in out)
        return [(r.i, r.v, r.t) for r in out]

    def runs(t):
        if not t:
            return []
        return [tuple(t[i : i + size]) for i in range(len(t) - size + 1)] if len(t) >= size else [tuple(t)]

    found = set()
    docs = cut(docs)
    for item, asked, template in cut(bench):
        own = runs(template)
        covered = collections.defaultdict(set)
        for doc, given, other in docs:
            shifts = collections.defaultdict(set)
            for at, run in enumerate(runs(other)):
                for place, mine in enumerate(own):
                    if run == mine:
                        shifts[at - place].add(place)
            for shift, places in shifts.items():
                stands = collections.defaultdict(set)
                for p in places:
                    for k in range(p, min(p + size, len(asked))):
                        if asked[k].startswith(tp.MARK):
                            stands[asked[k]].add(given[k + shift])
                if all(len(v) == 1 for v in stands.values()):
                    covered[doc] |= places
        found |= {(d, item) for d, places in covered.items() if len(places) >= cover * len(own)}
    return found


def leaks(spark, docs, bench, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "windows", "at", "place", "hits")})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "window", "words")})
    return tp.leaks(d, b, **kw).collect()


BENCH = [(1, ITEM), (2, "short one here"), (3, None), (4, ""), (None, ITEM), (5, "The cat sat on the mat and looked at the dog for a while today.")]
DOCS = [
    (1, CONSISTENT), (2, CONSISTENT.replace("Hamburg. ", "Munich. ")), (3, "x " + ITEM), (4, "Short one here!"), (5, "this is a short one here"),
    (6, None), (7, ""), (8, "unrelated text of some words that are not in it"), (None, ITEM), (9, ITEM), (9, ITEM), (9, "second text under nine"),
    (10, (ITEM + " ") * 40), (11, "word " * 30_000 + ITEM), (12, ITEM[: len(ITEM) // 4]), (13, "the CAT sat on the mat, and looked at the dog!"),
    (14, CONSISTENT + " Then " + CONSISTENT.replace("340", "17").replace("Berlin", "Rome")),
]


def test_equals_brute_force(spark):
    rows = leaks(spark, DOCS, BENCH)
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(spark, DOCS, BENCH) and len(rows) == len(got)
    assert {d for d, _ in got} == {1, 3, 4, 9, 10, 11, 13, 14}
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert by[1, 1].reparameterised and by[1, 1].changed == 5 and not by[3, 1].reparameterised


def test_random_texts(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "Gamma", "7", "12 km", "delta,", "omega."]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bench = [(i, text(rnd.randrange(5, 20))) for i in range(25)]
    docs = [(i, text(rnd.randrange(3, 60)) + " " + bench[i % 25][1].replace("7", str(i)) + " " + text(5)) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in leaks(spark, docs, bench)}
    assert got == brute(spark, docs, bench)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in tp.leaks(docs, bench).collect()}
    assert got == brute(spark, [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    # an item that is in a document word for word leaks; a document without any of its words does not
    plain = lambda t: " ".join((t or "").lower().split())
    for d in docs.collect():
        for b in bench.collect():
            if plain(b.text) in plain(d.text):
                assert (d.doc_id, b.item_id) in got


@pytest.mark.parametrize("text,want", [
    ("It cost 5 km/h or 3kg, said Bob Smith.", ["it", "cost", "@n", "@u", "h", "or", "@n", "@u", "said", "@p", "@p"]),
    ("Bob ran.\nAnn won 1,200.50 euros", ["bob", "ran", "ann", "won", "@n", "@u"]), (None, []), ("...", []), ("a1 2b", ["a1", "@n", "b"]),
])
def test_placeholders(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tp.template(F.col("t")).alias("x")).first().x
    assert [x.replace(tp.MARK, "@") for x in got] == want


def test_empty_tables(spark):
    assert leaks(spark, [], BENCH) == [] and leaks(spark, DOCS, []) == []


def test_native(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    plan = tp.hits(docs, tp.items(bench))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def pairs(spark, docs, bench):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    rows = tp.found(d, b).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r for r in rows}


def test_copies_of_any_case_and_line_breaks(spark):
    docs = [(1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM.title()), (4, ITEM.replace(" ", "\n")), (5, ITEM.replace(" ", "  ")), (6, ITEM), (7, "other words")]
    got = pairs(spark, docs, [(1, ITEM)])
    assert set(got) == {(i, 1) for i in range(1, 7)} and not any(r.reparameterised for r in got.values())
    # re-wrapped and with other values
    assert pairs(spark, [(1, CONSISTENT.replace(" ", "\r\n  "))], [(1, ITEM)])[1, 1].changed == 5


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Anna gives Tom 3 apples more. Tom eats 2 apples of them. Anna asks how many apples Tom has."
    other = item.replace("Tom", "Paul").replace("Anna", "Vera")
    assert pairs(spark, [(1, other)], [(1, item)])[1, 1].reparameterised


def test_an_inconsistent_value_costs_only_its_own_windows(spark):
    rest = "the old bridge over the river was closed for a long time and nobody in the whole valley knew when it would be opened again"
    item = f"In spring the mayor Olga met the baker, and {rest}, so that the mayor Olga left."
    one = item.replace("Olga left", "Rita left")
    assert {(r.doc_id, r.item_id) for r in leaks(spark, [(1, one), (2, item)], [(1, item)])} == {(1, 1), (2, 1)}
    item = f"There are 5 apples and 5 pears, and {rest}."
    (row,) = leaks(spark, [(1, item.replace("5 apples", "7 apples").replace("5 pears", "3 pears"))], [(1, item)])
    assert row.changed == 1 and row.reparameterised and row.covered < row.windows


def test_runs_of_long_items_and_short_items_in_long_documents(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(59)]
    part = lambda a, b: "before it " + " ".join(words[a:b]) + " and after it"
    bench = [(1, " ".join(words)), (2, "short one here"), (3, "unheard"), (4, ""), (5, "a b c d e f g")]
    docs = [(1, part(10, 42)), (2, part(40, 53)), (3, part(40, 52)), (4, part(0, 12) + part(20, 32)), (5, "this is a Short\none here, said he"),
            (6, "short one, not here"), (7, "a b c d e f g"), (8, "x a b c d e f g h"), (9, "short"), (10, None)]
    assert set(pairs(spark, docs, bench)) == {(1, 1), (2, 1), (5, 2), (7, 5), (8, 5)}
    assert pairs(spark, docs, []) == {} and pairs(spark, [], bench) == {}


def brute_found(spark, docs, bench, size=8, cover=0.5, run=13, literals=3):
    """``found`` by loops: template windows of enough literal words whose slots are consistent, and runs of plain words."""

    def cut(rows, opening):
        df = spark.createDataFrame([r for r in rows if r[0] is not None], "i long, text string").distinct()
        return [(r.i, r.v, r.t) for r in df.select("i", tp.values(F.col("text"), opening).alias("v"), tp.template(F.col("text"), opening).alias("t")).collect()]

    out = set()
    for opening in (False, True):
        documents = cut(docs, opening)
        for item, asked, own in cut(bench, opening):
            n = min(size, len(own))
            spans = [p for p in range(len(own) - n + 1) if n and sum(not w.startswith(tp.MARK) for w in own[p : p + n]) * size >= n * literals]
            covered = collections.defaultdict(set)
            for doc, given, other in documents:
                if n < size and len(other) != n:
                    continue
                shifts = collections.defaultdict(list)
                for p in spans:
                    for at in range(len(other) - n + 1):
                        if other[at : at + n] == own[p : p + n]:
                            shifts[at - p].append(p)
                for shift, places in shifts.items():
                    stands = collections.defaultdict(set)
                    for k in {k for p in places for k in range(p, p + n)}:
                        if asked[k].startswith(tp.MARK):
                            stands[asked[k]].add(given[k + shift])
                    mixed = {k for k, w in enumerate(asked) if len(stands.get(w, ())) > 1}
                    covered[doc] |= {p for p in places if not mixed & set(range(p, p + size))}
            out |= {(d, item) for d, places in covered.items() if places and len(places) >= cover * len(spans)}
    for item, asked, _ in cut(bench, False):
        own = [w[2:] if w.startswith(tp.MARK) else w for w in asked]
        n = min(size, len(own))
        covered, rows = collections.defaultdict(set), set()
        for doc, given, _ in cut(docs, False):
            other = [w[2:] if w.startswith(tp.MARK) else w for w in given]
            for p in range(len(own) - n + 1 if n else 0):
                if any(other[at : at + n] == own[p : p + n] for at in range(len(other) - n + 1)):
                    covered[doc].add(p)
            if any(other[at : at + run] == own[p : p + run] for p in range(len(own) - run + 1) for at in range(len(other) - run + 1)):
                rows.add((doc, item))
        out |= rows | {(d, item) for d, places in covered.items() if len(places) >= cover * (len(own) - n + 1)}
    return out


CLASH = ("item_id", "windows", "at", "place", "hits", "way", "w0", "words", "version")


def found(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "window", "words", "template")})
    rows = tp.found(d, b).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id) for r in rows}


def test_found_equals_brute_force(spark):
    docs = [(i, t[:400] if t else t) for i, t in DOCS if i != 11]
    assert found(spark, docs, BENCH) == brute_found(spark, docs, BENCH)
    rnd = random.Random(3)
    words = ["alpha", "beta", "Gamma", "7", "12 km", "delta,", "omega.", "kappa", "Sigma", "mu"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bench = [(i, text(rnd.randrange(3, 24))) for i in range(20)]
    docs = [(i, text(rnd.randrange(2, 30)) + " " + bench[i % 20][1].replace("7", str(i)) + " " + text(4)) for i in range(40)]
    assert found(spark, docs, bench) == brute_found(spark, docs, bench)
    assert found(spark, [], bench) == set() and found(spark, docs, []) == set() and found(spark, [], []) == set()


def test_lists_of_numbers_are_no_templates(spark):
    item = "Sum these: 3 8 15 22 31 40 57 66 71 80 92 105 118 127 144"
    docs = [(1, "Winners of the years 2001 2002 2003 2004 2005 2006 2007 2008 2009 2010 2011 2012 2013 2014 2015 2016"),
            (2, "Lottery draw: 5 9 12 40 41 42 45 47 48 49 50 51 52 53 54"), (3, "so " + item.lower() + " now")]
    assert found(spark, docs, [(1, item)]) == {(3, 1)}


def test_numbers_of_any_length_are_one_word(spark):
    number = ".".join("1" * 120)
    df = spark.createDataFrame([(f"Version {number} of it has 3 parts",)], "t string")
    v, t = df.select(tp.values(F.col("t")), tp.template(F.col("t"))).first()
    assert len(v) == len(t) == 7 and v[1] == f"{tp.MARK}n{number}" and t[1] == f"{tp.MARK}n"
