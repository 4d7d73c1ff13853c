"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm.spread import join_per_key, small


class Rule(NamedTuple):
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha1("\0".join(map(str, self)).encode()).hexdigest()[:16]


# Kinds in their order, and what each looks for.
RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)

LEDGER = "blob string, rule string"
FOUND = ("blob", "rule", "kind", "kind_no", "start", "end")


class Scan(NamedTuple):
    paths: DataFrame
    findings: DataFrame
    ledger: DataFrame


def address(text: Column) -> Column:
    """The content address; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text",
         ledger: DataFrame | None = None, findings: DataFrame | None = None,
         rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scans what the ledger has not seen, and returns it all.

    ``versions`` has a row for each historical version of each path; its other columns are
    left out. ``ledger`` (blob, rule) names the pairs of content address and rule version that
    earlier runs have scanned, ``findings`` what they found; both may be missing. A blob that
    many versions share is scanned once. A null text is the empty blob, which has no findings.

    Returns ``paths`` (path, blob; one row per version, repeated rows included), ``findings``
    (blob, rule, kind, kind_no, start, end; code points, end exclusive) and the ``ledger`` to
    keep for the next run, with every pair scanned so far.
    """
    spark = versions.sparkSession
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    paths = versions.select(F.col(path).alias(path), address(F.col(text)).alias("blob"))
    wanted = F.explode(F.array(*(F.lit(r.version) for r in rules))).alias("rule")
    seen = empty_ledger(spark) if ledger is None else ledger.select("blob", "rule").distinct()
    new = paths.select("blob").distinct().select("blob", wanted).join(seen, ["blob", "rule"], "left_anti")
    if ledger is not None:
        todo, few = small(new.groupBy("blob").agg(F.collect_set("rule").alias("rules")), "unseen-blobs", 256)
        one = (blobs.join(todo, "blob", "left_semi") if few else blobs).dropDuplicates(["blob"]).join(todo, "blob")
    else:
        one = blobs.dropDuplicates(["blob"]).withColumn("rules", F.array(*(F.lit(r.version) for r in rules)))
    fresh = spans(one, rules)
    if findings is not None:
        fresh = findings.select(*FOUND).unionByName(fresh)
    return Scan(paths, fresh, seen.unionByName(new))


def spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in ``blobs`` (blob, text, rules): leftmost matches of each rule, none overlapping.

    Splitting a text at a pattern gives the gaps between its matches, so running sums of the
    lengths of gaps and matches place each match. Sums run per blob and rule.
    """
    rows = blobs.select("blob", F.explode_outer(F.concat(*(matches(no, r) for no, r in enumerate(rules)))).alias("h"))
    rows = rows.filter("h IS NOT NULL").select("blob", "h.*")  # explode would add a filter that matches all once more
    order = Window.partitionBy("blob", "kind_no").orderBy("i")
    before = F.coalesce(F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.col("gap"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind_no") + 1)
    pick = lambda names: F.element_at(F.array(*(F.lit(n) for n in names)), F.col("kind_no") + 1)
    return rows.filter(F.col("part") >= least).select(
        "blob", pick([r.version for r in rules]).alias("rule"), pick([r.kind for r in rules]).alias("kind"),
        "kind_no", "start", (F.col("start") + F.col("len")).alias("end"),
    )


def matches(no: int, rule: Rule) -> Column:
    """The matches in order, each with the length of the gap before it; none where no match counts."""
    whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split("text", rule.pattern, -1)
    rows = F.transform(F.arrays_zip(whole.alias("whole"), part.alias("part"), gaps.alias("gap")), lambda x, i: F.struct(
        F.lit(no).alias("kind_no"), i.alias("i"), F.length(x["gap"]).alias("gap"),
        F.length(x["whole"]).alias("len"), F.length(x["part"]).alias("part")))
    found = F.array_contains("rules", F.lit(rule.version)) & F.col("text").rlike(screen(rule))
    none = F.array().cast("array<struct<kind_no:int,i:int,gap:int,len:int,part:int>>")
    return F.when(found, rows).otherwise(none)


def screen(rule: Rule) -> str:
    """A pattern found in every text that has a finding: the last repeat at its least length."""
    if rule.group:
        return rule.pattern.removesuffix("+)") + f"{{{rule.least}}})"
    head, _, last = rule.pattern.rpartition("[")
    return f"{head}[{last.removesuffix('+')}{{{rule.least - len(head)}}}"


def per_blob(findings: DataFrame) -> DataFrame:
    """(blob, spans): the sorted spans of each blob, by start and then kind."""
    span = F.struct("start", "kind_no", "end", "kind")
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def by_path(done: Scan, path: str = "doc_id") -> DataFrame:
    """(path, blob, spans): each version with its spans; null where there are none."""
    return join_per_key(done.paths, "blob", [path], per_blob(done.findings))


def redacted(docs: DataFrame, found: DataFrame, text: str = "text", mark: str = "[SECRET]",
             hashes: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span of ``found`` (blob, spans) in ``text`` replaced by ``mark``.

    Spans that touch or overlap become one mark. Other texts, null among them, stay as they
    are; so do all other columns. ``hashes`` (__has) are the distinct xxhash64 of the blobs of ``found``,
    marked for broadcast: texts that are not among them are then not shuffled.
    """
    names = docs.columns
    if hashes is not None:
        same = F.xxhash64(address(F.col(text))) == F.col("__has")
        some = redacted(docs.join(hashes, same, "left_semi"), found, text, mark)
        return docs.join(hashes, same, "left_anti").unionByName(some)
    rows = docs.withColumn("__blob", address(F.col(text)))
    per = found.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    rows = join_per_key(rows, "__blob", [names[0]], per)
    joined = F.aggregate("__spans", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)"), lambda out, s: F.when(
        (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
            F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"].cast("long")).alias("end")))),
    ).otherwise(F.concat(out, F.array(F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))))
    rows = rows.withColumn("__cut", joined)
    kept = F.transform("__cut", lambda s, i: F.substring(
        F.col(text), (F.coalesce(F.get(F.col("__cut"), i - 1)["end"], F.lit(0)) + 1).cast("int"),
        (s["start"] - F.coalesce(F.get(F.col("__cut"), i - 1)["end"], F.lit(0))).cast("int")))
    tail = F.substring(F.col(text), (F.element_at("__cut", -1)["end"] + 1).cast("int"), F.length(F.col(text)))
    clean = F.concat(F.array_join(F.concat(kept, F.array(F.lit(""))), mark), tail)
    return rows.withColumn(text, F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col(text))).select(*names)
