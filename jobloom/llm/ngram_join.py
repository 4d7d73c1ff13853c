"""Documents whose word n-grams are alike: MinHash bands, verified on whole n-gram sets."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.components import components
from jobloom.llm.spread import join_per_key, small
from jobloom.session import written

WORDS = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that some band must bring together.
RECALL = 0.99999
#: Hash functions that bands and rows may use in all.
MOST_HASHES = 160
#: Members and n-grams in a block; larger buckets are compared block by block.
MOST_MEMBERS, MOST_NGRAMS = 1 << 10, 1 << 18
#: Words of the texts that a worker takes at once.
MOST_WORDS = 1 << 19

SKETCH = "doc_id long, digest binary, n long, bands array<bigint>"


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows per band, and the bands then needed for ``recall``, within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, 33):
        miss = 1 - threshold**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words (letters, digits, underscores) of a whole text."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, words) in slices that end with the first text to reach MOST_WORDS."""
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy()
        start = 0
        for i in range(1, len(ends)):
            if i == len(ends) - 1 or ends[i] - ends[start] >= MOST_WORDS:
                yield batch.slice(start, i - start)
                start = i


def ngram_sets(words: pa.ListArray, size: int) -> list[np.ndarray]:
    """The distinct n-grams of each row, sorted. Fewer than ``size`` words are one n-gram."""
    offsets = words.offsets.to_numpy()
    flat = words.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    step = np.uint64(0x9E3779B97F4A7C15)
    runs = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        runs = runs * step + flat[k : k + len(runs)]
    runs = mixed(runs)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for w in flat[a:b]:
                one = one * step + w
            out.append(mixed(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.lru_cache(maxsize=4)
def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    numbers = rng.integers(0, 1 << 63, (2, count), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return numbers[0], numbers[1]


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """MinHash signatures of non-empty sets, hashed band by band."""
    mult, add = hash_functions(bands * rows)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    flat = np.concatenate(sets)
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat(flat * mult[k] + add[k], starts)
        out[:, k // rows] = mixed(out[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(k))
    return out.view(np.int64)


def digest_of(ngrams: bytes) -> bytes:
    return hashlib.blake2b(ngrams, digest_size=16).digest()


def node_of(doc_id: str, digest: str) -> Column:
    """24 bytes that stand for an n-gram set and sort by its smallest doc_id, then by its digest."""
    high = F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # unsigned order is that of the ids
    return F.concat(F.unhex(high), F.col(digest))


def doc_of(node: Column) -> Column:
    """The doc_id of a node."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, n, bands) per row: the n-gram set's digest and size, and its band hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ngram_sets(batch.column(1), words)
            digests = [digest_of(s.tobytes()) for s in sets]
            found: list[list[int] | None] = [None] * len(sets)
            part: list[int] = []
            size = 0
            for i in range(len(sets) + 1):
                if part and (i == len(sets) or size >= 1 << 16):  # of a size that a cache holds
                    for j, row in zip(part, band_hashes([sets[j] for j in part], bands, rows).tolist(), strict=True):
                        found[j] = row
                    part, size = [], 0
                if i < len(sets) and len(sets[i]):
                    part.append(i)
                    size += len(sets[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "bands"])

    rows_in = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("words"))
    return rows_in.mapInArrow(sketch, SKETCH)


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, parts, node, members): the members of the buckets that have to be looked at.

    A bucket is a band with one value. Buckets of one member have no pairs. Of buckets with
    the same members only the one of the first band stays: a pair counts in the first band that
    brings it together, and that band is the same for all of them. ``parts`` is the number of
    blocks that a bucket takes.
    """
    held = classes.select("node", "n", "members", F.posexplode("bands").alias("band", "value"))
    held = held.select("node", "n", "members", "band", F.xxhash64("band", "value").alias("bucket"))
    counted = held.groupBy("bucket", "band").agg(
        F.count("*").alias("size"), F.sum("n").alias("ngrams"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    first = counted.filter("size > 1").groupBy("x", "y", "size", "ngrams").agg(F.min(F.struct("band", "bucket")).alias("b"))
    parts = F.greatest(F.ceil(F.col("size") / MOST_MEMBERS), F.ceil(F.col("ngrams") / MOST_NGRAMS)).cast("int")
    live, few = small(first.select("b.bucket", parts.alias("parts")), "live-buckets", 24)
    held = held.drop("n")
    return held.join(live, "bucket") if few else join_per_key(held, "bucket", ["node"], live, "inner")


def cores(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, members, home): the core that a member of a bucket of several blocks belongs to.

    Such a bucket has a pivot, the member with the most copies, of these the smallest. By the n-grams
    of the pivot that x lacks, and those of x, a pair shares at least ``|pivot| - lacks_x - lacks_y``
    n-grams, and is linked if that is t / (1 + t) of ``n_x + n_y``. All members whose half of this
    holds are linked to each other and need no comparison: they are the pivot's core, whatever
    bucket they share with it. A member in several cores belongs to that of the first pivot, so
    buckets of one group mostly have one core.
    """
    order = F.struct((-F.col("members")).alias("rank"), F.col("node").alias("pivot"))
    large = members.filter("parts > 1").select("bucket", "node", "members")
    pivots = large.groupBy("bucket").agg(F.min(order).alias("first")).select("bucket", "first.*")
    pivots = pivots.join(sets.select(F.col("node").alias("pivot"), F.col("ngrams").alias("center")), "pivot")
    rows = join_per_key(large.join(sets.select("node", "ngrams"), "node"), "bucket", ["node"], pivots, "inner")
    share = threshold / (1 + threshold)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for own, center in zip(batch.column(4), batch.column(5), strict=True):
                x, p = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(center.as_py(), np.uint64)
                lacks = len(p) - len(np.intersect1d(x, p, assume_unique=True))
                kept.append(2 * (lacks + share * len(x)) <= len(p) - 1e-6)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(kept, pa.bool_()))

    found = rows.select("node", "members", "rank", "pivot", "ngrams", "center").mapInArrow(near, "node binary, members long, rank long, pivot binary")
    return found.groupBy("node", "members").agg(F.min(F.struct("rank", "pivot")).alias("first")).select(
        "node", "members", F.col("first.pivot").alias("home"))


def core_links(homes: DataFrame) -> DataFrame:
    """(node, hub, links) of the members of cores: all others of the core, and its smallest node."""
    per_home = homes.groupBy("home").agg(F.sum("members").alias("all"), F.min("node").alias("hub"))
    rows = join_per_key(homes, "home", ["node"], per_home, "inner")
    return rows.select("node", "hub", (F.col("all") - F.col("members")).alias("links")).filter("links > 0")


#: ``core`` is a member's core, empty for none, and ``home`` that of its block.
ROWS = "bucket long, home binary, part int, parts int, band int, node binary, members long, bands array<bigint>, core binary, ngrams binary"
LINKS = "node binary, hub binary, links long"
PACKED = f"{LINKS}, bucket long, home binary, part int, packed binary"


class Group:
    """Members of one block, or of two, compared in whole."""

    def __init__(self, blocks: list[pa.Table], threshold: float):
        rows = pa.concat_tables(blocks)
        column = {c: rows.column(c).combine_chunks() for c in ("node", "members", "bands", "core", "ngrams", "band")}
        self.threshold, self.two = threshold, len(blocks) == 2
        self.band = column["band"][0].as_py()
        nodes = [n.as_py() for n in column["node"]]
        self.names = sorted(set(nodes))
        place = {n: i for i, n in enumerate(self.names)}
        self.node = np.array([place[n] for n in nodes], np.int64)  # by order
        self.own = np.repeat(np.arange(len(blocks)), [b.num_rows for b in blocks])
        self.members = column["members"].to_numpy()
        none = -1 - np.arange(rows.num_rows)  # differ from all
        core = column["core"].dictionary_encode()
        self.core = np.where([len(x.as_py()) == 0 for x in column["core"]], none, core.indices.to_numpy())
        self.bands = np.array(column["bands"].to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in column["ngrams"]]
        self.n = np.array([len(s) for s in sets])
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]

    def links(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, js): the members alike to member i, each pair once.

        A pair is compared in the first band they share, if it is not of one core. Members of
        two blocks are compared with those of the other only.
        """
        mark = np.zeros(self.codes.max() + 1, bool)
        at = np.arange(len(self.node))
        for i in at:
            js = (at > i) & (self.own != self.own[i]) if self.two else at > i
            js &= np.minimum(self.n, self.n[i]) >= self.threshold * np.maximum(self.n, self.n[i])
            js &= (self.node != self.node[i]) & (self.core != self.core[i])
            js[js] = ~(self.bands[js, : self.band] == self.bands[i, : self.band]).any(axis=1)
            if not js.any():
                continue
            mark[self.codes[self.starts[i] : self.starts[i + 1]]] = True
            both = np.add.reduceat(mark[self.codes], self.starts[:-1], dtype=np.int64)
            mark[:] = False
            yield i, np.flatnonzero(js & (both / (self.n + self.n[i] - both) >= self.threshold))

    def found(self) -> list[tuple[bytes, bytes, int]]:
        """(node, hub, links): a node's linked documents here, and the smallest node it is connected to."""
        count = np.zeros(len(self.node), np.int64)
        root = list(range(len(self.node)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, js in self.links():
            for j in js.tolist():
                count[i] += self.members[j]
                count[j] += self.members[i]
                a, b = top(i), top(j)
                if a != b:
                    a, b = (a, b) if self.node[a] < self.node[b] else (b, a)
                    root[b] = a
        return [(self.names[self.node[i]], self.names[self.node[top(i)]], int(count[i])) for i in range(len(root)) if count[i]]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows that agree in ``keys``, over the bounds of batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, now = [], i, value
        if len(values) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def link_arrays(found: list[tuple[bytes, bytes, int]]) -> list[pa.Array]:
    return [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]


def blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """PACKED rows of ROWS: links of the buckets of one block, and the blocks of larger ones, a row each.

    A block has the members of one core, or of none, that hash to its part. So a member's n-gram
    set moves once per bucket.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "home", "part"]):
            if group.column("parts")[0].as_py() == 1:
                links = link_arrays(Group([group], threshold).found())
                rest = [pa.nulls(len(links[0]), t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.binary())]
            else:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, group.schema) as out:
                    out.write_table(group)
                links = [pa.nulls(1, t) for t in (pa.binary(), pa.binary(), pa.int64())]
                rest = [group.column(c).combine_chunks()[:1] for c in ("bucket", "home", "part")] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*links, *rest], [c.split()[0] for c in PACKED.split(", ")])

    names = [c.split()[0] for c in ROWS.split(", ")]
    keys = ["bucket", "home", "part"]
    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(verify, PACKED)


def block_pairs(packed: DataFrame) -> DataFrame:
    """(bucket, low, high, own, packed): each block once for each block of its bucket that it has to meet.

    Two blocks of one core need not meet, so a bucket that is one core has no pairs.
    """
    own = packed.select("bucket", "packed", F.struct("home", "part").alias("block"))
    of_bucket = own.groupBy("bucket").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    rows = own.join(of_bucket, "bucket").withColumn("own", (F.array_position("blocks", F.col("block")) - 1).cast("int"))
    others = F.filter(
        F.sequence(F.lit(0), F.size("blocks") - 1),
        lambda j: (F.length("block.home") == 0) | (F.get("blocks", j)["home"] != F.col("block.home")))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "packed")


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """LINKS between the members of two blocks, or within one."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket", "low", "high"]):
            held = [pa.ipc.open_stream(x.as_py()).read_all() for x in group.column("packed")]
            yield pa.RecordBatch.from_arrays(link_arrays(Group(held, threshold).found()), ["node", "hub", "links"])

    keys = ["bucket", "low", "high"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys, "own").mapInArrow(verify, LINKS)


def links_of(members: DataFrame, sets: DataFrame, homes: DataFrame | None, threshold: float) -> DataFrame:
    """LINKS of all pairs that a bucket brings together, stored; each pair once.

    ``members`` is the output of ``buckets``, ``sets`` has node, bands and ngrams, ``homes`` is the
    output of ``cores``, None if no bucket takes several blocks.
    """
    rows = members.join(sets, "node")
    if homes is not None:
        rows = rows.join(homes.select("node", "home"), "node", "left")
    else:
        rows = rows.withColumn("home", F.lit(b""))
    several = F.col("parts") > 1
    core = F.coalesce("home", F.lit(b""))
    part = F.when(several, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0)
    rows = rows.select(
        "bucket", F.when(several, core).otherwise(F.lit(b"")).alias("home"), part.alias("part"), "parts", "band", "node", "members", "bands",
        core.alias("core"), "ngrams")
    done = written(blocks(rows, threshold), "blocks")
    found = done.filter("node IS NOT NULL").select("node", "hub", "links")
    if homes is not None:
        across = written(verified(block_pairs(done.filter("packed IS NOT NULL")), threshold), "block-links")
        found = found.unionByName(across).unionByName(core_links(homes))
    return found


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, ngrams): the whole sorted n-gram sets of these ``nodes``, and of other texts of their ids.

    Sets are made unique by node, so a join by node needs no other shuffle of them.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.tobytes() for s in ngram_sets(batch.column(1), words)]
            digests = [digest_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "ngrams"])

    ids, _ = small(nodes.select(doc_of(F.col("node")).alias("doc_id")).distinct(), "candidate-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    built = texts.select("doc_id", word_hashes(F.col("text")).alias("words")).mapInArrow(build, "doc_id long, digest binary, ngrams binary")
    return built.select(node_of("doc_id", "digest").alias("node"), "ngrams").dropDuplicates(["node"])


def similar(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of, n_ngrams) for every row of ``docs`` with a doc_id.

    Two documents are linked if the Jaccard similarity of their word n-gram sets is
    ``threshold`` or more. ``class_id`` is the smallest doc_id that a document is connected to
    by links, its own if it has none; ``n_links`` counts the other rows it is linked to;
    ``copy_of`` is the smallest doc_id with the same n-gram set. Texts of equal sets are
    compared once, and their links counted for all of them.

    A null or empty text, or one without words, has no n-grams and no links. Fewer words than
    ``words`` are one n-gram. Rows without a doc_id are left out, and so are other columns.
    Repeated rows count as copies. Texts that share a doc_id are compared and linked like others.
    """
    bands, rows = bands_and_rows(threshold, recall)
    drawn = written(sketches(docs, words, bands, rows), "sketches")
    classes = drawn.groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", node_of("low", "digest")), "classes")
    compared = classes.filter("n > 0").select("node", "members", "n", "bands")
    members = written(buckets(compared), "bucket-members")
    nodes, _ = small(members.select("node").distinct(), "candidates", 32)
    info = compared.select("node", "bands").join(nodes, "node", "left_semi").join(sets_of(docs, nodes, words), "node")
    homes = None
    several = members.filter("parts > 1")
    if not several.isEmpty():
        # only the sets of their members are built for the cores, so that the others move once
        of_several, _ = small(several.select("node").distinct(), "members-of-several", 32)
        own = sets_of(docs, of_several, words).join(of_several, "node", "left_semi")
        homes = written(cores(members, written(own, "sets-of-several"), threshold), "cores")
    found = written(links_of(members, info, homes, threshold), "links")
    labels = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.select("digest", "node", "members", "n").join(labels, "node", "left").join(links, "node", "left").select(
        "digest", "n", doc_of(F.col("node")).alias("copy_of"), doc_of(F.coalesce("label", "node")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    out = join_per_key(drawn.select("doc_id", "digest"), "digest", ["doc_id"], per_class, "inner")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.col("n").alias("n_ngrams"))
