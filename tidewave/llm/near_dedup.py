"""MinHash near-duplicate detection with SetSketch registers (operator 4).

1. Every text becomes its set of word shingles and m SetSketch registers: the minimum over the
   set of an exponentially distributed hash per register, stored as the truncated logarithm to
   the base b. Registers of a union are the maxima of the registers, so sketches merge.
2. Documents with the same sequence of words are one class with one sketch (classes of any size
   cost one row from here on).
3. Bands of registers are hashed; classes that share a band value are candidates, found by a
   star per band value and connected components: no pairs are written.
4. The members of a candidate unit of one block are compared in one task: each pair's Jaccard similarity is
   estimated jointly by likelihood from the registers and the two set sizes, and what the estimate leaves
   is confirmed on the full sets. It returns only the links that join something, at most one less than its members.
5. Of a larger unit each member is first compared with the leads of its stars, in blocks. What these links
   join is a cluster; clusters of a block or more get blocks of their own, smaller ones share blocks. Every
   pair of blocks, but those within one cluster, is one task that compares members of different clusters. So a
   unit of n near copies costs n / BLOCK tasks and each text is copied once for each lead; only a unit
   whose members are no near-duplicates costs (n / BLOCK)^2 / 2 tasks.
6. Components of the confirmed links are the result.

A block has about BLOCK documents and BLOCK_SHINGLES shingles, or one document.

The chance that a pair of the least similarity shares no band is (1 - s^rows)^bands: 5e-6 for the
defaults at s = 0.8. The likelihood filter keeps a pair unless its estimate is six standard
deviations below s.

Nulls and empty texts have no shingles and link with nothing: their own component, kept. Rows
with a null doc_id take part in no class and return a null component. Rows that repeat a doc_id are one document,
and the near-duplicates of any of its texts are in one component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm import _text
from tidewave.llm._spark import components, cut, drop_unused, map_texts

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BLOCK, BLOCK_SHINGLES = 128, 1 << 19


def _multipliers(m: int) -> np.ndarray:
    return _text.mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def registers(shingles: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    factors = _multipliers(m)[:, None]
    least = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (factors * shingles[None, i : i + 512]).min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(more, less, same, u, v, j):
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))


def _counts(one: np.ndarray, many: np.ndarray):
    more, less = (one > many).sum(axis=1), (one < many).sum(axis=1)
    return more, less, one.shape[-1] - more - less


def estimate(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of one sketch with many, the set sizes being known."""
    more, less, same = _counts(one, many)
    u, v = size / (size + sizes), sizes / (size + sizes)
    lo, hi = np.zeros(len(sizes)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = _log_likelihood(more, less, same, u, v, a) > _log_likelihood(more, less, same, u, v, b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


def likely(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray, least: float) -> np.ndarray:
    """Whether the maximum-likelihood estimate is `least` or more: whether the likelihood still rises there."""
    more, less, same = _counts(one, many)
    u, v = size / (size + sizes), sizes / (size + sizes)
    return _log_likelihood(more, less, same, u, v, least + 1e-4) >= _log_likelihood(more, less, same, u, v, least - 1e-4)


def _sign(k: int, m: int):
    def run(batches):
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for _, words in _text.texts_in(batch.column("text")):
                if len(words):
                    found = _text.shingles(words, k)
                    keys.append(_text.sequence_key(words))
                    sizes.append(len(found))
                    sketches.append(registers(found, m).tobytes())
                else:
                    keys.append(None)
                    sizes.append(0)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("same"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "same", "key", "n_shingles", "registers"],
            )

    return run


def _links(rows: list, k: int, percent: int, m: int, stars: bool) -> list[tuple[int, int]]:
    """The links that join something among rows (doc_id, text, registers, n_shingles, side, cluster), in the order found.

    Rows of one cluster are joined from the start. With two sides, only rows of different sides are compared. stars: every
    row is compared with the first alone.
    """
    tokens = [w for _, w in _text.texts_in(pa.array([r[1] for r in rows], pa.large_string()))]
    sets: list[np.ndarray | None] = [None] * len(rows)

    def of(i: int) -> np.ndarray:
        if sets[i] is None:
            sets[i] = _text.shingles(tokens[i], k)
        return sets[i]

    def shared(i: int, j: int) -> int:
        a, b = sorted((of(i), of(j)), key=len)
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum())

    sizes = np.asarray([r[3] for r in rows], dtype=np.float64)
    sketches = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u2").reshape(len(rows), m)
    side = np.asarray([r[4] for r in rows])
    two = bool((side != side[0]).any())
    first: dict = {}
    root = [i if r[5] is None else first.setdefault(r[5], i) for i, r in enumerate(rows)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    share = percent / 100
    least = share - 6 * math.sqrt(share * (1 - share) / m)
    found = []
    for i in range(1 if stars else len(rows) - 1):
        near = np.arange(i + 1, len(rows))
        if two:
            near = near[side[near] != side[i]]
        near = near[np.minimum(sizes[near], sizes[i]) * 100 >= percent * np.maximum(sizes[near], sizes[i])]
        if not len(near):
            continue
        near = near[likely(sketches[i], sketches[near], sizes[i], sizes[near], least)]
        for j in near.tolist():
            if find(i) == find(j):
                continue
            both = shared(i, j)
            if 100 * both >= percent * (len(of(i)) + len(of(j)) - both):
                root[find(j)] = find(i)
                found.append((rows[i][0], rows[j][0]))
    return found


def _confirm(k: int, percent: int, m: int, stars: bool = False):
    """Over a partition sorted by task (unit, i, j): one task's rows at a time are in memory."""

    def run(batches):
        task, rows = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "i", "j", "doc_id", "text", "registers", "n_shingles", "block", "cluster")]
            for *own, doc_id, text, sketch, size, block, cluster in zip(*columns, strict=True):
                if own != task:
                    if len(rows) > 1 and (found := _links(rows, k, percent, m, stars)):
                        yield out(found)
                    task, rows = own, []
                rows.append((doc_id, text, sketch, size, block, cluster))
        if len(rows) > 1 and (found := _links(rows, k, percent, m, stars)):
            yield out(found)

    return run


def _blocks(n: F.Column, shingles: F.Column) -> F.Column:
    return F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _compared(texts: DataFrame, tasks: DataFrame, run) -> DataFrame:
    """The links found by run over tasks (unit, i, j, doc_id, block, cluster, and the member's first, registers, n_shingles)."""
    rows = texts.join(tasks, ["doc_id", "same"]).select("unit", "i", "j", "first", "doc_id", "text", "registers", "n_shingles", "block", "cluster")
    dealt = rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", F.desc("first"), "doc_id")
    return map_texts(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, bands: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of shingles of
    `words` words (blank-separated, A-Z in lower case).
    """
    m = rows * bands
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("same"))
    signed = cut(map_texts(own, _sign(words, m), "doc_id long, same long, key binary, n_shingles long, registers binary"))
    classes = cut(signed.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "same", "n_shingles", "registers")).alias("x")).select("key", "x.*"))
    heads = classes.drop("key")
    width = 2 * rows
    band = heads.select("doc_id", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(registers, b * {width} + 1, {width})))")).alias("h"))
    leads = band.groupBy("h").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    stars = cut(band.join(leads, "h").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct())
    members = heads.join(components(stars).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "unit"), "doc_id")
    # cut, so that the members are shuffled to it anew and those of a very large unit can be split
    size = cut(members.groupBy("unit").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")))
    members = cut(members.join(size, "unit"))
    drop_unused(docs.sparkSession)
    texts = own.dropDuplicates(["doc_id", "same"]) if _repeats(signed) else own
    none = F.lit(None).cast("long").alias("cluster")
    zero, no = F.lit(0), F.lit(False).alias("first")
    few = members.where("blocks = 1").select("*", zero.alias("i"), zero.alias("j"), zero.alias("block"), none, no)
    links = cut(_compared(texts, few, _confirm(words, percent, m)))
    drop_unused(docs.sparkSession)
    many = members.where("blocks > 1")
    if not many.isEmpty():
        links = cut(links.unionByName(_large(texts, many, stars, lambda stars: _confirm(words, percent, m, stars))))
    drop_unused(docs.sparkSession)
    merged = components(links)
    named = classes.join(merged.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", F.coalesce("component", "doc_id").alias("component"))
    alone = "key is null or doc_id is null"
    result = (
        signed.where(f"not ({alone})")
        .join(named, "key")
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"))
        .unionByName(signed.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _repeats(signed: DataFrame) -> bool:
    """Whether rows repeat a document: then one of each is compared."""
    return not signed.groupBy("doc_id", "same").count().where("count > 1 and doc_id is not null").limit(1).isEmpty()


def _large(texts: DataFrame, members: DataFrame, stars: DataFrame, confirm) -> DataFrame:
    """The links within units of several blocks: those to the leads, then those between the clusters that these make."""
    one = members.drop("blocks")
    none, zero = F.lit(None).cast("long").alias("cluster"), F.lit(0).alias("block")
    spokes = stars.join(one.withColumnRenamed("doc_id", "a"), "a").withColumnRenamed("a", "doc_id")
    hubs = spokes.groupBy("b").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("parts"))
    # a lead's spokes are dealt to tasks (lead, part, 0); the lead itself is in each and comes first
    part = spokes.join(hubs, "b").select(F.col("b").alias("unit"), F.expr("pmod(xxhash64(doc_id), parts)").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(False).alias("first"), zero, none, "doc_id", "same", "registers", "n_shingles")
    lead = one.join(hubs.withColumnRenamed("b", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("unit"), F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("first"), zero, none, "doc_id", "same", "registers", "n_shingles"
    )
    near = cut(_compared(texts, part.unionByName(lead), confirm(True)))
    drop_unused(texts.sparkSession)
    clusters = components(near).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "cluster")
    own = cut(one.join(clusters, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id")))
    sizes = own.groupBy("unit", "cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), _blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    alone = sizes.groupBy("unit").agg(F.count("*").alias("clusters")).where("clusters > 1")
    sizes = cut(sizes.join(alone, "unit"))  # units of one cluster are done
    # clusters of several blocks keep them apart; the others share blocks. (cluster, part) names a block; shared ones have no cluster
    large = "blocks > 1"
    shared = sizes.where(f"not ({large})").groupBy("unit").agg(_blocks(F.sum("n"), F.sum("shingles")).alias("parts"))
    apart = own.join(sizes.where(large).select("cluster", "blocks"), "cluster").withColumn("part", F.expr("pmod(xxhash64(doc_id), blocks)")).withColumn("apart", F.lit(True)).drop("blocks")
    mixed = own.join(sizes.where(f"not ({large})").select("cluster", "unit"), ["cluster", "unit"]).join(shared, "unit").withColumn("part", F.expr("pmod(xxhash64(cluster), parts)")).withColumn("apart", F.lit(False)).drop("parts")
    drop_unused(texts.sparkSession)
    placed = cut(apart.unionByName(mixed).withColumn("block", F.xxhash64("apart", F.when(F.col("apart"), F.col("cluster")), "part")))
    block = placed.groupBy("unit", "block").agg(F.max(F.when(F.col("apart"), F.col("cluster"))).alias("whole")).alias("p")
    other = block.alias("q")
    pairs = block.join(other, F.col("p.unit") == F.col("q.unit")).where("not (p.whole <=> q.whole) or p.whole is null").select("p.unit", "p.block", F.col("q.block").alias("with"))
    tasks = placed.join(pairs, ["unit", "block"]).select(
        "unit", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.lit(False).alias("first"), "block", "cluster", "doc_id", "same", "registers", "n_shingles"
    )
    return near.unionByName(_compared(texts, tasks, confirm(False)))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs of which one stays for each component, all columns.

    Of rows that repeat a doc_id one stays: that of the smallest hash of its text, then by the other columns. Rows with a
    null doc_id belong to no group and stay.
    """
    result = cut(near_duplicates(docs, **how).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    drop_unused(docs.sparkSession)
    once = docs.join(result.where("kept and n = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    out = once.unionByName(docs.where("doc_id is null"))
    several = result.where("kept and n > 1").select("doc_id")
    if several.isEmpty():
        return out
    row = F.struct(*docs.columns)
    order = F.struct(F.xxhash64("text"), *(F.col(f.name).cast("string") for f in docs.schema if f.name not in ("doc_id", "text")))
    repeated = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("_row"))
    return out.unionByName(repeated.select("_row.*"))
