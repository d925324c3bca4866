"""Line deduplication by pairwise alignment (operator 6).

1. Lines are hashed (trimmed, in lower case). A line is sought if it has at least `words` words or `chars`
   characters: such lines are rare by themselves. One that stands in very many documents is sought like any
   other, since a line costs at most two pairs for each document that holds it, however many those are.
2. Overlapping documents are found through shared line hashes: each document is paired with the
   earliest document (smallest id) of every such line in it, and with the earliest one that holds the line
   once. No two later documents are paired with each other for it.
3. Each pair is aligned with patience diff: lines that are unique in both and in the same order in both
   (a longest increasing run) are anchors, and equal neighbours extend them to blocks. Unique lines that
   this leaves stand in another order: they are anchors of moved blocks. Sought lines that are left are
   repeated in one of the two texts: each of their places is a block of its own.
4. Aligned blocks that hold a sought line are deleted from the later document.

So a sought line goes from every document but the earliest that holds it, whatever its order and number;
shorter lines go only beside one. The first occurrence of a line is never deleted (a document's own repeats
stay), and a document of which all lines go becomes an empty text.
Texts that are null or empty stay as they are; rows with a null doc_id are not compared; of rows that repeat a
doc_id, none is earlier, so they are not compared with each other, and each is aligned as its own;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._spark import cut, map_texts


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines: unique common anchors in order, extended by equal neighbours."""
    once_a, once_b = Counter(a), {x: j for j, x in enumerate(b)}
    many_b = Counter(b)
    pairs = [(i, once_b[x]) for i, x in enumerate(a) if once_a[x] == 1 and many_b.get(x) == 1]
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[at], ends[at] = j, n
    chain = []
    n = ends[-1] if ends else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    chain.reverse()
    out: list[tuple[int, int]] = []
    for c, (i, j) in enumerate(chain):
        up = chain[c + 1] if c + 1 < len(chain) else (len(a), len(b))
        low = out[-1] if out else (-1, -1)
        back = []
        x, y = i - 1, j - 1
        while x > low[0] and y > low[1] and a[x] == b[y]:
            back.append((x, y))
            x, y = x - 1, y - 1
        out += reversed(back)
        out.append((i, j))
        x, y = i + 1, j + 1
        while x < up[0] and y < up[1] and a[x] == b[y]:
            out.append((x, y))
            x, y = x + 1, y + 1
    return out


def moved(a: list[int], b: list[int], pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Blocks of the unique common lines that are not in pairs, extended by equal neighbours that are not either."""
    many_a, many_b, at = Counter(a), Counter(b), {x: i for i, x in enumerate(a)}
    used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
    out = []
    for j, x in enumerate(b):
        i = at.get(x, -1)
        if j in used_b or i in used_a or many_a[x] != 1 or many_b[x] != 1:
            continue
        ends = []
        for step in (-1, 1):
            n = step
            while 0 <= i + n < len(a) and 0 <= j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                n += step
            ends.append(n)
        block = [(i + n, j + n) for n in range(ends[0] + 1, ends[1])]
        used_a.update(i for i, _ in block)
        used_b.update(j for _, j in block)
        out.append(block)
    return out


def repeated(late: list[int], early: list[int], seeds: set[int], used: set[int]) -> list[int]:
    """Places in late, not in used, of sought lines that early holds too."""
    there = seeds.intersection(early)
    return [j for j, x in enumerate(late) if x in there and j not in used]


def blocks(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of neighbours on both sides."""
    out: list[list[tuple[int, int]]] = []
    for i, j in pairs:
        if out and out[-1][-1] == (i - 1, j - 1):
            out[-1].append((i, j))
        else:
            out.append([(i, j)])
    return out


def _align(batches):
    for batch in batches:
        ids, places = [], []
        for doc_id, key, early, late, rare in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "early", "late", "rare")), strict=True):
            seeds = set(rare)
            pairs = patience(early, late)
            aligned = [[j for _, j in block] for block in blocks(pairs) + moved(early, late, pairs)]
            gone = {j for block in aligned if any(late[j] in seeds for j in block) for j in block}
            gone.update(repeated(late, early, seeds, gone))
            ids += [(doc_id, key)] * len(gone)
            places += sorted(gone)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(places, pa.int32())], names=["doc_id", "key", "place"]
        )


def deduplicate(docs: DataFrame, words: int = 5, chars: int = 40) -> DataFrame:
    """doc_id, text without the deleted lines, n_lines, n_deleted for each row of docs (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("text"))
    hashed = own.where("doc_id is not null and length(text) > 0").select(
        "doc_id",
        "key",
        F.expr("transform(split(text, '\\n', -1), l -> xxhash64(lower(trim(l))))").alias("lines"),
        F.expr(f"transform(split(text, '\\n', -1), l -> length(trim(l)) - length(replace(trim(l), ' ', '')) + 1 >= {words} and length(trim(l)) > 0 or length(trim(l)) >= {chars})").alias("long"),
    )
    hashed = cut(hashed)
    ordered = hashed.select("doc_id", "key", F.expr("array_sort(filter(transform(lines, (x, i) -> if(long[i], x, null)), x -> x is not null))").alias("own"))
    once = "transform(own, (x, i) -> if(get(own, i - 1) <=> x, null, struct(x as h, not (get(own, i + 1) <=> x) as once)))"
    line = ordered.select("doc_id", "key", F.inline(F.expr(f"filter({once}, x -> x is not null)")))
    holder = F.struct("doc_id", "key")
    first = line.groupBy("h").agg(F.min(holder).alias("any"), F.min(F.when(F.col("once"), holder)).alias("single"), F.count("*").alias("n"))
    # cut, so that the lines are shuffled to it anew and a very common line's rows can be split
    first = cut(first.where("n > 1").select("h", F.array_distinct(F.array_compact(F.array("any", "single"))).alias("holders")))
    pairs = line.join(first, "h").select("doc_id", "key", "h", F.explode("holders").alias("x")).where("x.doc_id < doc_id")
    pairs = pairs.groupBy("doc_id", "key", F.col("x.doc_id").alias("first"), F.col("x.key").alias("first_key")).agg(F.collect_list("h").alias("rare"))
    texts = hashed.select("doc_id", "key", "lines").dropDuplicates(["doc_id", "key"])
    one = texts.select(F.col("doc_id").alias("first"), F.col("key").alias("first_key"), F.col("lines").alias("early"))
    both = pairs.join(texts.withColumnRenamed("lines", "late"), ["doc_id", "key"]).join(one, ["first", "first_key"])
    deleted = map_texts(both.select("doc_id", "key", "early", "late", "rare"), _align, "doc_id long, key long, place int")
    deleted = deleted.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    out = own.join(deleted, ["doc_id", "key"], "left")
    # the places that stay are a difference of sets, so the work is in proportion to the lines
    kept = "transform(array_except(sequence(0, size(w) - 1), places), i -> element_at(w, i + 1))"
    rest = F.expr(f"element_at(transform(array(split(text, '\\n', -1)), w -> array_join({kept}, '\\n')), 1)")
    return out.select(
        "doc_id",
        F.when(F.col("places").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.expr("split(text, '\\n', -1)"))).alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).alias("n_deleted"),
    ).withColumn("n_deleted", F.greatest("n_deleted", F.lit(0)))
