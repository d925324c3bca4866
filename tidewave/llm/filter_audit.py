"""Filter interaction audit (operator 11): what every subset of filters would keep, and what every order of them removes.

Each document gets one bit for each filter that it fails. Documents are counted by part and bits; a subset-zeta
transform turns these 2^k counts into, for every set of bits, the documents whose failures lie within it, which are
the survivors of all other filters. Survivors of any filter subset, and so every step of every order, are then one look-up:
a step removes the survivors of the filters before it less those of the filters up to it. The same holds for labelled documents.

The filters are column rules on the text, and `copy`: the text is identical to that of a smaller doc_id, wherever that is.
Copies have equal failures of the column rules, so they are counted by a 256-bit hash of the text and never listed.

Null texts are empty ones; a null part is the empty string. Rows that repeat a doc_id are each counted; none of them is a
copy of another of the same id. A null doc_id is above all others and has no label; rows without ids are not compared
with each other. A document whose label rows disagree has a label if any row gives it. Other columns are ignored; an
empty table gives no row.

Only DataFrame functions: documents are shuffled as (id, hash, bits), never with their text.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
#: The counted measures: all documents, those labelled good, those labelled toxic.
MEASURES = ("n", "good", "toxic")
#: Rows without an id are spread over so many keys where ids meet their labels.
SPREAD = 1024


def rules(text: str = "text") -> dict[str, Column]:
    """Whether a text fails: too few words, too repetitive, too many capitals, symbols of markup or tables."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, BLANKS), "")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, failing: Mapping[str, Column], copy: str | None = "E", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, bit i for the i-th rule and the next for `copy`."""
    t = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failing.values())), F.lit(0))
    own = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).cast("string").alias("part"), F.sha2(t, 256).alias("key"), bits.alias("mask"))
    own = own.withColumn("_spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SPREAD))).otherwise(F.lit(0)))
    own = own.groupBy("doc_id", "_spread", "part", "key", "mask").agg(F.count("*").alias("c"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = own.join(marked.withColumn("_spread", F.lit(0).cast("long")), ["doc_id", "_spread"], "left").na.fill(0, ["good", "toxic"])
    lead = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c")))
    by = met.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("c").alias("c"), lead.alias("lead"))
    if copy is not None:
        first = F.min("lead.doc_id").over(Window.partitionBy("key"))  # a few rows for each text: its parts and labels
        fresh = F.when(first.isNull(), F.col("c")).when(F.col("lead.doc_id") == first, F.col("lead.c")).otherwise(F.lit(0))
        halves = F.array(F.struct(F.col("mask"), F.col("fresh").alias("c")), F.struct((F.col("mask") + (1 << len(failing))).alias("mask"), (F.col("c") - F.col("fresh")).alias("c")))
        by = by.withColumn("fresh", fresh).select("part", "good", "toxic", F.inline(halves)).where("c > 0")
    return by.groupBy("part", "mask").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("good")).alias("good"), F.sum(F.col("c") * F.col("toxic")).alias("toxic"))


def zeta(counts: Column, k: int) -> Column:
    """For every set of k bits, the sum of an array of 2^k counts over all sets within it."""

    def along(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.get(sums, m - bit)).otherwise(0))

    return F.aggregate(F.lit([1 << b for b in range(k)]), counts, along)


def survivors(counted: DataFrame, k: int) -> DataFrame:
    """(part, n, good, toxic): arrays of 2^k numbers, at place s the documents that pass all filters of the set s."""
    cells = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("cell"))  # 2^k at most
    full = (1 << k) - 1

    def passing(measure: str) -> Column:
        dense = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at("cell", m)[measure], F.lit(0).cast("long")))
        return F.reverse(zeta(dense, k)).alias(measure)  # the sets within the complement of s

    return cells.select("part", *map(passing, MEASURES))


def orders(passed: DataFrame, filters: str) -> DataFrame:
    """One row for each part, order of the filters and step, with what the step keeps and removes.

    redundant: documents that fail the step's filter but had gone before; unique_fails: that fail it alone; shapley: what the
    filter removes, summed over all orders.
    """
    full = (1 << len(filters)) - 1
    set_of = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    every = F.lit(["".join(p) for p in permutations(filters)])
    steps = passed.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    steps = steps.withColumns({"_bit": set_of(F.expr("substr(filter_order, step, 1)")), "_before": set_of(F.expr("left(filter_order, step - 1)"))})
    at = lambda measure, s: F.get(measure, s)
    before, bit = F.col("_before"), F.col("_bit")
    lost = lambda measure: at(measure, before) - at(measure, before + bit)
    out = steps.select(
        "part",
        "filter_order",
        "step",
        "_bit",
        at("n", before + bit).alias("kept"),
        lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - lost("n")).alias("redundant"),
        (at("n", F.lit(full) - bit) - at("n", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "_bit"))  # one row for each order
    return out.withColumn("shapley", total).drop("_bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over documents, by language."""
    failing = rules()
    filters = "".join(failing) + "E"
    return orders(survivors(masks(docs, labels, failing, "E"), len(filters)), filters)


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
|| CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
|| CASE WHEN coalesce(w.doc_id > first, w.doc_id IS NULL AND first IS NOT NULL) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, left(filter_order, step - 1) AS before FROM p, (SELECT unnest(generate_series(1, 5)) AS step)),
x AS (SELECT g.*, s.*, contains(fails, own) AS failing, translate(fails, before, '') <> fails AS gone FROM g, s),
r AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS BIGINT) AS removed,
CAST(sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
CAST(sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
