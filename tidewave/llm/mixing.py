"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Token counts are summed by cell (source, language, topic). Raking multiplies the cells' weights by
target / present share for one marginal after another until all hold within `tolerance` (the largest relative
gap of a category), or for `rounds` rounds at most; the gap that is left is returned, and warned of. A
document's probability is its cell's multiplier over the largest one, so every probability is at most 1 and
expected kept tokens have the target marginals; a document is kept if a uniform number from its id's md5
is below it. Copies of an id are kept or dropped together.

Targets are given for each marginal as a dict or a table of category and share; shares are scaled to 1 over the
categories that have tokens, and a category without one gets none. A marginal without targets is tempered: share ** power.

The fit runs in Spark by sums over the table of cells, whatever their number. Documents are joined with the fitted
cells by a broadcast if these are counted to be at most BROADCAST_CELLS, else by a shuffle.

Null source, language or topic make a category of their own; a null or empty text has no tokens, and a cell without
tokens keeps the multiplier 1 (or 0, if one of its categories has tokens but no target). Extra columns are kept, unless
a result's column has their name.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm._spark import cut

BROADCAST_CELLS = 100_000
POWER, TOLERANCE, ROUNDS = 0.9, 1e-10, 50
#: Rounds between two looks at the gap.
ROUNDS_EACH = 5
NONE = "(none)"
MARGINALS = ("source", "lang", "topic")


def tokens(text: str = "text") -> Column:
    """One more than the blanks and line ends of a text; 0 of none."""
    t = F.col(text)
    blank = F.length(t) - F.length(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.lit(0)).otherwise(blank + 1).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse topic of a text: legal, records or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(t.rlike("[Ll]icensed|[Cc]opyright|[Rr]ights reserved"), "legal").when(t.rlike("[0-9]{5}"), "records").otherwise("prose")


def _targets(own: DataFrame, d: str, given, power: float) -> DataFrame:
    """(d, target): the shares of the categories of own, given or tempered, with the sum 1."""
    if given is None:
        raised = own.groupBy(d).agg((F.sum("now") ** power).alias("raised"))
    else:
        if isinstance(given, dict):
            given = own.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"{d} string, raised double")
        given = given.toDF(d, "raised").select(F.col(d).cast("string").alias(d), F.col("raised").cast("double").alias("raised"))
        raised = own.select(d).distinct().join(given.groupBy(d).agg(F.sum("raised").alias("raised")), d, "left").fillna(0.0, ["raised"])
    whole = raised.agg(F.sum("raised")).first()[0]
    if not whole:
        raise ValueError(f"no category of {d} has a target")
    return raised.select(d, (F.col("raised") / whole).alias("target"))


def rake(cells: DataFrame, targets: dict | None = None, power: float = POWER, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """cells (*MARGINALS, tokens) with multiplier, and the largest relative gap to a target that is left."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("multiplier", F.lit(1.0)), 0.0
    own = cut(cells.where("tokens > 0").withColumn("now", F.col("tokens") / F.lit(float(total))).withColumn("fitted", F.col("now")))
    wanted = {d: cut(_targets(own, d, (targets or {}).get(d), power)) for d in MARGINALS}
    for d in MARGINALS:
        own = own.join(wanted[d].withColumnRenamed("target", f"target_{d}"), d)
    own, gap, done = cut(own), float("inf"), 0
    while gap > tolerance and done < rounds:
        for last in reversed(range(min(ROUNDS_EACH, rounds - done))):
            for d in MARGINALS:  # windows over cells, not documents
                have, target = F.sum("fitted").over(Window.partitionBy(d)), F.col(f"target_{d}")
                if not last:
                    own = own.withColumn(f"gap_{d}", F.when(target > 0, F.abs(have / target - 1)).otherwise(have))
                own = own.withColumn("fitted", F.when((target > 0) & (have > 0), F.col("fitted") * target / have).otherwise(0.0))
            done += 1
        own = cut(own)
        gap = own.agg(F.greatest(*(F.max(f"gap_{d}") for d in MARGINALS))).first()[0]
        own = own.drop(*(f"gap_{d}" for d in MARGINALS))
    if gap > tolerance:
        warnings.warn(f"the marginals are off by up to {gap:.3g} of a target after {rounds} rounds", stacklevel=2)
    fitted = own.select(*MARGINALS, (F.col("fitted") / F.col("now")).alias("multiplier"))
    barred = [wanted[d].where("target = 0").select(F.col(d), F.lit(True).alias(f"no_{d}")) for d in MARGINALS]
    out = reduce(lambda t, b: t.join(b, b.columns[0], "left"), barred, cells.join(fitted, list(MARGINALS), "left"))
    empty = F.when(reduce(lambda a, b: a | b, (F.coalesce(f"no_{d}", F.lit(False)) for d in MARGINALS)), 0.0).otherwise(1.0)
    return out.select(*MARGINALS, "tokens", F.coalesce("multiplier", empty).alias("multiplier")), gap


def probabilities(docs: DataFrame, targets: dict | None = None, power: float = POWER, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text, source, lang, topic, ...) with tokens, multiplier, probability and kept added."""
    docs = docs.drop("tokens", "multiplier", "probability", "kept")
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(f"_cell_{c}") for c in MARGINALS]
    own = docs.select("*", *keyed, tokens().alias("tokens"))
    sums = cut(own.groupBy(*(F.col(f"_cell_{c}").alias(c) for c in MARGINALS)).agg(F.sum("tokens").alias("tokens")))
    table = cut(rake(sums, targets, power, tolerance, rounds)[0])
    most = table.agg(F.count("*").alias("n"), F.max("multiplier").alias("top")).first()
    cells = table.select(*(F.col(c).alias(f"_of_{c}") for c in MARGINALS), "multiplier")
    same = reduce(lambda a, b: a & b, [F.col(f"_cell_{c}") == F.col(f"_of_{c}") for c in MARGINALS])
    joined = own.join(F.broadcast(cells) if most["n"] <= BROADCAST_CELLS else cells, same)
    uniform = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    out = joined.withColumn("probability", F.col("multiplier") / F.lit(most["top"] or 1.0)).withColumn("kept", uniform < F.col("probability"))
    return out.drop(*(f"_cell_{c}" for c in MARGINALS), *(f"_of_{c}" for c in MARGINALS))


def sample(docs: DataFrame, targets: dict | None = None, power: float = POWER) -> DataFrame:
    """The kept rows of docs (doc_id, text, source, lang), with its own columns; the topic is that of topic(), whatever column has that name."""
    own = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "doc_id", "text", "source", "lang", topic().alias("topic"))
    return probabilities(own, targets, power).where("kept").select("_row.*")


def oracle(rounds: int = 30, power: float = POWER) -> str:
    """DuckDB SQL for the rows of the query."""
    steps, last = [], "c"
    for r in range(rounds):
        for d in MARGINALS:
            name = f"f{r}{d[0]}"
            steps.append(f"{name} AS MATERIALIZED (SELECT {last}.* REPLACE ({last}.fitted * {last}.t_{d} / sum({last}.fitted) OVER (PARTITION BY {last}.{d}) AS fitted) FROM {last})")
            last = name
    marginal = ", ".join(f"m_{d} AS (SELECT {d}, pow(sum(n), {power}) / sum(pow(sum(n), {power})) OVER () AS t_{d} FROM s GROUP BY {d})" for d in MARGINALS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN regexp_matches(coalesce(text, ''), '[Ll]icensed|[Cc]opyright|[Rr]ights reserved') THEN 'legal'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]{{5}}') THEN 'records' ELSE 'prose' END AS topic,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 END AS tokens,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM documents),
t AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, lang, topic, tokens / (SELECT sum(tokens) FROM t) AS n FROM t WHERE tokens > 0),
{marginal},
c AS MATERIALIZED (SELECT s.*, s.n AS fitted, t_source, t_lang, t_topic FROM s JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)),
{", ".join(steps)},
x AS (SELECT t.source, t.lang, t.topic, coalesce(fitted / n, 1.0) AS multiplier FROM t LEFT JOIN {last} USING (source, lang, topic))
SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(multiplier, 6) AS multiplier,
  round(multiplier / (SELECT max(multiplier) FROM x), 6) AS probability, u < multiplier / (SELECT max(multiplier) FROM x) AS kept
FROM d JOIN x USING (source, lang, topic)"""
