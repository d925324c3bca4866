"""Queries over spans, triggers and blocks: events by user as triggers, orders and their lines as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators import intervals, scans
from tidewave.plans.catalog import query
from tidewave.plans.detection import DAY, HOUR, _events, _split, SPLIT
from tidewave.session import table

#: Ordered scans go by files of so long.
FILE = 5 * DAY
E = "e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events)"
SPANS = "s AS (SELECT user_id, us AS lo, us + CAST(floor(value * 60000000) AS BIGINT) AS hi FROM e WHERE event_type <> 'error'), v AS (SELECT user_id, us - 600000000 AS lo, us + 600000000 AS hi FROM e WHERE event_type = 'error')"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir)
    spans = e.where("event_type <> 'error'").select("user_id", F.col("us").alias("lo"), (F.col("us") + F.floor(F.col("value") * 60_000_000)).alias("hi"))
    return spans, e.where("event_type = 'error'").select("user_id", (F.col("us") - 600_000_000).alias("lo"), (F.col("us") + 600_000_000).alias("hi"))


def _merge_sql(name: str) -> str:
    return f"(SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {name})) GROUP BY user_id, island)"


@query(
    f"""WITH {E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 21600000000 THEN 1 ELSE 0 END AS fresh FROM e), c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) + 1 AS cluster FROM g)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, event_id, us, value FROM c QUALIFY row_number() OVER (PARTITION BY user_id, cluster ORDER BY value DESC, us) = 1"""
)
def dedup_gap_cluster(spark, sf_dir):
    c = intervals.gap_clusters(_events(spark, sf_dir), "us", 6 * HOUR, ["user_id"], FILE)
    best = F.max_by(F.struct("event_id", "us", "value"), F.struct("value", -F.col("us")))
    return c.groupBy("user_id", "cluster").agg(best.alias("b")).select("user_id", "cluster", "b.*")


@query(
    f"""WITH RECURSIVE {E}, k(user_id, us) AS (SELECT user_id, min(us) FROM e GROUP BY 1 UNION ALL
SELECT k.user_id, (SELECT min(e.us) FROM e WHERE e.user_id = k.user_id AND e.us >= k.us + 28800000000) FROM k WHERE k.us IS NOT NULL) SELECT user_id, us FROM k WHERE us IS NOT NULL"""
)
def greedy_spacing(spark, sf_dir):
    return intervals.spaced(_events(spark, sf_dir), "us", 8 * HOUR, ["user_id"], FILE)


@query(f"WITH {E}, {SPANS} SELECT user_id, lo, hi FROM {_merge_sql('s')}")
def merge_spans(spark, sf_dir):
    return intervals.merged(_spans(spark, sf_dir)[0], "lo", "hi", ["user_id"], FILE)


@query(f"WITH {E}, {SPANS} SELECT user_id, CAST(sum(hi - lo) AS BIGINT) / 3600000000.0 AS hours, count(*) AS spans FROM {_merge_sql('s')} GROUP BY 1")
def span_hours(spark, sf_dir):
    return intervals.merged(_spans(spark, sf_dir)[0], "lo", "hi", ["user_id"], FILE).groupBy("user_id").agg((F.sum(F.col("hi") - F.col("lo")) / HOUR).alias("hours"), F.count("*").alias("spans"))


@query(
    f"""WITH {E}, {SPANS}, ms AS {_merge_sql('s')}, mv AS {_merge_sql('v')},
p AS (SELECT user_id, lo AS t, 1 AS d, 0 AS w FROM ms UNION ALL SELECT user_id, hi, -1, 0 FROM ms UNION ALL SELECT user_id, lo, 0, 1 FROM mv UNION ALL SELECT user_id, hi, 0, -1 FROM mv),
q AS (SELECT user_id, t, sum(d) AS d, sum(w) AS w FROM p GROUP BY ALL), r AS (SELECT user_id, t AS lo, lead(t) OVER o AS hi, sum(d) OVER o AS d, sum(w) OVER o AS w FROM q WINDOW o AS (PARTITION BY user_id ORDER BY t)),
z AS (SELECT user_id, lo, hi FROM r WHERE d > 0 AND w = 0 AND hi > lo) SELECT user_id, lo, hi FROM {_merge_sql('z')}"""
)
def interval_subtract(spark, sf_dir):
    return intervals.subtracted(*_spans(spark, sf_dir), "lo", "hi", ["user_id"], FILE)


#: Microseconds: the shortest stretch, what stays free at either end of one, and a block.
SHORTEST, PAD, BLOCK = 3_600_000_000, 60_000_000, 1_800_000_000


@query(
    f"""WITH {E}, {SPANS}, ms AS {_merge_sql('s')}, mv AS {_merge_sql('v')},
p AS (SELECT user_id, lo AS t, 1 AS d, 0 AS w FROM ms UNION ALL SELECT user_id, hi, -1, 0 FROM ms UNION ALL SELECT user_id, lo, 0, 1 FROM mv UNION ALL SELECT user_id, hi, 0, -1 FROM mv),
q AS (SELECT user_id, t, sum(d) AS d, sum(w) AS w FROM p GROUP BY ALL), r AS (SELECT user_id, t AS lo, lead(t) OVER o AS hi, sum(d) OVER o AS d, sum(w) OVER o AS w FROM q WINDOW o AS (PARTITION BY user_id ORDER BY t)),
z AS (SELECT user_id, lo, hi FROM r WHERE d > 0 AND w = 0 AND hi > lo), y AS (SELECT * FROM {_merge_sql('z')} WHERE hi - lo >= {SHORTEST}),
b AS (SELECT user_id, lo AS stretch, lo + {PAD} + k * {BLOCK} AS us, CASE WHEN k = 0 THEN 0 ELSE 1 END AS role FROM (SELECT *, unnest(range(0, (hi - lo - {2 * PAD}) // {BLOCK})) AS k FROM y))
SELECT user_id, stretch, us, role FROM (SELECT *, sum(role) OVER (PARTITION BY user_id ORDER BY us) - role AS done FROM b) WHERE done < 20"""
)
def planned_blocks(spark, sf_dir):
    """Blocks laid into each user's stretches that vetoes leave and that are long enough, the first of a stretch a source of its spectrum, until 20 are data."""
    left = intervals.subtracted(*_spans(spark, sf_dir), "lo", "hi", ["user_id"], FILE).where(F.col("hi") - F.col("lo") >= SHORTEST)
    n = F.floor((F.col("hi") - F.col("lo") - 2 * PAD) / BLOCK)
    k = left.where(n > 0).select("user_id", F.col("lo").alias("stretch"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    b = k.select("user_id", "stretch", (F.col("stretch") + PAD + F.col("k") * BLOCK).alias("us"), F.when(F.col("k") == 0, 0).otherwise(1).alias("role"))
    return scans.running(b, ["user_id"], "us", FILE, ["us"], {"done": (F.col("role"), "sum")}).where("done < 20").select("user_id", "stretch", "us", "role")


@query(f"WITH {E} SELECT event_id FROM e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'error' AND v.user_id = e.user_id AND abs(e.us - v.us) < 14400000000)")
def veto_anti_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    near = e.where("event_type = 'error'").select("user_id", (F.col("us") - 4 * HOUR + 1).alias("lo"), (F.col("us") + 4 * HOUR).alias("hi"))
    return intervals.range_join(e.where("event_type <> 'error'"), near, "us", "lo", "hi", 8 * HOUR, ("user_id",), "left_anti").select("event_id")


@query(f"WITH {E}, {SPANS}, ms AS {_merge_sql('s')} SELECT event_id, lo, hi FROM e JOIN ms ON e.user_id = ms.user_id AND us >= lo AND us < hi WHERE event_type = 'error'")
def containment_join(spark, sf_dir):
    spans = intervals.merged(_spans(spark, sf_dir)[0], "lo", "hi", ["user_id"], FILE)
    return intervals.range_join(_events(spark, sf_dir).where("event_type = 'error'"), spans, "us", "lo", "hi", 12 * HOUR, ("user_id",)).select("event_id", "lo", "hi")


@query(f"WITH {E}, {SPANS}, ms AS {_merge_sql('s')} SELECT lo, hi, user_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE event_type = 'error' AND e.user_id = ms.user_id AND us >= lo AND us < hi) THEN 1 ELSE 0 END AS role FROM ms")
def role_flag(spark, sf_dir):
    spans = intervals.merged(_spans(spark, sf_dir)[0], "lo", "hi", ["user_id"], FILE)
    with_one = intervals.range_join(_events(spark, sf_dir).where("event_type = 'error'"), spans, "us", "lo", "hi", 12 * HOUR, ("user_id",)).select("user_id", "lo").distinct().withColumn("has", F.lit(1))
    return spans.join(with_one, ["user_id", "lo"], "left").select("lo", "hi", "user_id", F.coalesce("has", F.lit(0)).alias("role"))


@query(f"WITH {E} SELECT l.event_id, l.us, r.event_id AS prior_id, r.value AS prior FROM (SELECT * FROM e WHERE event_type = 'error') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type <> 'error') r ON l.user_id = r.user_id AND l.us >= r.us")
def asof_trigger(spark, sf_dir):
    e = _events(spark, sf_dir)
    right = e.where("event_type <> 'error'").select("user_id", "us", F.col("event_id").alias("prior_id"), F.col("value").alias("prior"))
    return intervals.asof(e.where("event_type = 'error'").select("user_id", "us", "event_id"), right, "us", ["user_id"], ["prior_id", "prior"], FILE).select("event_id", "us", "prior_id", "prior")


@query(
    f"""WITH {E}, n AS (SELECT l.event_id, l.us - r.us AS d FROM (SELECT * FROM e WHERE event_type = 'error') l ASOF JOIN (SELECT * FROM e WHERE event_type <> 'error') r ON l.user_id = r.user_id AND l.us >= r.us
UNION ALL SELECT l.event_id, r.us - l.us FROM (SELECT * FROM e WHERE event_type = 'error') l ASOF JOIN (SELECT * FROM e WHERE event_type <> 'error') r ON l.user_id = r.user_id AND l.us <= r.us) SELECT event_id, min(d) AS distance FROM n GROUP BY 1"""
)
def nearest_event(spark, sf_dir):
    e = _events(spark, sf_dir)
    error = F.col("event_type") == "error"
    e = e.withColumns({"back": -F.col("us"), "later": error.cast("int")})  # others before errors at equal times, either way
    other = F.when(~error, F.col("us"))
    near = scans.running(e, ["user_id"], "us", FILE, ["us", "later"], {"before": (other, "last")}, inclusive=True)
    near = scans.running(near, ["user_id"], "back", FILE, ["back", "later"], {"after": (other, "last")}, inclusive=True)
    near = near.withColumn("distance", F.least(F.col("us") - F.col("before"), F.col("after") - F.col("us")))
    return near.where(error & F.col("distance").isNotNull()).select("event_id", "distance")


B = f"{E}, b AS (SELECT DISTINCT user_id, CAST(floor(us / 86400000000) AS BIGINT) AS block FROM e)"


def _blocks(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", F.floor(F.col("us") / DAY).alias("block")).distinct()


@query(f"WITH {B}, i AS (SELECT *, block - row_number() OVER (PARTITION BY user_id ORDER BY block) AS k FROM b) SELECT user_id, min(block) AS first, max(block) AS last, count(*) AS n FROM i GROUP BY user_id, k")
def consecutive_runs(spark, sf_dir):
    return intervals.runs(_blocks(spark, sf_dir), "block", ["user_id"], FILE // DAY)


@query(f"WITH {B}, i AS (SELECT *, block - row_number() OVER (PARTITION BY user_id ORDER BY block) AS k FROM b), g AS (SELECT *, (row_number() OVER (PARTITION BY user_id, k ORDER BY block) - 1) // 8 AS part FROM i) SELECT user_id, min(block) AS first, count(*) AS n FROM g GROUP BY user_id, k, part")
def fetch_groups(spark, sf_dir):
    r = intervals.runs(_blocks(spark, sf_dir), "block", ["user_id"], FILE // DAY)
    return r.select("user_id", F.explode(F.sequence("first", "last", F.lit(8))).alias("first"), "last").select("user_id", "first", F.least(F.lit(8), F.col("last") - F.col("first") + 1).alias("n"))


@query(f"WITH {B} SELECT c.user_id, c.block FROM b c JOIN b p ON p.user_id = c.user_id AND p.block = c.block - 1")
def causal_predecessor(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return b.join(b.select("user_id", (F.col("block") + 1).alias("block")), ["user_id", "block"], "left_semi")


@query(f"WITH {B} SELECT DISTINCT user_id, block - d AS block FROM b, (VALUES (0), (1)) x(d)")
def needed_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("user_id", F.explode(F.array(F.col("block") - 1, F.col("block"))).alias("block")).distinct()


@query(f"WITH {B}, i AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, k ORDER BY block) = 1 THEN 0 ELSE 1 END AS role FROM (SELECT *, block - row_number() OVER (PARTITION BY user_id ORDER BY block) AS k FROM b)) SELECT user_id, block, role FROM (SELECT *, sum(role) OVER (PARTITION BY user_id ORDER BY block) - role AS before FROM i) WHERE before < 5")
def quota_prefix(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    after = b.select("user_id", (F.col("block") + 1).alias("block"), F.lit(1).alias("role"))
    role = b.join(after, ["user_id", "block"], "left").na.fill(0, ["role"])
    return scans.running(role, ["user_id"], "block", FILE // DAY, ["block"], {"done": (F.col("role"), "sum")}).where("done < 5").select("user_id", "block", "role")


@query(f"WITH {E} SELECT user_id, event_type, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 3")
def topk_per_class_file(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    return _events(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_type", "event_id", "value")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT block) AS blocks, min(us) AS first, max(us) AS last FROM x GROUP BY 1")
def time_split(spark, sf_dir):
    return _split(_events(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.min("us").alias("first"), F.max("us").alias("last"))


@query(f"WITH {SPLIT} SELECT count(*) = count(DISTINCT event_id) AS ids_unique, bool_and(value IS NOT NULL AND isfinite(value)) AS scores_finite, (SELECT max(n) FROM (SELECT count(DISTINCT split) AS n FROM x GROUP BY block)) = 1 AS block_in_one_split, max(CASE WHEN split = 'train' THEN us END) < min(CASE WHEN split = 'val' THEN us END) AS val_after_train, max(CASE WHEN split = 'val' THEN us END) < min(CASE WHEN split = 'test' THEN us END) AS test_after_val FROM x")
def quality_checks(spark, sf_dir):
    x = _split(_events(spark, sf_dir))
    one = x.groupBy("block").agg(F.countDistinct("split").alias("n")).agg((F.max("n") == 1).alias("block_in_one_split"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    of = lambda s: F.when(F.col("split") == s, F.col("us"))
    rest = x.agg((F.count("*") == F.countDistinct("event_id")).alias("ids_unique"), F.bool_and(finite).alias("scores_finite"), (F.max(of("train")) < F.min(of("val"))).alias("val_after_train"), (F.max(of("val")) < F.min(of("test"))).alias("test_after_val"))
    return rest.crossJoin(one)  # one row each


@query("SELECT o_orderkey AS id, 'order' AS origin, o_totalprice AS score, NULL::INTEGER AS line FROM orders UNION ALL SELECT l_orderkey, 'line', l_extendedprice, l_linenumber FROM lineitem")
def union_mix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("origin"), F.col("o_totalprice").alias("score"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("origin"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("line"))
    return o.unionByName(li, allowMissingColumns=True)


@query("SELECT user_id FROM events WHERE event_type = 'error' AND value > 300 INTERSECT SELECT user_id FROM events WHERE event_type <> 'error' AND value > 300")
def seed_intersection(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 300")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type <> 'error'").select("user_id"))


@query("SELECT count(*) AS differing FROM ((SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL SELECT o_orderkey, round(o_totalprice, 2) FROM orders) UNION ALL (SELECT o_orderkey, round(o_totalprice, 2) FROM orders EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders))")
def bag_equal(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    b = a.withColumn("o_totalprice", F.round("o_totalprice", 2))
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("differing"))


@query("SELECT n_name, r_name, count(*) AS n, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS good FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dictionary_decode(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    by = c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("good"))
    return by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n", "good")


@query("SELECT s_suppkey AS block, o AS start FROM supplier, (SELECT unnest(generate_series(0, 508)) AS o) WHERE s_acctbal < 0")
def spec_cross(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("block"))
    return s.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(508).cast("long"))).alias("start"))
