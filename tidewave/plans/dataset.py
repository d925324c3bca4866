"""Queries that build and check datasets: background draws, balance within blocks, clean offsets, order of splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.operators import evaluate, intervals, scans
from tidewave.plans.catalog import query
from tidewave.plans.detection import DAY, HOUR, SPLIT, _events, _split
from tidewave.session import table

E = "e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events)"


def _days(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))


@query("""SELECT user_id, value, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp
FROM (SELECT user_id, value, count(*) FILTER (event_type = 'error') AS p, count(*) FILTER (event_type <> 'error') AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY user_id ORDER BY value DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(_events(spark, sf_dir).withColumn("positive", F.col("event_type") == "error"), "value", "positive", ["user_id"])


@query(f"""WITH {E}, d AS (SELECT user_id, max(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY day) AS epoch FROM e GROUP BY user_id, day),
b AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
l AS (SELECT *, max(CASE WHEN before IS NULL OR v > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS last FROM b),
s AS (SELECT user_id, min(epoch) AS stop FROM l WHERE epoch - last >= 6 GROUP BY user_id)
SELECT user_id, max(last) AS best_epoch, max(v) AS best, max(epoch) AS stopped_at FROM l LEFT JOIN s USING (user_id) WHERE stop IS NULL OR epoch <= stop GROUP BY user_id""")
def early_stop(spark, sf_dir):
    """A user's days are epochs, the day's largest value the metric."""
    by = _days(spark, sf_dir).groupBy("user_id", "day").agg(F.max("value").alias("v"))
    epochs = by.withColumn("epoch", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long"))
    return evaluate.early_stop(epochs, ["user_id"], "epoch", "v")


@query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value, us, event_id) AS i, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM e)
SELECT event_type, user_id, event_id, value FROM r WHERE i = n // 2 + 1""")
def median_specimen(spark, sf_dir):
    """The row of middle rank of each class and user."""
    ranked = scans.placed(_events(spark, sf_dir), ["event_type", "user_id"], "value", 50.0, ["value", "us", "event_id"])
    return ranked.where("place = n div 2").select("event_type", "user_id", "event_id", "value")


@query(f"""WITH {E}, n AS (SELECT day, value FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY day ORDER BY us, event_id) <= 120),
c AS (SELECT day, count(*) AS background FROM n GROUP BY day HAVING count(*) >= 30)
SELECT p.event_id, background, count(*) FILTER (n.value >= p.value) AS louder FROM e p JOIN c USING (day) JOIN n USING (day) WHERE p.event_type = 'error' GROUP BY p.event_id, background""")
def same_block_background(spark, sf_dir):
    """Each positive's rank among the first 120 negatives of its day, where there are 30: a row for each day holds these as an array."""
    e = _days(spark, sf_dir)
    first = e.where("event_type <> 'error'").withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("us", "event_id"))).where("i <= 120")
    by = first.groupBy("day").agg(F.collect_list("value").alias("values"), F.count("*").alias("background")).where("background >= 30")
    louder = F.size(F.filter("values", lambda v: v >= F.col("value"))).cast("long")
    return e.where("event_type = 'error'").join(by, "day").select("event_id", "background", louder.alias("louder"))


@query(f"""WITH {E}, c AS (SELECT day, user_id, count(*) FILTER (event_type = 'error') AS g, count(*) FILTER (event_type <> 'error') AS c FROM e GROUP BY ALL),
k AS (SELECT *, least(g, c) AS t, least(least(g, c), (c - least(g, c)) // 2) AS plain FROM c),
r AS (SELECT e.*, row_number() OVER (PARTITION BY day, user_id, event_type = 'error' ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS i FROM e)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'glitch' WHEN i <= plain THEN 'plain' ELSE 'injected' END AS role FROM r JOIN k USING (day, user_id)
WHERE CASE WHEN event_type = 'error' THEN i <= t ELSE i <= t + 2 * plain END""")
def block_balance(spark, sf_dir):
    """Roles within a block (a user's day): glitches, at most as many as clean rows; as many plain rows as half the rest allows; injected, both together."""
    e = _days(spark, sf_dir).withColumn("glitch", F.col("event_type") == "error")
    own = Window.partitionBy("day", "user_id")
    counted = e.withColumn("g", F.count_if("glitch").over(own)).withColumn("c", F.count_if(~F.col("glitch")).over(own)).withColumn("t", F.least("g", "c"))
    ranked = counted.withColumn("plain", F.least("t", F.expr("(c - t) div 2"))).withColumn(
        "i", F.row_number().over(Window.partitionBy("day", "user_id", "glitch").orderBy(F.md5(F.col("event_id").cast("string")), "event_id"))
    )
    role = F.when(F.col("glitch"), "glitch").when(F.col("i") <= F.col("plain"), "plain").otherwise("injected")
    return ranked.where("i <= if(glitch, t, t + 2 * plain)").select("event_id", role.alias("role"))


@query(f"""WITH {E}, u AS (SELECT user_id, min(us) // {HOUR} AS a, max(us) // {HOUR} AS b FROM e GROUP BY user_id),
h AS (SELECT user_id, unnest(range(a, b + 1)) * {HOUR} AS h FROM u)
SELECT user_id, h FROM h WHERE NOT EXISTS (SELECT 1 FROM e WHERE event_type = 'error' AND e.user_id = h.user_id AND us > h.h - {HOUR} AND us < h.h + 2 * {HOUR})""")
def clean_offsets(spark, sf_dir):
    """The hours of each user's span that keep an hour's margin from every trigger."""
    e = _events(spark, sf_dir)
    ends = e.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    hours = ends.select("user_id", F.explode(F.expr(f"transform(sequence(a div {HOUR}, b div {HOUR}), h -> h * {HOUR})")).alias("h"))
    near = e.where("event_type = 'error'").select("user_id", (F.col("us") - 2 * HOUR + 1).alias("lo"), (F.col("us") + HOUR).alias("hi"))
    return intervals.range_join(hours, near, "h", "lo", "hi", 3 * HOUR, ("user_id",), "left_anti")


@query(f"""WITH {SPLIT}, s AS (SELECT split, min(block) AS first, max(block) AS last, count(DISTINCT block) AS blocks FROM x GROUP BY split)
SELECT *, coalesce(first > max(last) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ordered FROM s""")
def split_order(spark, sf_dir):
    """Whether each split starts after all earlier ones have ended: a row for each split."""
    s = _split(_events(spark, sf_dir)).groupBy("split").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.countDistinct("block").alias("blocks"))
    before = F.max("last").over(Window.partitionBy(F.lit(1)).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("ordered", F.coalesce(F.col("first") > before, F.lit(True)))


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 9) AS p5, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.95), 9) AS p95 FROM events GROUP BY event_type""")
def score_quantiles(spark, sf_dir):
    at = lambda p, name: F.round(F.max(F.when(F.col("share") == p, F.col("value"))), 9).alias(name)
    found = evaluate.percentiles(_events(spark, sf_dir), "value", ["event_type"], [0.05, 0.5, 0.95])
    return found.groupBy("event_type").agg(at(0.05, "p5"), at(0.5, "median"), at(0.95, "p95"))


@query(f"""WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT DISTINCT user_id, event_id FROM r, unnest(range(5)) AS t(k) WHERE i = k * (n - 1) // 4""")
def evenly_spaced(spark, sf_dir):
    """Five rows of each user, evenly spaced from first to last (all, if fewer)."""
    ranked = scans.placed(_events(spark, sf_dir), ["user_id"], "us", 5 * DAY, ["us", "event_id"])
    return ranked.where(F.expr("exists(sequence(0, 4), k -> place = k * (n - 1) div 4)")).select("user_id", "event_id")


@query("""SELECT 'left only' AS name, 0::BIGINT AS n UNION ALL SELECT 'right only', 0 UNION ALL
SELECT 'n_chars', count(*) FILTER (n_chars IS DISTINCT FROM length(text)) FROM documents""")
def dataset_difference(spark, sf_dir):
    """Two versions of a dataset compared by key: the stored lengths and those of the texts."""
    d = table(spark, sf_dir, "documents")
    return evaluate.differing(d.select("doc_id", "n_chars"), d.select("doc_id", F.length("text").cast("long").alias("n_chars")), ["doc_id"])
