"""Plans over counts: which files to take, and which split a block belongs to.

Rows are only counted, ranked and summed in Spark; what comes to the driver is bounded by the numbers of classes and of
files to take, never by the data.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import intervals
from tidewave.session import cut


def file_counts(rows: DataFrame, kind: str, file: str, files: int) -> list[tuple]:
    """(class, file, rows) of all files that a cover of `files` files can take.

    A class picks its richest unpicked file, so none but its `files` richest can be its pick: at most classes x files files.
    """
    n = rows.groupBy(F.col(kind).alias("kind"), F.col(file).alias("file")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "file"))
    rich = n.withColumn("rank", rank).where(F.col("rank") <= files).select("file").distinct()
    return [tuple(r) for r in n.join(rich, "file", "left_semi").select("kind", "file", "n").collect()]


def balanced_cover(counts: list[tuple], cap: int, files: int) -> list[tuple[int, dict]]:
    """Files in the order they are taken, each with the rows to take of each class.

    The class that has fewest rows so far (ties to the smaller name) picks the unpicked file with most of it (ties to
    the smaller file), and every class takes from that file what it still lacks to `cap`. A class without an
    unpicked file has no further turn.
    """
    holds: dict = defaultdict(dict)
    wish: dict = defaultdict(list)
    for kind, file, n in counts:
        holds[file][kind] = n
        wish[kind].append((n, file))
    for own in wish.values():
        own.sort(key=lambda x: (x[0], -x[1]))  # the best last
    turn = [(0, kind) for kind in sorted(wish)]  # a heap of (rows so far, class); entries may be out of date
    so_far = dict.fromkeys(wish, 0)
    taken: dict[int, dict] = {}
    while turn and len(taken) < files:
        n, kind = heapq.heappop(turn)
        if n != so_far[kind]:
            continue
        while wish[kind] and wish[kind][-1][1] in taken:
            wish[kind].pop()
        if not wish[kind]:
            continue
        _, file = wish[kind].pop()
        taken[file] = {k: min(n, cap - so_far[k]) for k, n in holds[file].items() if so_far[k] < cap}
        for k, more in taken[file].items():
            so_far[k] += more
            if so_far[k] < cap:
                heapq.heappush(turn, (so_far[k], k))
    return list(taken.items())


def cover(rows: DataFrame, kind: str, file: str, best: list, cap: int, files: int, span: tuple[str, int, int] | None = None) -> DataFrame:
    """The rows of a balanced cover: of each class in a taken file the first by `best`, with `pick`, the file's place in the order.

    span (time column, reach, most): files are taken until the spans of `reach` around the chosen times cover more
    than `most`; the file that passes it is the last one.
    """
    picks = balanced_cover(file_counts(rows, kind, file, files), cap, files)
    quota = [(f, k, n, i) for i, (f, own) in enumerate(picks) for k, n in own.items()]
    types = ", ".join(f"_{c} {rows.schema[x].dataType.simpleString()}" for c, x in (("file", file), ("kind", kind)))
    table = rows.sparkSession.createDataFrame(quota, f"{types}, _quota long, pick int")  # at most classes x files rows
    met = rows.join(F.broadcast(table), (F.col(file) == F.col("_file")) & (F.col(kind) == F.col("_kind")))
    place = F.row_number().over(Window.partitionBy(file, kind).orderBy(*best))
    chosen = met.withColumn("_place", place).where("_place <= _quota").drop("_file", "_kind", "_quota", "_place")
    if span is None or not picks:
        return chosen
    at, reach, most = span
    chosen = cut(chosen)

    def length(last: int) -> int:
        spans = chosen.where(F.col("pick") <= last).select(F.lit(1).alias("_one"), (F.col(at) - reach).alias("_lo"), (F.col(at) + reach).alias("_hi"))
        return intervals.merged(spans, "_lo", "_hi", ["_one"], 100 * reach).agg(F.sum(F.col("_hi") - F.col("_lo"))).first()[0] or 0

    low, high = 0, len(picks) - 1  # the first pick that passes the budget, by halves: the length only grows
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if length(middle) > most else (middle + 1, high)
    return chosen.where(F.col("pick") <= low)


def stratified_split(rows: DataFrame, kind: str, block: str, test: float = 0.3, val: float = 0.1, least: int = 20) -> DataFrame:
    """(block, split): the rarest class deals out its blocks first, in order: to test up to its share (`least` rows at least), then to val, the rest to train.

    A class counts what blocks that rarer classes dealt out already give it. Each class is one running sum over its blocks.
    """
    n = cut(rows.groupBy(F.col(kind).alias("kind"), F.col(block).alias("block")).agg(F.count("*").alias("n")))
    totals = [tuple(r) for r in n.groupBy("kind").agg(F.sum("n").alias("n")).orderBy("n", "kind").collect()]  # one row for each class
    dealt = None
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    for name, total in totals:
        own = n.where(F.col("kind") == name).select("block", "n")
        given: dict = {}
        if dealt is not None:
            given = {r["split"]: r["n"] for r in own.join(dealt, "block").groupBy("split").agg(F.sum("n").alias("n")).collect()}
            own = own.join(dealt, "block", "left_anti")
        for_test = max(round(test * total), min(least, total)) - given.get("test", 0)
        for_val = round(val * total) - given.get("val", 0)
        run = own.withColumn("before", before)
        spent = F.coalesce(F.max(F.when(F.col("before") < for_test, F.col("before") + F.col("n"))).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        split = F.when(F.col("before") < for_test, "test").when(F.col("before") - spent < for_val, "val").otherwise("train")
        new = run.select("block", split.alias("split"))
        dealt = cut(new if dealt is None else dealt.unionByName(new))
    return dealt if dealt is not None else n.select("block", F.lit("train").alias("split"))


def resumed(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a plan that have not been written yet."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
