"""Training dense scorers on rows that stay in Spark: gradients are summed by partition, weights are broadcast each step.

Rows are laid out by split and by batch (a hash of their key), so a step reads the files of its batch alone. A step is one job
for all runs (arm, seed) that are still being trained: a task gives the sum of its rows' gradients for each run and layer, these
are added by run and layer, and only sums, as large as the weights, reach the driver, which takes an Adam step. After each epoch the
loss and the AUC on the validation split decide the best weights and when a run ends, and the state of all runs is published
as the next version. A fit that was lost goes on after the last epoch that was published; runs that ended are not trained again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import evaluate
from tidewave.sources import writers

STATE = "run string, kind string, name string, shape array<int>, x array<double>"
#: Rows whose gradients are computed at once.
SLICE = 4096

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Run:
    """One model: the arm it belongs to, the seed of its weights, and the array column it sees."""

    arm: str
    seed: int
    column: str

    @property
    def name(self) -> str:
        return f"{self.arm}/{self.seed}"


def initial(sizes: tuple[int, ...], seed: int) -> Weights:
    """Weights of dense layers, a function of the seed."""
    r = np.random.default_rng(seed)
    out: Weights = {}
    for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True), 1):
        out[f"dense{i}"] = r.standard_normal((b, a)) * np.sqrt(2 / a)
        out[f"bias{i}"] = np.zeros(b)
    return out


def _layers(w: Weights, x: np.ndarray) -> list[np.ndarray]:
    out = [x]
    depth = len(w) // 2
    for i in range(1, depth + 1):
        z = out[-1] @ w[f"dense{i}"].T + w[f"bias{i}"]
        out.append(np.maximum(z, 0) if i < depth else z)
    return out


def logits(w: Weights, x: np.ndarray) -> np.ndarray:
    return _layers(w, x)[-1][:, 0]


def gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """The sum of the cross entropy over rows, and its gradient."""
    out = _layers(w, x)
    z = out[-1][:, 0]
    loss = float((np.logaddexp(0, z) - y * z).sum())
    back = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)[:, None]
    found: Weights = {}
    for i in range(len(w) // 2, 0, -1):
        found[f"dense{i}"], found[f"bias{i}"] = back.T @ out[i - 1], back.sum(axis=0)
        if i > 1:
            back = (back @ w[f"dense{i}"]) * (out[i - 1] > 0)
    return loss, found


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def laid_out(rows: DataFrame, path: str, key: str, batches: int) -> DataFrame:
    """Writes rows (key, split, y, arrays) by split and batch, and reads them back."""
    batch = F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int")
    rows.withColumn("batch", batch).repartition("split", "batch").write.partitionBy("split", "batch").parquet(path)
    return rows.sparkSession.read.parquet(path)


def summed(rows: DataFrame, models: dict[Run, Weights]) -> dict[str, tuple[float, int, Weights]]:
    """For each run the loss, the rows and the gradient, all summed over rows (y, arrays)."""
    shared = rows.sparkSession.sparkContext.broadcast({r.name: (r.column, w) for r, w in models.items()})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            for name, (column, w) in shared.value.items():
                for lo in range(0, len(y), SLICE):
                    own = y[lo : lo + SLICE]
                    loss, found = gradients(w, _matrix(b.column(column).slice(lo, SLICE)), own)
                    for layer, g in (*found.items(), ("_loss", np.array([loss, len(own)]))):
                        total[name, layer] = total.get((name, layer), 0) + g.ravel()
        for (name, layer), g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([layer]), pa.array([g], pa.list_(pa.float64()))], names=["run", "layer", "x"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1].assign(x=[np.sum(np.stack(sorted(rows["x"].tolist(), key=tuple)), axis=0)])  # one array for each task, in an order that does not change

    columns = sorted({r.column for r in models})
    sums = rows.select("y", *columns).mapInArrow(partial, "run string, layer string, x array<double>").groupBy("run", "layer").applyInPandas(add, "run string, layer string, x array<double>")
    found = {(r["run"], r["layer"]): np.asarray(r["x"]) for r in sums.collect()}  # as large as the weights
    out = {}
    for r, w in models.items():
        loss, n = found.get((r.name, "_loss"), np.zeros(2))
        out[r.name] = float(loss), int(n), {k: found[r.name, k].reshape(v.shape) if n else np.zeros_like(v) for k, v in w.items()}
    return out


def scored(rows: DataFrame, models: dict[Run, Weights], keep: tuple[str, ...] = ("y",)) -> DataFrame:
    """(run, arm, seed, *keep, logit) of every row under every run."""
    shared = rows.sparkSession.sparkContext.broadcast([(r.name, r.arm, r.seed, r.column, w) for r, w in models.items()])

    def run(batches):
        for b in batches:
            for name, arm, seed, column, w in shared.value:
                z = logits(w, _matrix(b.column(column))) if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array([arm] * len(b), pa.string()), pa.array([seed] * len(b), pa.int64()), *(b.column(c) for c in keep), pa.array(z)], names=["run", "arm", "seed", *keep, "logit"])

    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, *sorted({r.column for r in models})).mapInArrow(run, f"run string, arm string, seed long{kept}, logit double")


@dataclass
class Fit:
    """The state of one run."""

    weights: Weights
    first: Weights
    second: Weights
    best: Weights
    step: int = 0
    history: list[tuple[float, ...]] = field(default_factory=list)  # epoch, training loss, validation loss, validation AUC

    def best_epoch(self) -> int:
        return int(max(self.history, key=lambda h: (h[3], -h[0]))[0]) if self.history else 0

    def ended(self, epochs: int, patience: int) -> bool:
        done = len(self.history)
        return done >= epochs or done - self.best_epoch() >= patience

    def learn(self, g: Weights, rate: float) -> None:
        """One Adam step."""
        self.step += 1
        for k, x in g.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * x
            self.second[k] = 0.999 * self.second[k] + 0.001 * x * x
            self.weights[k] = self.weights[k] - rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)


def fresh(sizes: tuple[int, ...], seed: int) -> Fit:
    w = initial(sizes, seed)
    zero = {k: np.zeros_like(v) for k, v in w.items()}
    return Fit(w, dict(zero), dict(zero), dict(w))


def _save(spark, path: str, fits: dict[Run, Fit], others: list) -> None:
    rows = [tuple(x) for x in others]
    for r, f in fits.items():
        for kind in ("weights", "first", "second", "best"):
            rows += [(r.name, kind, k, list(v.shape), v.ravel().tolist()) for k, v in getattr(f, kind).items()]
        rows += [(r.name, "history", str(f.step), [len(h)], list(map(float, h))) for h in f.history]
        rows.append((r.name, "step", "", [1], [float(f.step)]))
    writers.publish(spark.createDataFrame(rows, STATE).coalesce(1), path)


def _load(spark, path: str, runs: list[Run]) -> tuple[dict[Run, Fit], list]:
    """The published state of those runs that have one, and the rows of others."""
    try:
        rows = writers.published(spark, path).collect()  # as large as the weights
    except FileNotFoundError:
        return {}, []
    out = {}
    for r in runs:
        own = [x for x in rows if x["run"] == r.name]
        if own:
            of = lambda kind: {x["name"]: np.asarray(x["x"]).reshape(x["shape"]) for x in own if x["kind"] == kind}  # noqa: B023, E731
            history = sorted(tuple(x["x"]) for x in own if x["kind"] == "history")
            out[r] = Fit(of("weights"), of("first"), of("second"), of("best"), int(of("step")[""][0]), history)
    names = {r.name for r in runs}
    return out, [x for x in rows if x["run"] not in names]


def fit(data: DataFrame, runs: list[Run], hidden: tuple[int, ...], path: str, epochs: int = 30, rate: float = 1e-3, patience: int = 6) -> dict[Run, Fit]:
    """Trains the runs on data that is laid out, from the state published at path on."""
    spark = data.sparkSession
    train, val = data.where("split = 'train'"), data.where("split = 'val'")
    batches = sorted(r["batch"] for r in train.select("batch").distinct().collect())  # folders
    width = {r.column: data.select(F.size(r.column)).first()[0] for r in runs}
    fits, others = _load(spark, path, runs)
    for r in runs:
        fits.setdefault(r, fresh((width[r.column], *hidden, 1), r.seed))
    while active := {r: f for r, f in fits.items() if not f.ended(epochs, patience)}:
        lost = dict.fromkeys(active, (0.0, 0))
        for b in batches:
            found = summed(train.where(F.col("batch") == b), {r: f.weights for r, f in active.items()})
            for r, f in active.items():
                loss, n, g = found[r.name]
                f.learn({k: x / max(n, 1) for k, x in g.items()}, rate)
                lost[r] = (lost[r][0] + loss, lost[r][1] + n)
        z = scored(val, {r: f.weights for r, f in active.items()})
        losses = {x["run"]: x["loss"] for x in z.groupBy("run").agg(evaluate.loss("logit", "y").alias("loss")).collect()}
        areas = {x["run"]: x["auc"] for x in evaluate.auc(z.withColumn("positive", F.col("y") == 1), "logit", "positive", ["run"]).collect()}
        for r, f in active.items():
            area = areas.get(r.name)
            f.history.append((len(f.history) + 1, lost[r][0] / max(lost[r][1], 1), losses.get(r.name, 0.0), -1.0 if area is None else area))
            if f.best_epoch() == len(f.history):
                f.best = dict(f.weights)
        _save(spark, path, fits, others)
    return fits


def sweep(data: DataFrame, arms: dict[str, str], seeds: list[int], hidden: tuple[int, ...], path: str, **options) -> DataFrame:
    """(arm, seed, epochs, best_epoch, auc): every arm with every seed, those that are missing at path being trained; the AUC is that of the best weights on the test split."""
    runs = [Run(arm, seed, column) for arm, column in arms.items() for seed in seeds]
    fits = fit(data, runs, hidden, path, **options)
    z = scored(data.where("split = 'test'"), {r: f.best for r, f in fits.items()})
    area = evaluate.auc(z.withColumn("positive", F.col("y") == 1), "logit", "positive", ["arm", "seed"]).select("arm", "seed", "auc")
    told = data.sparkSession.createDataFrame([(r.arm, r.seed, len(f.history), f.best_epoch()) for r, f in fits.items()], "arm string, seed long, epochs int, best_epoch int")
    return told.join(area, ["arm", "seed"], "left")
