"""Training in Spark against a plain loop over the same batches, its restarts, and the seed sweep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import evaluate, training
from tidewave.sources import writers

ARMS = {"whole": "x", "half": "x_half"}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    split = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "val").otherwise("test")
    x = F.transform("embedding", lambda v: 8 * v.cast("double"))
    rows = e.select("vec_id", split.alias("split"), (F.col("label") < 5).cast("int").alias("y"), x.alias("x"), F.slice(x, 1, 32).alias("x_half"))
    return training.laid_out(rows, str(tmp_path_factory.mktemp("rows") / "d"), "vec_id", 3)


def plain(data, run, hidden, epochs, rate):
    """Adam over the batches in order, on the driver."""
    rows = data.select("vec_id", "split", "batch", "y", run.column).toPandas()
    x, y = np.stack(rows[run.column]), rows["y"].to_numpy(float)
    w = training.initial((x.shape[1], *hidden, 1), run.seed)
    m, v, t, out = {k: 0 * a for k, a in w.items()}, {k: 0 * a for k, a in w.items()}, 0, []
    for _ in range(epochs):
        loss = n = 0
        for b in sorted(rows.loc[rows["split"] == "train", "batch"].unique()):
            own = ((rows["split"] == "train") & (rows["batch"] == b)).to_numpy()
            step, g = training.gradients(w, x[own], y[own])
            loss, n, t = loss + step, n + own.sum(), t + 1
            for k in w:
                mean = g[k] / own.sum()
                m[k], v[k] = 0.9 * m[k] + 0.1 * mean, 0.999 * v[k] + 0.001 * mean**2
                w[k] = w[k] - rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        own = (rows["split"] == "val").to_numpy()
        z = training.logits(w, x[own])
        area = np.mean([(a > b) + (a == b) / 2 for a in z[y[own] == 1] for b in z[y[own] == 0]])
        out.append((loss / n, np.mean(np.logaddexp(0, z) - y[own] * z), area))
    return w, out


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(1)
    w, x, y = training.initial((5, 4, 3, 1), 2), rng.standard_normal((9, 5)), rng.integers(0, 2, 9).astype(float)
    _, g = training.gradients(w, x, y)
    for k, a in w.items():
        for i in np.ndindex(a.shape):
            up, down = ({**w, k: a + s * 1e-6 * (np.indices(a.shape) == np.array(i).reshape(-1, *[1] * a.ndim)).all(axis=0)} for s in (1, -1))
            slope = (training.gradients(up, x, y)[0] - training.gradients(down, x, y)[0]) / 2e-6
            assert g[k][i] == pytest.approx(slope, abs=1e-4)


def test_training_is_the_plain_loop_and_the_loss_falls(spark, data, tmp_path):
    run = training.Run("whole", 3, "x")
    (found,) = training.fit(data, [run], (6,), str(tmp_path / "s"), epochs=4, rate=0.01).values()
    w, want = plain(data, run, (6,), 4, 0.01)
    assert np.allclose(np.array(found.history)[:, 1:], np.array(want), atol=1e-9) and [h[0] for h in found.history] == [1, 2, 3, 4]
    assert all(np.allclose(found.weights[k], w[k]) for k in w)
    assert found.history[-1][1] < 0.9 * found.history[0][1]


def test_a_fit_that_was_lost_goes_on_after_its_last_epoch(spark, data, tmp_path, monkeypatch):
    runs = [training.Run("whole", 3, "x"), training.Run("half", 4, "x_half")]
    whole = training.fit(data, runs, (6,), str(tmp_path / "a"), epochs=3, rate=0.01)
    path, steps = str(tmp_path / "b"), []
    own = training.summed

    def dying(rows, models):
        steps.append(len(models))
        if len(steps) == 5:  # in the second epoch
            raise RuntimeError("lost")
        return own(rows, models)

    monkeypatch.setattr(training, "summed", dying)
    with pytest.raises(RuntimeError, match="lost"):
        training.fit(data, runs, (6,), path, epochs=3, rate=0.01)
    again = training.fit(data, runs, (6,), path, epochs=3, rate=0.01)
    assert len(steps) == 5 + 6  # three batches an epoch: one epoch was published, two were left
    for r in runs:
        assert np.allclose(again[r].history, whole[r].history) and all(np.allclose(again[r].best[k], whole[r].best[k]) for k in whole[r].best)
    training.fit(data, runs, (6,), path, epochs=3, rate=0.01)
    assert len(steps) == 11 and writers.versions(spark, path).count() == 3


def test_runs_end_when_the_area_no_longer_grows():
    f = training.fresh((2, 1), 0)
    f.history = [(1, 0, 0, 0.5), (2, 0, 0, 0.7), (3, 0, 0, 0.7), (4, 0, 0, 0.6)]
    assert f.best_epoch() == 2 and f.ended(30, 2) and not f.ended(30, 3) and f.ended(4, 9)


def test_a_sweep_trains_what_is_missing_and_its_verdict_counts_every_seed(spark, data, tmp_path, monkeypatch):
    trained = []
    own = training.summed
    monkeypatch.setattr(training, "summed", lambda rows, models: (trained.append({r.name for r in models}), own(rows, models))[1])
    path, options = str(tmp_path / "s"), {"epochs": 1, "rate": 0.01}
    training.sweep(data, {"whole": "x"}, [1, 2], (4,), path, **options)
    assert trained == [{"whole/1", "whole/2"}] * 3
    trained.clear()
    rows = training.sweep(data, ARMS, [1, 2], (4,), path, **options).collect()
    assert trained == [{"half/1", "half/2"}] * 3 and sorted((r.arm, r.seed, r.epochs) for r in rows) == [(a, s, 1) for a in ("half", "whole") for s in (1, 2)]
    assert all(0 <= r.auc <= 1 for r in rows)
    made = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.3), ("b", 0.5), ("c", 0.2), ("c", 0.9)], "arm string, auc double")
    got = {(r.arm, r.other): r.verdict for r in evaluate.separated(made, "arm", "auc").collect()}
    assert got == {("a", "b"): "separated", ("a", "c"): "overlapping", ("b", "c"): "overlapping"}
