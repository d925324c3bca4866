"""A small convolutional scorer: three convolutions with normalisation and pooling, two dense layers."""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (filters, inputs, width) of the convolutions, and the dense layers' shapes.
CONVOLUTIONS = ((16, 1, 64), (32, 16, 8), (64, 32, 8))
DENSE = ((128, 1792), (1, 128))
POOLS = (4, 4, 4)


def weights(seed: int) -> dict[str, np.ndarray]:
    """Random weights, a function of the seed."""
    r = np.random.default_rng(seed)
    out = {}
    for i, shape in enumerate(CONVOLUTIONS, 1):
        out[f"conv{i}"] = r.standard_normal(shape) / np.sqrt(shape[1] * shape[2])
        for name, value in (("scale", 1.0), ("shift", 0.0), ("mean", 0.0), ("var", 1.0)):
            out[f"bn{i}_{name}"] = np.full(shape[0], value)
    for i, shape in enumerate(DENSE, 1):
        out[f"dense{i}"] = r.standard_normal(shape) / np.sqrt(shape[1])
        out[f"bias{i}"] = np.zeros(shape[0])
    return out


def trainable(w: dict[str, np.ndarray]) -> int:
    return sum(v.size for k, v in w.items() if not k.endswith(("_mean", "_var")))


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Logits of crops [n, 2048]."""
    h = x[:, None, :]
    for i, pool in enumerate(POOLS, 1):
        k = w[f"conv{i}"]
        view = np.lib.stride_tricks.sliding_window_view(h, k.shape[2], axis=2)
        h = np.einsum("nctk,fck->nft", view, k, optimize=True)
        h = (h - w[f"bn{i}_mean"][:, None]) / np.sqrt(w[f"bn{i}_var"][:, None] + 1e-5) * w[f"bn{i}_scale"][:, None] + w[f"bn{i}_shift"][:, None]
        h = np.maximum(h, 0)
        h = h[:, :, : h.shape[2] // pool * pool].reshape(h.shape[0], h.shape[1], -1, pool).max(axis=3)
    h = h.reshape(len(h), -1)
    h = np.maximum(h[:, : DENSE[0][1]] @ w["dense1"].T + w["bias1"], 0)
    return (h @ w["dense2"].T + w["bias2"])[:, 0]


#: Crops that are scored at once.
SLICE = 32


def scores(crops: DataFrame, w: dict[str, np.ndarray], x: str = "x") -> DataFrame:
    """The other columns of crops (x array of 2048) with a logit; slices of SLICE crops are scored at once, the last one filled up, so each product has the same shape."""
    shared = crops.sparkSession.sparkContext.broadcast(w)
    names = [c for c in crops.columns if c != x]

    def run(parts):
        for p in parts:
            out = np.zeros(len(p))
            for lo in range(0, len(p), SLICE):
                own = np.stack([np.asarray(v, float) for v in p[x].iloc[lo : lo + SLICE]])
                full = np.concatenate((own, np.zeros((SLICE - len(own), own.shape[1]))))
                out[lo : lo + len(own)] = forward(shared.value, full)[: len(own)]
            yield p[names].reset_index(drop=True).assign(logit=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema if f.name != x)
    return crops.mapInPandas(run, schema + ", logit double")


def score_arms(crops: DataFrame, arms: dict[str, tuple[dict[str, np.ndarray], str]]) -> DataFrame:
    """The logits of every arm: its weights over its own column of the crops, with the arm's name."""
    columns = {x for _, x in arms.values()}
    keys = [c for c in crops.columns if c not in columns]
    each = [scores(crops.select(*keys, x), w, x).withColumn("arm", F.lit(name)) for name, (w, x) in arms.items()]
    return reduce(DataFrame.unionByName, each)


def to_rows(w: dict[str, np.ndarray]) -> list[tuple[str, list[int], list[float]]]:
    """Weights as rows of a table (name, shape, x)."""
    return [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(w.items())]


def from_rows(rows: list) -> dict[str, np.ndarray]:
    """Weights from rows (name, shape, x); layers that are missing or of another shape are an error."""
    w = {name: np.asarray(x, float).reshape(shape) for name, shape, x in rows}
    want = {k: v.shape for k, v in weights(0).items()}
    if {k: v.shape for k, v in w.items()} != want:
        raise ValueError(f"layers differ: {sorted(set(want) ^ set(w)) or [k for k in want if w[k].shape != want[k]]}")
    return w


def speed(w: dict[str, np.ndarray], batch: int, rounds: int = 5) -> float:
    """Seconds for each crop in batches of a size on one core: the median of rounds after a warm-up."""
    x = np.random.default_rng(0).standard_normal((batch, 2048))
    times = []
    for _ in range(rounds + 1):
        began = time.perf_counter()
        forward(w, x)
        times.append(time.perf_counter() - began)
    return float(np.median(times[1:])) / batch
