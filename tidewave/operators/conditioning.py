"""Treatments of strain buffers, as gains by frequency.

A block's whitening comes from the block before it, so nothing that is treated shapes its own filter. Numpy functions are
pure; those on DataFrames take Arrow batches row by row (Spark bounds a batch by bytes, 64 MB unless set otherwise).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import arrays
from tidewave.operators import signal

#: The four treatments of a buffer.
ARMS = ("raw", "bp", "wh", "full")


@dataclass(frozen=True)
class Geometry:
    """Samples a second, of a buffer, where its crop starts, the crop's samples, band, whitening from, filter taps."""

    rate: float = 2048.0
    length: int = 8192
    start: int = 3072
    size: int = 2048
    low: float = 30.0
    high: float = 350.0
    flow: float = 15.0
    taps: int = 1024
    order: int = 256
    segment: int = 8192

    @property
    def crop(self) -> slice:
        return slice(self.start, self.start + self.size)


def filter_of(before: np.ndarray, g: Geometry) -> np.ndarray:
    """The spectrum to whiten buffers with, from the samples of the block before."""
    segment = min(g.segment, len(before))
    return signal.truncated_inverse(signal.welch(before, segment, segment // 2), g.length, g.taps, g.flow / (g.rate / 2))


def band_gain(g: Geometry, length: int) -> np.ndarray:
    """The band-pass as a gain: the transform of its taps around sample 0, real as they are symmetric."""
    impulse = np.zeros(length)
    impulse[0] = 1
    centred = np.roll(signal.band_pass(np.roll(impulse, length // 2), g.rate, g.low, g.high, g.order), -(length // 2))
    return np.fft.rfft(centred).real


def gains(psd: np.ndarray | None, g: Geometry, length: int | None = None) -> dict[str, np.ndarray]:
    """The gain of each treatment at the frequencies of a buffer; without a spectrum, of those that need none.

    Every treatment multiplies a buffer's transform by numbers that the buffer has no part in, so all are linear.
    """
    length = length or g.length
    out = {"raw": np.ones(length // 2 + 1), "bp": band_gain(g, length)}
    if psd is not None:
        out["wh"] = 1 / np.sqrt(psd)
        out["full"] = out["wh"] * out["bp"]
    return out


def treated(x: np.ndarray, gain: np.ndarray, g: Geometry) -> np.ndarray:
    """The crops of one or more buffers under a gain."""
    return np.fft.irfft(np.fft.rfft(x) * gain, x.shape[-1])[..., g.crop]


def leaky(x: np.ndarray, g: Geometry, segment: int | None = None) -> np.ndarray:
    """The negative control: a buffer whitened by its own spectrum, so a signal in it shapes its filter."""
    segment = segment or g.length // 4
    own = signal.truncated_inverse(signal.welch(x, segment, segment // 2), len(x), g.taps)
    return treated(x, gains(own, g, len(x))["full"], g)


def conditioned(buffers: DataFrame, g: Geometry, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """buffers (x, before, ...) with the crops x_raw, x_bp, x_wh and x_full in place of x and before, in one pass.

    Rows without a whole buffer or, where a treatment whitens, without a predecessor get nulls.
    """
    names = [c for c in buffers.columns if c not in ("x", "before")]

    def run(parts):
        for p in parts:
            out = []
            for x, before in zip(p["x"], p["before"], strict=True):
                if x is None or len(x) != g.length:
                    out.append([None] * len(arms))
                    continue
                psd = filter_of(np.asarray(before, float), g) if before is not None and len(before) else None
                found = gains(psd, g)
                out.append([treated(np.asarray(x, float), found[a], g) if a in found else None for a in arms])
            yield pd.concat([p[names].reset_index(drop=True), pd.DataFrame({f"x_{a}": [r[i] for r in out] for i, a in enumerate(arms)}, dtype=object)], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in buffers.schema if f.name in names)
    return buffers.mapInPandas(run, ", ".join([kept, *(f"x_{a} array<double>" for a in arms)]))


def norms(crops: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """One row: for each treatment, one over the mean deviation of the noise crops given."""
    return crops.agg(*((1 / F.avg(arrays.deviation(F.col(f"x_{a}")))).alias(f"norm_{a}") for a in arms))


def scaled(crops: DataFrame, scale: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """crops times the norms (one row), as floats."""
    joined = crops.crossJoin(F.broadcast(scale))
    times = lambda a: F.transform(f"x_{a}", lambda e: (e * F.col(f"norm_{a}")).cast("float"))
    return joined.withColumns({f"x_{a}": times(a) for a in arms}).drop(*scale.columns)


def fitting_factor(h: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """The largest match of each waveform with a bank."""
    return signal.matches(h, bank).max(axis=1)


def recovered_snr(x: np.ndarray, h: np.ndarray, psd: np.ndarray, rate: float, low: float, high: float) -> float:
    """The SNR of a known waveform in a buffer: the largest |<x, h>| / sqrt(<h, h>) over phase and time, weighted by one over psd within a band."""
    n = len(x)
    f = np.fft.rfftfreq(n, 1 / rate)
    fine = np.interp(f, np.linspace(0, rate / 2, len(psd)), psd)
    weight = np.where((f >= max(low, 1e-9)) & (f <= high) & (fine > 0), 1 / np.maximum(fine, np.finfo(float).tiny), 0)
    a, b = np.fft.rfft(x), np.fft.rfft(h)
    norm = np.sqrt(4 / (rate * n) * (np.abs(b) ** 2 * weight).sum())
    full = np.zeros(n, complex)
    full[: len(f)] = a * np.conj(b) * weight
    return float(np.abs(np.fft.ifft(full) * n).max() * 4 / (rate * n) / norm)
