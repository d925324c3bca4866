"""Matched filtering of crops with a bank of waveforms, in the metric of the noise that came before them.

Everything about a block is made once from the block before it: the treatment's gain, how loud treated noise is at each
frequency of the band, and how each template answers to that noise. Crops and templates are then short vectors over the band.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import conditioning, signal
from tidewave.operators.conditioning import Geometry

#: Fixed value: the saturation of a crop in deviations.
SATURATION = 20.0


@dataclass
class Noise:
    """What a block's predecessor tells: the gain, the band's frequencies, the mean power of treated crops there, and their spectra over its root."""

    g: Geometry
    gain: np.ndarray
    band: np.ndarray
    power: np.ndarray
    spectra: np.ndarray

    @property
    def size(self) -> int:
        """Crops are padded to twice their length, so that no lag wraps round."""
        return 2 * self.g.size

    def seen(self, crops: np.ndarray) -> np.ndarray:
        """Crops as spectra over the band in which noise has equal power everywhere."""
        return np.fft.rfft(crops, self.size)[..., self.band] / np.sqrt(self.power)

    def turns(self, lags: np.ndarray) -> np.ndarray:
        """[frequency, lag]: the phase by which a lag turns a frequency."""
        return np.exp(2j * np.pi * np.outer(self.band, lags) / self.size)


def noise_of(before: np.ndarray, g: Geometry, most: int = 64) -> Noise:
    """From crops that begin every half crop, or `most` of them evenly.

    The power of one frequency over crops of noise has a median of ln 2 times its mean, whatever a few loud crops add; its
    logarithm is averaged over nine neighbours.
    """
    gain = conditioning.gains(conditioning.filter_of(before, g), g)["full"]
    room = len(before) - g.length
    starts = np.linspace(0, room, min(most, room // (g.size // 2) + 1)).astype(int)
    crops = conditioning.treated(np.stack([before[s : s + g.length] for s in starts]), gain, g)
    f = np.fft.rfftfreq(2 * g.size, 1 / g.rate)
    band = np.flatnonzero((f >= g.low) & (f <= g.high))
    raw = np.fft.rfft(crops, 2 * g.size)[:, band]
    level = np.log(np.maximum(np.median(np.abs(raw) ** 2, axis=0) / np.log(2), np.finfo(float).tiny))
    box = np.ones(min(9, len(band)))
    power = np.exp(np.convolve(level, box, "same") / np.convolve(np.ones(len(band)), box, "same"))
    return Noise(g, gain, band, power, raw / np.sqrt(power))


@dataclass
class Bank:
    """Templates over the band, scaled so that noise gives each quadrature a deviation of 1; the part of the power that each frequency has, and its bin."""

    noise: Noise
    templates: np.ndarray
    share: np.ndarray
    bin: np.ndarray
    bins: int

    def one(self, k: int) -> Bank:
        return Bank(self.noise, self.templates[k : k + 1], self.share[k : k + 1], self.bin[k : k + 1], self.bins)


def bank_of(noise: Noise, waves: np.ndarray, bins: int = 8, lags: int = 16) -> Bank:
    """The bank of some waveforms, one buffer in a row.

    Each template is scaled by its own answer to the crops of noise: the root mean square over a few lags about 0, where
    crop and template lie over each other, and of these the median over crops.
    """
    own = noise.seen(conditioning.treated(np.atleast_2d(waves), noise.gain, noise.g))
    power = np.abs(own) ** 2
    total = power.sum(axis=1, keepdims=True)
    if not (total > 0).all():
        raise ValueError(f"templates without power in band: {np.flatnonzero(~(total[:, 0] > 0)).tolist()}")
    own, share = own / np.sqrt(total), power / total
    turned = np.conj(own)[:, :, None] * noise.turns(np.linspace(-noise.g.size // 4, noise.g.size // 4, lags).round())
    answer = np.abs(np.tensordot(noise.spectra, turned, axes=(1, 1))) ** 2  # crop, template, lag
    deviation = np.median(np.sqrt(answer.mean(axis=2) / 2), axis=0)
    middle = np.cumsum(share, axis=1) - share / 2  # a frequency is in the bin that holds the middle of its power
    return Bank(noise, own / deviation[:, None], share, np.minimum((bins * middle).astype(int), bins - 1), bins)


def chisq_of(products: np.ndarray, lag: np.ndarray, bank: Bank) -> np.ndarray:
    """For each template the reduced chi-square of its bins at a lag: how far what each adds to the peak is from its part of the power."""
    turned = products * bank.noise.turns(lag).T
    whole = turned.sum(axis=1)
    off, used = np.zeros(len(products)), np.zeros(len(products), int)
    for b in range(bank.bins):
        inside = bank.bin == b
        part = (bank.share * inside).sum(axis=1)
        there = part > 0
        gap = np.abs((turned * inside).sum(axis=1) - part * whole) ** 2
        off[there] += gap[there] / part[there]
        used += there
    return off / np.maximum(2 * used - 2, 1)


def score(crop: np.ndarray, bank: Bank) -> tuple[float, float, int, int, float]:
    """rho, chi-square, lag and template at the largest rho, and the largest re-weighted rho of any template, maybe another."""
    noise = bank.noise
    products = noise.seen(np.clip(crop, -SATURATION, SATURATION)) * np.conj(bank.templates)
    wide = np.zeros((len(products), noise.size), complex)
    wide[:, noise.band] = products
    z = np.abs(np.fft.ifft(wide, axis=1)) * noise.size
    lag = z.argmax(axis=1)
    rho = z.max(axis=1)
    chisq = chisq_of(products, lag, bank)
    best = int(rho.argmax())
    return float(rho[best]), float(chisq[best]), int(lag[best]), best, float(signal.new_snr(rho, chisq).max())


def quadratures(crops: np.ndarray, bank: Bank, lags: np.ndarray) -> np.ndarray:
    """[crop, template, lag]: the complex answers, whose real and imaginary parts have mean 0 and deviation 1 on noise."""
    turned = np.conj(bank.templates)[:, :, None] * bank.noise.turns(lags)
    return np.tensordot(bank.noise.seen(np.clip(crops, -SATURATION, SATURATION)), turned, axes=(-1, 1))


def calibration(blocks: DataFrame, templates: np.ndarray, g: Geometry, starts: tuple[int, ...], keys: list[str], lags: tuple[int, ...] = tuple(range(-512, 513, 89))) -> DataFrame:
    """(*keys, n, sd_real, sd_imaginary): how the quadratures of noise spread in blocks (x, before) that calibrated nothing; near 1 if the calibration carries over."""
    shared = blocks.sparkSession.sparkContext.broadcast(templates)  # a bank is small by its rule
    names = [c for c in blocks.columns if c not in ("x", "before")]

    def run(parts):
        for p in parts:
            rows = []
            for x, before in zip(p["x"], p["before"], strict=True):
                noise = noise_of(np.asarray(before, float), g)
                crops = conditioning.treated(np.stack([np.asarray(x, float)[s : s + g.length] for s in starts]), noise.gain, g)
                z = quadratures(crops, bank_of(noise, shared.value), np.array(lags))
                rows.append((z.size, z.real.sum(), (z.real**2).sum(), z.imag.sum(), (z.imag**2).sum()))
            yield pd.concat([p[names].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "a", "aa", "b", "bb"])], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name in names)
    whole = blocks.where(f"before is not null and x is not null and size(before) >= {g.length} and size(x) >= {max(starts) + g.length}")
    sums = whole.mapInPandas(run, f"{kept}, n long, a double, aa double, b double, bb double").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "a", "aa", "b", "bb")))
    sd = lambda s, ss: F.sqrt(F.col(ss) / F.col("n") - F.pow(F.col(s) / F.col("n"), F.lit(2)))
    return sums.select(*keys, "n", sd("a", "aa").alias("sd_real"), sd("b", "bb").alias("sd_imaginary"))


def scored(blocks: DataFrame, templates: np.ndarray, g: Geometry, starts: tuple[int, ...], truth: bool = False) -> DataFrame:
    """For each block (x, before, ...) and each start of a buffer in it: start, rho, chisq, lag, template, rhotilde.

    truth: blocks have a column `own` with waveforms, one for each start or null, and rho_oracle is the score of that alone.
    Blocks without a predecessor have no filter and give no rows.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(templates)  # a bank is small by its rule
    names = [c for c in blocks.columns if c not in ("x", "before", "own")]

    def of_block(x: np.ndarray, before: np.ndarray, own: list | None):
        noise = noise_of(before, g)
        bank = bank_of(noise, shared.value)
        known = [k for k in range(len(starts)) if own is not None and own[k] is not None]
        oracle = bank_of(noise, np.stack([np.asarray(own[k], float) for k in known])) if known else None
        crops = conditioning.treated(np.stack([x[s : s + g.length] for s in starts]), noise.gain, g)
        for k, s in enumerate(starts):
            yield s, *score(crops[k], bank), score(crops[k], oracle.one(known.index(k)))[0] if k in known else None

    def run(parts):
        for p in parts:
            rows = []
            for i in range(len(p)):
                x, before = (np.asarray(p[c].iloc[i], float) for c in ("x", "before"))
                rows += [(*p[names].iloc[i], *r) for r in of_block(x, before, p["own"].iloc[i] if truth else None)]
            yield pd.DataFrame(rows, columns=[*names, "start", "rho", "chisq", "lag", "template", "rhotilde", "rho_oracle"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name in names)
    whole = blocks.where(f"before is not null and x is not null and size(before) >= {g.length} and size(x) >= {max(starts) + g.length}")
    return whole.mapInPandas(run, f"{kept}, start int, rho double, chisq double, lag int, template int, rhotilde double, rho_oracle double")
