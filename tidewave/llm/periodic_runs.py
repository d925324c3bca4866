"""Periodic run detection (operator 12): stretches in which the same few words come again and again.

A run is a stretch of words with a smallest period q, at least `exponent` periods and `least` words long, that no neighbour
extends. Its pairs of words p apart are equal over at least exponent - 1 periods, so they cover that many points in a
row of any grid of spacing p. For each period p the grid's neighbours, jp and (j + 1)p, are compared (harmonic grid: n / p points for each
p, so n log n in all); from pairs that begin so many equal ones, a forward and a backward longest common extension give
the whole stretch of period p. An extension is the minimum of the common prefixes between two ranks of the
suffix array, from a sparse table; backward, of the reversed words. A stretch found under several periods
has the smallest; the others are its multiples, as it is two of them long.

Suffixes are sorted by doubling; the ranks at each doubling also give the common prefixes of neighbours. Arrays are built
for a slice of texts at once, and only for texts with such pairs; equal words of different texts have different
numbers, so no extension leaves its text. Memory is about 8 * log2(n) + 100 bytes for each of a slice's n words, a slice being
1 MB of texts or one longer text.

Null and empty texts have no words, hence no runs and an empty collapsed text. Repeated rows each give a row, null ids
too; other columns are ignored. An empty table gives no row. Ties (several runs with the same start) stay apart, by period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm import _text
from tidewave.llm._spark import map_texts

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions to the right within an array of small numbers."""

    def __init__(self, x: np.ndarray):
        n = self.n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels, width = [rank.astype(np.int32)], 1
        order = np.argsort(rank, kind="stable")
        while rank[order[-1]] < n - 1:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1  # what ends earlier comes first
            order = np.argsort(key, kind="stable")
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            levels.append(rank.astype(np.int32))
            width *= 2
        self.rank = rank
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            own = np.append(levels.pop(), -1)  # the top level tells all apart
            same = (a < n) & (b < n) & (own[np.minimum(a, n)] == own[np.minimum(b, n)])
            common += same.astype(np.int32) << k
            a += same.astype(np.int64) << k
            b += same.astype(np.int64) << k
        self.least = [common]
        while 2 << len(self.least) - 1 <= len(common):
            last, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j on are equal, for different i and j; 0 beyond the end."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.rank[i[inside]], self.rank[j[inside]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        size = np.frexp((hi - lo).astype(np.float64))[1] - 1  # whole part of the binary logarithm
        for k in np.unique(size):
            of = size == k
            out[inside[of]] = np.minimum(self.least[k][lo[of]], self.least[k][hi[of] - (1 << int(k))])
        return out


def grid_pairs(x: np.ndarray, longest: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): grid points from which exponent - 1 neighbours in a row are equal, for periods that fit in `longest` words."""
    places, periods = [], []
    for p in range(1, longest // exponent + 1):
        grid = x[::p]
        same = grid[1:] == grid[:-1]
        row = same[: len(same) - exponent + 2]
        for k in range(1, exponent - 1):
            row = row & same[k : len(same) - exponent + 2 + k]
        found = np.flatnonzero(row)
        if len(found):
            places.append(found * p)
            periods.append(np.full(len(found), p))
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def find_runs(x: np.ndarray, firsts: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (start, end, period) of the runs of texts that begin at `firsts` in x and share no number, by start, then period."""
    sizes = np.diff(np.append(firsts, len(x)))
    place, period = grid_pairs(x, int(sizes.max(initial=0)), exponent)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    hit = np.unique(np.searchsorted(firsts, place, side="right") - 1)  # the texts that have such pairs
    keep = np.repeat(np.isin(np.arange(len(firsts)), hit), sizes)
    own = x[keep]
    shift = np.cumsum(~keep)  # how far each word of a kept text moves
    i = place - shift[place]
    j = i + period
    ahead = Extensions(own)(i, j)
    back = Extensions(own[::-1])(len(own) - i, len(own) - j)
    start, end = place - back, place + period + ahead
    long = end - start >= np.maximum(exponent * period, least)
    found = np.unique(np.stack((start, end, period), axis=1)[long], axis=0)  # ascending, so the smallest period of a stretch is first
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, equal only for equal words of the same text, and where the texts start."""
    numbers, firsts, base = [], [], 0
    for own in words:
        firsts.append(len(numbers))
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, base + len(known)) for w in own]
        base += len(known)
    return np.asarray(numbers, np.int64), np.asarray(firsts, np.int64)


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    kept = np.ones(len(words), bool)
    for start, end, period in runs:
        kept[start + period : end] = False
    return b" ".join([words[k] for k in np.flatnonzero(kept)])


def _detect(texts: list[bytes], exponent: int, least: int) -> list[tuple[list[dict], bytes]]:
    """For each text its runs, and the text with each run's later periods taken out."""
    words = [t.split() for t in texts]  # bytes split at space and tab to carriage return, nowhere else
    x, firsts = _numbered(words)
    found = find_runs(x, firsts, exponent, least)
    of = np.searchsorted(firsts, found[:, 0], side="right") - 1 if len(found) else np.zeros(0, np.int64)
    # a text without words starts where the next does, and has no run
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for k, own in enumerate(words):
        runs = found[edges[k] : edges[k + 1]] - [firsts[k], firsts[k], 0]
        kept = _collapsed(own, runs) if len(runs) else b" ".join(own)
        out.append(([{"start": s, "length": e - s, "period": p} for s, e, p in runs.tolist()], kept))
    return out


def detect(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text in order, and its words, one space between, without each run's later periods."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            offsets, data = _text.buffers(column)
            runs, kept = [], []
            for i, j in _text.slices(offsets):
                texts = [data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)]
                for own, rest in _detect(texts, exponent, least):
                    runs.append(own)
                    kept.append(rest)
            collapsed = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, _RUNS), collapsed], names=["doc_id", "runs", "collapsed"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row for each text: how many runs, the longest, and checksums of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_l"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("_l.length") / F.col("_l.period"))
    return out.select("doc_id", "n_runs", "_l.start", "_l.length", "_l.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the tenth of the texts whose id's checksum ends in 0, the words from a place on repeat themselves.

    With h the checksum of the id's digits and g = h div 10, word i >= a = g % n becomes word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")

    def repeating(w: Column) -> Column:
        a = F.col("_g") % F.size(w)
        plan = F.struct(a.alias("a"), (1 + F.floor((F.size(w) - a) / (3 + F.col("_g") % 8))).alias("p"))
        return F.transform(F.array(plan), lambda s: F.array_join(F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))[0]

    own = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeating(w)).otherwise(F.lit("")))[0]  # bound once
    return own.select("doc_id", F.when((F.col("_h") % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
