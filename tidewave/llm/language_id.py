"""Language identification by prediction by partial matching (operator 8).

For each language, byte contexts of up to three bytes are counted with the bytes that follow (A-Z in lower
case). A context of total t with d different followers gives a follower seen n times the chance n / (t + d) and
escapes to the next shorter context with d / (t + d) (escape method C); below the empty context all 256 bytes are
equally likely. The statistics are frozen, so each byte's exact code length in bits depends on four bytes alone, and
a text's is the sum over the whole text. The language with the shortest code wins, ties to the smaller name.

The contexts of all languages make one tree: a node is a byte string that the sample holds, with its code length
and its escape under each language. A byte is coded by the deepest node that ends with it.

The counts come from a bounded sample of labelled rows: about `sample_rows` for each language
(all, if fewer), drawn by a hash of the row. They are summed in Spark; what comes to the driver
and is broadcast is bounded by the sample's different four-byte strings.

`und` with score 0.0: text null, or without any letter. A text without a sampled language to
compare gets `und` too. Labels that are null or empty tables teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm import _text
from tidewave.llm._spark import map_texts

ORDER = 3
#: Bytes, and what lies before a text.
SYMBOLS, START = 257, 256
#: A byte takes about 200 bytes while it is scored.
SCORED_BYTES = 1 << 17
_LOWER = np.arange(256, dtype=np.uint16)
_LOWER[65:91] += 32


@dataclass
class Model:
    """Level k has the strings of k + 1 symbols, as (number of the string without its last symbol) * width + last symbol.

    At level 0 the symbols themselves are the numbers; all bytes that the sample lacks are one symbol.
    """

    languages: list[str]
    symbol: np.ndarray  # of each byte and of START, below `width`
    width: int
    strings: list[np.ndarray]  # of levels 1 to ORDER, ascending
    bits: list[np.ndarray]  # code lengths of levels 0 to ORDER, by language
    escape: list[np.ndarray]  # bits to leave the contexts of levels 0 to ORDER - 1, by language
    tables: list = field(default_factory=list)

    def numbers(self) -> list[np.ndarray]:
        """For levels 1 to ORDER, the number of each string in a table of all contexts and symbols, -1 if the sample lacks it."""
        if not self.tables:
            contexts = self.width
            for own in self.strings:
                table = np.full((contexts + 1) * self.width, -1, dtype=np.int32)  # the last row is that of unknown contexts, number -1
                table[own] = np.arange(len(own), dtype=np.int32)
                self.tables.append(table)
                contexts = len(own)
        return self.tables

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": []}


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Each place's last four symbols of a text as one number."""
    code = np.concatenate((np.full(ORDER, START), symbols)).astype(np.int64)
    return sum(code[ORDER - back : len(code) - back] * SYMBOLS**back for back in range(ORDER + 1))


def _count_grams(batches):
    for batch in batches:
        offsets, data = _text.buffers(batch.column("text"))
        by = pd.Series(batch.column("lang").to_pylist())
        for lang, rows in by.groupby(by).groups.items():
            total: dict = {}
            for r in rows:
                found, n = np.unique(_grams(_LOWER[data[offsets[r] : offsets[r + 1]]]), return_counts=True)
                for c, k in zip(found.tolist(), n.tolist(), strict=True):
                    total[c] = total.get(c, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["lang", "code", "n"])


def fit(labelled: DataFrame, sample_rows: int = 800) -> Model:
    """A model of the languages of labelled (doc_id, text, lang), from about sample_rows rows of each."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(SYMBOLS, np.int64), 1, [], [], [])
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample_rows / n))) for x, n in sizes.items()])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counts = map_texts(sample.select("text", "lang"), _count_grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()
    return from_counts(languages, *(counts.column(c).to_numpy() for c in ("lang", "code", "n")))


def from_counts(languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """The model of counted strings of four symbols, numbers in base SYMBOLS with the last symbol lowest."""
    number = np.append(np.searchsorted(np.asarray(languages), lang.astype(str)) if len(lang) else np.zeros(0, np.int64), 0)
    code = np.append(code, sum(START * SYMBOLS**k for k in range(ORDER + 1)))  # what lies before a text is a context too
    n = np.append(n, 0)
    parts = [code // SYMBOLS**back % SYMBOLS for back in range(ORDER + 1)]
    seen = np.unique(parts[0][:-1])
    width = len(seen) + 2
    symbol = np.full(SYMBOLS, width - 2, dtype=np.int64)
    symbol[seen] = np.arange(len(seen))
    symbol[START] = width - 1
    parts = [symbol[p] for p in parts]
    strings, bits, escape = [], [], []
    ids, contexts, above, under = parts[0], np.zeros(width, np.int64), 1, np.full((width, len(languages)), 8.0)
    for level in range(ORDER + 1):
        if level:
            own, ids = np.unique(_number(strings, width, parts[1 : level + 1]) * width + parts[0], return_inverse=True)
            contexts, above = own // width, len(bits[level - 1])
            under = bits[level - 1][_number(strings, width, _spelt(strings, width, own, level)[:level])]  # without the first symbol
            strings.append(own)
        each = range(len(languages))
        times = np.stack([np.bincount(ids[number == x], weights=n[number == x], minlength=len(contexts)) for x in each], axis=1)
        total = np.stack([np.bincount(contexts, weights=times[:, x], minlength=above) for x in each], axis=1)
        kinds = np.stack([np.bincount(contexts, weights=times[:, x] > 0, minlength=above) for x in each], axis=1)
        leave = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
        bits.append(np.where(times > 0, np.log2(np.maximum(total + kinds, 1)[contexts] / np.maximum(times, 1)), leave[contexts] + under))
        if level:
            escape.append(leave)
    return Model(languages, symbol, width, strings, bits, escape)


def _number(strings: list[np.ndarray], width: int, parts: list[np.ndarray]) -> np.ndarray:
    """The number of the strings whose symbols, the last first, are in parts; all are known."""
    at = parts[-1]
    for level, p in enumerate(reversed(parts[:-1])):
        at = np.searchsorted(strings[level], at * width + p)
    return at


def _spelt(strings: list[np.ndarray], width: int, own: np.ndarray, level: int) -> list[np.ndarray]:
    """The symbols of a level's strings, the last first."""
    out = []
    for k in range(level, 0, -1):
        out.append(own % width)
        own = own // width
        own = strings[k - 2][own] if k > 1 else own
    return [*out, own]


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    last = model.symbol[_LOWER[data]]
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(starts):
        return out
    ends, before, start = [last], [], int(model.symbol[START])
    for level, table in enumerate(model.numbers()):
        context = np.empty_like(ends[level])
        context[1:] = ends[level][:-1]
        context[starts] = start
        before.append(context)
        rows = len(table) // model.width - 1
        ends.append(table[np.where(context < 0, rows, context) * model.width + last].astype(np.int64))
        start = int(table[start * model.width + model.symbol[START]])
    each = np.zeros((len(last), len(model.languages)))
    rest = np.arange(len(last))
    for level in range(ORDER, -1, -1):
        found = ends[level][rest] >= 0
        there = rest[found]
        each[there] += model.bits[level][ends[level][there]]
        rest = rest[~found]
        if level:
            known = rest[before[level - 1][rest] >= 0]
            each[known] += model.escape[level - 1][before[level - 1][known]]
    out[np.diff(offsets) > 0] = np.add.reduceat(each, starts, axis=0)
    return out


def _scored(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its share of the likelihood of all, for each text."""
    offsets, data = _text.buffers(column)
    best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
    for i, j in _text.slices(offsets, SCORED_BYTES):
        lo, hi = offsets[i], offsets[j]
        bits = code_lengths(model, data[lo:hi], offsets[i : j + 1] - lo)
        best[i:j] = bits.argmin(axis=1)
        score[i:j] = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
    return best, score


def _letters() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score: the best language's share of the likelihood of all, 0 to 1."""
    if not model.languages:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            best, score = _scored(shared.value, batch.column("text"))
            names = pa.array([shared.value.languages[x] for x in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("und"), names, pa.array(score)], names=["doc_id", "und", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.when(_letters(), F.col("text")).alias("text"), (~_letters()).alias("und"))
    out = map_texts(texts, run, f"doc_id {kind}, und boolean, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("und"), "und").otherwise(F.col("lang_pred")).alias("lang_pred"), F.when(F.col("und"), 0.0).otherwise(F.col("score")).alias("score"))


def accept(docs: DataFrame, sample_rows: int = 800, least: float = 0.5) -> DataFrame:
    """The documents in a known language, with that language as lang: those of `und` or with a score below `least` go.

    Without any labelled text to learn from, documents with letters keep the label they have.
    """
    model = fit(docs, sample_rows)
    lettered = docs.where(_letters())
    if not model.languages:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            best, score = _scored(shared.value, batch.column("text"))
            place = batch.schema.get_field_index("lang")
            names = pa.array([shared.value.languages[x] for x in best], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), names).filter(pa.array(score >= least))

    return map_texts(lettered, run, docs.schema)


def is_held_out(doc_id) -> F.Column:
    """Whether the document is kept out of training: crc32 of its id's digits modulo 3 is 1; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def identify(docs: DataFrame, sample_rows: int = 800) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the documents that are not held out, applied to all."""
    model = fit(docs.where(~is_held_out("doc_id")), sample_rows)
    return predict(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
