"""Benchmark decontamination: a BM25 inverted index of test items with block-max pruning (operator 9).

Every training text is cut into half-passages of `stride` words; two neighbours make a passage,
so that each item of at most `stride` words lies whole in some passage (stride is at least the
longest item's length). Each passage queries the index with its distinct words:

1. The largest impact of each word over all items bounds a passage, then its words' largest impacts in
   each block of items do; a passage without a block that may reach the threshold is done.
2. The others run block-max WAND: cursors stand in the words' postings, in the order of their items. The
   pivot is the first item that the words so far can lift to the threshold by their largest impacts. If
   the impacts of its block cannot, the cursors skip to the end of the block, else to the pivot.
3. An item that all cursors before the pivot have reached is scored exactly. All items at or above the
   threshold are retrieved.
4. The last sentence of a retrieved item counts as its answer, what comes before as its question. It is a
   leak in each of these cases: at least `overlap` of the item's five-word shingles and half of its
   answer's words stand in the passage; `overlap` of the question's shingles (of five words or more) and
   half of the answer's words stand in the passage, whatever is between them; or `overlap` of the question's
   and of the answer's shingles stand in the text, however far apart. Both overlaps are returned.

Impacts are BM25 weights over all items, divided by the item's score for its own text: a passage
with the whole item scores 1, whatever the item's length. Of a question and an answer that stand whole
but far apart, one has half of the item's weight, so a threshold of 0.5 retrieves the item; with a
higher one, or with parts far apart that are not whole, either has to reach the threshold by itself.

The index is built in Spark and broadcast in shards of about `shard_bytes` of postings and item texts, so what
one task holds is bounded: there is one scan of the passages for each shard, and one shard at a time. Statistics
are over all items. Texts and items that are null or have no words match nothing; repeated rows of docs match
again; one item_id with several texts stands for each of them, and a row of it gives the best match of a document;
equal items count once; extra columns are kept by clean() and ignored by hits().
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm import _text
from tidewave.llm._spark import cut, map_texts

K1, B = 1.2, 0.75
#: A shard has about so many blocks of items, of two items at least.
BLOCKS = 128
#: Bytes of texts that are looked at together.
_SLICE = 1 << 18
#: Block bounds are summed for so many cells (half-passages by blocks) at once.
_CELLS = 1 << 19


@dataclass
class Shard:
    stride: int
    width: int  # items of a block
    items: list[int]
    questions: list[np.ndarray]  # shingles
    long: list[bool]  # whether the question has five words
    answers: list[np.ndarray]  # words
    answer_shingles: list[np.ndarray]
    wholes: list[np.ndarray]  # shingles
    words: np.ndarray  # ascending hashes
    most: np.ndarray  # largest impact of each word
    first: np.ndarray  # of each word's postings
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    lists: dict = field(default_factory=dict)  # each word's postings as lists, as far as they were used


def words_of(texts: list[str]) -> list[np.ndarray]:
    return [w for _, w in _text.texts_in(pa.array(texts, pa.large_string()), _text.LETTERS_DIGITS)]


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what comes before the question; of one sentence, both are it."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _postings(batches):
    for batch in batches:
        ids, found, counts, lengths = [], [], [], []
        column = batch.column("item").to_pylist()
        for row, words in _text.texts_in(batch.column("text"), _text.LETTERS_DIGITS):
            word, n = np.unique(words, return_counts=True)
            ids += [column[row]] * len(word)
            found.append(word.view(np.int64))
            counts.append(n)
            lengths += [len(words)] * len(word)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(flat(found), pa.int64()), pa.array(flat(counts), pa.int64()), pa.array(lengths, pa.int64())],
            names=["item", "word", "tf", "length"],
        )


def shards(benchmark: DataFrame, shard_bytes: int = 64 << 20):
    """The shards of the index of benchmark (item_id, text), one at a time: each holds about shard_bytes."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = cut(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"))
    postings = cut(map_texts(items.select("item", "text"), _postings, "item long, word long, tf long, length long"))
    by_item = postings.groupBy("item").agg(F.max("length").alias("length"), F.count("*").alias("words"))
    total = by_item.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest"), F.sum("words").alias("words")).first()
    if not total["n"]:
        return
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    weighed = postings.join(df, "word").withColumn(
        "weight",
        F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / total["mean"]))),
    )
    own = weighed.groupBy("item").agg(F.sum("weight").alias("own"))
    impacts = cut(weighed.join(own, "item").select("item", "word", (F.col("weight") / F.col("own")).alias("impact")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    count = -(-(64 * total["words"] + 2 * size) // shard_bytes)
    for s in range(count):
        part = F.pmod(F.xxhash64("item_id"), F.lit(count)) == s
        own = items.where(part)
        texts = own.orderBy("item_id", "text").collect()  # about shard_bytes
        rows = impacts.join(own.select("item"), "item", "left_semi").toArrow().to_pandas()
        if len(rows):
            yield _shard(max(64, total["longest"]), texts, rows)


def _shard(stride: int, texts: list, rows) -> Shard:
    width = max(2, -(-len(texts) // BLOCKS))
    ids = [r["item_id"] for r in texts]
    number = {r["item"]: i for i, r in enumerate(texts)}
    item = rows["item"].map(number).to_numpy(dtype=np.int64)
    word = rows["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.lexsort((item, word))
    item, word, impact = item[order], word[order], rows["impact"].to_numpy(dtype=np.float64)[order]
    words, first = np.unique(word, return_index=True)
    first = np.append(first, len(word))
    most = np.maximum.reduceat(impact, first[:-1])
    place = np.searchsorted(words, word)
    blocks = len(ids) // width + 1
    keys, start = np.unique(place * blocks + item // width, return_index=True)
    block_impact = np.maximum.reduceat(impact, start)
    parts = [question_answer(r["text"]) for r in texts]
    questions, answers = words_of([q for q, _ in parts]), words_of([a for _, a in parts])
    return Shard(
        stride, width, ids, [_text.shingles(w, 5) for w in questions], [len(w) >= 5 for w in questions], [np.unique(w) for w in answers], [_text.shingles(w, 5) for w in answers],
        [_text.shingles(w, 5) for w in words_of([r["text"] for r in texts])], words, most, first, item, impact,
        np.searchsorted(keys // blocks, np.arange(len(words) + 1)), keys % blocks, block_impact,
    )


def _gather(first: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The places of all postings of the terms."""
    n = first[terms + 1] - first[terms]
    return np.repeat(first[terms] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(terms) else np.zeros(0, np.int64)


def _lists(shard: Shard, term: int) -> tuple:
    """A word's items (ending with one beyond all), impacts, and largest impact by block."""
    if term not in shard.lists:
        lo, hi = shard.first[term], shard.first[term + 1]
        a, b = shard.block_first[term], shard.block_first[term + 1]
        blocks = dict(zip(shard.block[a:b].tolist(), shard.block_impact[a:b].tolist(), strict=True))
        shard.lists[term] = ([*shard.item[lo:hi].tolist(), len(shard.items)], shard.impact[lo:hi].tolist(), blocks)
    return shard.lists[term]


def retrieve(shard: Shard, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """Block-max WAND: all items that a passage with these distinct terms scores at or above the threshold, and their scores."""
    threshold -= 1e-9
    none = len(shard.items)
    # one cursor for each term: its item now, largest impact, place, items, impacts, largest impacts by block
    cursors = [[own[0][0], float(shard.most[t]), 0, *own] for t in terms.tolist() for own in (_lists(shard, t),)]
    found = []

    def to(c: list, item: int) -> None:
        c[2] = bisect_left(c[3], item, c[2])
        c[0] = c[3][c[2]]

    while True:
        cursors.sort(key=_item_of)
        most, pivot = 0.0, -1
        for pivot, c in enumerate(cursors):  # noqa: B007
            most += c[1]
            if most >= threshold or c[0] == none:
                break
        if most < threshold or cursors[pivot][0] == none:
            return found
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // shard.width
        if sum(c[5].get(block, 0.0) for c in cursors[: pivot + 1]) < threshold:
            end = min((block + 1) * shard.width, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else none)
            for c in cursors[: pivot + 1]:
                to(c, end)
        elif cursors[0][0] == item:
            score = sum(c[4][c[2]] for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((item, score))
            for c in cursors[: pivot + 1]:
                to(c, item + 1)
        else:
            for c in cursors[: pivot + 1]:
                if c[0] < item:
                    to(c, item)


def _item_of(cursor: list) -> int:
    return cursor[0]


def _may_reach(shard: Shard, half: np.ndarray, term: np.ndarray, last: np.ndarray, threshold: float) -> np.ndarray:
    """The half-passages h that make, with h + 1 unless h is a text's last, a passage that some block of items may lift to the threshold."""
    n = len(last)
    bound = np.bincount(half, weights=shard.most[term], minlength=n + 1)
    pair = bound[:n] + np.where(last, 0, bound[1:])
    first = np.flatnonzero(pair >= threshold - 1e-9)
    if not len(first):
        return first
    blocks = len(shard.items) // shard.width + 1
    step = max(2, _CELLS // blocks)
    at = np.searchsorted(half, np.arange(n + 2))
    good = []
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        own = first[(first >= lo) & (first < hi)]
        if not len(own):
            continue
        part = slice(at[lo], at[hi + 1])
        size = shard.block_first[term[part] + 1] - shard.block_first[term[part]]
        places = _gather(shard.block_first, term[part])
        cells = (np.repeat(half[part], size) - lo) * blocks + shard.block[places]
        sums = np.bincount(cells, weights=shard.block_impact[places], minlength=(hi - lo + 1) * blocks).reshape(-1, blocks)
        both = sums[own - lo] + np.where(last[own, None], 0, sums[own - lo + 1])
        good.append(own[both.max(axis=1) >= threshold - 1e-9])
    return np.concatenate(good) if good else first[:0]


def _share(own: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(own, there).mean()) if len(own) else 1.0


def leaks(shard: Shard, column: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of each leak, once for each text and item."""
    offsets, data = _text.buffers(column)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(shard.words):
        return []
    for i, j in _text.slices(offsets, _SLICE):
        lo, hi = offsets[i], offsets[j]
        hashes, first = _text.word_hashes(data[lo:hi], offsets[i : j + 1] - lo, _text.LETTERS_DIGITS)
        if not len(hashes):
            continue
        n = np.diff(first)
        halves = -(-n // shard.stride)
        base = np.concatenate(([0], np.cumsum(halves)))  # each text's first half-passage
        place = np.searchsorted(shard.words, hashes)
        hit = np.flatnonzero(shard.words[np.minimum(place, len(shard.words) - 1)] == hashes)
        text_of = np.repeat(np.arange(j - i), n)[hit]
        half = base[text_of] + (hit - first[text_of]) // shard.stride
        keys = np.unique(half * len(shard.words) + place[hit])
        half, term = np.divmod(keys, len(shard.words))
        last = np.zeros(base[-1], dtype=bool)
        last[base[1:][halves > 0] - 1] = True
        at = np.searchsorted(half, np.arange(base[-1] + 2))
        texts: dict[int, dict] = {}  # the shingles and words of the last text that was looked at whole
        for h in _may_reach(shard, half, term, last, threshold):
            end = h + 1 if last[h] else h + 2
            found = retrieve(shard, np.unique(term[at[h] : at[end]]), threshold)
            if not found:
                continue
            text = int(np.searchsorted(base, h, side="right")) - 1
            start = first[text] + (h - base[text]) * shard.stride
            passage = hashes[start : min(start + 2 * shard.stride, first[text + 1])]
            there = {5: _text.shingles(passage, 5), 1: np.unique(passage)}
            for x, s in found:
                asked, told = _share_any(shard.questions[x], there, passage), _share(shard.answers[x], there[1])
                near = told >= 0.5 and (_share_any(shard.wholes[x], there, passage) >= overlap or shard.long[x] and asked >= overlap)
                if not near:
                    full = hashes[first[text] : first[text + 1]]
                    if text not in texts:
                        texts = {text: {5: _text.shingles(full, 5), 1: np.unique(full)}}
                    asked, told = _share_any(shard.questions[x], texts[text], full), _share(shard.answers[x], texts[text][1])
                    if asked < overlap or _share_any(shard.answer_shingles[x], texts[text], full) < overlap:
                        continue
                seen = (s, asked, told)
                best[i + text, x] = max(best.get((i + text, x), seen), seen)
    return [(r, x, *v) for (r, x), v in sorted(best.items())]


def _share_any(own: np.ndarray, there: dict, passage: np.ndarray) -> float:
    """The share of an item's shingles in the passage; an item of fewer than five words is one shingle, sought as such."""
    if len(own) == 1 and len(passage) >= 5:
        for k in range(1, 5):
            windows = np.lib.stride_tricks.sliding_window_view(passage, k)
            if (_text.short_shingles(windows) == own[0]).any():
                return 1.0
    return _share(own, there[5])


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, shard_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each leak, for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for own in shards(benchmark, shard_bytes):
        out = out if out is None else cut(out)  # so one shard at a time is in memory
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches, shared=shared):
            for batch in batches:
                best: dict[tuple[int, int], tuple] = {}
                for row, x, *seen in leaks(shared.value, batch.column("text"), threshold, overlap):
                    key = row, shared.value.items[x]
                    best[key] = max(best.get(key, tuple(seen)), tuple(seen))
                ids = batch.column("doc_id").take(pa.array([row for row, _ in best], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([x for _, x in best], pa.int64()), *(pa.array([v[k] for v in best.values()], pa.float64()) for k in range(3))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        part = map_texts(texts, run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, shard_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs without a leak, all columns."""
    for number, own in enumerate(shards(benchmark, shard_bytes)):
        docs = cut(docs) if number else docs
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches, shared=shared):
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                good[[x[0] for x in leaks(shared.value, batch.column("text"), threshold, overlap)]] = False
                yield batch.filter(pa.array(good))

        docs = map_texts(docs, run, docs.schema)
    return docs
