"""Toxicity by weak supervision (operator 13): many weak voters, a generative model of them, a linear classifier.

Lexicon voters are mined from labelled rows: starts of words and whole words that stand out in toxic texts, voting by presence
or by density, whichever tells more. Pattern voters look at the lexicon as a whole (how many of its words, how dense, how many different
ones), at capitals, exclamation marks and symbols. Each text's votes are bits of one number; texts are counted by it.

The label model is generative: a text is toxic or not, and each vote depends on that and on one other vote (the
strongest tree of conditional mutual information), so votes that go together are not counted twice. It starts from the votes of the labelled
rows and is fitted by expectation-maximisation to the votes of all documents of the training side, labelled or not,
with the share of toxic texts held at that of the labels. Its posterior labels train a logistic regression on votes, counts and rates,
which scores every text by itself.

Bounds, all parameters: the lexicon is mined from about `sample_rows` labelled rows of each kind, where copies and most near
copies count once; the classifier is fitted to about `fit_rows` different texts. The label model's counts cover all documents, equal texts once.

A score needs a text alone. A null or empty text has no votes and gets the score of that. Labels other than 0 and 1, null ids and
ids without a document teach nothing; of several labels of an id the larger counts. Repeated rows are rows like others. Without
labels of both kinds nothing can be learnt: all scores are the share of toxic labels (0 without any). Other columns are ignored; an
empty table gives no row. Ties among patterns go to the longer, then to the smaller one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm import _text
from tidewave.llm._spark import cut, map_texts

WORD = re.compile(r"[^\W\d_]+")
#: Starts of words of so many letters are patterns, and whole words.
STARTS = range(3, 9)
#: A lexicon voter needs so many toxic texts and so large a likelihood ratio statistic.
SUPPORT, EVIDENCE = 4, 25.0
#: A vote by density takes two words and a hundredth of all.
DENSE = 0.01
LEXICON = 48
PATTERNS = ("dense lexicon", "three of lexicon", "very dense lexicon", "two different", "three different", "capitals", "exclamations", "symbols")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|@^~"]] = True


@dataclass
class Lexicon:
    """Patterns, `word$` for whole words, and whether each votes by density."""

    patterns: list[str]
    dense: np.ndarray

    @property
    def voters(self) -> int:
        return len(self.patterns) + len(PATTERNS)

    def automaton(self) -> ahocorasick.Automaton:
        by_letters: dict[str, list[tuple[int, bool]]] = {}
        for k, p in enumerate(self.patterns):
            by_letters.setdefault(p.rstrip("$"), []).append((k, p.endswith("$")))
        found = ahocorasick.Automaton()
        for letters, entries in by_letters.items():
            found.add_word(letters, (len(letters), entries))
        if by_letters:
            found.make_automaton()
        return found


@dataclass
class LabelModel:
    """share: of toxic texts; parent: of each voter, -1 at the root; table[y, i, u, v]: log of the chance that voter i votes v if its parent votes u.

    The first `abstaining` voters abstain if they do not vote, which tells nothing: a text has the words of one language.
    """

    share: float
    parent: np.ndarray
    table: np.ndarray
    abstaining: int = 0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        each = np.arange(votes.shape[1])
        told = (votes == 1) | (each >= self.abstaining)
        odds = np.log(self.share / (1 - self.share)) + ((self.table[1][each, above, votes] - self.table[0][each, above, votes]) * told).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self, moments: np.ndarray) -> np.ndarray:
        """(voter, 2): how often a voter is silent on texts that are not toxic, and votes on toxic ones."""
        rate = np.stack([np.diag(m) for m in moments[:, :-1, :-1]]) / moments[:, -1, -1][:, None]
        return np.stack((1 - rate[0], rate[1]), axis=1)


# Voters


def measures(lexicon: Lexicon, automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how often each pattern occurs, and its words, capitals, exclamation marks, symbols and bytes."""
    offsets, data = _text.buffers(column)
    counts = np.zeros((len(column), len(lexicon.patterns)), np.int32)
    rest = np.zeros((len(column), 5))
    for r in range(len(column)):
        own = data[offsets[r] : offsets[r + 1]]
        text = own.tobytes().decode()
        rest[r] = len(text.split()), ((own >= 65) & (own <= 90)).sum(), (own == 33).sum(), _SYMBOL[own].sum(), len(own)
        if not lexicon.patterns:
            continue
        text = text.lower()
        for end, (size, entries) in automaton.iter(text):
            first = end + 1 - size
            if first and text[first - 1].isalpha():
                continue
            whole = end + 1 == len(text) or not text[end + 1].isalpha()
            for k, needs_whole in entries:
                counts[r, k] += whole or not needs_whole
    return counts, rest


def votes_of(lexicon: Lexicon, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """0 or 1 of each voter for each text, the lexicon's first."""
    words = np.maximum(rest[:, 0], 1)
    own = np.where(lexicon.dense, (counts >= 2) & (counts >= DENSE * words[:, None]), counts >= 1)
    total, different = counts.sum(axis=1), (counts > 0).sum(axis=1)
    patterns = (
        (total >= 2) & (total >= DENSE * words),
        total >= 3,
        (total >= 2) & (total >= 3 * DENSE * words),
        different >= 2,
        different >= 3,
        rest[:, 1] > 0.3 * np.maximum(rest[:, 4], 1),
        rest[:, 2] > 0.2 * words,
        rest[:, 3] > 0.2 * words,
    )
    return np.column_stack((own, *patterns)).astype(np.int64)


def features_of(votes: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What the classifier sees of a text."""
    words, total = np.maximum(rest[:, 0], 1), counts.sum(axis=1)
    rates = np.minimum(100 * total / words, 10), np.log1p(total), np.minimum(rest[:, 1] / np.maximum(rest[:, 4], 1), 1), np.minimum(rest[:, 2] / words, 1), np.minimum(rest[:, 3] / words, 4), np.log1p(rest[:, 0])
    return np.column_stack((votes, np.minimum(counts, 5), *rates))


def _numbers(votes: np.ndarray) -> np.ndarray:
    return (votes << np.arange(votes.shape[1])).sum(axis=1)


def _bits(numbers: np.ndarray, voters: int) -> np.ndarray:
    return (numbers[:, None] >> np.arange(voters)) & 1


# Mining


def _patterns(text: str) -> tuple[dict[str, int], int]:
    """How often each pattern occurs in a text, and its words."""
    found: dict[str, int] = {}
    words = WORD.findall(text.lower())
    for w in words:
        for n in STARTS:
            if n > len(w):
                break
            found[w[:n]] = found.get(w[:n], 0) + 1
        found[w + "$"] = found.get(w + "$", 0) + 1
    return found, len(text.split())


def _mine(batches):
    """Sums by pattern of the toxic and other texts that have it, and have it densely."""
    for batch in batches:
        offsets, _ = _text.buffers(batch.column("text"))
        for i, j in _text.slices(offsets):
            total: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").slice(i, j - i).to_pylist(), batch.column("toxic").slice(i, j - i).to_pylist(), strict=True):
                found, words = _patterns(text)
                for p, n in found.items():
                    own = total.setdefault(p, [0, 0, 0, 0])
                    own[1 - toxic] += 1
                    own[3 - toxic] += n >= 2 and n >= DENSE * words
            columns = np.array(list(total.values()), np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), *map(pa.array, columns)], names=["pattern", "t", "f", "td", "fd"])


def _evidence(hit: Column, other: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio statistic of a pattern in `hit` of the toxic and `other` of the clean texts; 0 if it is not the toxic ones that have it more."""

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    both = hit + other
    cells = ((hit, toxic, both), (other, clean, both), (toxic - hit, toxic, toxic + clean - both), (clean - other, clean, toxic + clean - both))
    g = 2 * sum((part(n, of * F.lit(side / (toxic + clean))) for n, side, of in cells), F.lit(0.0))
    return F.when((hit >= SUPPORT) & (hit * clean > 4 * other * toxic), g).otherwise(0.0)


def _likeness(words: int = 5) -> Column:
    """The smallest hash of a text's word shingles: equal for equal texts, and for near copies as often as they share shingles."""

    def least(w: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
        return F.array_min(F.transform(firsts, lambda i: F.xxhash64(F.slice(w, i, words))))

    return F.transform(F.array(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")), least)[0]


def mine(sample: DataFrame, most: int = LEXICON) -> Lexicon:
    """The lexicon of labelled (text, toxic): the patterns with the most evidence, none of them the start of another."""
    texts = sample.where("text is not null").groupBy(_likeness()).agg(F.min(F.struct("text", "toxic")).alias("x")).select("x.*")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon([], np.zeros(0, bool))
    sums = map_texts(texts.select("text", "toxic"), _mine, "pattern string, t long, f long, td long, fd long").groupBy("pattern").agg(*(F.sum(c).alias(c) for c in ("t", "f", "td", "fd")))
    scored = sums.where(F.col("t") >= SUPPORT).select("pattern", _evidence(F.col("t"), F.col("f"), toxic, clean).alias("any"), _evidence(F.col("td"), F.col("fd"), toxic, clean).alias("dense"))
    best = F.greatest("any", "dense")
    top = scored.where(best >= EVIDENCE).orderBy(best.desc(), F.length("pattern").desc(), "pattern").limit(100 * most).collect()  # the best of a lexicon
    kept: list = []
    for r in top:
        own = r["pattern"].rstrip("$")
        if len(kept) < most and not any(own.startswith(k) or k.startswith(own) for k in (x["pattern"].rstrip("$") for x in kept)):
            kept.append(r)
    return Lexicon([r["pattern"] for r in kept], np.array([r["dense"] > r["any"] for r in kept], bool))


# Label model


def counted_votes(texts: DataFrame, lexicon: Lexicon, *by: str) -> DataFrame:
    """(votes, *by, n): different texts by their votes as bits; copies count once, so a text that is much of the corpus does not stand for its class."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            counts, rest = measures(shared.value, automaton, batch.column("text"))
            own = pa.array(_numbers(votes_of(shared.value, counts, rest)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), own, *(batch.column(c) for c in by)], names=["key", "votes", *by])

    kinds = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in by)
    each = map_texts(texts.select("text", *by, F.xxhash64("text").alias("key")), run, f"key long, votes long{kinds}").distinct()
    return each.groupBy("votes", *by).agg(F.count("*").alias("n"))


def moments(counted: DataFrame, voters: int, model: LabelModel | None = None) -> np.ndarray:
    """[y, i, j]: how many texts of label y votes i and j go together, expected under the model, or by the column toxic; the last i and j is always 1."""

    def run(batches):
        total = np.zeros((2, voters + 1, voters + 1))
        for batch in batches:
            bits = _bits(batch.column("votes").to_numpy(), voters)
            chance = model.posterior(bits) if model else batch.column("toxic").to_numpy().astype(float)
            wide = np.column_stack((bits, np.ones(len(bits)))).astype(float)
            for y, own in enumerate((1 - chance, chance)):
                total[y] += wide.T @ (wide * (own * batch.column("n").to_numpy())[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

    sums = counted.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()  # as many as pairs of voters
    out = np.zeros(2 * (voters + 1) ** 2)
    for r in sums:
        out[r["cell"]] = r["s"]
    return out.reshape(2, voters + 1, voters + 1)


def model_of(sums: np.ndarray, share: float, abstaining: int = 0) -> LabelModel:
    """The tree model with given moments: a spanning tree of the largest conditional mutual information, with smoothed tables."""
    voters = sums.shape[1] - 1
    pair = np.zeros((2, 2, 2, voters, voters))  # y, u, v: counts of (i votes u, j votes v)
    on, both, n = np.diagonal(sums[:, :-1, :-1], axis1=1, axis2=2), sums[:, :-1, :-1], sums[:, -1, -1]
    pair[:, 1, 1] = both
    pair[:, 1, 0] = on[:, :, None] - both
    pair[:, 0, 1] = on[:, None, :] - both
    pair[:, 0, 0] = n[:, None, None] - on[:, :, None] - on[:, None, :] + both
    pair = np.maximum(pair, 0) + 0.25
    chance = pair / pair.sum(axis=(0, 1, 2))
    first, second = chance.sum(axis=2, keepdims=True), chance.sum(axis=1, keepdims=True)
    shared = (chance * np.log(chance * chance.sum(axis=(1, 2), keepdims=True) / (first * second))).sum(axis=(0, 1, 2))
    parent = np.full(voters, -1)
    best, where = shared[0].copy(), np.zeros(voters, np.int64)
    inside = np.arange(voters) == 0
    for _ in range(voters - 1):
        k = int(np.where(inside, -np.inf, best).argmax())
        inside[k], parent[k] = True, where[k]
        nearer = shared[k] > best
        best, where = np.where(nearer, shared[k], best), np.where(nearer, k, where)
    table = np.zeros((2, voters, 2, 2))
    for i, p in enumerate(parent):
        for y in (0, 1):
            counts = pair[y, :, :, p, i] if p >= 0 else np.tile(np.array([n[y] - on[y, i], on[y, i]]) + 0.5, (2, 1))
            table[y, i] = np.log(counts / counts.sum(axis=1, keepdims=True))
    return LabelModel(share, parent, table, abstaining)


def fit_label_model(counted: DataFrame, labelled: DataFrame, lexicon: Lexicon, share: float, rounds: int = 8) -> LabelModel:
    """From the votes of labelled texts, fitted to those of all texts; the labelled ones keep half of the weight, so the two classes stay what the labels mean."""
    voters, abstaining = lexicon.voters, len(lexicon.patterns)
    known = moments(labelled, voters)
    model = model_of(known, share, abstaining)
    for _ in range(rounds):
        expected = moments(counted, voters, model)
        weight = expected[:, -1:, -1:] / known[:, -1:, -1:]
        model = model_of(expected + weight * known, share, abstaining)
    return model


# Classifier


@dataclass
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    middle: np.ndarray
    scale: np.ndarray

    def score(self, votes: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
        z = (features_of(votes, counts, rest) - self.middle) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on labels from 0 to 1, by damped Newton steps."""
    wide = np.column_stack((x, np.ones(len(x))))
    ridge = np.append(np.full(x.shape[1], decay), 1e-6)
    w = np.zeros(wide.shape[1])

    def loss(w: np.ndarray) -> float:
        z = wide @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2)

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -500, 500)))
        step = np.linalg.solve((wide * (p * (1 - p))[:, None]).T @ wide + np.diag(ridge + 1e-9), wide.T @ (p - y) + ridge * w)
        size = 1.0
        while loss(w - size * step) > at and size > 1e-6:
            size /= 2
        w, before = w - size * step, at
        at = loss(w)
        if before - at < 1e-9 * (1 + abs(at)):
            break
    return w[:-1], float(w[-1])


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether the document is kept out of training: crc32 of its id's digits modulo 5 is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _drawn(share: float, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(share * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, fit_rows: int = 20000) -> tuple[Classifier | None, float]:
    """The classifier learnt from (doc_id, text) and (doc_id, toxic), and the share of toxic labels."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = toxic / max(toxic + clean, 1)
    if not toxic or not clean:
        return None, share
    drawn = marks.where(F.when(F.col("toxic") == 1, _drawn(min(1.0, sample_rows / toxic), "doc_id")).otherwise(_drawn(min(1.0, sample_rows / clean), "doc_id")))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic"))  # about 2 * sample_rows rows
    lexicon = mine(sample)
    counted = cut(counted_votes(docs, lexicon))
    texts = counted.agg(F.sum("n")).first()[0]
    if not texts:
        return None, share
    model = fit_label_model(counted, counted_votes(sample, lexicon, "toxic"), lexicon, share)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            counts, rest = measures(shared.value, automaton, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(counts), pa.list_(pa.int32())), pa.array(list(rest), pa.list_(pa.float64()))], names=["key", "counts", "rest"])

    drawn = docs.where(_drawn(min(1.0, fit_rows / texts), "text")).select("text", F.xxhash64("text").alias("key"))
    # copies are drawn together and count once: about fit_rows rows
    fitted = map_texts(drawn, run, "key long, counts array<int>, rest array<double>").distinct().orderBy("key", "counts", "rest").toArrow()
    n = len(fitted)
    if not n:
        return None, share
    counts = np.array(fitted.column("counts").to_pylist(), np.int64).reshape(n, -1)
    rest = np.array(fitted.column("rest").to_pylist()).reshape(n, 5)
    votes = votes_of(lexicon, counts, rest)
    x = features_of(votes, counts, rest)
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    weights, bias = logistic((x - middle) / scale, model.posterior(votes))
    return Classifier(lexicon, weights, bias, middle, scale), share


def score(docs: DataFrame, classifier: Classifier | None, share: float = 0.0) -> DataFrame:
    """(doc_id, score) of every text."""
    if classifier is None:
        return docs.select("doc_id", F.lit(float(share)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        own = shared.value
        automaton = own.lexicon.automaton()
        for batch in batches:
            counts, rest = measures(own.lexicon, automaton, batch.column("text"))
            scores = own.score(votes_of(own.lexicon, counts, rest), counts, rest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def detect(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, fit_rows: int = 20000) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt on the documents that are not held out, applied to all."""
    own = docs.where(~is_held_out()).select("doc_id", "text")
    classifier, share = train(own, labels.where(~is_held_out()), sample_rows, fit_rows)
    scored = score(docs, classifier, share)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
