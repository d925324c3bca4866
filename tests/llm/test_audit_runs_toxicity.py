"""Filter audit, periodic runs and toxicity against plain definitions, with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tidewave.llm import filter_audit, periodic_runs, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n int, good int, toxic int, mask int, key string, runs string"
LABELS = "doc_id long, quality int, toxic int, text string, mask int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 7, 1, 1, 3, "k", "r") for i, t, g in rows], DOCS)


def marks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], LABELS)


# Filter audit


def audited(docs, labels):
    """Every order walked through document by document."""
    ids = defaultdict(list)
    for i, t, _ in docs:
        ids[t or ""].append(i)
    first = {t: min((i for i in own if i is not None), default=None) for t, own in ids.items()}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        own["E"] = first[t] is not None and (i is None or i > first[t])
        fails.append((lang or "", {f for f in own if own[f]}, i in good, i in toxic))
    removed_by = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in fails if x[0] == part and f in x[1]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone))
                removed_by[part, f] += len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit_is_every_order_walked_through(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(queries.op11_filter_audit(spark, SF)) == audited(docs, labels)


def test_filter_audit_of_odd_rows(spark):
    long, caps = " ".join(f"w{i}" for i in range(30_000)), "ABC " * 250
    docs = [(1, None, None), (2, "", ""), (3, "", "en"), (3, "", "en"), (4, long, "en"), (5, long, "de"), (5, "other #", "de"), (None, long, "en"), (None, "alone", None), (None, "alone", None), (6, caps, "de"), (7, " \t\r\n", "en")]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]
    assert rows_of(filter_audit.audit(table(spark, docs), marks(spark, labels))) == audited(docs, labels)
    assert filter_audit.audit(table(spark, []), marks(spark, labels)).count() == 0
    assert rows_of(filter_audit.audit(table(spark, docs), marks(spark, []))) == audited(docs, [])


def test_the_transform_sums_over_subsets(spark):
    rng = np.random.default_rng(3)
    for k in (1, 3, 6):
        own = rng.integers(0, 100, 1 << k).tolist()
        got = spark.createDataFrame([(own,)], "c array<long>").select(filter_audit.zeta("c", k)).first()[0]
        assert got == [sum(own[m] for m in range(1 << k) if m & s == m) for s in range(1 << k)]


def test_filter_audit_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(filter_audit.ORACLE)
    got = filter_audit.audit(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


# Periodic runs


def plain_runs(w, exponent=4, least=6):
    """Maximal stretches of each period, the smallest first."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, exponent * p):
                found.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapse(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_are_those_of_a_plain_search():
    rng = np.random.default_rng(5)
    texts = []
    for size in [0, 1, 5, 6, 7, 40, 300, 2000] * 12:
        w = [b"%d" % x for x in rng.integers(0, rng.choice([1, 2, 3, 50]), size)]
        for _ in range(rng.integers(0, 4)):  # stretches that repeat, some within others
            a, p, n = rng.integers(0, max(size, 1)), rng.integers(1, 9), rng.integers(4, 60)
            w[a : a + n] = [w[a + k % p] for k in range(n)] if a + p < size else w[a : a + n]
        texts.append(b" ".join(w))
    for exponent, least in ((4, 6), (2, 4), (3, 3)):
        for t, (runs, kept) in zip(texts, periodic_runs._detect(texts, exponent, least), strict=True):
            want = plain_runs(t.split(), exponent, least)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want and kept == collapse(t.split(), want)


def test_extensions_are_common_prefixes():
    rng = np.random.default_rng(7)
    for n, kinds in ((1, 1), (2, 1), (50, 1), (200, 2), (500, 20)):
        x = rng.integers(0, kinds, n)
        i, j = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300)
        i, j = i[i != j], j[i != j]
        common = lambda a, b: next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), 0) if max(a, b) < n else 0  # noqa: B023, E731
        assert periodic_runs.Extensions(x)(i, j).tolist() == [common(a, b) for a, b in zip(i, j, strict=True)]


def test_op12_equals_its_definition(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(texts)
    planted = 0
    for doc_id, text in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        runs = plain_runs(w)
        planted += h % 10 == 0 and bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        want = (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(w, runs)).hexdigest())
        assert tuple(got[doc_id]) == want
    assert planted > 3


def test_runs_of_odd_rows(spark):
    long = "x y z " * 50_000 + "end"
    rows = [(1, None, None), (2, "", None), (3, " \t", None), (4, "a a a a a", None), (5, "a\ta\na a  a\x0ba b", None), (5, "a\ta\na a  a\x0ba b", None), (None, "b c " * 4, None), (6, long, None), (7, "           ", None)]
    out = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.detect(table(spark, rows)).collect())
    assert out == Counter(
        [(1, (), ""), (2, (), ""), (3, (), ""), (4, (), "a a a a a"), (5, ((0, 6, 1),), "a b"), (5, ((0, 6, 1),), "a b"), (None, ((0, 8, 2),), "b c"), (6, ((0, 150_000, 3),), "x y z end"), (7, ((0, 6, 1),), " ")]
    )
    assert periodic_runs.detect(table(spark, [])).count() == 0
    digest = {r.doc_id: r for r in periodic_runs.digest(periodic_runs.detect(table(spark, rows))).collect()}
    assert digest[1].n_runs == 0 and digest[1].start is None and digest[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest() and digest[6].exponent_milli == 50_000_000


# Toxicity


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    return scores, [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()]


def test_toxic_texts_that_were_held_out_are_found(judged):
    scores, labels = judged
    assert len(scores) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scores.items())
    held = [(scores[i].score, t) for i, t in labels if scores[i].held_out]
    found = [t for s, t in held if s >= 0.5]
    assert sum(found) >= 0.97 * len(found) and sum(found) >= 0.85 * sum(t for _, t in held)
    toxic, clean = (np.array([s for s, t in held if t == k]) for k in (1, 0))
    assert (toxic[:, None] > clean).mean() > 0.93


def insults(rng, n, toxic):
    words = [f"w{x}" for x in rng.integers(0, 300, n)]
    for k in rng.integers(0, n, n // 12 if toxic else 0):
        words[k] = rng.choice(["zorgish", "Zorgly", "flumph", "FLUMPH!"])
    return " ".join(words)


def planted(spark, n=600, flip=0.05):
    rng = np.random.default_rng(11)
    kinds = (rng.random(n) < 0.2).astype(int)
    docs = [(i, insults(rng, int(rng.integers(30, 200)), kinds[i]), None) for i in range(n)]
    return docs, kinds, [(i, 1, int(kinds[i] ^ (rng.random() < flip))) for i in range(n) if i % 3]


def test_the_voters_outdo_noisy_labels(spark):
    docs, kinds, labels = planted(spark)
    own = toxicity.detect(table(spark, docs), marks(spark, labels)).collect()
    assert np.mean([r.predicted == kinds[r.doc_id] for r in own]) > 0.98
    lexicon = toxicity.mine(table(spark, docs).drop("toxic").join(marks(spark, labels).select("doc_id", "toxic"), "doc_id"))
    assert {p[:4] for p in lexicon.patterns} >= {"zorg", "flum"} and not any(p.startswith("w") for p in lexicon.patterns)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs, _, labels = planted(spark, 300)
    first = sorted(map(tuple, toxicity.detect(table(spark, docs), marks(spark, labels)).collect()))
    turned = [(i, 0, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    again = sorted(map(tuple, toxicity.detect(table(spark, [(i, t, "zz") for i, t, _ in docs]), marks(spark, turned)).collect()))
    assert [(a, b, d) for a, b, _, d in first] == [(a, b, d) for a, b, _, d in again]
    assert np.allclose([r[2] for r in first], [r[2] for r in again])


def test_a_row_that_is_most_of_the_table_counts_once_in_the_fit(spark):
    docs, kinds, labels = planted(spark, 300)
    repeated = table(spark, docs).unionByName(table(spark, [(7, docs[7][1], None)] * 20_000))
    own, _ = toxicity.train(repeated.where(~toxicity.is_held_out()), marks(spark, labels), fit_rows=30_000)
    once, _ = toxicity.train(table(spark, docs).where(~toxicity.is_held_out()), marks(spark, labels), fit_rows=30_000)
    assert np.allclose(own.middle, once.middle) and own.lexicon.patterns == once.lexicon.patterns
    out = toxicity.score(table(spark, docs), own).collect()
    assert np.mean([(r.score >= 0.5) == kinds[r.doc_id] for r in out]) > 0.97


def test_toxicity_of_odd_rows(spark):
    docs, _, labels = planted(spark, 300)
    odd = [(None, "zorgish flumph zorgly", None), (1000, None, None), (1001, "", None), (1002, "zorgish flumph " * 30_000, None), (1003, "w1 " * 60_000, None), (5, docs[5][1], None)]
    out = toxicity.detect(table(spark, [*docs, *odd]), marks(spark, [*labels, (None, 1, 1), (2000, 1, 1), (1, None, None), (2, 1, 7), (4, 1, 0), (4, 1, 0)])).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + len(odd) and by[None].held_out and by[None].predicted == 1 and by[1002].predicted == 1
    assert by[1000].score == by[1001].score < 0.5 and by[1003].predicted == 0 and len({r.score for r in out if r.doc_id == 5}) == 1
    assert toxicity.detect(table(spark, []), marks(spark, labels)).count() == 0
    assert {r.score for r in toxicity.detect(table(spark, docs), marks(spark, [])).collect()} == {0.0}
    assert {r.score for r in toxicity.detect(table(spark, docs), marks(spark, [(i, 1, 1) for i in range(300)])).collect()} == {1.0}


def test_the_label_model_is_a_distribution_and_finds_what_goes_together(spark):
    rng = np.random.default_rng(2)
    y = rng.random(20_000) < 0.3
    a = np.where(y, rng.random(20_000) < 0.8, rng.random(20_000) < 0.1)
    b = np.where(rng.random(20_000) < 0.9, a, rng.random(20_000) < 0.2)  # mostly copies a
    c = np.where(y, rng.random(20_000) < 0.7, rng.random(20_000) < 0.2)
    bits = np.stack((a, b, c), axis=1).astype(int)
    counted = spark.createDataFrame([(int(v), int(t), int(n)) for (v, t), n in Counter(zip(toxicity._numbers(bits), y.astype(int), strict=True)).items()], "votes long, toxic int, n long")
    sums = toxicity.moments(counted, 3)
    assert np.allclose(sums[:, -1, -1], [20_000 - y.sum(), y.sum()]) and np.allclose(sums[1][0, 1], (a & b & y).sum())
    model = toxicity.model_of(sums, 0.3)
    every = np.array([[i >> k & 1 for k in range(3)] for i in range(8)])
    assert {0, 1} in [{i, p} for i, p in enumerate(model.parent)]
    share = [np.exp(sum(model.table[1][i, v[model.parent[i]] if model.parent[i] >= 0 else 0, v[i]] for i in range(3))) for v in every]
    assert sum(share) == pytest.approx(1)
    for v, p in zip(every, model.posterior(every), strict=True):
        rows = (bits == v).all(axis=1)
        assert abs(p - y[rows].mean()) < 0.05
    assert np.allclose(model.accuracies(sums)[:, 1], bits[y].mean(axis=0))
