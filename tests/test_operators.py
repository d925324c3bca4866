import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import arrays, probability
from tidewave.operators import conditioning, evaluate, intervals, matched, network, selection, signal


def test_range_join_plans_no_nested_loop(spark):
    points, spans = spark.range(100).selectExpr("id as t"), spark.createDataFrame([(5, 8), (7, 30), (90, 95)], "lo long, hi long")
    out = intervals.range_join(points, spans, "t", "lo", "hi", 10)
    assert sorted((r.t, r.lo) for r in out.collect()) == sorted((t, a) for t in range(100) for a, b in ((5, 8), (7, 30), (90, 95)) if a <= t < b)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_spacing_is_the_greedy_loop(spark):
    times = [0, 3, 5, 6, 9, 11, 30, 31, 35, 36]
    kept = []
    for t in times:
        if not kept or t - kept[-1] >= 5:
            kept.append(t)
    out = intervals.spaced(spark.createDataFrame([(1, t) for t in times], "k int, t long"), "t", 5, ["k"], 7)
    assert sorted(r.t for r in out.collect()) == kept


def test_merge_counts_touching_and_nested_spans(spark):
    spans = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 8, 20), (1, 9, 10)], "k int, lo long, hi long")
    assert sorted((r.lo, r.hi) for r in intervals.merged(spans, "lo", "hi", ["k"], 5).collect()) == [(0, 6), (8, 20)]


def test_subtraction(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 20, 30)], "k int, lo long, hi long")
    vetoes = spark.createDataFrame([(1, 8, 22), (1, 25, 26), (2, 0, 50)], "k int, lo long, hi long")
    assert sorted((r.lo, r.hi) for r in intervals.subtracted(spans, vetoes, "lo", "hi", ["k"], 6).collect()) == [(0, 8), (22, 25), (26, 30)]


def test_white_noise_has_a_flat_spectrum():
    psd = signal.welch(np.random.default_rng(0).standard_normal(1 << 16), 256, 128)
    assert 0.9 < np.median(psd) / 2 < 1.1


def test_known_spectrum_whitens_and_own_spectrum_leaks():
    rng = np.random.default_rng(1)
    noise, h = rng.standard_normal(4096), 5 * signal.chirp(30, 30, 4096, 2048.0)
    psd = signal.truncated_inverse(signal.welch(rng.standard_normal(1 << 15), 256, 128), 4096, 512)
    causal = signal.whiten(noise + h, psd) - signal.whiten(noise, psd)
    assert np.abs(causal - signal.whiten(h, psd)).max() < 1e-9
    own = lambda x: signal.whiten(x, signal.truncated_inverse(signal.welch(x, 256, 128), 4096, 512))
    leaky = own(noise + h) - own(noise)
    assert np.abs(leaky - signal.whiten(h, psd)).max() > 1e-2


def test_template_matches_itself_and_reweighting_only_lowers():
    bank = signal.spectra(np.stack([signal.chirp(m, m, 512, 2048.0) for m in (20.0, 30.0)]), 1024)
    h = signal.chirp(30, 30, 512, 2048.0)
    rho, chisq, lag, best, newrho = signal.score(h, bank, 1.0)
    assert best == 1 and lag == 0 and chisq < 1e-6 * rho**2
    for seed in range(5):
        rho, *_, newrho = signal.score(np.random.default_rng(seed).standard_normal(512), bank, 1.0)
        assert newrho <= rho + 1e-12


def test_network_has_the_layers_of_the_survey():
    w = network.weights(3)
    assert network.trainable(w) == 251_361
    x = np.random.default_rng(0).standard_normal((3, 2048))
    assert np.allclose(network.forward(w, x)[1], network.forward(w, x[1:2])[0])


def test_network_scores_do_not_depend_on_batches(spark):
    w = network.weights(3)
    x = np.random.default_rng(1).standard_normal((70, 2048))
    crops = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "row long, x array<double>").withColumn("x_raw", F.expr("transform(x, e -> 2 * e)"))
    want = dict(enumerate(network.forward(w, x)))
    for parts in (1, 7):
        got = {r.row: r.logit for r in network.scores(crops.drop("x_raw").repartition(parts), w).collect()}
        assert got == pytest.approx(want, rel=1e-9)
    both = network.score_arms(crops, {"full": (w, "x"), "raw": (network.weights(4), "x_raw")}).collect()
    assert {(r.arm, r.row): r.logit for r in both}["raw", 5] == pytest.approx(network.forward(network.weights(4), 2 * x[5:6])[0])
    assert len(both) == 140


def plain_cover(counts, cap, files):
    have, taken, stalled = {k: 0 for k, _, _ in counts}, [], set()
    while len(taken) < files and (open_ := [k for k in have if have[k] < cap and k not in stalled]):
        need = min(open_, key=lambda k: (have[k], k))
        best = min(((-n, f) for k, f, n in counts if k == need and f not in [t for t, _ in taken]), default=None)
        if best is None:
            stalled.add(need)
            continue
        own = {k: min(n, cap - have[k]) for k, f, n in counts if f == best[1] and have[k] < cap}
        taken.append((best[1], own))
        for k, n in own.items():
            have[k] += n
    return taken


def test_balanced_cover_is_the_plain_loop(spark):
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = [(k, f, int(rng.integers(1, 30))) for k in "abcd" for f in range(12) if rng.random() < 0.6]
        cap, files = int(rng.integers(5, 90)), int(rng.integers(1, 14))
        assert selection.balanced_cover(counts, cap, files) == plain_cover(counts, cap, files)
    rows = spark.createDataFrame([(k, f, i, 10 * f + i) for k, f, n in counts for i in range(n)], "kind string, file int, score int, at long")
    want = plain_cover(counts, 20, 4)
    chosen = selection.cover(rows, "kind", "file", [F.desc("score")], 20, 4)
    got = {(r.file, r.kind): r.n for r in chosen.groupBy("file", "kind").agg(F.count("*").alias("n")).collect()}
    assert got == {(f, k): n for f, own in want for k, n in own.items()}
    few = selection.cover(rows, "kind", "file", [F.desc("score")], 20, 4, ("at", 1, 5))
    assert {r.pick for r in few.collect()} == {0}
    assert selection.cover(rows.limit(0), "kind", "file", ["score"], 20, 4).count() == 0


def test_stratified_split_is_the_plain_loop(spark):
    rng = np.random.default_rng(3)
    counts = {(k, b): int(rng.integers(1, 9)) for k in "abc" for b in range(30) if rng.random() < {"a": 0.2, "b": 0.5, "c": 0.9}[k]}
    total = {k: sum(n for (c, _), n in counts.items() if c == k) for k in "abc"}
    want: dict = {}
    for k in sorted(total, key=lambda k: (total[k], k)):
        own = {s: sum(n for (c, b), n in counts.items() if c == k and want.get(b) == s) for s in ("test", "val")}
        for b in sorted(b for c, b in counts if c == k and b not in want):
            s = "test" if own["test"] < max(round(0.3 * total[k]), min(20, total[k])) else "val" if own["val"] < round(0.1 * total[k]) else "train"
            want[b] = s
            if s in own:
                own[s] += counts[k, b]
    rows = spark.createDataFrame([(k, b) for (k, b), n in counts.items() for _ in range(n)], "kind string, block int")
    assert {r.block: r.split for r in selection.stratified_split(rows, "kind", "block").collect()} == want


def test_a_waveform_is_placed_in_a_window(spark):
    h = [0.0, 1.0, -3.0, 2.0]
    for n, peak in ((4, 2), (6, 4), (3, 0), (5, 9), (3, -4), (8, 1)):
        want = [0.0] * n
        for i, e in enumerate(h):
            if 0 <= i - 2 + peak < n:
                want[i - 2 + peak] = e
        assert spark.range(1).select(arrays.placed(F.array(*map(F.lit, h)), n, peak).alias("x")).first().x == want


def test_normal_distribution(spark):
    from statistics import NormalDist

    xs = [-9.0, -6.5, -3.0, -0.1, 0.0, 0.5, 2.0, 5.0, 7.9, 8.5]
    for x, r in zip(xs, spark.createDataFrame([(x,) for x in xs], "x double").select(probability.normal_cdf(F.col("x")).alias("p")).collect(), strict=True):
        assert r.p == pytest.approx(NormalDist().cdf(x), abs=1e-11)
    ps = [1e-6, 0.001, 0.3, 0.5, 0.9, 0.999, 0.0, None]
    out = spark.createDataFrame([(p,) for p in ps], "p double").select(probability.normal_quantile(F.col("p")).alias("x"), probability.ceiling(F.lit(8.0), F.col("p")).alias("c")).collect()
    for p, r in zip(ps[:6], out, strict=False):
        assert r.x == pytest.approx(NormalDist().inv_cdf(p), abs=1e-6) and r.c == pytest.approx(NormalDist().cdf(8 - NormalDist().inv_cdf(1 - p)), abs=1e-9)
    assert out[6].x is None and out[7].x is None and out[7].c is None


G = conditioning.Geometry(rate=256.0, length=1024, start=384, size=256, low=20.0, high=100.0, flow=15.0, taps=128, order=64, segment=512)


def test_band_pass_keeps_the_band():
    t = np.arange(4096) / 2048
    inside, outside = (np.sin(2 * np.pi * f * t) for f in (100.0, 700.0))
    out = signal.band_pass(inside + outside, 2048, 30, 350)[500:-500]
    assert np.abs(out - inside[500:-500]).max() < 0.02
    assert np.allclose(signal.band_pass(inside, 2048, 30, 350), np.convolve(inside, (lambda k: (700 / 2048 * np.sinc(700 / 2048 * k) - 60 / 2048 * np.sinc(60 / 2048 * k)) * np.hamming(257))(np.arange(257) - 128), mode="same"))


def test_halving_and_band_limits():
    t = np.arange(4096) / 4096
    low, high = np.sin(2 * np.pi * 60 * t), np.sin(2 * np.pi * 1500 * t)
    assert np.allclose(signal.halved(low + high), low[::2], atol=1e-9)
    assert len(signal.halved(low, 256)) == 2048 - 256 and np.allclose(signal.halved(low, 256), low[::2][128:-128], atol=1e-9)
    assert np.allclose(signal.band_limited(low + high, 4096, 30, 350), low, atol=1e-9)


def test_the_four_arms_are_linear_and_the_leaky_one_is_not(spark):
    rng = np.random.default_rng(5)
    before, n1, n2, h = rng.standard_normal(4096), rng.standard_normal(1024), rng.standard_normal(1024), np.zeros(1024)
    h[400:600] = 20 * np.sin(np.arange(200) * 1.2)
    psd = conditioning.filter_of(before, G)
    gains = conditioning.gains(psd, G)
    plain = {"raw": n2, "bp": signal.band_pass(n2, G.rate, G.low, G.high, G.order), "wh": signal.whiten(n2, psd), "full": signal.band_pass(signal.whiten(n2, psd), G.rate, G.low, G.high, G.order)}
    for which in conditioning.ARMS:
        d1, d2 = (conditioning.treated(n + h, gains[which], G) - conditioning.treated(n, gains[which], G) for n in (n1, n2))
        assert np.abs(d1 - d2).max() < 1e-9 * np.abs(d1).max()
        assert np.allclose(conditioning.treated(n2, gains[which], G), plain[which][G.crop])  # filtered one after another
    d1, d2 = (conditioning.leaky(n + h, G) - conditioning.leaky(n, G) for n in (n1, n2))
    assert np.abs(d1 - d2).max() > 1e-2 * np.abs(d1).max()
    assert set(conditioning.gains(None, G)) == {"raw", "bp"}
    rows = [(1, n1.tolist(), before.tolist()), (2, n2.tolist(), before.tolist()), (3, n1.tolist(), None), (4, n1[:50].tolist(), before.tolist())]
    crops = conditioning.conditioned(spark.createDataFrame(rows, "row long, x array<double>, before array<double>"), G).cache()
    out = {r.row: r for r in crops.collect()}
    for which in conditioning.ARMS:
        assert np.allclose(out[2][f"x_{which}"], plain[which][G.crop])
    assert out[3].x_full is None and out[3].x_raw is not None and out[4].x_raw is None
    made = conditioning.scaled(crops.where("row < 3"), conditioning.norms(crops.where("row < 3"))).collect()
    assert np.mean([np.std(r.x_full) for r in made]) == pytest.approx(1, rel=1e-6)


def test_scores_are_those_of_a_plain_loop_and_find_what_was_injected(spark):
    rng = np.random.default_rng(6)
    end = G.start + 200
    waves = np.stack([np.concatenate((signal.chirp(m, m, end, G.rate, 20.0), np.zeros(G.length - end))) for m in (12.0, 20.0, 28.0, 36.0)])
    before, x = rng.standard_normal(8192), rng.standard_normal(2048)
    sigma = signal.optimal_snr(waves[2], np.full(9, 2 / G.rate), G.rate, G.low, G.high)
    x[1024:] = signal.inject(x[1024:], waves[2], sigma, 15.0)
    own = [None, (waves[2] * 15 / sigma).tolist()]
    blocks = spark.createDataFrame([(1, x.tolist(), before.tolist(), own), (2, x.tolist(), None, own)], "block long, x array<double>, before array<double>, own array<array<double>>")
    rows = matched.scored(blocks, waves, G, (0, 1024), truth=True).orderBy("start").collect()
    assert len(rows) == 2 and rows[0].rho_oracle is None
    assert rows[1].rho == pytest.approx(rows[1].rho_oracle, rel=0.25) and rows[1].rho > 10 > 7 > rows[0].rho and rows[1].template in (1, 2, 3)
    assert all(np.isfinite([r.rho, r.chisq, r.rhotilde]).all() and r.rhotilde <= r.rho + 1e-9 for r in rows)
    noise = matched.noise_of(before, G)
    bank = matched.bank_of(noise, waves)
    assert rows[1].rho_oracle == pytest.approx(matched.score(conditioning.treated(x[1024:], noise.gain, G), matched.bank_of(noise, waves[2]))[0])
    for r, s in zip(rows, (0, 1024), strict=True):
        data = np.fft.fft(np.clip(conditioning.treated(x[s : s + G.length], noise.gain, G), -20, 20), 512)[noise.band] / np.sqrt(noise.power)
        best = (0.0, 0, 0)
        for t, h in enumerate(bank.templates):
            for lag in {r.lag, *range(0, 512, 64)}:
                z = sum(d * np.conj(e) * np.exp(2j * np.pi * k * lag / 512) for d, e, k in zip(data, h, noise.band, strict=True))
                best = max(best, (abs(z), t, lag))
        assert best == (pytest.approx(r.rho), r.template, r.lag)
        # the chi-square of the winner, bin by bin
        h = bank.templates[r.template]
        pieces = data * np.conj(h) * np.exp(2j * np.pi * noise.band * r.lag / 512)
        power, bins = np.abs(h) ** 2 / (np.abs(h) ** 2).sum(), {}
        for k, (c, p) in enumerate(zip(np.cumsum(power), power, strict=True)):
            bins.setdefault(min(int(8 * (c - p / 2)), 7), []).append(k)
        chisq = sum(abs(pieces[own].sum() - power[own].sum() * pieces.sum()) ** 2 / power[own].sum() for own in bins.values()) / (2 * len(bins) - 2)
        assert r.chisq == pytest.approx(chisq)
    quiet = matched.scored(spark.createDataFrame([(i, rng.standard_normal(2048).tolist(), before.tolist()) for i in range(30)], "block long, x array<double>, before array<double>"), waves, G, (0, 1024)).collect()
    assert 2 < np.median([r.rho for r in quiet]) < 5
    with pytest.raises(ValueError, match="without power"):
        matched.bank_of(noise, np.zeros((1, G.length)))
    with pytest.raises(ValueError):
        signal.spectra(np.zeros((1, 8)), 16)


def test_noise_has_unit_quadratures_and_a_chi_square_of_one(spark):
    """Held out noise, that is not what the templates are calibrated on; and a glitch has a large chi-square, an injection has not."""
    rng = np.random.default_rng(16)
    waves = np.stack([np.concatenate((signal.chirp(m, m, G.start + 200, G.rate, 20.0), np.zeros(G.length - G.start - 200))) for m in (12.0, 20.0, 36.0)])
    noise = matched.noise_of(rng.standard_normal(1 << 15), G)
    bank = matched.bank_of(noise, waves)
    held = conditioning.treated(rng.standard_normal((600, G.length)), noise.gain, G)
    z = matched.quadratures(held, bank, np.array([0, 30]))
    for part in (z.real, z.imag):
        assert np.abs(part.mean(axis=0)).max() < 0.15 and np.abs(part.std(axis=0) - 1).max() < 0.2
    pairs = spark.createDataFrame([(i % 2, rng.standard_normal(4096).tolist(), rng.standard_normal(8192).tolist()) for i in range(40)] + [(0, [0.0] * 4096, None)], "k int, x array<double>, before array<double>")
    spreads = matched.calibration(pairs, waves, G, (0, 1024, 2048), ["k"], (-20, 0, 20)).collect()
    assert len(spreads) == 2 and all(r.n == 20 * 3 * 3 * 3 and 0.85 < r.sd_real < 1.15 and 0.85 < r.sd_imaginary < 1.15 for r in spreads)
    products = noise.seen(held[0]) * np.conj(bank.templates)
    means = np.mean([matched.chisq_of(noise.seen(c) * np.conj(bank.templates), np.zeros(3), bank) for c in held], axis=0)
    assert products.shape == (3, len(noise.band)) and np.abs(means - 1).max() < 0.2
    sigma = signal.optimal_snr(waves[1], np.full(9, 2 / G.rate), G.rate, G.low, G.high)
    found = matched.score(conditioning.treated(signal.inject(rng.standard_normal(G.length), waves[1], sigma, 12.0), noise.gain, G), bank)
    glitch = rng.standard_normal(G.length)
    glitch[G.start + 100] += 60
    loud = matched.score(conditioning.treated(glitch, noise.gain, G), bank)
    assert found[0] > 8 and found[1] < 3 < loud[1] and loud[4] < 0.8 * loud[0]



def test_matches_banks_and_recovered_snr(spark):
    waves = np.stack([signal.chirp(m, m, 512, 512.0) for m in (20.0, 20.2, 30.0, 31.0, 45.0)])
    near = signal.matches(waves, waves)
    assert np.allclose(np.diag(near), 1) and np.allclose(near, near.T) and (near <= 1 + 1e-9).all()
    assert conditioning.fitting_factor(waves[:2], waves[2:]) == pytest.approx(near[:2, 2:].max(axis=1))
    kept = []
    for i in range(5):
        if all(near[i, j] < 0.97 for j in kept):
            kept.append(i)
    candidates = spark.createDataFrame([(10 + i, h.tolist()) for i, h in enumerate(waves)], "id long, h array<double>")
    for block in (2, 3, 512):
        assert signal.stochastic_bank(candidates, block=block) == [10 + i for i in kept]
    assert signal.stochastic_bank(candidates, least=0.0, stop=2) == [10]
    psd = np.full(9, 2 / 512.0)
    x = signal.inject(np.zeros(512), waves[2], signal.optimal_snr(waves[2], psd, 512.0, 30, 200), 9.0)
    assert conditioning.recovered_snr(np.roll(x, 37), waves[2], psd, 512.0, 30, 200) == pytest.approx(9.0, rel=1e-6)


def test_banks_shuffle_and_make_no_more_than_the_blocks_they_try(spark):
    shapes = np.random.default_rng(4).standard_normal((6, 64))
    made = spark.sparkContext.accumulator(0)

    def waves(p):
        made.add(len(p))
        return shapes[p["kind"]]

    kinds = spark.range(0, 600, 1, 4).select(F.col("id"), (F.col("id") % 6).cast("int").alias("kind"))
    table = spark.createDataFrame([(k, h.tolist()) for k, h in enumerate(shapes)], "kind int, h array<double>")
    stored = kinds.join(F.broadcast(table), "kind").select("id", "h")
    spark.sparkContext.setJobGroup("bank", "")
    assert signal.stochastic_bank(stored, stop=20, block=16) == [0, 1, 2, 3, 4, 5]
    spark.sparkContext.setJobGroup("", "")
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("bank") for s in tracker.getJobInfo(j).stageIds}
    lists = [store.taskList(s, 0, 1000) for s in stages]
    read = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for tasks in lists for i in range(tasks.size())]
    assert 0 < max(read) <= 16
    assert signal.stochastic_bank(kinds, stop=20, block=16, waves=waves) == [0, 1, 2, 3, 4, 5]
    assert made.value == 32


def test_banks_with_repeated_and_missing_ids(spark):
    shapes = np.random.default_rng(5).standard_normal((5, 64))
    ids = [None, None, 3, 3, 3, 3, 3, 4, 7, 7, 8, 9, 9, 12]
    kinds = [0, 0, 1, 1, 1, 1, 1, 0, 2, 2, 1, 3, 3, 4]
    candidates = spark.createDataFrame([(i, shapes[k].tolist()) for i, k in zip(ids, kinds, strict=True)][::-1], "id long, h array<double>")
    for stop in (3, 4, 5, 9):
        want, seen, failed = [], set(), 0
        for i, k in zip(ids, kinds, strict=True):
            failed = failed + 1 if k in seen else 0
            if k not in seen:
                want.append(i)
                seen.add(k)
            if failed >= stop:
                break
        for block in (1, 3, 512):
            assert signal.stochastic_bank(candidates, stop=stop, block=block) == want
    assert signal.stochastic_bank(candidates.where("id > 99")) == []


def test_noise_is_a_function_of_the_seed(spark):
    keys = spark.createDataFrame([(i, 7 + i % 3) for i in range(40)], "k long, seed long")
    psd = np.linspace(1, 2, 9)
    got = {r.k: r.x for n in (1, 9) for r in signal.noise_blocks(keys.repartition(n), psd, 64).collect()}
    assert len(got) == 40 and got[0] == got[3] == signal.coloured_noise(psd, 64, 7).tolist() and got[0] != got[1]


def test_numbers_follow_the_hash(spark):
    rows = spark.range(500).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("m"))
    out = {r.m: (r.place, r.n) for r in intervals.numbered(rows, "m", 1).collect()}
    assert [out[m][0] for m in sorted(out)] == list(range(500)) and {n for _, n in out.values()} == {500}


def test_area_and_percentiles_by_ranges_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), float(s), bool(p)) for k, s, p in zip(rng.integers(0, 2, 3000), np.round(rng.normal(size=3000), 2), rng.random(3000) < 0.3, strict=True)] + [(2, 1.0, True), (2, None, False)]
    df = spark.createDataFrame(rows, "k int, s double, p boolean")
    for r in evaluate.auc(df, "s", "p", ["k"]).collect():
        own = [x for x in rows if x[0] == r.k and x[1] is not None]
        p, n = np.asarray([x[1] for x in own if x[2]]), np.asarray([x[1] for x in own if not x[2]])
        assert (r.auc is None) if not len(n) else r.auc == pytest.approx((p[:, None] > n[None]).mean() + (p[:, None] == n[None]).mean() / 2)
    got = evaluate.percentiles(df, "s", ["k"], [0.0, 0.05, 0.5, 0.999, 1.0]).collect()
    assert {(r.k, r.share): r.value for r in got} == {(k, q): pytest.approx(np.quantile([x[1] for x in rows if x[0] == k and x[1] is not None], q)) for k in (0, 1, 2) for q in (0.0, 0.05, 0.5, 0.999, 1.0)}
