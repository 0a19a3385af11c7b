"""Operators on literal rows and against plain folds."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import config
from tidegrid.functions import text as T
from tidegrid.functions import vectors as V
from tidegrid.operators import audit, features, grid, joins, lsa, report, ridge, segments, signal, stats

INTERVALS = "story string, ord long, t0 double, t1 double, text string"


def fold_text(rows):
    """The transcript rule as a left-to-right fold: words and marks."""
    out = []
    for _, _, a, b, text in rows:
        token = text.strip()
        if token == "" or re.search(config.NOISE, token):
            mark = "." if b - a >= config.PERIOD_PAUSE else "," if b - a >= config.COMMA_PAUSE else ""
            if mark and out:
                out[-1][1] = "." if "." in (mark, out[-1][1]) else ","
            continue
        word = re.sub(r"[^a-zA-Z']", "", token).lower()
        if word:
            out.append([word, ""])
    return out


def transcript(seed, story="a", n=60):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        text = rng.choice(["", "sp", "{BR}", "xspnx", "Hello", "don't", "42", "the", " Time ", "[noise]", "lg"])
        d = rng.choice([0.1, 0.34, 0.35, 0.4, 0.64, 0.65, 0.9])
        rows.append((story, i, t, t + d, text))
        t += d
    return rows


def test_punctuation_against_fold(spark):
    rows = [r for s in range(12) for r in transcript(s, f"s{s}")]
    df = spark.createDataFrame(rows, INTERVALS).repartition(5)
    got = {}
    for r in segments.punctuated(df).orderBy("story", "ord").collect():
        got.setdefault(r.story, []).append([r.word, r.mark])
    for s in range(12):
        own = [r for r in rows if r[0] == f"s{s}"]
        durations = [(a, b) for _, _, a, b, _ in own]
        assert durations and got.get(f"s{s}", []) == fold_text(own)


def test_text_and_offsets(spark):
    df = spark.createDataFrame(transcript(3), INTERVALS)
    words = segments.punctuated(df)
    text = segments.text_of(words).first().text
    assert text == " ".join(w + m for w, m in fold_text(transcript(3)))
    for r in segments.offsets(words).collect():
        assert text[r.char_start : r.char_end] == r.word


def test_strict_offsets_lose_what_the_search_loses(spark):
    df = spark.createDataFrame([("a", i, float(i), i + 0.2, w) for i, w in enumerate(["say", "'", "don't", "stop"])], INTERVALS)
    got = {r.word: (r.char_start, r.char_end) for r in segments.strict_offsets(segments.punctuated(df)).collect()}
    assert got["say"] == (0, 3) and "stop" in got or len(got) < 4


def test_two_clause_rules_differ(spark):
    rows = [("a", 0, 0.0, 0.2, "one"), ("a", 1, 0.2, 0.6, ""), ("a", 2, 0.6, 1.0, "sp"), ("a", 3, 1.0, 1.2, "two"), ("a", 4, 1.2, 1.9, ""), ("a", 5, 1.9, 2.0, "three")]
    df = spark.createDataFrame(rows, INTERVALS)
    fit = {r.word: r.clause for r in segments.clauses_by_pause(df).collect()}
    gap = {r.word: r.clause for r in segments.clauses_by_gap(segments.punctuated(df)).collect()}
    assert fit == {"one": 0, "two": 0, "three": 1} and gap == {"one": 0, "two": 1, "three": 2}
    assert {(r.t0, r.t1) for r in segments.spans(segments.clauses_by_gap(segments.punctuated(df))).collect()} == {(0.0, 0.2), (1.0, 1.2), (1.9, 2.0)}


@pytest.mark.parametrize("zero_writes", [True, False])
def test_grid_is_last_writer_wins(spark, zero_writes):
    rng = random.Random(4)
    rows = [("a", i, (t := rng.uniform(0, 3)), t + rng.uniform(0, 0.4), rng.choice([0, 0, 1, 2])) for i in range(50)] + [("a", 50, 0.29, 0.29, 5), ("a", 51, 9.0, 9.5, 7)]
    n = 300
    want = [0] * n
    for _, _, a, b, v in rows:
        if v or zero_writes:
            for k in range(math.floor(a * 100), min(math.ceil(b * 100), n)):
                want[k] = v
    df = spark.createDataFrame(rows, "story string, ord long, t0 double, t1 double, v long")
    sizes = spark.createDataFrame([("a", n)], "story string, n long")
    got = grid.project(df, sizes, ["v"], 100, zero_writes).orderBy("k").collect()
    assert [r.v for r in got] == want
    for rows_ in (grid.project(df, sizes, ["v"], 100, zero_writes), grid.owned(df, sizes, ["v"], 100, zero_writes)):
        runs = grid.runs(rows_, ["v"]).orderBy("a").collect()
        assert [v for r in runs for v in [r.v] * (r.b - r.a)] == want
        assert all(a.v != b.v for a, b in zip(runs, runs[1:]))


def test_joins(spark):
    words = spark.createDataFrame([("a", "didn't", 0, 6), ("a", "go", 7, 9), ("a", "gap", 30, 33)], "story string, word string, char_start int, char_end int")
    tokens = spark.createDataFrame([("a", 0, 0, "did"), ("a", 1, 3, "n't"), ("a", 2, 7, "go")], "story string, i int, idx int, text string")
    assert {(r.word, r.token) for r in joins.char_to_token(words, tokens).collect()} == {("didn't", "n't"), ("go", "go")}
    files = spark.createDataFrame([("x/SUB_Long_Story.h5",), ("none",)], "f string")
    names = spark.createDataFrame([("story",), ("long_story",), ("",)], "s string")
    assert [tuple(r) for r in joins.name_in_name(files, names, "f", "s").collect()] == [("x/SUB_Long_Story.h5", "long_story")]
    work = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k int, p string")
    assert [r.k for r in joins.not_done(work, done, "k", "p", 2).collect()] == [2]


def test_names_in_files(spark):
    df = spark.createDataFrame([("/d/sub-uts01/ses-02_run-03_x.hf5",), ("/d/other/file.hf5",)], "p string")
    got = df.select(T.subject_id(F.col("p")), T.session_id(F.col("p")), T.run_id(F.col("p")), T.stem_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("sub-UTS01", "ses-2", "run-3", "ses-02_run-03_x"), (None, "ses-unknown", "run-1", "file")]


def test_word_features(spark):
    t = spark.createDataFrame([("NOUN", "NN", "cat"), ("VERB", "VBD", "walked"), ("VERB", "VBD", "ran"), ("AUX", "MD", "would"), ("AUX", "VBD", "'d"), ("VERB", "VBZ", "runs"), ("VERB", "VBP", "run"), ("VERB", "VBG", "running"), ("ADP", "IN", "of")], "pos string, tag string, text string")
    got = {r.text: [r[c] for c in config.TENSES] for r in features.tense(t).collect()}
    assert got["walked"] == [1, 0, 0, 0] and got["ran"] == [0, 1, 0, 0] and got["runs"] == [0, 0, 1, 0] and got["run"] == [0, 0, 0, 1]
    assert sum(map(sum, got.values())) == 4
    cat = {r.text: [c for c in config.CATEGORIES if r[c]] for r in features.categorical(t).collect()}
    assert cat["cat"] == ["noun"] and cat["running"] == ["non_finite_verb"] and cat["of"] == ["preposition"] and cat["ran"] == []
    p = {r.text: [c for c in config.PHONE_CLASSES if r[c]] for r in features.phonological(spark.createDataFrame([("W",), ("AH0",), ("CH",), ("sp",)], "text string")).collect()}
    assert p == {"W": ["consonantal", "voiced", "bilabial", "palatal_velar", "approximant"], "AH0": ["vocalic", "voiced"], "CH": ["consonantal", "voiceless", "dental_alveolar", "affricate"], "sp": []}
    assert len(config.FEATURES) == 43 and len(config.CONTROLS) == 39


def test_depths(spark):
    rng = random.Random(0)
    head = [0] + [rng.randrange(i) for i in range(1, 40)]
    want = [0] * 40
    for i in range(1, 40):
        want[i] = want[head[i]] + 1
    df = spark.createDataFrame([("a", i, h) for i, h in enumerate(head)], "story string, i int, head_i int")
    got = {r.i: (r.syntactic_depth, r.dependency_distance, r.is_root) for r in features.syntactic(df).collect()}
    assert got == {i: (want[i], abs(i - head[i]), int(i == head[i])) for i in range(40)}
    # a path longer than any fixed number of rounds, a cycle, and a parent that is not there
    chain = [("b", i, max(0, i - 1)) for i in range(150)] + [("c", 0, 1), ("c", 1, 2), ("c", 2, 0), ("c", 3, 3), ("c", 4, 99)]
    deep = {(r.story, r.i): r.depth for r in features.depths(spark.createDataFrame(chain, "story string, i int, head_i int"), "story", "i", "head_i").collect()}
    assert all(deep["b", i] == i for i in range(150)) and [deep["c", i] for i in range(5)] == [None, None, None, 0, None]


def test_standardised(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", None, 5.0), ("b", float("nan"), 1.0)], "g string, x double, y double")
    got = [(r.g, r.x, r.y) for r in stats.standardised(df, ["g"], ["x", "y"]).collect()]
    x = np.array([1.0, 3.0, 0.0])
    z = (x - x.mean()) / x.std()
    assert np.allclose(sorted(v for g, v, _ in got if g == "a"), sorted(z)) and all(y == 0 for *_, y in got)


def test_r2_without_variance(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 2.0), (2, 2.0, 3.0), (2, 2.0, 2.0), (3, 1.0, 1.5), (3, 2.0, 2.0)], "k int, y double, p double")
    assert {r.k: r.r2 for r in stats.r2_by(df, ["k"], "y", "p").collect()} == {1: 1.0, 2: 0.0, 3: 0.5}


def test_ceiling(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 1)) + rng.normal(size=(40, 3))
    df = spark.createDataFrame([("v", t, r, float(x[t, r])) for t in range(40) for r in range(3)] + [("one", t, 0, float(t)) for t in range(5)] + [("flat", t, r, 1.0) for t in range(3) for r in range(2)], "v string, t int, r int, y double")
    got = {r.v: r.ceiling for r in stats.ceiling(df, ["v"], "t", "r", "y").collect()}
    var, noise = x.mean(1).var(), x.var(1).mean() * 3 / 2
    assert math.isclose(got["v"], max(0, var - noise / 3) / var) and got["one"] is None and got["flat"] is None


def test_shift_null_and_p(spark):
    rng = np.random.default_rng(2)
    n = 40
    rows = [(i, *(rng.normal(size=n).tolist() for _ in range(3))) for i in range(5)]
    df = spark.createDataFrame(rows, "v int, y array<double>, f array<double>, l array<double>")
    got = {(r.v, r["shift"]): r.delta for r in stats.shift_null(df, ["v"], "y", "f", "l", n).collect()}
    assert {s for _, s in got} == set(range(10, 30))
    for i, y, f, p in rows:
        y, tot = np.array(y), ((np.array(y) - np.mean(y)) ** 2).sum()
        for s in range(10, 30):
            res = lambda q: ((y - np.roll(q, s)) ** 2).sum()
            assert math.isclose(got[i, s], (res(p) - res(f)) / tot, abs_tol=1e-9)
    # the same nulls, tested in one pass
    done = {r.v: r for r in stats.tested(df, ["v"], "y", "f", "l", n).collect()}
    for i, y, f, p in rows:
        y, tot = np.array(y), ((np.array(y) - np.mean(y)) ** 2).sum()
        delta = (((y - p) ** 2).sum() - ((y - f) ** 2).sum()) / tot
        assert math.isclose(done[i].delta, delta, abs_tol=1e-9) and math.isclose(done[i].r2_global, 1 - ((y - f) ** 2).sum() / tot, abs_tol=1e-9)
        assert (done[i].n_shifts, done[i].n_shifts_sensitivity) == (20, 9)
        assert math.isclose(done[i].p_value, (sum(got[i, s] >= delta for s in range(10, 30)) + 1) / 21)
        assert math.isclose(done[i].p_value_sensitivity, (sum(got[i, s] >= delta for s in range(16, 25)) + 1) / 10)
    null = spark.createDataFrame([(1, s, float(s)) for s in range(10, 30)], "v int, shift int, delta double")
    p = stats.empirical_p(null, spark.createDataFrame([(1, 27.0)], "v int, delta double"), ["v"], n).first()
    assert math.isclose(p.p_value, 4 / 21) and p.n_shifts_sensitivity == 9 and math.isclose(p.p_value_sensitivity, 1 / 10)
    with pytest.raises(ValueError):
        stats.shifts(20)
    assert stats.shifts(21) == (10, 10)


def test_benjamini_hochberg(spark):
    rng = random.Random(1)
    p = [rng.choice([0.01, 0.02, 0.02, 0.3, 0.9, 0.04]) for _ in range(60)]
    order = sorted(range(60), key=lambda i: p[i])
    want, low = [0.0] * 60, 1.0
    for rank in range(60, 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * 60 / rank)
        want[i] = low
    df = spark.createDataFrame([(i, "s", x) for i, x in enumerate(p)] + [(99, "s", None)], "i int, s string, p double")
    got = {r.i: r.p_fdr for r in stats.adjusted(df, ["s"], "p").collect()}
    assert all(math.isclose(got[i], want[i]) for i in range(60)) and got[99] is None


def test_pulse_through_the_response(spark):
    h = signal.double_gamma()
    assert len(h) == 3200 and abs(h.sum() - 1) < 1e-9 and abs(h.argmax() / 100 - 5.0) < 0.05 and abs(h.argmin() / 100 - 15.75) < 0.1
    x = np.zeros((3000, 1))
    x[200:250] = 1
    df = spark.createDataFrame([("a", k, float(v)) for k, (v,) in enumerate(x)], "story string, k long, v double")
    y = [r.v for r in signal.responses(df, ["v"]).orderBy("j").collect()]
    direct = np.convolve(x[:, 0], h)[:3000]
    assert len(y) == 15 and int(np.argmax(y)) == 4 and np.abs(signal.convolved(x, h)[:, 0] - direct).max() < 1e-9
    assert np.abs(np.array(y)[1:-1] - direct[::200][1:-1]).max() < 0.02
    assert len(signal.single_gamma()) == 3200


def test_lags_and_taps(spark):
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(7)], "s string, k long, v double")
    got = signal.lagged(df, "s", "k", ["v"], (1, 2)).orderBy("k").collect()
    assert [(r.v_lag1, r.v_lag2) for r in got] == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert [r.y for r in signal.taps(df, "s", "k", "v", [1.0, 0.5], "y", 3).orderBy("k").collect()] == [1.0, 5.5, 10.0]


def test_latent_axes(spark):
    rng = random.Random(0)
    groups = [["red", "green", "blue"], ["cat", "dog", "cow"]]
    rows = [(d, rng.choice(groups[d % 2])) for d in range(40) for _ in range(6)]
    terms = spark.createDataFrame(rows, "doc int, term string")
    vocab = lsa.vocabulary(terms)
    w = lsa.weighted(terms, vocab)
    assert all(abs(r.n - 1) < 1e-9 for r in w.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect())
    axis, s = lsa.axes(w, vocab, 2)
    got = {r.doc: r for r in lsa.projected(w, axis, 2).collect()}
    side = {d: int(abs(r.semantic_dim_0) > abs(r.semantic_dim_1)) for d, r in got.items()}
    assert len(s) == 2 and all(side[d] == side[d % 2] for d in side) and side[0] != side[1]
    dense = np.zeros((40, 6))
    place = {t: i for i, t in enumerate(sorted(sum(groups, [])))}
    for r in w.collect():
        dense[r.doc, place[r.term]] = r.w
    u, sv, vt = np.linalg.svd(dense)
    assert np.allclose(s, sv[:2]) and np.allclose(np.abs(np.array([r.axis for r in axis.orderBy("term").collect()])), np.abs(vt[:2].T), atol=1e-6)
    known = lsa.coverage(terms, vocab.where("term <> 'red'")).first()
    assert known.total == 240 and known.covered + known.unknown == 240


def test_ridge_by_sums(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(90, 4)), rng.normal(size=(4, 3))
    y = x @ w + rng.normal(size=(90, 3)) * 0.1
    group = [f"g{i // 30}" for i in range(90)]
    names = [f"x{i}" for i in range(4)]
    xs = spark.createDataFrame([(i, group[i], *map(float, x[i])) for i in range(90)], "i long, story string, " + ", ".join(f"{n} double" for n in names))
    ys = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(90) for t in range(3)], "i long, target int, y double")
    fold = ridge.folds({"g0": 30, "g1": 30, "g2": 30})
    assert sorted(fold.values()) == [0, 1, 2]
    got = {r.target: r for r in ridge.chosen(ridge.gram(xs, "story", names), ridge.cross(xs, ys, ["i"], "story", names), "story", fold).collect()}
    for t in range(3):
        score = []
        for a in config.ALPHAS:
            total = 0
            for f in range(3):
                held = np.array([fold[g] == f for g in group])
                b = np.linalg.solve(x[~held].T @ x[~held] + a * np.eye(4), x[~held].T @ y[~held, t])
                total += 1 - ((y[held, t] - x[held] @ b) ** 2).sum() / (y[held, t] ** 2).sum()
            score.append(total / 3)
        a = config.ALPHAS[int(np.argmax(score))]
        assert got[t].alpha == a and np.allclose(got[t].w, np.linalg.solve(x.T @ x + a * np.eye(4), x.T @ y[:, t]))
    p = {r.target: r.p for r in ridge.predicted(xs, spark.createDataFrame([(t, got[t].w) for t in range(3)], "target int, w array<double>"), names, "i").collect()}
    assert len(p[1]) == 90 and math.isclose(p[1][5], float(x[5] @ np.array(got[1].w)))
    small = ridge.cross(xs, ys, ["i"], "story", names, block=2).collect()
    assert len(small) == 9 and all(np.allclose(r.b, x[30 * int(r.story[1]) : 30 * int(r.story[1]) + 30].T @ y[30 * int(r.story[1]) : 30 * int(r.story[1]) + 30, r.target]) for r in small)
    with pytest.raises(ValueError):
        ridge.folds({"one": 3})


def test_banded_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    y = x[:, :2] @ rng.normal(size=(2, 2)) + rng.normal(size=(60, 2))
    names, group = [f"x{i}" for i in range(5)], [f"g{i // 20}" for i in range(60)]
    xs = spark.createDataFrame([(i, group[i], *map(float, x[i])) for i in range(60)], "i long, story string, " + ", ".join(f"{n} double" for n in names))
    ys = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(60) for t in range(2)], "i long, target int, y double")
    fold, bands, alphas = ridge.folds({"g0": 20, "g1": 20, "g2": 20}), ridge.bands([2, 3]), (0.1, 10.0)
    assert bands == [[0, 1], [2, 3, 4]]
    got = {r.target: r for r in ridge.searched(ridge.gram(xs, "story", names), ridge.cross(xs, ys, ["i"], "story", names), "story", fold, bands, alphas, draws=4, seed=1).collect()}
    draws = np.vstack([[0.5, 0.5], np.random.default_rng(1).dirichlet(np.ones(2), 3)]) * 2
    for t in range(2):
        best = []
        for i, d in enumerate(draws):
            z = x * np.sqrt(d)[[0, 0, 1, 1, 1]]
            for a in alphas:
                total = 0
                for f in range(3):
                    held = np.array([fold[g] == f for g in group])
                    b = np.linalg.solve(z[~held].T @ z[~held] + a * np.eye(5), z[~held].T @ y[~held, t])
                    total += 1 - ((y[held, t] - z[held] @ b) ** 2).sum() / (y[held, t] ** 2).sum()
                w = np.linalg.solve(z.T @ z + a * np.eye(5), z.T @ y[:, t]) * np.sqrt(d)[[0, 0, 1, 1, 1]]
                best.append((total / 3, i, a, w))
        score, i, a, w = max(best, key=lambda b: b[0])
        assert (got[t].draw, got[t].alpha) == (i, a) and math.isclose(got[t].score, score) and np.allclose(got[t].w, w)


def test_model_of_a_corpus(spark, tmp_path):
    """Fit report against dense algebra, and a model that comes back from its tables."""
    from tidegrid.sources import store

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    terms = spark.createDataFrame([(d, rng.choice(words[: 4 + d % 8])) for d in range(30) for _ in range(9)], "doc int, term string")
    held = spark.createDataFrame([("w0",), ("w1",), ("nothing",)], "term string")
    vocab, axis, told = lsa.fit(terms, held, 3, 0.9, 2)
    r = told.first()
    w = lsa.weighted(terms, vocab).collect()
    place = {t: i for i, t in enumerate(sorted({x.term for x in w}))}
    dense = np.zeros((30, len(place)))
    for x in w:
        dense[x.doc, place[x.term]] = x.w
    v = np.linalg.svd(dense)[2][:2].T
    assert r.vocabulary_size == len(place) and r.documents == 30 and r.held_out_tokens == 3 and r.held_out_unknown >= 1
    assert math.isclose(r.explained_variance_ratio, (dense @ v).var(0).sum() / dense.var(0).sum(), rel_tol=1e-6)
    store.save_model(str(tmp_path / "m"), vocab, axis, told)
    v2, a2, t2 = store.load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, vocab.collect())) and a2.count() == axis.count() and t2.first() == r


def test_report_sections(spark):
    rows = [("s", 0.1 * i, 0.01 * i - 0.05, 0.01 if i > 7 else 0.5, None, None, None, 23, 1 / 24, 0, None) for i in range(10)]
    names = "r2_global double, delta_r2 double, p_value_fdr double, r2_global_normalized double, delta_r2_normalized double, p_value_fdr_sensitivity double, n_exhaustive_shifts long, p_resolution_min double, n_exhaustive_shifts_sensitivity long, p_resolution_min_sensitivity double"
    df = spark.createDataFrame(rows, f"subject string, {names}")
    m = report.metrics(df, ["subject"])
    text = report.subject_report(m, "subject").first().report
    assert "### s\n" in text and "2 targets (20.00%)" in text and "mean 0.03500" in text and "23 shifts, smallest p 0.04167" in text
    assert "noise ceiling: N/A" in text and "larger margin: N/A" in text
    none = report.subject_report(report.metrics(df.withColumn("p_value_fdr", F.lit(0.9)), ["subject"]), "subject").first().report
    assert "their gain: N/A" in none
    whole = report.document(m, "subject", "T").first().report
    assert whole.startswith("# T\n\n## Each participant\n\n### s") and "in 1 of 1" in whole


def test_summaries(spark):
    from tidegrid.operators import modelling

    fits = spark.createDataFrame([(0.5, 0.1), (0.3, 0.3), (-0.2, 0.9)], "r2_global double, delta_r2 double")
    r = modelling.simulation_summary(fits).first()
    assert (r.targets, r.valid, r.mean_r2_global, r.mean_delta_r2, r.max_delta_r2) == (3, 2, 0.4, 0.2, 0.9)
    assert modelling.simulation_summary(fits.where("r2_global < 0")).first().max_delta_r2 is None
    assert tuple(audit.repeated(spark.createDataFrame([(0,), (1,), (2,), (5,)], "n int"), "n").first()) == (4, 1, 1, 2)


def test_report(spark):
    rows = [("s", i, 0.1 * i, 0.01 * i - 0.05, 0.01 if i > 7 else 0.5, None, None, None) for i in range(10)]
    df = spark.createDataFrame(rows, "subject string, voxel int, r2_global double, delta_r2 double, p_value_fdr double, r2_global_normalized double, delta_r2_normalized double, p_value_fdr_sensitivity double")
    m = report.metrics(df, ["subject"]).first()
    assert m.sig_count == 2 and m.sig_delta_mean == "0.03500" and m.delta_normalized_median == "N/A" and m.sensitivity_stability_pct == "N/A" and m.sig_sensitivity_pct == 0.0 and not m.sensitivity_computable
    none = report.metrics(df.withColumn("p_value_fdr", F.lit(0.9)).drop("p_value_fdr_sensitivity"), ["subject"])
    assert none.first().sig_delta_mean == "N/A" and "N/A" in report.markdown(none, "subject").first().report
    assert report.across(report.metrics(df.where("false"), ["subject"])).first().subjects == 0
    lim = report.limits(report.layers(df), ["subject"]).first()
    assert lim.limit_significant == pytest.approx(0.0399) and lim.limit_delta == pytest.approx(0.0491)


def test_audit(spark):
    df = spark.createDataFrame([("a", "x", 60.0, 2), ("a", "x", None, 1), ("b", "y", 30.0, 1)], "s string, story string, d double, run int")
    got = {r.s: tuple(r)[1:] for r in audit.by_subject(df, "s", "story", "d").collect()}
    assert got == {"a": (2, 1, 60.0, 1.0), "b": (1, 1, 30.0, 0.5)}
    runs = df.withColumn("run", F.col("run").cast("string")).withColumn("o", F.monotonically_increasing_id())
    assert runs.coalesce(1).groupBy("s").agg(audit.joined_names("run", False, "o").alias("r")).orderBy("s").first().r == "2, 1"
    d = audit.distribution(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), [], "v").first()
    assert (d.n, d.p25, d.median, d.p75) == (3, 1.5, 2.0, 3.0)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(V.rotate(F.col("x"), F.lit(1))).first()[0] == [3.0, 1.0, 2.0]
    bad = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in bad.select(V.clean_number(F.col("x"))).collect()] == [0.0, 0.0, 3.4028234663852886e38, 2.0]
    assert [r[0] for r in bad.select(V.estimable(F.col("x"))).collect()][1] is None
