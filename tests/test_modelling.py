"""Assembly, the two fits and the spaces, end to end on small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import config
from tidegrid.operators import extract, lsa, modelling, report, segments, signal


def test_encoding_against_dense(spark):
    rng = np.random.default_rng(0)
    names, n = [f"x{i}" for i in range(5)], {"a": 60, "b": 50, "c": 55, "test": 44}
    x = {s: rng.normal(size=(m, 5)) for s, m in n.items()}
    weights = np.array([[1, 0, 0], [0, 1, 0], [0.5, 0, 0], [0, 0, 0], [1.5, 0, 0]], float)
    sessions = [("s1", "a"), ("s1", "b"), ("s2", "c"), ("s1", "test"), ("s2", "test")]
    y = {k: x[k[1]] @ weights + rng.normal(size=(n[k[1]], 3)) for k in sessions}
    series = spark.createDataFrame([(s, j, *map(float, x[s][j])) for s in x for j in range(n[s])], "story string, j long, " + ", ".join(f"{c} double" for c in names))
    bold = spark.createDataFrame([(*k, j, [float(v) for v in y[k][j]]) for k in sessions for j in range(n[k[1]] - (k == ("s2", "test")))], "session string, story string, j long, y array<double>")
    m = modelling.assembled(series, modelling.long_form(bold), names, "test")
    assert m.x_test.count() == 43 and m.x_train.count() == 165
    got = {r.voxel_idx: r for r in modelling.encoded(m, names[:4]).collect()}
    assert len(modelling.encoded(m, names[:4]).columns) == 16
    z = lambda a: (a - a.mean(0)) / a.std(0)
    xs = {k: z(x[k[1]][: n[k[1]] - (k == ("s2", "test"))]) for k in sessions}
    ys = {k: z(y[k][: n[k[1]] - (k == ("s2", "test"))]) for k in sessions}
    xt, yt = xs["s1", "test"][:43], (ys["s1", "test"][:43] + ys["s2", "test"][:43]) / 2

    def fit(use, t):
        best = []
        for a in config.ALPHAS:
            score = 0
            for held in sessions[:3]:
                rest = [k for k in sessions[:3] if k != held]
                tx, ty = np.vstack([xs[k][:, use] for k in rest]), np.concatenate([ys[k][:, t] for k in rest])
                w = np.linalg.solve(tx.T @ tx + a * np.eye(len(use)), tx.T @ ty)
                score += 1 - ((ys[held][:, t] - xs[held][:, use] @ w) ** 2).sum() / (ys[held][:, t] ** 2).sum()
            best.append(score)
        a = config.ALPHAS[int(np.argmax(best))]
        tx, ty = np.vstack([xs[k][:, use] for k in sessions[:3]]), np.concatenate([ys[k][:, t] for k in sessions[:3]])
        p = xt[:, use] @ np.linalg.solve(tx.T @ tx + a * np.eye(len(use)), tx.T @ ty)
        return 1 - ((yt[:, t] - p) ** 2).sum() / ((yt[:, t] - yt[:, t].mean()) ** 2).sum()

    for t in range(3):
        assert got[t].r2_global == pytest.approx(fit([0, 1, 2, 3, 4], t), abs=1e-5)
        assert got[t].r2_restricted == pytest.approx(fit([0, 1, 2, 3], t), abs=1e-5)
    assert got[0].p_value_raw == pytest.approx(1 / 24) and got[0].n_exhaustive_shifts == 23 and got[0].p_resolution_min == pytest.approx(1 / 24)
    summary = report.metrics(modelling.for_report(modelling.encoded(m, names[:4])).withColumn("subject", F.lit("s")), ["subject"]).first()
    assert summary.total == 3 and summary.n_exhaustive_shifts == 23
    without = modelling.missing_features(modelling.long_form(bold), series.where("story <> 'c'")).collect()
    assert [(r.session, r.story) for r in without] == [("s2", "c")]


def test_scaling_by_training(spark):
    a, b = spark.createDataFrame([(1.0,), (3.0,)], "x double"), spark.createDataFrame([(5.0,)], "x double")
    tr, te = modelling.scaled_by_training(a, b, ["x"])
    assert sorted(r.x for r in tr.collect()) == [-1.0, 1.0] and te.first().x == 3.0


def test_simulation(spark):
    x, y = modelling.simulated(spark, 80, 3, 2)
    assert x.count() == y.count() == 80 and len(x.columns) == 5


def annotator():
    kinds = {"the": ("DET", "DT"), "cat": ("NOUN", "NN"), "walked": ("VERB", "VBD"), "home": ("ADV", "RB"), "sees": ("VERB", "VBZ")}

    def one(text):
        out, at = [], 0
        for i, w in enumerate(text.replace(".", " .").split()):
            at = text.index(w, at)
            pos, tag = kinds.get(w, ("PUNCT", "."))
            out.append({"i": i, "idx": at, "text": w, "pos": pos, "tag": tag, "dep": "", "head_i": max(0, i - 1), "lemma": w, "is_stop": w == "the", "is_punct": pos == "PUNCT", "like_num": False})
            at += len(w)
        return out

    return one


def test_spaces(spark):
    said = [("", 0.0, 0.1), ("The", 0.1, 0.2), ("cat", 0.2, 0.5), ("walked", 0.5, 0.9), ("", 0.9, 1.7), ("the", 1.7, 1.8), ("cat", 1.8, 2.0), ("sees", 2.0, 2.4), ("home", 2.4, 3.0)]
    words = spark.createDataFrame([("a", i, t0, t1, w) for i, (w, t0, t1) in enumerate(said)], "story string, ord long, t0 double, t1 double, text string")
    phones = spark.createDataFrame([("a", 0, 0.1, 0.2, "DH"), ("a", 1, 0.2, 0.3, "sp"), ("a", 2, 0.3, 0.4, "AE1")], "story string, ord long, t0 double, t1 double, text string")
    tokens = extract.annotated(segments.text_of(segments.punctuated(words)), annotator)
    freq = spark.createDataFrame([("cat", 4.5)], "word string, zipf double")
    vocab = spark.createDataFrame([("cat", 2, 1.0), ("walked", 1, 1.5)], "term string, df long, idf double")
    axis = spark.createDataFrame([("cat", [1.0] + [0.0] * 9), ("walked", [0.0, 1.0] + [0.0] * 8)], "term string, axis array<double>")
    found = extract.spaces(words, phones, tokens, freq, vocab, axis)
    m = extract.matrix(found)
    got = {r.k: r for r in m.collect()}
    assert len(got) == 300 and m.columns[2:] == list(config.FEATURES)
    assert got[15].determiner == 1 and got[30].noun == 1 and got[30].lexical_frequency == 4.5 and got[60].past_regular == 1 and got[210].non_past_marked_3sg == 1
    assert got[12].voiced == 1 and got[35].vocalic == 1 and got[100].word_presence == 0
    assert got[40].semantic_dim_0 == pytest.approx(1 / (1 + 1.5**2) ** 0.5) and got[250].semantic_dim_0 == pytest.approx(1.0) and got[100].semantic_dim_0 == 0
    assert got[15].is_root == 1 and got[30].syntactic_depth == 1
    tr = signal.responses(m, list(config.FEATURES)).collect()
    assert len(tr) == 2
    assert lsa.coverage(spark.createDataFrame([("cat",), ("dog",)], "term string"), vocab).first().pct == 50.0
