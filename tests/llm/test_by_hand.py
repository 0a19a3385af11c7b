"""Language models and fingerprints against versions that follow the definition word by word."""

import collections
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from tests.llm import data
from tidegrid.llm import langid, winnow


def runs_of(word):
    """Runs of letters of a lower-cased word, each with the blank behind it."""
    out, run = [], ""
    for c in word + " ":
        if c.isalpha():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def predicted(word):
    """(symbols before, padded with blanks; symbol) of everything that a model of the full order predicts."""
    for run in runs_of(word):
        whole = " " * (langid.ORDER - 1) + run + " "
        for i in range(langid.ORDER - 1, len(whole)):
            yield whole[i - langid.ORDER + 1 : i], whole[i]


def test_kneser_ney_by_hand():
    counts = pd.DataFrame({"lang": ["a"] * 4 + ["b"] * 3, "word": ["aba", "abba", "baab", "x-abab", "ccd", "dcc", "cab"], "n": [3, 2, 1, 1, 4, 1, 2]})
    model = langid.train(counts, pd.DataFrame({"lang": [], "text": []}))
    langs, grams = ["a", "b"], {}
    for lang in langs:
        own = counts[counts["lang"] == lang]
        top = collections.Counter()
        for w, n in zip(own["word"], own["n"]):
            for before, c in predicted(w):
                top[before, c] += n
        orders = {langid.ORDER: top}
        for n in range(langid.ORDER - 1, 0, -1):
            # how many different symbols stand before it
            orders[n] = collections.Counter((before[1:], c) for before, c in orders[n + 1])
        grams[lang] = orders
    alphabet = {c for lang in langs for _, c in grams[lang][1]}
    uniform = 0.5 / max(2, len(alphabet)) / 50

    def chance(lang, before, c, n):
        if n == 0:
            return uniform
        if n == 1 and c not in alphabet:
            return uniform
        own = grams[lang][n]
        once, twice = (sum(v == k for v in own.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context = before[len(before) - n + 1 :] if n > 1 else ""
        total, kinds = sum(v for (b, _), v in own.items() if b == context), sum(b == context for b, _ in own)
        low = chance(lang, before, c, n - 1)
        return max(own[context, c] - discount, 0) / total + discount * kinds / total * low if total else low

    texts = ["aba", "abab ccd", "zebra", "cabd, ab", "xabba x"]
    h, n = model.texts(pa.array(texts))
    for i, text in enumerate(texts):
        each = [x for w in text.split() for x in predicted(w)]
        assert n[i] == len(each)
        for j, lang in enumerate(langs):
            want = -sum(math.log(chance(lang, before, c, langid.ORDER)) for before, c in each) / len(each)
            assert abs(h[i, j] - want) < 1e-4, (text, lang, h[i, j], want)
    assert model.decide(pa.array(texts))[0][:2] == ["a", "a" if h[1, 0] < h[1, 1] else "b"]


def keys_by_hand(text):
    raw, k, w = text.encode(), winnow.K, winnow.W
    if not raw:
        return []
    grams = [raw[i : i + k] for i in range(max(1, len(raw) - k + 1))]
    keys = []
    for i, g in enumerate(grams, 1):
        v = ((xxhash.xxh64_intdigest(g, seed=42) << 24) + 0xFFFFFF - i) & (2**64 - 1)
        keys.append(v - 2**64 if v >> 63 else v)
    return list(dict.fromkeys(min(keys[a : a + w]) for a in range(max(1, len(keys) - w + 1))))


def alike(a, b):
    x, y = {k >> 24 for k in a}, {k >> 24 for k in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_winnowing_by_hand(spark):
    docs = data.frame(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    say = lambda keys: ",".join(f"{k & (2**64 - 1):X}" for k in keys)
    want = collections.Counter()
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        own, changed, after = keys_by_hand(t), keys_by_hand(t[: len(t) - q] + u[:q]), keys_by_hand(u)
        want[d, say(own), say(changed), round(alike(own, changed), 9), round(alike(own, after), 9)] += 1
    got = collections.Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnow.compare(docs).collect())
    assert got == want
    assert len({x for x in np.ravel([k[3:] for k in got])}) > 3
