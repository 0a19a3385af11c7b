"""Language identification by interpolated Kneser-Ney character models.

One model per language. A text is lower-cased and cut into runs of letters; every run is read with
blanks before and after it, so a letter's context never leaves its run. All n-grams of all models
live in one sorted array of 64-bit hashes per order, beside a matrix of log-probabilities (a column
per language); contexts live in a second sorted array with their back-off weights. The language of
the lowest cross-entropy per symbol wins. A text is rejected when its cross-entropy lies farther
above the language's mean than a limit calibrated on labelled texts that the counts never saw.

Defined results: a text that is null, empty or without letters gets `und`, score 0 and is rejected;
equal entropies go to the language that sorts first; a language with fewer than five calibration texts
has no limit and rejects nothing; repeated rows are answered one by one; with no
labelled row at all, every text is `und`. The score is the winner's share of the languages' likelihoods, as if the
text had SCORED symbols at most: beyond, it would be 1 for every text. Extra columns of the input are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

UND = "und"
ORDER = 5
#: Labelled documents of each language that a model is fitted on (expected number, drawn by hash).
SAMPLE = 600
#: Of those, one in so many only calibrates the rejection limit.
CALIBRATION = 5
#: The limit above a language's mean is this quantile of all calibration texts' deviations from their own languages'
#: means, less SHORT / sqrt(n) each (never below 0), times SLACK; a text of n symbols may lie SHORT / sqrt(n) farther.
QUANTILE = 0.995
SLACK = 1.2
SHORT = 4.0
SCORED = 60
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean"


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _MUL
    return h ^ (h >> np.uint64(29))


_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _ALPHA[0]


def _symbols(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols to predict (letters, and one blank after each run), the token of each, and a matrix
    of the ORDER - 1 symbols before each (nearest first; 0 stands for a blank)."""
    raw = np.frombuffer(" ".join([*tokens, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    token = np.cumsum(raw == 32) - (raw == 32)
    sym = np.where(_letters()[np.minimum(raw, 0x10FFFF)], raw, 0).astype(np.uint64)
    blank = sym == 0
    after = np.r_[False, ~blank[:-1]]
    use = ~blank | after
    at = np.arange(len(sym))
    since = at - np.maximum.accumulate(np.where(np.r_[True, blank[:-1]], at, 0))
    small = sym.astype(np.uint32)
    before = [np.where(since >= k, np.r_[np.zeros(k, np.uint32), small[:-k]] if k < len(sym) else np.zeros(len(sym), np.uint32), np.uint32(0))[use] for k in range(1, ORDER)]
    return sym[use], token[use], np.stack(before)


def _contexts(before: np.ndarray, n: int) -> list[np.ndarray]:
    """For each order 1..ORDER, a hash of the order - 1 symbols before each of n symbols."""
    ctx, h = [], np.full(n, 0x51ED27, dtype=np.uint64)
    for k in range(1, ORDER + 1):
        if k > 1:
            h = _mix(h, before[k - 2].astype(np.uint64) + np.uint64(k << 32))
        ctx.append(h)
    return ctx


def _grams(ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    return _mix(ctx, sym + np.uint64(1 << 40))


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = -14.0
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None

    def token_scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each token by language, and how many symbols it predicts."""
        sym, token, before = _symbols(tokens)
        ctx = _contexts(before, len(sym))
        del before
        out = np.zeros((len(sym), len(self.langs)), np.float32)
        left = np.arange(len(sym))
        for n in range(ORDER, 0, -1):
            at, ok = _find(self.grams[n - 1], _grams(ctx[n - 1][left], sym[left]))
            out[left[ok]] += self.logp[n - 1][at[ok]]
            left = left[~ok]
            if not len(left):
                break
            if n == 1:
                out[left] += self.floor
                break
            at, ok = _find(self.contexts[n - 1], ctx[n - 1][left])
            out[left[ok]] += self.backoff[n - 1][at[ok]]
        n_sym = np.bincount(token, minlength=len(tokens)).astype(np.int64)
        return np.stack([np.bincount(token, weights=out[:, j], minlength=len(tokens)) for j in range(len(self.langs))], 1), n_sym

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text by language (nats per symbol) and its number of symbols."""
        arr = pc.utf8_lower(words.as_arrow(texts))
        distinct, at, lens = words.split(arr)
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if len(at):
            score, n_sym = self.token_scores(distinct.to_pylist())
            doc = np.repeat(np.arange(len(texts)), lens)
            n = np.bincount(doc, weights=n_sym[at], minlength=len(texts)).astype(np.int64)
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(doc, weights=score[at, j], minlength=len(texts))
        return -total / np.maximum(n, 1)[:, None], n

    def decide(self, texts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.langs:
            z = np.zeros(len(texts))
            return [UND] * len(texts), z, z, z.astype(np.int64), z == 0
        h, n = self.texts(texts)
        best, real = h.argmin(1), n > 0
        sharp = np.exp(-(h - h.min(1, keepdims=True)) * np.minimum(n, SCORED)[:, None])
        score = np.where(real, 1 / sharp.sum(1), 0.0)
        own = h[np.arange(len(h)), best]
        far = own - self.mean[best] > self.limit[best] + SHORT / np.sqrt(np.maximum(n, 1))
        return [self.langs[b] if r else UND for b, r in zip(best, real)], score, np.where(real, own, 0.0), n, far | ~real


def train(counts: pd.DataFrame, calibration: pd.DataFrame) -> Model:
    """counts: lang, word, n. calibration: lang, text."""
    langs = sorted(counts["lang"].unique())
    model, per = Model(langs), []
    for lang in langs:
        own = counts[counts["lang"] == lang]
        sym, token, before = _symbols(own["word"].tolist())
        weight = own["n"].to_numpy(np.float64)[token]
        ctx = _contexts(before, len(sym))
        del before
        grams = [_grams(c, sym) for c in ctx]
        orders, keep = [], None
        for n in range(ORDER, 0, -1):
            g, first, inverse = np.unique(grams[n - 1], return_index=True, return_inverse=True)
            # the highest order counts tokens, lower ones count distinct continuations to the left
            if n == ORDER:
                c = np.bincount(inverse, weights=weight)
            else:
                c = np.bincount(inverse[keep], minlength=len(g)).astype(np.float64)
            keep = first
            orders.append((g, c, ctx[n - 1][first], grams[n - 2][first] if n > 1 else None))
        per.append(orders[::-1])
    vocab = max(2, len(np.unique(np.concatenate([p[0][0] for p in per]))))
    uniform = np.log(0.5 / vocab / 50)
    model.floor = float(uniform)
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([p[n - 1][0] for p in per]))
        contexts = np.unique(np.concatenate([p[n - 1][2] for p in per]))
        ctx_of, low_of = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for p in per:
            at = np.searchsorted(union, p[n - 1][0])
            ctx_of[at] = p[n - 1][2]
            if n > 1:
                low_of[at] = p[n - 1][3]
        logp, back = np.zeros((len(union), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        below = model.logp[n - 2][np.searchsorted(model.grams[n - 2], low_of)] if n > 1 else np.full((len(union), len(langs)), uniform)
        for j, p in enumerate(per):
            g, c, cx, _ = p[n - 1]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(contexts, cx)
            total, kinds = np.bincount(at, weights=c, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            back[:, j] = np.log(gamma)
            count = np.zeros(len(union))
            count[np.searchsorted(union, g)] = c
            where = np.searchsorted(contexts, ctx_of)
            seen = np.maximum(count - discount, 0) / np.maximum(total[where], 1)
            logp[:, j] = np.log(seen + gamma[where] * np.exp(below[:, j]) + 1e-12)
        model.grams.append(union)
        model.logp.append(logp)
        model.contexts.append(contexts)
        model.backoff.append(back)
    model.mean, model.limit = np.zeros(len(langs)), np.full(len(langs), np.inf)
    over, known = [], []
    for j, lang in enumerate(langs):
        own = calibration.loc[calibration["lang"] == lang, "text"].tolist()
        if own:
            h, n = model.texts(own)
            h, n = h[n > 0, j], n[n > 0]
            if len(n) >= 5:
                model.mean[j] = np.average(h, weights=np.sqrt(n))
                over.append(h - model.mean[j] - SHORT / np.sqrt(n))
                known.append(j)
    if known:
        # one limit for all: a quantile so high needs more texts than one language has
        model.limit[known] = SLACK * max(0.0, float(np.quantile(np.concatenate(over), QUANTILE)))
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        for one in dict.fromkeys(lang):
            distinct, at, _ = words.split(pc.utf8_lower(words.as_arrow(batch.column("text").filter(pa.array(lang == one)))))
            n = np.bincount(at, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(distinct), pa.string()), distinct.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Fits on an expected number of `sample` documents of each language among the rows where `learn`
    holds, drawn by a hash of text, so that neither order nor partitioning matters. The model
    is built in one task whose input `sample` bounds, and the driver gets the model alone."""
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    chance = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v)))])
    # copies are drawn together, so each text counts once and `sample` bounds what is drawn
    drawn = rows.withColumn("draw", draw / chance[F.col("lang")]).where("draw < 1").dropDuplicates(["lang", "text"])
    part = F.floor(F.col("draw") * 1000 * CALIBRATION) % CALIBRATION
    counted = drawn.where(part != 0).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.select("lang", "word", "n").unionByName(drawn.where(part == 0).select("lang", F.col("text").alias("word"), F.lit(0).cast("long").alias("n")))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        held = frame["n"] == 0
        counts = frame[~held] if (~held).any() else pd.DataFrame({"lang": frame["lang"], "word": frame["word"], "n": 1})
        made = pickle.dumps(train(counts, frame[held].rename(columns={"word": "text"})))
        words.release()
        return pd.DataFrame({"model": [made]})

    # one task, of bounded input: the sample's distinct words and its calibration texts
    return pickle.loads(rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(build, "model binary").first()["model"])


def predict(docs: DataFrame, model: Model, block_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, n_letters, rejected; one row for each input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_arrow(batch.column("text"))
            for a, b in words.blocks(texts, block_bytes):
                lang, score, entropy, n, rejected = sent.value.decide(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(n), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "n_letters", "rejected"])
        words.release()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def keep(docs: DataFrame, model: Model, block_bytes: int = 3_000_000) -> DataFrame:
    """The rows of docs, all columns, whose text is not rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.as_arrow(batch.column("text"))
            for a, b in words.blocks(texts, block_bytes):
                yield batch.slice(a, b - a).filter(pa.array(~sent.value.decide(texts.slice(a, b - a))[4]))
        words.release()

    return docs.mapInArrow(run, docs.schema)
