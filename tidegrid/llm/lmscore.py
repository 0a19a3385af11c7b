"""Language-model scores by logistic context mixing.

Text is lower-cased (A-Z) and read as words and one end. A token's probability is a mixture of four routes, each
a distribution over all tokens, so the whole is one as well:

* two words: how often the token followed the two tokens before it, among all training texts;
* one word: how often it followed the token before it;
* class: how often it occurs in the training texts of a class (a value of `lang`, or none), under the posterior
  of the classes that the document's own tokens so far give (its own `lang` is never used);
* spelled: its bytes and a blank (the end: one line feed), bit by bit. Every bit is predicted from counts of zeros
  and ones in hashed contexts (the byte's earlier bits with the place in the word and the last 1, 2, 3 and 5
  bytes); the predictions are mixed in the logistic domain by weights that a gate chooses (how often the longer
  contexts were seen, and the bit), and a second table refines the result.

The first two routes open by logistic gates: weights chosen by how many of the last four tokens the two-word route
had foreseen, over how often the context was seen, refined by a table where there is evidence. So a text that goes
on as a training text did is soon trusted to go on so, and one that does not is not. A class's spelled share is
the share of its tokens that occur in it once. A training document's own occurrences are taken out of every count
of words and word contexts before it is scored: it is scored as a held-out one would be, and one that occurs twice
stands out. (The spelled route counts distinct words; its counts hold a document's own.)

What is gathered follows the input: counts of all words and of all two- and three-token sequences, under hashes
whose width follows the number of tokens. Documents are packed into chunks once; a chunk sends its distinct words and
sequences, sorted and delta-coded, to buckets, a bucket adds up and answers, and what a chunk has learnt of its
tokens is kept as codes (ratios of the routes, and spelled probabilities, rounded down to a sixteenth of an octave, so
that a distribution never exceeds one). The gates learn from the codes of all training documents, added up in a table of bounded size;
the spelled route's weights learn online in parallel from all distinct words, each bucket from its own, and are averaged by
the buckets' numbers of words. The spelled route's slots follow the number of distinct words up to 2^SLOTS_MOST.

Defined results: null text counts as empty and is the end alone; repeated rows are scored one by one; with no
training document the base is uniform smoothing and every token is spelled; words are told apart by 64-bit
SipHash. Classes are few, as languages are. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut, sweep

#: Bytes of text in a chunk.
CHUNK_BYTES = 8_000_000
#: Slots of the spelled route for each distinct word, and the most (as powers of two): two counts a slot.
SLOTS_EACH, SLOTS_LEAST, SLOTS_MOST = 8, 16, 23
SLICES = 64
ORDERS = 5
BATCH = 4096
BLOCK_WORDS = 20_000
BLOCK_TOKENS = 150_000
BLANK, END = 32, 10
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
_BEGIN, _LAST = np.uint64(0x1B873593A5A5A5A5), np.uint64(0x85EBCA6BC2B2AE35)
_ASKS = "chunk long, bucket long, keys binary, extra binary"
_ANSWERS = "chunk long, bucket long, answer binary"


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * _M
    return (h ^ (h >> np.uint64(31))) * _N


# ---- packed columns


def squeeze(a: np.ndarray) -> bytes:
    """An array, exactly; whole numbers (none negative) in the fewest bytes that hold the largest."""
    a = np.ascontiguousarray(a)
    if a.dtype.kind in "iu":
        a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T) if len(a) else a
    return a.dtype.name.encode() + b"|" + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def spread(raw: bytes) -> np.ndarray:
    name, _, rest = bytes(raw).partition(b"|")
    kind = np.dtype(name.decode())
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(rest), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_words(some: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(" ".join(some).encode("utf-8", "surrogatepass"))


def unpack_words(raw: bytes) -> list[str]:
    joined = zstandard.ZstdDecompressor().decompress(bytes(raw)).decode("utf-8", "surrogatepass")
    return joined.split(" ") if joined else []


def keys_of(some: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(some, object), categorize=False) if some else np.zeros(0, np.uint64)


def _edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // buckets for i in range(buckets)], np.uint64)


def spans(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """For sorted keys of so many bits: bucket, first and end, for buckets that have any."""
    cuts = [*np.searchsorted(keys, _edges(buckets, bits)).tolist(), len(keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def deal(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int, bytes]]:
    """As spans, and the bucket's keys as differences."""
    edges = _edges(buckets, bits)
    return [(i, a, b, squeeze(np.diff(keys[a:b], prepend=edges[i]))) for i, a, b in spans(keys, buckets, bits)]


def dealt_keys(bucket: int, raw: bytes, buckets: int, bits: int) -> np.ndarray:
    return _edges(buckets, bits)[bucket] + np.cumsum(spread(raw).astype(np.uint64), dtype=np.uint64)


# ---- the spelled route


def symbols(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens, each with a blank behind it, and each byte's token. An empty token is the end."""
    arr = tokens.cast(pa.large_string()) if len(tokens) else pa.array([], pa.large_string())
    size = pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pa.array(["\x20".join([*arr.to_pylist(), ""])], pa.large_string())
    s = np.frombuffer(joined.buffers()[2], np.uint8, int(size.sum()) + len(size)).copy() if len(size) else np.zeros(0, np.uint8)
    last = np.cumsum(size + 1) - 1
    s[last[size == 0]] = END
    return s, np.repeat(np.arange(len(size)), size + 1)


def contexts(s: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
    """For each order, a hash of what stands before each byte in its token."""
    n = len(s)
    at = np.arange(n)
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if n else np.zeros(0, int)
    place = at - np.repeat(first, np.diff(np.r_[first, n]))
    wide = s.astype(np.uint64) + np.uint64(1)
    before = lambda k: np.where(place >= k, np.r_[np.zeros(k, np.uint64), wide[:-k]] if k < n else np.zeros(n, np.uint64), np.uint64(0))
    out = [np.minimum(place, 3).astype(np.uint64) + np.uint64(1001)]
    h = np.full(n, 77, np.uint64)
    for k in range(1, 6):
        h = _mix(h, before(k) + np.uint64(k << 20))
        if k != 4:
            out.append(h + np.uint64(k))
    return out


def regions(ctx: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For each order, a slot of each byte's context; the byte's bits have slots around it."""
    return [(_mix(c, np.uint64(1 << 50)) >> np.uint64(64 - bits)).astype(np.int64) for c in ctx]


def node_of(s: np.ndarray, bit: int) -> np.ndarray:
    return (1 << bit) | (s.astype(np.int64) >> (8 - bit))


def bit_of(s: np.ndarray, bit: int) -> np.ndarray:
    return (s >> np.uint8(7 - bit)) & np.uint8(1)


def add_counts(table: np.ndarray, tokens: pa.Array) -> None:
    """Adds each token's bits once to table[slot, bit]."""
    flat, bits, one = table.reshape(-1), len(table).bit_length() - 1, table.dtype.type(1)
    for a in range(0, len(tokens), BLOCK_WORDS):
        s, token = symbols(tokens.slice(a, BLOCK_WORDS))
        around = [2 * x for x in regions(contexts(s, token), bits)]
        for bit in range(8):
            own = 2 * node_of(s, bit) + bit_of(s, bit)
            for x in around:
                np.add.at(flat, x ^ own, one)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    return (np.log((n1 + 0.04) / (n0 + 0.04)) * (n / (n + 0.3))).astype(np.float32)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


#: Places of a count among 0, 1, 2-3, 4-7, ... that part the gate's classes: of five bytes, and of three.
FIVE_STEPS, THREE_STEPS = (1, 2, 4, 6), (1, 4)
GATES = (len(FIVE_STEPS) + 1) * (len(THREE_STEPS) + 1)


def levels(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1)), 15).astype(np.uint8)


_KIND = np.searchsorted(FIVE_STEPS, np.arange(16), side="right")[:, None] * (len(THREE_STEPS) + 1) + np.searchsorted(THREE_STEPS, np.arange(16), side="right")


def _initial() -> np.ndarray:
    """Trust the longest context the more the oftener it was seen."""
    w = np.zeros((GATES, 8, ORDERS + 1), np.float32)
    rest = np.array([0.02, 0.1, 0.2, 0.68, 0, 0], np.float32)
    for g in range(GATES):
        trust = (0.0, 0.3, 0.5, 0.7, 0.8)[g // (len(THREE_STEPS) + 1)]
        w[g] = rest * (1 - trust)
        w[g, :, ORDERS - 1] = trust
    return w.reshape(-1, ORDERS + 1)


@dataclass
class Spelled:
    counts: np.ndarray = field(default_factory=lambda: np.zeros((1 << SLOTS_LEAST, 2), np.uint32))  # zeros and ones by slot
    weights: np.ndarray = field(default_factory=_initial)
    refined: np.ndarray = field(default_factory=lambda: np.tile(_squash((np.arange(65) - 32) / 3), (GATES, 1)))

    _x: np.ndarray | None = None
    _level: np.ndarray | None = None

    @property
    def bits(self) -> int:
        return len(self.counts).bit_length() - 1

    def __getstate__(self) -> dict:
        return {**self.__dict__, "counts": squeeze(self.counts.ravel()), "_x": None, "_level": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, counts=spread(state["counts"]).astype(np.uint32).reshape(-1, 2))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Each slot's stretched prediction and level, made once in a process."""
        if self._x is None:
            n0, n1 = self.counts[:, 0].astype(np.float32), self.counts[:, 1].astype(np.float32)
            self._x, self._level = _stretch(n0, n1), levels(n0 + n1)
        return self._x, self._level

    def mixed(self, inputs: list[np.ndarray], level: list[np.ndarray], bit: int) -> tuple[np.ndarray, ...]:
        """Mixed and final probabilities of a one; the gate, its class and the refinement's cell. level: of the two longest contexts."""
        kind = _KIND[level[-1], level[-2]]
        gate = kind * 8 + bit
        w = self.weights.T
        z = w[ORDERS][gate]
        for own, x in zip(w, inputs):
            z += own[gate] * x
        p = _squash(z)
        cell = np.clip(np.rint(z * 3) + 32, 0, 64).astype(np.int64)
        final = np.clip(0.75 * p + 0.25 * self.refined[kind, cell], 2.0**-16, 1 - 2.0**-16)
        return p, final, gate, kind, cell

    def score(self, tokens: pa.Array) -> np.ndarray:
        """log10 probability of each token."""
        out, (x, level) = [], self.tables()
        for a in range(0, len(tokens), BLOCK_WORDS):
            s, token = symbols(tokens.slice(a, BLOCK_WORDS))
            around, total = regions(contexts(s, token), self.bits), np.ones(len(s))
            for bit in range(8):
                node = node_of(s, bit)
                at = [r ^ node for r in around]
                _, p, *_ = self.mixed([x[i] for i in at], [level[i] for i in at[-2:]], bit)
                total *= np.where(bit_of(s, bit) == 1, p, 1 - p)
            out.append(np.bincount(token, weights=np.log10(total), minlength=min(BLOCK_WORDS, len(tokens) - a)))
        return np.concatenate(out) if out else np.zeros(0)

    def learn(self, tokens: pa.Array) -> None:
        """One bit batch after the other, steps scaled by the gradients so far; a word's own bits are taken
        out of its counts first."""
        past = np.full(self.weights.shape, 1e-3)
        for a in range(0, len(tokens), 2000):
            s, token = symbols(tokens.slice(a, 2000))
            around = regions(contexts(s, token), self.bits)
            for bit in range(8):
                y, node = bit_of(s, bit), node_of(s, bit)
                got = [self.counts[r ^ node].astype(np.float32) for r in around]
                n0, n1 = [np.maximum(g[:, 0] - (y == 0), 0) for g in got], [np.maximum(g[:, 1] - (y == 1), 0) for g in got]
                x, level = np.stack([_stretch(u, v) for u, v in zip(n0, n1)]), np.stack([levels(u + v) for u, v in zip(n0[-2:], n1[-2:])])
                for b in range(0, len(s), BATCH):
                    part = slice(b, b + BATCH)
                    p, _, gate, kind, cell = self.mixed(x[:, part], level[:, part], bit)
                    miss = y[part] - p
                    slope = np.stack([np.bincount(gate, weights=w * miss, minlength=len(self.weights)) for w in x[:, part]] + [np.bincount(gate, weights=miss, minlength=len(self.weights))], 1) / len(gate)
                    past += slope**2
                    self.weights += (0.05 * slope / np.sqrt(past)).astype(np.float32)
                    at = kind * 65 + cell
                    self.refined += 0.005 * np.bincount(at, weights=y[part] - self.refined.ravel()[at], minlength=self.refined.size).reshape(self.refined.shape)
                    np.clip(self.refined, 1e-6, 1 - 1e-6, out=self.refined)


def fit_spelled(lexicon: DataFrame, kinds: int) -> Spelled:
    """Counts of all distinct training words' bits, then weights learnt in parallel from all of them and averaged."""
    bits = int(np.clip(np.ceil(np.log2(max(1, SLOTS_EACH * kinds))), SLOTS_LEAST, SLOTS_MOST))
    size, width = 1 << bits, (1 << bits) // SLICES

    def known(row: bytes, counts: bytes) -> pa.Array:
        n = sum(spread(x).astype(np.int64) for x in pickle.loads(counts))
        return pa.array([w for w, c in zip(unpack_words(row), (n > 0).tolist()) if c], pa.large_string())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((size, 2), np.uint32)
        for frame in frames:
            for row, n in frame[["words", "counts"]].itertuples(index=False):
                add_counts(table, known(row, n))
        for i in range(SLICES):
            part = table[i * width : (i + 1) * width]
            at = np.flatnonzero(part.any(1))
            if len(at):
                yield pd.DataFrame({"slice": [i], "at": [squeeze(np.diff(at, prepend=0))], "n": [squeeze(part[at].ravel())]})
        words.release()

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((width, 2), np.int64)
        for at, n in zip(frame["at"], frame["n"]):
            table[np.cumsum(spread(at).astype(np.int64))] += spread(n).reshape(-1, 2)
        return pd.DataFrame({"slice": [int(frame["slice"].iloc[0])], "n": [squeeze(table.ravel())]})

    model = Spelled(np.zeros((size, 2), np.uint32))
    summed = lexicon.select("words", "counts").mapInPandas(count, "slice long, at binary, n binary").groupBy("slice").applyInPandas(add, "slice long, n binary")
    for row in summed.collect():  # SLICES rows, of a size that SLOTS_MOST bounds
        model.counts[row["slice"] * width : (row["slice"] + 1) * width] = spread(row["n"]).reshape(-1, 2)
    sent = lexicon.sparkSession.sparkContext.broadcast(model)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a task: its buckets' weights, each times its number of words, added up."""
        n, weights, refined = 0, np.zeros(sent.value.weights.size), np.zeros(sent.value.refined.size)
        for frame in frames:
            for row, counts in frame[["words", "counts"]].itertuples(index=False):
                tokens = known(row, counts)
                if len(tokens):
                    own = Spelled(sent.value.counts, sent.value.weights.copy(), sent.value.refined.copy())
                    own.learn(tokens)
                    n, weights, refined = n + len(tokens), weights + len(tokens) * own.weights.ravel().astype(float), refined + len(tokens) * own.refined.ravel()
        if n:
            yield pd.DataFrame({"n": [float(n)], "weights": [weights.tolist()], "refined": [refined.tolist()]})
        words.release()

    told = lexicon.select("words", "counts").mapInPandas(learn, "n double, weights array<double>, refined array<double>")
    each = lambda c: told.select("n", F.posexplode(c).alias("i", "v")).groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("i")
    told = cut(told)
    for name in ("weights", "refined"):
        got = each(name).toPandas()["v"].to_numpy()
        if len(got):
            setattr(model, name, got.reshape(getattr(model, name).shape).astype(getattr(model, name).dtype))
    sent.destroy()
    return model


# ---- chunks of documents


@dataclass
class Chunk:
    ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    kind: np.ndarray  # 0: no class
    per: np.ndarray  # words of each document
    size: np.ndarray  # bytes of each document
    words: list[str]
    code: np.ndarray

    @staticmethod
    def of(raw: bytes) -> Chunk:
        ids, null, held, kind, per, size, some, code = pickle.loads(bytes(raw))
        return Chunk(spread(ids), spread(null).astype(bool), spread(held).astype(bool), *(spread(x).astype(np.int64) for x in (kind, per, size)), unpack_words(some), spread(code).astype(np.int64))


def packed(docs: DataFrame, held: Column, names: list[str]) -> DataFrame:
    """chunk, body: documents in the order they are read, packed; text never moves."""
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("lang")), F.lit(0)) if names else F.lit(0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = words.as_arrow(batch.column("text")), batch.column("doc_id").cast(pa.int64())
            plain = lambda name: batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for a, b in words.blocks(texts, CHUNK_BYTES):
                distinct, code, per = words.split(pc.ascii_lower(texts.slice(a, b - a)))
                own = ids.slice(a, b - a)
                body = (np.asarray(pc.fill_null(own, 0)), own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), plain("held")[a:b], plain("kind")[a:b], per, pc.binary_length(texts.slice(a, b - a)).to_numpy(zero_copy_only=False))
                ids_ = body[0].view(np.uint64) if (body[0] < 0).any() else body[0]
                raw = pickle.dumps((squeeze(ids_), *map(squeeze, body[1:]), pack_words(distinct.to_pylist()), squeeze(code)))
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([raw], pa.binary())], ["chunk", "body"])
                at += 1
        words.release()

    return docs.select("doc_id", "text", held.cast("long").alias("held"), kind.cast("long").alias("kind")).mapInArrow(read, "chunk long, body binary")


def sequences(c: Chunk, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens with a begin and an end around each document: the document, and the keys of the two and of
    the three tokens that end there (0 where the document has not so many)."""
    n = c.per + 2
    last = np.cumsum(n) - 1
    first = last - n + 1
    doc = np.repeat(np.arange(len(n)), n)
    h = np.zeros(int(n.sum()), np.uint64)
    inner = np.ones(len(h), bool)
    inner[first] = inner[last] = False
    h[inner] = keys[c.code] if len(c.code) else 0
    h[first], h[last] = _BEGIN, _LAST
    two, three = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    pair = _mix(_mix(np.uint64(5) + h[:-1], np.uint64(1)), h[1:])
    two[1:] = pair
    three[2:] = _mix(_mix(pair[:-1], np.uint64(3)), h[2:])
    shift = np.uint64(64 - bits)
    return doc, two >> shift, three >> shift


@dataclass
class Grams:
    """The distinct keys of a chunk's sequences, each place's key among them, and its number in its own document."""

    keys: np.ndarray
    train: np.ndarray
    two: np.ndarray
    three: np.ndarray
    own_two: np.ndarray
    own_three: np.ndarray


def in_order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of so many bits, and the keys in it."""
    low = max(1, (len(key) - 1).bit_length())
    if bits + low > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key.astype(np.uint64) << np.uint64(low)) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


def own_counts(key: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each place's key among them and its count in its document. Documents ascend."""
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, k = in_order(key, bits)
    d = doc[order]
    new = np.r_[True, k[1:] != k[:-1]]
    heads = np.flatnonzero(new | np.r_[True, d[1:] != d[:-1]])
    times = np.diff(np.r_[heads, len(k)])
    place, own = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    place[order], own[order] = np.cumsum(new) - 1, np.repeat(times, times)
    return k[new], place, own


def grams(c: Chunk, keys: np.ndarray, bits: int) -> Grams:
    doc, two, three = sequences(c, keys, bits)
    n = c.per + 2
    first = np.cumsum(n) - n
    has = np.ones((2, len(doc)), bool)  # of two tokens, of three
    has[:, first] = has[1, first + 1] = False
    has = has.ravel(order="F")  # documents ascend
    at = np.flatnonzero(has)
    key, owner = np.stack([two, three], 1).ravel()[at], np.repeat(doc, 2)[at]
    distinct, place, own = own_counts(key, owner, bits)
    train = np.bincount(place, weights=~c.held[owner], minlength=len(distinct)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    spread_, own_ = np.full(2 * len(doc), -1, np.int64), np.zeros(2 * len(doc), np.int64)
    spread_[at], own_[at] = place, own
    return Grams(distinct, train, spread_[::2], spread_[1::2], own_[::2], own_[1::2])


# ---- gates


#: Levels of how often a context was seen (1, 2-3, 4-7, ...): of one word, and of two; tokens looked back on.
LEVELS_ONE, LEVELS_TWO, BACK = 14, 8, 4
CELLS_ONE, CELLS_TWO = LEVELS_ONE * (BACK + 1) + 1, LEVELS_TWO * (BACK + 1) + 1
#: Steps of a ratio's code to an octave, and the code of ratio one (0: the route does not have the token).
STEPS, MIDDLE = 16, 1024
#: Octaves that the learning table puts together, and its codes.
COARSE, COARSE_CODES = 2, 33
#: Occurrences that weigh as much as the mixed gate in a refined one.
EVIDENCE = 50.0


def ratio_code(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.floor(STEPS * np.log2(np.where(ratio > 0, ratio, 1))) + MIDDLE, 1, 2 * MIDDLE - 1), 0).astype(np.int64)


def ratio_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((code - MIDDLE) / STEPS), 0.0)


def spelled_code(log10: np.ndarray) -> np.ndarray:
    """Spelled probabilities in steps of an octave, rounded down like the ratios."""
    return np.ceil(-log10 * np.log2(10) * STEPS).astype(np.int64)


def spelled_log10(code: np.ndarray) -> np.ndarray:
    return code / (-np.log2(10) * STEPS)


def foreseen(hit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many of the last BACK tokens of its document were hits, for each token."""
    out = np.zeros(len(doc), np.int64)
    for back in range(1, BACK + 1):
        if back < len(doc):
            out[back:] += hit[:-back] * (doc[back:] == doc[:-back])
    return out


def cells(n: np.ndarray, hits: np.ndarray, most: int) -> np.ndarray:
    level = np.minimum(np.floor(np.log2(np.maximum(n, 1))), most - 1).astype(np.int64)
    return np.where(n > 0, level * (BACK + 1) + hits + 1, 0)


def coarse(one: np.ndarray, r1: np.ndarray, two: np.ndarray, r2: np.ndarray) -> np.ndarray:
    part = lambda r: np.where(r > 0, np.clip((r - MIDDLE) // (STEPS * COARSE) + COARSE_CODES // 2 + 1, 1, COARSE_CODES - 1), 0)
    return ((one * COARSE_CODES + part(r1)) * CELLS_TWO + two) * COARSE_CODES + part(r2)


def _uncoarse(code: np.ndarray) -> tuple[np.ndarray, ...]:
    whole = lambda q: np.where(q > 0, np.exp2((q - COARSE_CODES // 2 - 0.5) * COARSE), 0.0)
    code, q2 = np.divmod(code, COARSE_CODES)
    code, two = np.divmod(code, CELLS_TWO)
    one, q1 = np.divmod(code, COARSE_CODES)
    return one, whole(q1), two, whole(q2)


@dataclass
class Gates:
    """weights[route][tokens foreseen]: bias and slope over the context's level; refined[route][cell]."""

    weights: list[np.ndarray] = field(default_factory=lambda: [np.tile([-3.0, 0.0], (BACK + 1, 1)) for _ in range(2)])
    refined: list[np.ndarray] = field(default_factory=lambda: [np.zeros(CELLS_ONE), np.zeros(CELLS_TWO)])
    seen: list[np.ndarray] = field(default_factory=lambda: [np.zeros(CELLS_ONE), np.zeros(CELLS_TWO)])

    def mixed(self, route: int, cell: np.ndarray) -> np.ndarray:
        level, hits = np.divmod(cell - 1, BACK + 1)
        w = self.weights[route][hits]
        return np.where(cell > 0, _squash(w[..., 0] + w[..., 1] * level), 0.0)

    def table(self, route: int) -> np.ndarray:
        """The gate's probability for each cell: mixed, and refined where there is evidence."""
        g = self.mixed(route, np.arange(len(self.seen[route])))
        n = self.seen[route]
        return (EVIDENCE * g + n * self.refined[route]) / (EVIDENCE + n) * (np.arange(len(n)) > 0)

    def learn(self, code: np.ndarray, n: np.ndarray, turns: int = 60) -> None:
        """Online, in batches of the table's rows in hashed order; then the refinement."""
        if not len(code):
            return
        order = np.argsort(_mix(code.astype(np.uint64), np.uint64(11)), kind="stable")
        one, r1, two, r2 = (x[order] for x in _uncoarse(code))
        n = n[order].astype(float)
        past = [np.full((BACK + 1, 2), 1e-6) for _ in range(2)]

        def routes(g1: np.ndarray, g2: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """How much of a token's probability came by two words, and by one of the rest."""
            low = g1 * r1[part] + 1 - g1
            whole = g2 * r2[part] + (1 - g2) * low
            by_two = g2 * r2[part] / whole
            return by_two, (1 - by_two) * g1 * r1[part] / low, 1 - by_two

        step = max(4096, len(code) // 16)
        for _ in range(turns):
            for a in range(0, len(code), step):
                part = slice(a, a + step)
                g1, g2 = self.mixed(0, one[part]), self.mixed(1, two[part])
                by_two, by_one, rest = routes(g1, g2, part)
                for route, cell, miss in ((0, one[part], by_one - rest * g1), (1, two[part], by_two - g2)):
                    use = cell > 0
                    level, hits = np.divmod(cell[use] - 1, BACK + 1)
                    slope = np.zeros((BACK + 1, 2))
                    pull = miss[use] * n[part][use]
                    np.add.at(slope, hits, np.stack([pull, pull * level], 1))
                    slope /= max(1.0, n[part].sum())
                    past[route] += slope**2
                    self.weights[route] += 0.3 * slope / np.sqrt(past[route])
        for route, cell in ((0, one), (1, two)):
            self.refined[route] = self.mixed(route, np.arange(len(self.seen[route])))
        whole = slice(None)
        for _ in range(20):
            by_two, by_one, rest = routes(self.refined[0][one], self.refined[1][two], whole)
            for route, cell, got, chance in ((0, one, by_one, rest), (1, two, by_two, np.ones(len(n)))):
                size = len(self.seen[route])
                top, base = np.bincount(cell, weights=got * n, minlength=size), np.bincount(cell, weights=chance * n, minlength=size)
                self.refined[route] = np.clip(np.where(base > 0, top / np.maximum(base, 1e-9), self.refined[route]), 1e-6, 1 - 1e-6) * (np.arange(size) > 0)
                self.seen[route] = base


# ---- scoring


@dataclass
class Corpus:
    """What all chunks need to know of the corpus: training tokens by class (ends included), ends by class, the spelled
    share of a class, its prior, and the sums."""

    tokens: np.ndarray
    ends: np.ndarray
    spelled: np.ndarray
    prior: np.ndarray
    total: int
    kinds: int
    end_spelled: float = -1.0
    bits: int = 40

    @property
    def floor(self) -> float:
        return self.total + 0.1 * (self.kinds + 1)


def class_route(n: np.ndarray, spelled: np.ndarray, doc: np.ndarray, kind: np.ndarray, train: np.ndarray, own: np.ndarray, length: np.ndarray, corpus: Corpus) -> np.ndarray:
    """log probability of each token of whole documents by class and spelling. n: its counts by class; spelled: its
    log10 probability when spelled; own: its count in its document; by document: kind, train, length (tokens)."""
    said, chance = 10.0**spelled, []
    for k in range(n.shape[1]):
        mine = train & (kind == k)
        left = corpus.tokens[k] - length * mine
        share = np.where(left > 0, (1 - corpus.spelled[k]) / np.maximum(left, 1), 0.0)
        rest = np.where(left > 0, corpus.spelled[k], 1.0)
        chance.append(share[doc] * (n[:, k] - own * mine[doc]) + rest[doc] * said)
    per = [np.log(x) for x in chance]
    first = np.cumsum(length) - length
    so_far = []
    for p, prior in zip(per, corpus.prior):
        before = np.cumsum(p) - p
        so_far.append(before - before[first][doc] + np.log(prior))
    top = np.maximum.reduce(so_far)
    weight = [np.exp(x - top) for x in so_far]
    return np.log(sum(w * p for w, p in zip(weight, chance)) / sum(weight))


def coded(c: Chunk, n: np.ndarray, spelled: np.ndarray, keys: np.ndarray, count: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, ...]:
    """For the words' counts by class and spelled log10, and for the counts of the chunk's sequences: by document base
    score, known tokens and log10 by class and spelling; by token (words, then the end) the two cells and ratio codes."""
    g = grams(c, keys, corpus.bits)
    docs, length = len(c.per), c.per + 1
    doc = np.repeat(np.arange(docs), length)
    last = np.cumsum(length) - 1
    is_word = np.ones(len(doc), bool)
    is_word[last] = False
    train = ~c.held
    whole = n.sum(1)
    by = np.repeat(corpus.ends[None], len(doc), 0).astype(float)
    say = np.full(len(doc), corpus.end_spelled)
    by[is_word], say[is_word] = n[c.code], spelled[c.code]
    own = np.ones(len(doc), np.int64)
    own[is_word] = own_counts(c.code, doc[is_word], 32)[2]
    total = by.sum(1)
    base = np.bincount(doc, weights=np.log10((total + 0.1) / corpus.floor), minlength=docs)
    known = np.bincount(doc, weights=total > 0, minlength=docs).astype(np.int64)
    # tokens stand one place behind their document's begin in the chunk's sequences
    at = np.arange(len(doc)) + doc + 1
    mine = train[doc].astype(np.int64)
    seen = lambda place, own_: np.where(place >= 0, count[np.maximum(place, 0)] - own_ * mine, 0)
    c1, c2 = seen(g.two[at], g.own_two[at]), seen(g.three[at], g.own_three[at])
    n2 = np.where(g.two[at - 1] >= 0, count[np.maximum(g.two[at - 1], 0)] - g.own_two[at - 1] * mine, 0)
    begins = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    n1 = np.where(begins, corpus.ends.sum() - mine, np.r_[0, (total - own * mine)[:-1]] if len(doc) else 0)
    c1, c2 = np.minimum(c1, n1), np.minimum(c2, n2)  # less only where two keys collide
    hits = foreseen((c2 > 0).astype(np.int64), doc)
    low = np.empty(len(doc))
    for a, b in _spans(length):
        part = slice(a, b)
        d = doc[part] - doc[a]
        ds = slice(doc[a], doc[b - 1] + 1)
        low[part] = class_route(by[part], say[part], d, c.kind[ds], train[ds], own[part], length[ds], corpus)
    with np.errstate(over="ignore"):
        r1 = ratio_code(np.where(n1 > 0, c1 / np.maximum(n1, 1), 0) / np.exp(low))
        r2 = ratio_code(np.where(n2 > 0, c2 / np.maximum(n2, 1), 0) / np.exp(low))
    return base, known, np.bincount(doc, weights=low, minlength=docs) / np.log(10), cells(n1, hits, LEVELS_ONE), r1, cells(n2, hits, LEVELS_TWO), r2, doc, whole


def _spans(length: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of tokens of whole documents, of about BLOCK_TOKENS."""
    ends = np.cumsum(length)
    group = (ends - length) // BLOCK_TOKENS
    edges = np.flatnonzero(np.r_[True, np.diff(group) > 0]) if len(length) else np.zeros(0, int)
    begin = (ends - length)[edges].tolist()
    return list(zip(begin, [*begin[1:], int(ends[-1])])) if len(length) else []


def prepare(docs: DataFrame, held: Column) -> tuple[DataFrame, Gates, Corpus, Spelled]:
    """Coded chunks (chunk, body), the gates, what is known of the corpus and the spelled route."""
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    spark = docs.sparkSession
    ends_by = {r["lang"]: r["n"] for r in docs.where(~held).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(x for x in ends_by if x is not None)
    classes = len(names) + 1
    ends = np.array([ends_by.get(x, 0) for x in [None, *names]], np.int64)
    rows = packed(docs, held, names)
    whole = cut(rows)
    chunks = max(1, whole.count())
    buckets = max(8, chunks // 4)

    def lexical(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A chunk's distinct words by key, with their counts by class in its training documents."""
        for frame in frames:
            for chunk, body in frame[["chunk", "body"]].itertuples(index=False):
                c = Chunk.of(body)
                keys = keys_of(c.words)
                order = np.argsort(keys, kind="stable")
                kind = np.where(c.held, -1, c.kind)[np.repeat(np.arange(len(c.per)), c.per)]
                n = [np.bincount(c.code[kind == k], minlength=len(keys))[order] for k in range(classes)]
                some, cuts = [c.words[i] for i in order.tolist()], spans(keys[order], buckets, 64)
                if cuts:
                    yield pd.DataFrame({"chunk": chunk, "bucket": [i for i, _, _ in cuts], "keys": b"", "extra": [pickle.dumps((pack_words(some[x:y]), [squeeze(v[x:y]) for v in n])) for _, x, y in cuts]})
            words.release()

    def tally(frame: pd.DataFrame) -> pd.DataFrame:
        """A bucket's distinct words by key, with their training counts by class, and which of them each chunk has."""
        frame = frame.sort_values("chunk")
        told = [(unpack_words(some), n) for some, n in map(pickle.loads, frame["extra"])]
        every = [w for some, _ in told for w in some]
        unique, first, place = np.unique(keys_of(every), return_index=True, return_inverse=True)
        n = [np.bincount(place, weights=np.concatenate([spread(x[k]) for _, x in told]), minlength=len(unique)).astype(np.int64) for k in range(classes)]
        ends_ = np.cumsum([len(some) for some, _ in told]).tolist()
        asked = [(int(chunk), squeeze(np.diff(place[e - len(some) : e], prepend=0))) for chunk, e, (some, _) in zip(frame["chunk"], ends_, told)]
        words.release()
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "kinds": [int((sum(n) > 0).sum())], "tokens": [[int(x.sum()) for x in n]], "single": [[int((x == 1).sum()) for x in n]], "words": [pack_words([every[i] for i in first.tolist()])], "counts": [pickle.dumps([squeeze(x) for x in n])], "asked": [pickle.dumps(asked)]})

    lexicon = cut(whole.mapInPandas(lexical, _ASKS).groupBy("bucket").applyInPandas(tally, "bucket long, kinds long, tokens array<long>, single array<long>, words binary, counts binary, asked binary"))
    sweep(spark)
    sums = lexicon.agg(F.sum("kinds").alias("kinds"), *[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("tokens", "single") for k in range(classes)]).first()
    of = lambda c: np.array([sums[f"{c}{k}"] or 0 for k in range(classes)], np.int64)
    tokens = of("tokens") + ends
    spelled_share = np.clip((of("single") + 0.5) / (tokens + 1.0), 1e-6, 0.999)
    kinds = sums["kinds"] or 0
    spelled = fit_spelled(lexicon, kinds)
    total = int(tokens.sum())
    every = max(total, 1 << 20)
    corpus = Corpus(tokens, ends, spelled_share, (tokens + 1.0) / (total + classes), total, kinds + bool(ends.sum()), float(spelled.score(pa.array([""]))[0]), min(56, int(np.ceil(np.log2(every))) + 7))
    sent = spark.sparkContext.broadcast(spelled)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """To each chunk, the counts of its words and their spelled log10, in the order of their keys."""
        for frame in frames:
            for bucket, some, counts, asked in frame[["bucket", "words", "counts", "asked"]].itertuples(index=False):
                say = spelled_code(sent.value.score(pa.array(unpack_words(some), pa.large_string())))
                n, out = [spread(x) for x in pickle.loads(counts)], []
                for chunk, raw in pickle.loads(asked):
                    at = np.cumsum(spread(raw).astype(np.int64))
                    out.append((chunk, bucket, pickle.dumps(([squeeze(x[at]) for x in n], squeeze(say[at])))))
                yield pd.DataFrame(out, columns=["chunk", "bucket", "answer"])
            words.release()

    def ask_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, body in frame[["chunk", "body"]].itertuples(index=False):
                c = Chunk.of(body)
                g = grams(c, keys_of(c.words), corpus.bits)
                rows_ = deal(g.keys, chunks, corpus.bits)
                if rows_:
                    yield pd.DataFrame({"chunk": chunk, "bucket": [x[0] for x in rows_], "keys": [x[3] for x in rows_], "extra": [squeeze(g.train[a:b]) for _, a, b, _ in rows_]})
            words.release()

    def add_grams(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked = [dealt_keys(int(key[0]), raw, chunks, corpus.bits) for raw in frame["keys"]]
        order, k = in_order(np.concatenate(asked), corpus.bits)
        new = np.r_[True, k[1:] != k[:-1]]
        place = np.empty(len(k), np.int64)
        place[order] = np.cumsum(new) - 1
        n = np.bincount(place, weights=np.concatenate([spread(x) for x in frame["extra"]])).astype(np.int64)
        ends_ = np.cumsum([len(x) for x in asked])
        out = [squeeze(n[place[b - len(x) : b]]) for b, x in zip(ends_.tolist(), asked)]
        words.release()
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "answer": out})

    def code(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, body in frame[["chunk", "body"]].itertuples(index=False):
            c = Chunk.of(body)
            keys = keys_of(c.words)
            order = np.argsort(keys, kind="stable")
            lexical_ = [pickle.loads(x) for x in told[told["kind"] == 0].sort_values("bucket")["answer"]]
            n, say = np.zeros((len(keys), classes)), np.zeros(len(keys))
            if lexical_:
                say[order] = spelled_log10(np.concatenate([spread(s) for _, s in lexical_]))
                for k in range(classes):
                    n[order, k] = np.concatenate([spread(x[k]) for x, _ in lexical_])
            count = [spread(x).astype(np.int64) for x in told[told["kind"] == 1].sort_values("bucket")["answer"]]
            base, known, low, one, r1, two, r2, doc, _ = coded(c, n, say, keys, np.concatenate(count) if count else np.zeros(0, np.int64), corpus)
            value, times = np.unique(coarse(one, r1, two, r2)[~c.held[doc]], return_counts=True)
            per = (c.ids.astype(np.int64), c.null.astype(np.uint8), c.held.astype(np.uint8), c.per, c.size, base, known, low)
            # a cell's number of hits follows from the codes, so only its level is kept
            level = lambda cell: (cell + BACK) // (BACK + 1)
            body = pickle.dumps(([squeeze(x.view(np.uint64) if x.dtype == np.int64 and len(x) and x.min() < 0 else x) for x in per], [squeeze(x) for x in (level(one), r1, level(two), r2)]))
            out.append((chunk, body, squeeze(np.diff(value, prepend=0)), squeeze(times)))
            words.release()
        return pd.DataFrame(out, columns=["chunk", "body", "codes", "times"])

    by_words = lexicon.select("bucket", "words", "counts", "asked").mapInPandas(answer, _ANSWERS)
    # answers are written before chunks meet them, so that what asked for them is deleted by then
    by_grams = cut(whole.mapInPandas(ask_grams, _ASKS).groupBy("bucket").applyInPandas(add_grams, _ANSWERS))
    sweep(spark)
    told = by_words.withColumn("kind", F.lit(0)).unionByName(by_grams.withColumn("kind", F.lit(1)))
    done = cut(whole.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(code, "chunk long, body binary, codes binary, times binary"))

    def add_codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, times = [], []
        for frame in frames:
            for a, b in frame[["codes", "times"]].itertuples(index=False):
                value.append(np.cumsum(spread(a).astype(np.int64)))
                times.append(spread(b).astype(np.int64))
        if value:
            unique, place = np.unique(np.concatenate(value), return_inverse=True)
            yield pd.DataFrame({"code": unique, "n": np.bincount(place, weights=np.concatenate(times)).astype(np.int64)})

    # as many rows as cells and coarse ratios make at most, whatever the input
    table = done.select("codes", "times").mapInPandas(add_codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    gates = Gates()
    gates.learn(table["code"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    return done.select("chunk", "body"), gates, corpus, spelled


def token_log10(one: np.ndarray, r1: np.ndarray, two: np.ndarray, r2: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of how much likelier the gated routes make each token than class and spelling alone."""
    g1, g2 = tables[0][one], tables[1][two]
    return np.log10(g2 * ratio_of(r2) + (1 - g2) * (g1 * ratio_of(r1) + 1 - g1))


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learns where held is false."""
    done, gates, corpus, _ = prepare(docs, held)
    tables = gates.table(0), gates.table(1)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["body"]:
                per, by_token = pickle.loads(bytes(raw))
                ids, null, held_, n, size, base, known, low = (spread(x) for x in per)
                n, size, ids = n.astype(np.int64), size.astype(np.int64), ids.astype(np.uint64).view(np.int64)
                doc = np.repeat(np.arange(len(n)), n + 1)
                one, r1, two, r2 = (spread(x).astype(np.int64) for x in by_token)
                hits = foreseen((r2 > 0).astype(np.int64), doc)
                one, two = (np.where(x > 0, (x - 1) * (BACK + 1) + hits + 1, 0) for x in (one, two))
                whole = low + np.bincount(doc, weights=token_log10(one, r1, two, r2, tables), minlength=len(n))
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(null.astype(bool)), "held_out": held_.astype(bool), "n_tokens": n + 1, "n_known": known.astype(np.int64), "train_tokens": corpus.total, "base_score": base, "score": whole, "bits_per_byte": -whole * np.log2(10) / np.maximum(size, 1)})

    return done.mapInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


__all__ = ["Gates", "Spelled", "prepare", "score", "token_log10"]
