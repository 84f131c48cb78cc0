"""Scoring by a log-bilinear model trained with noise-contrastive estimation.

Words are counted over all training documents. Those counted at least OFTEN
times, the OWN most frequent of them at most, are units with vectors of their
own, all others fall into RARE units by their last two characters, and the end
of a text is unit 0, which also stands before its first word. The prediction of
a unit from the CONTEXT units before it is the sum of their context vectors,
each weighted by the vector of its position. Units are in bands of SIZE by
frequency: the prediction's products with the bands' target vectors, then with
those of the units of one band, plus biases, give the normalised probabilities
of bands and of units in their band. A rare word's probability is that of its
unit times its smoothed share of the unit's words; words never seen are one
event of each rare unit.

Every training token is used once. Texts become unit numbers, in pieces of
PIECE tokens at most, and a hash of the document and piece deals these into
shards of about SHARD tokens, so what a shard holds follows from the corpus and
not from how its rows are dealt. Shards are taken in WAVES, one after the other.
Each shard of a wave takes the model and the sums of squared gradients as the
wave before left them, and improves the model by gradient steps of the
noise-contrastive objective, with noise drawn from the frequencies by a
generator seeded by the shard's number. The changes of a unit are averaged over
the shards by how often each met the unit, the gains of the squared gradients
over all of them. They are summed as whole numbers, so that the order in which
they come makes no difference, and a task that is run again returns the same.

Counts of the KNOWN most frequent words go to the tasks, which bounds what is
sent, as OWN does for the model; the other words of each document meet their
counts in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm import shingles
from fedseek.llm.common import dropped, stored

OWN, OFTEN, RARE, KNOWN = 6144, 5, 64, 200_000
DIM, CONTEXT, SIZE = 24, 3, 80
BATCH, RATE = 4096, 0.1
#: Tokens of a shard and of a piece, waves of shards, rows that repeat a document and may be in one shard, tasks of a wave.
SHARD, PIECE, WAVES, REPEATS, TASKS = 1_000_000, 1 << 16, 8, 1000, 20_000
#: What a row's sum of squared gradients starts with, so that a first step is small: of vectors, of biases.
EARLIER, EARLIER_BIAS = 1.0, 100.0
#: Noise drawn for each batch: bands, and units of each band.
BAND_NOISE, UNIT_NOISE = 16, 12
#: Changes are summed as multiples of 1/FIXED, squares of 1/FIXED_SQUARE, and moved in blocks of rows.
FIXED, FIXED_SQUARE, BLOCK = 1 << 20, 1 << 10, 512
#: Sums of a block that are formed before its last.
SUMS = 64
#: Tokens that are scored at once, and rows of a product of matrices.
CHUNK, ROWS = 32_768, 2048
#: Numbers whose exp has room in four bytes, summed too.
NEAR = 70


def training(doc_id: str = "doc_id") -> Column:
    return ~F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def rare_class(word: str, rare: int = RARE) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % rare


@dataclass
class Bilinear:
    """context, unit: vectors [unit, DIM]; band: vectors [band, DIM]; position: [CONTEXT, DIM]; biases; freq: count of each unit, smoothed."""

    context: np.ndarray
    unit: np.ndarray
    band: np.ndarray
    position: np.ndarray
    unit_bias: np.ndarray
    band_bias: np.ndarray
    freq: np.ndarray
    size: int = SIZE

    @classmethod
    def start(cls, counts: np.ndarray, dim: int = DIM, size: int = SIZE, seed: int = 7) -> Bilinear:
        """A model of unit frequencies only: vectors near 0."""
        rng, k = np.random.default_rng(seed), len(counts)
        freq = counts + 0.5
        band = np.add.reduceat(freq, np.arange(0, k, size))
        small = lambda n: rng.normal(0, 0.05, (n, dim)).astype(np.float32)
        inside = np.log(freq / np.repeat(band, size)[:k])
        return cls(small(k), small(k), small(len(band)), np.full((CONTEXT, dim), 1 / CONTEXT, dtype=np.float32), inside.astype(np.float32), np.log(band / band.sum()).astype(np.float32), freq, size)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return np.einsum("ijk,jk->ik", self.context[before], self.position)

    def log_probability(self, before: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each unit of seq after the units before it [token, CONTEXT]."""
        out = np.empty(len(seq))
        # one more column has biases
        band, unit = np.column_stack([self.band, self.band_bias]), np.column_stack([self.unit, self.unit_bias])
        longest = max(_lengths(band).max(initial=0.0), _lengths(unit).max(initial=0.0))
        for lo in range(0, len(seq), CHUNK):
            y = seq[lo : lo + CHUNK]
            order = _order(y // self.size, len(self.band))
            y, q = y[order], self.predicted(before[lo : lo + CHUNK][order])
            q = np.concatenate([q, np.ones((len(q), 1), dtype=q.dtype)], axis=1)
            # no product is larger than that of the lengths
            g, lp, most = y // self.size, np.empty(len(y)), _lengths(q) * longest
            for a in range(0, len(y), ROWS):
                lp[a : a + ROWS] = _log_share(q[a : a + ROWS] @ band.T, g[a : a + ROWS], most[a : a + ROWS].max() < NEAR)
            starts = np.flatnonzero(np.diff(g, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(y)), strict=True):
                first = int(g[a]) * self.size
                vectors = unit[first : first + self.size].T
                for c in range(a, b, ROWS):
                    d = min(c + ROWS, b)
                    lp[c:d] += _log_share(q[c:d] @ vectors, y[c:d] - first, most[c:d].max() < NEAR)
            out[lo + order] = lp
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"context": self.context, "unit": np.column_stack([self.unit, self.unit_bias]), "band": np.column_stack([self.band, self.band_bias]), "position": self.position}

    def moved(self, by: dict[str, np.ndarray]) -> Bilinear:
        now = {k: (x + by[k]).astype(np.float32) if k in by else x for k, x in self.arrays().items()}
        return Bilinear(now["context"], np.ascontiguousarray(now["unit"][:, :-1]), np.ascontiguousarray(now["band"][:, :-1]), now["position"], now["unit"][:, -1], now["band"][:, -1], self.freq, self.size)


def _order(x: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers under `below`; short types are sorted by radix."""
    return np.argsort(x.astype(np.min_scalar_type(below)), kind="stable")


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def _log_share(s: np.ndarray, own: np.ndarray, near: bool = False) -> np.ndarray:
    """log of exp(s[i, own[i]]) over the sum of exp of row i; s is used up. near: all of s are within NEAR of 0, so that exp needs no shift."""
    mine = s[np.arange(len(s)), own].astype(np.float64)
    if near:
        np.exp(s, out=s)
        return mine - np.log((s @ np.ones(s.shape[1], dtype=s.dtype)).astype(np.float64))
    top = s.max() if len(s) else 0.0
    if s.size and top - s.min() > 80:  # far apart: each row by its own largest
        top = s.max(axis=1)
        s -= top[:, None]
    else:
        s -= top
    np.exp(s, out=s)
    return mine - top - np.log(s.sum(axis=1, dtype=np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


#: Sums of squared gradients by row: of vectors, of biases.
State = tuple[dict[str, np.ndarray], dict[str, np.ndarray]]


def fresh(model: Bilinear) -> State:
    rows = {k: len(x) for k, x in model.arrays().items()}
    return {k: np.full(n, EARLIER) for k, n in rows.items()}, {k: np.full(n, EARLIER_BIAS) for k, n in rows.items()}


class Trainer:
    """Steps of the noise-contrastive objective on one shard's tokens."""

    def __init__(self, model: Bilinear, rate: float, state: State | None = None):
        self.start = model.arrays()
        self.m = Bilinear(*(x.copy() for x in (model.context, model.unit, model.band, model.position, model.unit_bias, model.band_bias)), model.freq, model.size)
        self.rate = rate
        self.band_p = np.add.reduceat(model.freq, np.arange(0, len(model.freq), model.size)) / model.freq.sum()
        # running sums of the units' chances in their bands, those of band i from i to i + 1, and the log of how often noise draws each
        of = np.arange(len(model.freq)) // model.size
        inside = model.freq / (self.band_p * model.freq.sum())[of]
        self.unit_cdf = np.minimum(np.cumsum(inside), of + 1.0)
        self.unit_cdf[np.flatnonzero(np.diff(of, append=-1))] = np.arange(len(self.band_p)) + 1.0
        self.unit_logp = np.log(UNIT_NOISE * inside).astype(np.float32)
        self.band_cdf = np.append(np.cumsum(self.band_p)[:-1], 2.0)
        self.band_logp = np.log(BAND_NOISE * self.band_p).astype(np.float32)
        #: sums of squared gradients by row, and how often each row was met
        self.earlier = state or fresh(model)
        self.square, self.square_bias = ({k: x.copy() for k, x in part.items()} for part in self.earlier)
        self.met = {k: np.zeros(len(x)) for k, x in self.start.items()}

    def _move(self, name: str, rows: np.ndarray | slice, vectors: np.ndarray, grad: np.ndarray, bias: np.ndarray | None = None, bias_grad: np.ndarray | None = None) -> None:
        """A step up the gradient, scaled to each row's own past; rows are distinct."""
        square = self.square[name]
        square[rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        vectors[rows] += grad * (self.rate / np.sqrt(square[rows])).astype(np.float32)[:, None]
        if bias is not None:
            square = self.square_bias[name]
            square[rows] += bias_grad * bias_grad
            bias[rows] += bias_grad * (self.rate / np.sqrt(square[rows])).astype(np.float32)

    def step(self, before: np.ndarray, seq: np.ndarray, rng: np.random.Generator) -> None:
        m = self.m
        order = _order(seq, len(m.freq))
        before, y = before[order], seq[order]
        ctx = m.context[before]
        q = np.einsum("ijk,jk->ik", ctx, m.position)
        g = y // m.size
        # bands
        noise, logp = np.searchsorted(self.band_cdf, rng.random(BAND_NOISE)), self.band_logp
        targets = m.band[g]
        up = 1 - _sigmoid(np.einsum("ij,ij->i", q, targets) + m.band_bias[g] - logp[g])
        down = _sigmoid(q @ m.band[noise].T + m.band_bias[noise] - logp[noise])
        dq = up[:, None] * targets - down @ m.band[noise]
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        bands, ends = g[starts], np.append(starts[1:], len(y))
        grad, bias = np.zeros_like(m.band), np.zeros_like(m.band_bias)
        np.add.at(grad, noise, -(down.T @ q))
        np.add.at(bias, noise, -down.sum(axis=0))
        # units within the bands that the batch has; a batch is in their order
        each = np.flatnonzero(np.diff(y, prepend=-1))
        self.met["unit"][y[each]] += np.diff(np.append(each, len(y)))
        targets = m.unit[y]
        ups = 1 - _sigmoid(np.einsum("ij,ij->i", q, targets) + m.unit_bias[y] - self.unit_logp[y])
        dq += ups[:, None] * targets
        noise = np.searchsorted(self.unit_cdf, bands[:, None] + rng.random((len(starts), UNIT_NOISE)))
        # one more column has biases; one more column of down, what raises the band itself
        vectors = np.concatenate([m.unit[noise], (m.unit_bias[noise] - self.unit_logp[noise])[:, :, None]], axis=2)
        q1 = np.concatenate([q, np.ones((len(q), 1), dtype=q.dtype)], axis=1)
        down, part = np.empty((len(y), UNIT_NOISE + 1), dtype=np.float32), np.empty((len(starts), UNIT_NOISE + 1, q1.shape[1]), dtype=np.float32)
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        for (a, b), v in zip(spans, vectors, strict=True):
            down[a:b, :-1] = q1[a:b] @ v.T
        down = _sigmoid(down)
        down[:, -1] = -up
        for i, (a, b) in enumerate(spans):
            d = down[a:b]
            dq[a:b] -= d[:, :-1] @ vectors[i, :, :-1]
            part[i] = d.T @ q1[a:b]
        grad[bands] -= part[:, -1, :-1]
        bias[bands] -= part[:, -1, -1]
        # first what the batch has, then noise, which may be drawn several times
        own = np.add.reduceat(ups[:, None] * q1, each)
        drawn = noise.ravel()
        rows = np.zeros(len(m.unit), dtype=bool)
        rows[y[each]] = rows[drawn] = True
        rows = np.flatnonzero(rows)
        unit_grad = np.zeros((len(rows), q1.shape[1]), dtype=np.float32)
        unit_grad[np.searchsorted(rows, y[each])] = own
        np.subtract.at(unit_grad, np.searchsorted(rows, drawn), part[:, :-1].reshape(len(drawn), -1))
        unit_rows = rows
        # contexts
        flat = before.ravel()
        by = _order(flat, len(m.freq))
        each = np.flatnonzero(np.diff(flat[by], prepend=-1))
        rows = flat[by][each]
        context = np.add.reduceat((dq[:, None, :] * m.position).reshape(len(flat), -1)[by], each)
        self.met["context"][rows] += np.diff(np.append(each, len(flat)))
        self._move("position", slice(None), m.position, np.einsum("ijk,ik->jk", ctx, dq))
        self._move("context", rows, m.context, context)
        self._move("band", slice(None), m.band, grad, m.band_bias, bias)
        self._move("unit", unit_rows, m.unit, unit_grad[:, :-1], m.unit_bias, unit_grad[:, -1])
        self.met["band"][bands] += ends - starts
        self.met["position"] += len(y)

    def changes(self) -> Iterator[tuple[str, int, np.ndarray]]:
        """(array, block, rows of weighted change, weight, gains of squares as multiples) of what this shard has met."""
        for name, now in self.m.arrays().items():
            met = self.met[name]
            gain = [(now_[name] - then[name]) * FIXED_SQUARE for now_, then in zip((self.square, self.square_bias), self.earlier, strict=True)]
            change = np.column_stack([(now - self.start[name]) * met[:, None] * FIXED, met * FIXED, *gain])
            for block in range(-(-len(met) // BLOCK)):
                part = change[block * BLOCK : (block + 1) * BLOCK]
                if part[:, -3:].any():
                    yield name, block, np.rint(part).astype(np.int64)


class Units:
    """Unit and count of words."""

    def __init__(self, words: pa.Array, counts: np.ndarray, own: int, rare: int):
        self.words, self.counts = words.cast(pa.string()), np.append(counts, 0)
        self.own, self.rare = own, rare

    def of(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each word, count of each that is at hand, else 0."""
        if not len(vocabulary):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = pc.fill_null(pc.index_in(vocabulary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        last = pc.utf8_slice_codeunits(vocabulary, -2).dictionary_encode()
        classes = np.array([rare_class(w, self.rare) for w in last.dictionary.to_pylist()], dtype=np.int64)
        unit = np.where((at >= 0) & (at < self.own), at + 1, 1 + self.own + classes[last.indices.to_numpy(zero_copy_only=False)])
        return unit, self.counts[at]


def _coded(texts: pa.Array, units: Units) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit of each token with an end after each text, tokens of each text, words by code, their units and counts, row and code of each word)."""
    row, code, vocabulary = shingles.words(texts)
    vocabulary = vocabulary.cast(pa.string())
    unit, count = units.of(vocabulary)
    seq = np.zeros(len(row) + len(texts), dtype=np.int64)
    if len(row):
        seq[np.arange(len(row)) + row] = unit[code]
    return seq, np.bincount(row, minlength=len(texts)) + 1, vocabulary, unit, count, row, code


def _sequence(texts: pa.Array, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units before each token, unit of each token with an end after each text, starts of texts there, words by code, their units and counts, row and code of each word)."""
    seq, size, *words = _coded(texts, units)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(len(seq)) - np.repeat(start, size)
    before = np.zeros((len(seq), CONTEXT), dtype=np.int64)
    for j in range(1, CONTEXT + 1):
        before[j:, j - 1] = np.where(at[j:] >= j, seq[:-j], 0)
    return before, seq, start, *words


def _pieces(k: int, seq: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(k, number, units as two bytes each) of pieces of a text, each after the CONTEXT units that stand before it."""
    led = np.concatenate([np.zeros(CONTEXT, dtype=np.uint16), seq.astype(np.uint16)])
    for i, lo in enumerate(range(0, len(seq), PIECE)):
        yield k, i, led[lo : lo + PIECE + CONTEXT].tobytes()


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(units before each token, unit of each token) of pieces."""
    parts = [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in pieces]
    led = np.concatenate(parts)
    own = np.ones(len(led), dtype=bool)
    starts = np.cumsum([0, *(len(x) for x in parts[:-1])])
    for j in range(CONTEXT):
        own[starts + j] = False
    at = np.flatnonzero(own)
    return np.stack([led[at - j] for j in range(1, CONTEXT + 1)], axis=1), led[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in shingles.slices(batch, "text"):
            _, code, vocabulary = shingles.words(part.column("text"))
            n = np.bincount(code, minlength=len(vocabulary))
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([vocabulary.cast(pa.string()).filter(keep), pa.array(n).filter(keep)], names=["word", "c"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal blocks. All rows of a block are in one task, which adds them up as they come."""
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for name, block, x in zip(*(batch.column(i) for i in range(3)), strict=True):
            k, x = (name.as_py(), block.as_py()), np.frombuffer(x.as_py(), dtype=np.int64)
            if k in total:
                total[k] += x
            else:
                total[k] = x.copy()
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["name", "block", "x"])


def dealt(learn: DataFrame, sent_words, own: int, rare: int, shards: int) -> DataFrame:
    """shard, k, piece, units: the tokens of learn (k, text), k a hash of the row, stored.

    A piece's shard follows from k and its number. Rows that repeat a document
    are alike, so where they are more than REPEATS they go to several shards by
    their place, and it makes no difference which of them goes where.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(*sent_words.value, own, rare)
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                seq, size = _coded(part.column("text"), units)[:2]
                ends = np.cumsum(size)
                rows = [x for k, a, b in zip(part.column("k").to_pylist(), ends - size, ends, strict=True) for x in _pieces(k, seq[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["k", "piece", "units"])

    pieces = learn.mapInArrow(code, "k bigint, piece int, units binary")
    many = stored(learn.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") > REPEATS))
    salt = F.lit(0).cast("bigint")
    if not many.isEmpty():
        pieces = pieces.join(many, "k", "left")
        salt = F.when(F.col("rows").isNotNull(), F.monotonically_increasing_id() % F.ceil(F.col("rows") / REPEATS)).otherwise(salt)
    return stored(pieces.select(F.pmod(F.xxhash64("k", "piece", salt), F.lit(shards)).alias("shard"), "k", "piece", "units"))


def _improver(sent):
    """What a shard's pieces change of the model and state that were sent."""

    def improve(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        trainer = Trainer(sent.value[0], RATE, sent.value[1])
        before, seq = _joined(rows.sort_by([("k", "ascending"), ("piece", "ascending")]).column("units").to_pylist())
        rng = np.random.default_rng([7, key[0].as_py()])
        mixed = rng.permutation(len(seq))
        for lo in range(0, len(seq), BATCH):
            at = mixed[lo : lo + BATCH]
            trainer.step(before[at], seq[at], rng)
        found = list(trainer.changes())
        return pa.table([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2].tobytes() for x in found], pa.binary())], names=["name", "block", "x"])

    return improve


def trained(pieces: DataFrame, model: Bilinear, shards: int, waves: int = WAVES) -> Bilinear:
    """model after all shards of pieces (as dealt() has them). What reaches the driver is the model's size."""
    spark, state = pieces.sparkSession, fresh(model)
    for w in range(min(waves, shards)):
        sent, n = spark.sparkContext.broadcast((model, state)), len(range(w, shards, waves))

        # first some shards' changes to each other, then these sums, so that no task reads what every other wrote
        own = pieces.where(F.pmod("shard", F.lit(waves)) == w).repartition(min(n, TASKS), "shard")
        schema = "name string, block int, x binary"
        moved = own.groupBy("shard").applyInArrow(_improver(sent), schema).withColumn("some", F.spark_partition_id() % SUMS).repartition("name", "block", "some").mapInArrow(_summed, schema)
        moved = moved.repartition("name", "block").mapInArrow(_summed, schema).toArrow()
        by = {k: np.zeros_like(x, dtype=np.float64) for k, x in model.arrays().items()}
        square = tuple({k: x.copy() for k, x in part.items()} for part in state)
        for name, block, x in zip(*(moved.column(i) for i in range(3)), strict=True):
            name, at = name.as_py(), slice(block.as_py() * BLOCK, (block.as_py() + 1) * BLOCK)
            to = by[name][at]
            x = np.frombuffer(x.as_py(), dtype=np.int64).reshape(len(to), -1).astype(np.float64)
            to += x[:, :-3] / np.maximum(x[:, -3:-2], 1)
            for i, part in ((-2, square[0]), (-1, square[1])):
                part[name][at] += x[:, i] / FIXED_SQUARE / n
        model, state = model.moved(by), square
    return model


@dataclass
class Fitted:
    """counts: word, c of all training words, a table; words: the most frequent with their counts, broadcast; own: how many are units."""

    counts: DataFrame
    words: object
    own: int
    rare: int
    model: Bilinear
    in_class: np.ndarray
    ends: int
    tokens: int
    kinds: int


def fit(docs: DataFrame, own: int = OWN, rare: int = RARE, known: int = KNOWN, often: int = OFTEN, size: int = SIZE) -> Fitted:
    """What is learned from the training rows of docs (doc_id, k, text), text not null."""
    spark = docs.sparkSession
    learn = docs.where(training()).select("k", "text")
    counts = stored(learn.select("text").mapInArrow(_counted, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")))
    ends = learn.count()
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = counts.orderBy(F.desc("c"), "word").limit(known).toArrow()
    words, c = top.column("word").combine_chunks(), top.column("c").to_numpy()
    sent = spark.sparkContext.broadcast((words, c))
    own = int(min(own, (c >= often).sum()))
    in_class, rare_count = np.full(rare, 0.5), np.zeros(rare)  # 0.5 of what was never seen
    names = spark.createDataFrame(pa.table({"word": words[:own]})) if own else None
    others = counts.join(F.broadcast(names), "word", "left_anti") if own else counts
    # the last two characters as in rare_class
    last = (F.crc32(F.right("word", F.lit(2)).cast("binary")) % rare).cast("int").alias("r")
    for r in others.groupBy(last).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        in_class[r.r] += r.c + 0.5 * r.n
        rare_count[r.r] = r.c
    shards = max(-(-int(tokens + ends) // SHARD), 1)
    pieces = dealt(learn, sent, own, rare, shards)
    model = trained(pieces, Bilinear.start(np.concatenate([[ends], c[:own], rare_count]), size=size), shards)
    dropped(pieces)
    return Fitted(counts, sent, own, rare, model, in_class, ends, tokens + ends, kinds + (ends > 0))


def scored(docs: DataFrame, own: int = OWN, rare: int = RARE, known: int = KNOWN, often: int = OFTEN, size: int = SIZE) -> DataFrame:
    """Rows of op4 for docs (doc_id, text); other columns are not looked at.

    A null or empty text has no word, only its end. A null doc_id counts as
    training. Repeated rows count each time and get the same scores. Without
    any training document all words are unknown and units are equally likely.
    A very long text is scored whole.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    f = fit(docs, own, rare, known, often, size)
    counts, n_train, v_train = f.counts, f.tokens, f.kinds
    sent_words, own = f.words, f.own
    sent = spark.sparkContext.broadcast((f.model, np.log10(f.in_class), f.ends))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, share, n_ends = sent.value
        units = Units(*sent_words.value, own, rare)
        first = 1 + own
        for batch in batches:
            for part in shingles.slices(batch, "text"):
                texts = part.column("text")
                before, seq, start, by_code, cls, c, row, code = _sequence(texts, units)
                lp = model.log_probability(before, seq) / np.log(10)
                lp -= np.where(seq >= first, share[np.maximum(seq - first, 0)], 0.0)
                logc = np.where(c > 0, np.log10(c + 0.5), 0.0)
                rows = len(texts)
                # of words whose count is at hand
                base = np.bincount(row, weights=logc[code], minlength=rows) if len(row) else np.zeros(rows)
                inner = np.bincount(row, weights=np.where(cls >= first, logc, 0.0)[code], minlength=rows) if len(row) else np.zeros(rows)
                have = np.bincount(row, weights=(c > 0)[code], minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, dtype=np.int64)
                sums = np.add.reduceat(lp, start) if rows else np.zeros(0)
                n = np.bincount(row, minlength=rows) + 1
                # the rest is looked up in a join: each distinct word of a document with how often it has it
                far = np.flatnonzero(c[code] == 0) if len(row) else np.zeros(0, dtype=np.int64)
                key, times = np.unique(row[far] * len(by_code) + code[far], return_counts=True)
                far_row, far_code = (key // len(by_code), key % len(by_code)) if len(key) else (key, key)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(far_row, minlength=rows))]).astype(np.int32)
                words_ = pa.ListArray.from_arrays(pa.array(offsets), by_code.take(pa.array(far_code)))
                times_ = pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k"), pa.array(n), pa.array(have + (n_ends > 0)), pa.array(base + np.log10(n_ends + 0.5)), pa.array(sums + inner), words_, times_],
                    names=["doc_id", "k", "n", "have", "base", "score", "words", "times"],
                )

    schema = "doc_id bigint, k bigint, n bigint, have bigint, base double, score double, words array<string>, times array<bigint>"
    rows = stored(docs.mapInArrow(score, schema))
    far = rows.select("k", F.posexplode(F.arrays_zip("words", "times")).alias("at", "w")).select("k", "at", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    far = far.join(counts, "word", "left").groupBy("k").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("far_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("far_have"), F.count_if(F.col("at") == 0).alias("repeats")
    )  # rows that repeat a document are summed together
    out = rows.drop("words", "times").join(far, "k", "left")
    far_log = F.coalesce(F.col("far_log") / F.col("repeats"), F.lit(0.0))
    return out.select(
        "doc_id",
        (~training()).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("have") + F.coalesce((F.col("far_have") / F.col("repeats")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + far_log - F.col("n") * F.log10(F.lit(n_train + 0.5 * (v_train + 1)))).alias("base_score"),
        (F.col("score") + far_log).alias("score"),
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fedseek.llm.common import documents

    return scored(documents(spark, sf_dir))
