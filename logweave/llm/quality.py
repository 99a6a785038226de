"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of
the features at a cost linear in their number. The features are the text's distinct words, hashed into BUCKETS and
scaled to unit length, and, standardised, the statistics of stats() and the documents' metadata: numeric columns, as
logarithms beside a sign of their absence. Neither labels nor language, source or id are read.
It is fitted on the bounded sample of labelled.sample() by AdaGrad in a fixed order; executors read the sample's texts,
whole, and the driver gets their features: at most BUCKETS numbers and the statistics of a text.

Defined cases: null and empty texts score as a text without words; without labels of both kinds every score is the
share of label 1 (0.5 without any); equal texts with equal metadata have equal scores; a metadata column that is not there,
or not a number, counts as null.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import small_batches
from logweave.llm.labelled import PER_LABEL, chosen, held_out, sample

BUCKETS = 1 << 14
RANK = 6
EPOCHS = 8
RATE = 0.08
WEIGHT_DECAY = 2e-4
THRESHOLD = 0.3
MEMO_WORDS = 300_000
#: Words whose weights are gathered at once, unless one text has more.
AT_ONCE = 500_000

STATS = 14
#: Numeric columns of documents that are features, two numbers each.
METADATA = ("n_chars",)
#: Kinds of characters, as bits. Plain marks are no symbols.
LETTER, UPPER, DIGIT, SPACE, SYMBOL, STOP, PIPE, BANG = (1 << i for i in range(8))
PLAIN_MARKS = frozenset("_.,;:'’\"()?-")


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of every code point, and for every kind which of the bits it has."""
    chars = np.arange(0x110000, dtype=np.uint32).view("<U1")
    is_ = {name: getattr(np.char, name)(chars) for name in ("isalpha", "isalnum", "isdecimal", "isspace", "isupper")}
    table = LETTER * is_["isalpha"] | DIGIT * is_["isdecimal"] | SPACE * is_["isspace"]
    table[:0x100] |= UPPER * (is_["isalpha"] & is_["isupper"])[:0x100]
    symbol = ~(is_["isalnum"] | is_["isspace"])
    symbol[[ord(c) for c in PLAIN_MARKS]] = False
    table |= SYMBOL * symbol
    for bit, marks in ((STOP, ".?!"), (PIPE, "|"), (BANG, "!")):
        table[[ord(c) for c in marks]] |= bit
    return table.astype(np.uint8), (np.arange(256)[:, None] >> np.arange(8) & 1).astype(float)


def stats(text: str, words: list[str]) -> list[float]:
    n, chars = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (STATS - 1)
    table, bits = _kinds()
    kind = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters, upper, digits, spaces, symbols, _, pipes, bangs = np.bincount(kind, minlength=256) @ bits
    space = (kind & SPACE) != 0
    ends = np.append(space[1:], True)
    word_ends, begins = np.flatnonzero(~space & ends), ~space
    begins[1:] &= space[:-1]
    lengths = word_ends - np.flatnonzero(begins) + 1
    lines = text.count("\n") + 1
    return [
        0.0,
        np.log1p(n),
        (chars - spaces) / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, islice(words, 1, None))) / n,
        upper / max(1, letters),
        symbols / n,
        np.count_nonzero((kind & SYMBOL).astype(bool) & ends) / n,
        pipes / n,
        bangs / n,
        digits / chars,
        np.count_nonzero((kind & STOP).astype(bool) & ends) / n,
        np.log1p(n / lines),
        np.count_nonzero(lengths <= 3) / n,
    ]


class Featurizer:
    """Distinct hashed words of texts, one after another, and their statistics."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        at = self.memo[word] = zlib.crc32(word.strip(".,;:!?").lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, their number per text, statistics."""
        at, sizes, rows = [np.zeros(0, np.int64)], [], []
        for text in texts:
            words = text.split()
            distinct = set(words)
            for w in distinct.difference(self.memo):
                self._bucket(w)
            try:
                found = np.fromiter(map(self.memo.__getitem__, distinct), np.int64, len(distinct))
            except KeyError:  # the memory was cleared meanwhile
                found = np.array([self._bucket(w) for w in distinct], np.int64)
            at.append(np.unique(found))
            sizes.append(len(at[-1]))
            rows.append(stats(text, words))
        return np.concatenate(at), np.array(sizes, np.int64), np.array(rows, float).reshape(-1, STATS)


class FactorisationMachine:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.mean, self.scale, self.w0, self.w, self.v = mean, scale, w0, w, v

    def dense(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6) / 2

    def _sums(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per text, the sums over its words of w, v and v^2."""
        table = np.column_stack([self.w[:BUCKETS], self.v[:BUCKETS], (self.v[:BUCKETS] ** 2).sum(axis=1)])
        out, ends = np.zeros((len(sizes), table.shape[1])), np.concatenate([[0], np.cumsum(sizes)])
        begin = 0
        while begin < len(sizes):
            to = max(begin + 1, int(np.searchsorted(ends, ends[begin] + AT_ONCE, "right")) - 1)
            some = begin + np.flatnonzero(sizes[begin:to])
            if len(some):
                out[some] = np.add.reduceat(table[at[ends[begin] : ends[to]]], ends[some] - ends[begin], axis=0)
            begin = to
        return out

    def score(self, at: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Linear-time scores: sums of w x, v x and v^2 x^2 per text."""
        dense, x = self.dense(rows), 1 / np.sqrt(np.maximum(sizes, 1))
        sums, vd = self._sums(at, sizes), self.v[BUCKETS:]
        linear = self.w0 + sums[:, 0] * x + (self.w[BUCKETS:] * dense).sum(axis=1)
        total = sums[:, 1:-1] * x[:, None] + (dense[:, :, None] * vd).sum(axis=1)
        squares = sums[:, -1] * x**2 + (dense * dense * (vd * vd).sum(axis=1)).sum(axis=1)
        out = linear + 0.5 * ((total * total).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> FactorisationMachine:
    """Fits on texts and their labels."""
    return fit_features(*Featurizer()([r[0] for r in rows]), np.array([r[1] for r in rows], float), epochs)


def fit_features(at: np.ndarray, sizes: np.ndarray, dense: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> FactorisationMachine:
    rng = np.random.default_rng(7)
    n_dense = dense.shape[1]
    w, v = np.zeros(BUCKETS + n_dense), rng.normal(0, 0.05, (BUCKETS + n_dense, RANK))
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    model = FactorisationMachine(np.zeros(n_dense), np.ones(n_dense), float(np.log(share / (1 - share))), w, v)
    if len(set(y)) < 2:
        model.v[:] = 0
        return model
    model.mean, model.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
    dense = model.dense(dense)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    gw, gv, g0 = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    tail = np.arange(BUCKETS, BUCKETS + n_dense)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            words = at[ends[i] : ends[i + 1]]
            f = np.concatenate([words, tail])
            x = np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), dense[i]])
            vf = v[f]
            total = x @ vf
            raw = model.w0 + w[f] @ x + 0.5 * (total @ total - (x * x) @ (vf * vf).sum(axis=1))
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]
            d = g * x + WEIGHT_DECAY * w[f]
            gw[f] += d * d
            w[f] -= RATE * d / np.sqrt(gw[f])
            d = g * (x[:, None] * total - vf * (x * x)[:, None]) + WEIGHT_DECAY * vf
            gv[f] += d * d
            v[f] -= RATE * d / np.sqrt(gv[f])
            g0 += g * g
            model.w0 -= RATE * g / np.sqrt(g0)
    return model


def metadata_of(docs: DataFrame, names: tuple[str, ...]) -> Column:
    """The features of the metadata as one array, two for each name."""
    out = []
    for name in names:
        value = F.col(name).cast("string").try_cast("double") if name in docs.columns else F.lit(None).cast("double")
        value = F.when(~F.isnan(value), F.log1p(F.least(F.greatest(value, F.lit(0.0)), F.lit(1e18))))
        out += [F.coalesce(value, F.lit(0.0)), value.isNull().cast("double")]
    return F.array(*out).cast("array<double>")


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(rows, -1)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, metadata: tuple[str, ...] = METADATA) -> FactorisationMachine:
    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Featurizer()
        for batch in batches:
            at, sizes, rows = read(batch.column("t").to_pylist())
            rows = np.hstack([rows, _numbers(batch.column("_m"), len(sizes))])
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            words = pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32)))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in "kyh"], words, dense], names=["k", "y", "h", "words", "dense"])

    with small_batches(docs.sparkSession):
        texts = sample(docs.withColumn("_m", metadata_of(docs, metadata)), labels, "quality", per_label=per_label, keep=("_m",))
        got = texts.mapInArrow(featurize, "k long, y int, h long, words array<int>, dense array<double>").toArrow()
    keys = [{"k": k, "y": y, "h": h, "i": i} for i, (k, y, h) in enumerate(zip(*[got[c].to_pylist() for c in "kyh"], strict=True))]
    rows = chosen(keys, per_label)
    words, dense = (got[c].take(pa.array([r["i"] for r in rows], pa.int64())).combine_chunks() for c in ("words", "dense"))
    sizes = np.asarray(words.value_lengths()).astype(np.int64)
    return fit_features(np.asarray(words.flatten()).astype(np.int64), sizes, np.asarray(dense.flatten()).reshape(-1, STATS + 2 * len(metadata)), np.array([r["y"] for r in rows], float))


def score_quality(docs: DataFrame, model: FactorisationMachine, *, text: str = "text", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """docs with the column score; input columns of that name are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (RANK + 1) numbers

    def quality(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        read, model = Featurizer(), shared.value
        for texts, more in batches:
            at, sizes, rows = read([t if isinstance(t, str) else "" for t in texts])
            rows = np.hstack([rows, np.array(more.tolist(), dtype=float).reshape(len(rows), -1)])
            yield pd.Series(model.score(at, sizes, rows), dtype=float)

    return docs.withColumn("score", F.pandas_udf("double")(_typed(quality))(F.col(text), metadata_of(docs, metadata)))


def _typed(fn):
    fn.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return fn


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score_quality(docs.select("doc_id", "text", *[c for c in METADATA if c in docs.columns]), learn(docs, labels))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
