"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.texts import text_or_empty
from bylines.scratch import written

BITS, FACTORS = 17, 6
STARTS = (5, 6, 7)  # a longer word also counts as its first letters, so that inflected forms teach each other
TRAIN_ROWS = 4_000  # bound of the labelled rows that a model is fitted on; the driver takes about a minute for as many
SHRINK = 0.75  # a weight gives way to chance by so many standard deviations of its term's gradient under no effect
CACHED_TERMS = 150_000
_TERM = re.compile(r"[^\W_]+")


class Hasher:
    """Distinct hashed terms of texts, words and their beginnings; remembers words up to a bound, then starts over."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = (1 << bits) - 1, {}

    def of_word(self, w: str) -> tuple[int, ...]:
        forms = [w, *(w[:k] + "*" for k in STARTS if len(w) > k)]
        return tuple({crc32(f.encode("utf-8", "surrogatepass")) & self.mask for f in forms})

    def terms(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHED_TERMS:
            self.known = {}
        known, out = self.known, set()
        for w in set(_TERM.findall((text or "").lower())):
            if (h := known.get(w)) is None:
                h = known[w] = self.of_word(w)
            out.update(h)
        return np.array(sorted(out), dtype=np.int64)


def joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All terms in one array, and where each row starts."""
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), starts


def row_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the dot product of their factors).

    With ``by_length`` the sum over pairs is divided by the row's number of terms, so that the many
    pairs of a long text do not drown the few that tell.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    by_length: bool = False

    def pair_scale(self, starts: np.ndarray) -> np.ndarray:
        n = np.diff(starts)
        return 1 / np.maximum(n, 1) if self.by_length else np.ones(len(n))

    def raw(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[terms]
        s = row_sums(v, starts)
        pairs = (s**2).sum(axis=1) - row_sums((v.astype(np.float64) ** 2).sum(axis=1), starts)
        return self.bias + row_sums(self.weights[terms], starts) + self.pair_scale(starts) * pairs / 2, s

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*joined(rows))[0], -40, 40)))


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 40, rate: float = 0.15, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss in batches of 64 rows, with L2 on the terms that a batch touches.

    A step also takes from each touched weight an L1 share in proportion to the noise of its term's
    gradient (``SHRINK``); factors give nothing, so terms without a weight of their own still learn
    pairs. One class only, or no rows: a machine that scores every text by the smoothed share of ones.
    """
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(1 << bits, np.float32), rng.normal(0, 0.02, (1 << bits, factors)).astype(np.float32), by_length=True)
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    held = np.zeros(1 << bits)
    for r in rows:
        held[r] += 1  # terms of a row are distinct
    touched = 1 - (1 - held / len(rows)) ** 64
    shrink = np.where(held > 0, SHRINK * np.sqrt(held * share * (1 - share)) / len(rows) / np.maximum(touched, 1e-12), 0).astype(np.float32)
    place = np.zeros(1 << bits, np.int64)
    gw, gv, gb = np.full(1 << bits, 1e-2, np.float32), np.full((1 << bits, factors), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            terms, starts = joined([rows[i] for i in batch])
            place[:] = 0
            place[terms] = 1
            used = np.flatnonzero(place)
            place[used] = np.arange(len(used))
            x = np.zeros((len(batch), len(used)), np.float32)  # rows of the batch by terms that it touches
            x[np.repeat(np.arange(len(batch)), np.diff(starts)), place[terms]] = 1
            w, v, scale = m.weights[used], m.factors[used], m.pair_scale(starts).astype(np.float32)
            sums = x @ np.column_stack([v, (v**2).sum(axis=1), w])
            s = sums[:, :-2]
            raw = m.bias + sums[:, -1] + scale * ((s**2).sum(axis=1) - sums[:, -2]) / 2
            error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[batch]).astype(np.float32)
            scaled = error * scale
            back = x.T @ np.column_stack([scaled[:, None] * s, scaled, error])
            dw = back[:, -1] / len(batch) + 1e-5 * w
            dv = (back[:, :-2] - back[:, -2:-1] * v) / len(batch) + 1e-4 * v
            gw[used] += dw**2
            gv[used] += dv**2
            step = rate / np.sqrt(gw[used])
            w -= step * dw
            m.weights[used] = np.sign(w) * np.maximum(np.abs(w) - step * shrink[used], 0)
            m.factors[used] = v - 0.2 * rate * dv / np.sqrt(gv[used])
            db = error.mean()
            gb += db**2
            m.bias -= rate * db / np.sqrt(gb)
    m.bias = float(m.bias)
    return m


def held_out(id_col: str | Column, folds: int = 5) -> Column:
    """Rows that never teach: crc32 of the id as text leaves no remainder."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Machine:
    """The machine from at most ``most`` labelled rows outside ``held_out``, those with the smallest hash of their id.

    The sample is drawn from the labels alone, so only the texts of chosen rows are hashed. All
    their terms come to the driver, as lists of numbers; none is left out for saying little on its
    own, as pairs of such terms may say much. Null ids and labels teach nothing, and without rows of both classes every
    text scores the smoothed share of ones.
    """
    ok = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    chosen = written(ok.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(most))
    texts = docs.join(F.broadcast(chosen), docs[id_col] == chosen["_id"]).select(text_or_empty(text_col).alias("t"), "y")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            lists = [hasher.terms(t).astype(np.int32) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), b.column(1)], names=["terms", "y"])

    found = texts.mapInArrow(told, "terms array<int>, y double").toArrow()
    rows = [x.values.to_numpy() for x in found.column("terms")]
    y = found.column("y").to_numpy()
    order = sorted(range(len(rows)), key=lambda i: (blake2b(rows[i], digest_size=16).digest(), y[i]))  # whatever order the rows came in
    return fit_machine([rows[i] for i in order], y[order])


def score(df: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from its whole text; a text without terms scores by the bias. The model has a fixed size."""
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    schema = rows.select(id_col).schema.add("score", "double")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, machine = Hasher(), shared.value
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                s = machine.scores([hasher.terms(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=schema.names)

    return rows.mapInArrow(apply, schema)
