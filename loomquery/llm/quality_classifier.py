"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Every grade boundary k has a threshold; P(grade <= k) is the logistic of the
threshold less one shared score, a linear function of hashed words and token
shapes. The model gives an expected grade and tail probabilities.

Defined results: null, empty or wordless text has score 0, so the thresholds
alone decide. Unlabelled documents and null labels are not learned from; with
fewer than two grades in the sample everything is selected. Rows repeat as they
are, and equal texts get equal results; equal rows are learned from once. A kept
column that is named like an added one makes way for it; other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm import textkernel as K
from loomquery.llm.quality_rules import bounded, labelled
from loomquery.llm.shared import arrow_map, docs_of, kept_columns

BITS = 18


def hashed(t: K.Text, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, weights, doc pointers): lower-case words, and the shapes of blank-separated tokens.

    A shape is a token's first three and last two bytes by class, its marks as they are, and whether it
    repeats the token before it. Counts enter as logs; each of the two groups has length 1.
    """
    low = t.lowered()
    start, end, wptr = low.spans(K.IS_WORD)
    word = low.hashes(start, end)
    wdoc = K.doc_of(wptr)
    start, end, tptr = t.spans(~K.IS_SPACE)
    tdoc = K.doc_of(tptr)
    shape = np.zeros(len(start), np.uint64)
    for at in (start, np.minimum(start + 1, end - 1), np.minimum(start + 2, end - 1), np.maximum(end - 2, start), end - 1):
        shape = shape * K.U(257) + _CLASS[t.buf[at]] if len(at) else shape
    if len(start) > 1:
        h = t.hashes(start, end)
        shape[1:] += K.U(1 << 50) * ((h[1:] == h[:-1]) & (tdoc[1:] == tdoc[:-1])).astype(np.uint64)
    shape = K.mix(shape + K.U(99991))
    shift = K.U(64 - bits)
    slots, docs, weights = [], [], []
    for h, d in ((word, wdoc), (shape, tdoc)):
        u, n = np.unique(d << bits | (h >> shift).astype(np.int64), return_counts=True)
        w = 1 + np.log(n)
        own = u >> bits
        norm = np.sqrt(np.bincount(own, w * w, t.n_docs))
        slots.append(u & (1 << bits) - 1)
        docs.append(own)
        weights.append(w / norm[own])
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(slots)[order], np.concatenate(weights)[order].astype(np.float32), np.searchsorted(doc[order], np.arange(t.n_docs + 1))


#: Bytes by class: lower case, upper case, digits, wide; any other byte is its own class.
_CLASS = np.arange(256).astype(np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


@dataclass(frozen=True)
class Ordinal:
    """weights[2**bits] and rising thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def score(self, t: K.Text) -> np.ndarray:
        slot, w, ptr = hashed(t, self.bits)
        return K.segment_sums((self.weights[slot] * w).astype(float), ptr)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns; their sum is the expected grade."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_ordinal(slot: np.ndarray, weight: np.ndarray, ptr: np.ndarray, grade: np.ndarray, bits: int = BITS, epochs: int = 15, batch: int = 256, rate: float = 2.0, decay: float = 1e-6, seed: int = 7) -> Ordinal:
    """Adagrad on the negative log-likelihood; thresholds stay ordered as base plus positive steps."""
    k = int(grade.max()) if len(grade) else 0
    n = len(grade)
    w, acc = np.zeros(1 << bits), np.full(1 << bits, 1e-3)
    share = np.array([np.clip((grade < j).mean(), 0.01, 0.99) for j in range(1, k + 1)]) if n else np.zeros(0)
    theta = np.log(share / (1 - share))
    for j in range(1, k):
        theta[j] = max(theta[j], theta[j - 1] + 1e-3)
    tacc = np.full(k, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if k else 0):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            take = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
            of = np.repeat(np.arange(len(rows)), ptr[rows + 1] - ptr[rows])
            s, x = slot[take], weight[take]
            z = np.bincount(of, w[s] * x, len(rows))
            y = grade[rows]
            bound = np.concatenate([[-np.inf], theta, [np.inf]])
            up, lo = 1 / (1 + np.exp(np.clip(z - bound[y + 1], -500, 500))), 1 / (1 + np.exp(np.clip(z - bound[y], -500, 500)))
            dup, dlo = up * (1 - up), lo * (1 - lo)
            p = np.maximum(up - lo, 1e-9)
            dz = (dup - dlo) / p / len(rows)  # of the loss, by the score
            g = np.bincount(s, dz[of] * x, 1 << bits) + decay * w
            hit = g != 0
            acc[hit] += g[hit] ** 2
            w[hit] -= rate * g[hit] / np.sqrt(acc[hit])
            gt = np.array([(-(dup / p)[y == j].sum() + (dlo / p)[y == j + 1].sum()) / len(rows) for j in range(k)])
            tacc += gt**2
            theta = np.maximum.accumulate(theta - 0.1 * gt / np.sqrt(tacc) + 1e-6 * np.arange(k))
    return Ordinal(w.astype(np.float32), theta, bits)


def fit(docs: DataFrame, labels: DataFrame, grade: Callable[..., Column], columns: list[str], sample: int = 12_000, text: str = "text", bits: int = BITS) -> Ordinal:
    """A model from ``sample`` rated documents at most (a documented bound on ids, and on rows); features are made on the executors.

    ``grade`` gets the label columns, averaged, and gives the grade from 0.
    """
    src = labelled(docs, labels, columns, sample, text).select("id", "h", grade(*(F.col(f"y{i}") for i in range(len(columns)))).cast("int").alias("grade"), "t")

    def run(b: pa.RecordBatch):
        for i, j, t in K.slices(b.column(3)):
            slot, w, ptr = hashed(t, bits)
            blobs = [[a[lo:hi].tobytes() for lo, hi in zip(ptr[:-1], ptr[1:], strict=True)] for a in (slot.astype(np.int32), w.astype(np.float16))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), *(pa.array(x, pa.binary()) for x in blobs)], ["id", "h", "grade", "s", "w"])

    rows = bounded(arrow_map(src, run, "id long, h long, grade int, s binary, w binary"), sample).toPandas().sort_values(["id", "h"])
    ptr = np.concatenate([[0], np.cumsum([len(s) // 4 for s in rows["s"]])]).astype(np.int64)
    return fit_ordinal(np.frombuffer(b"".join(rows["s"]), np.int32), np.frombuffer(b"".join(rows["w"]), np.float16).astype(np.float32), ptr, rows["grade"].to_numpy(np.int64), bits)


def rate(docs: DataFrame, model: Ordinal, text: str = "text", keep: tuple[str, ...] = ("doc_id",), at_least: int | None = None, least: float = 0.5) -> DataFrame:
    """Expected grade, P(grade >= at_least) and whether that reaches ``least``. The weights have a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = kept_columns(keep, "expected_grade", "tail_probability", "selected")
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("_text_"))

    def run(b: pa.RecordBatch):
        m = sent.value
        for i, j, t in K.slices(b.column(len(keep))):
            tails = m.tails(m.score(t))
            top = tails[:, (at_least or tails.shape[1]) - 1] if tails.shape[1] else np.ones(len(tails))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(tails.sum(1)), pa.array(top), pa.array(top >= least)], [*keep, "expected_grade", "tail_probability", "selected"])

    from pyspark.sql.types import StructType

    schema = StructType(list(src.schema.fields[:-1])).add("expected_grade", "double").add("tail_probability", "double").add("selected", "boolean")
    return arrow_map(src, run, schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good; selected where good is more likely than not."""
    docs = docs_of(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda quality, toxic: F.when(toxic == 1, 0).otherwise(1 + quality), ["quality", "toxic"])
    return rate(docs, model)
