"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed for whole texts with vectorised byte passes. The trees
are fitted in numpy (histogram splits, logistic loss, monotonic constraints on
chosen statistics) on a bounded sample of labelled documents, then flattened
into node arrays that score a batch level by level.

Defined results: null or empty text has no words, so it fails the base rule.
Labels that are null, or of unknown documents, are not used; a document with
several labels counts with their mean, rounded; equal rows are learned from once.
Without two label classes every document that passes the base rule is kept.
Repeated rows are judged alike, null ids stay null. A kept column that is named
like an added one makes way for it; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import textkernel as K
from loomquery.llm.shared import arrow_map, docs_of, kept_columns

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share",
    "letter_share", "distinct_share", "top_word_share", "line_words", "wide_share", "end_mark_share", "short_share",
)
#: More of these may only lower the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "top_word_share")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL, _DIGIT, _UPPER = _table(SYMBOLS), _table("0123456789"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _table("!\"'(),-./:;?[]_{}~@^`\\+=")
_LETTER = K.IS_WORD & ~_DIGIT & ~_table("_")
_END = _table(".!?")
_CONT = np.zeros(256, bool)
_CONT[128:192] = True


def statistics(t: K.Text) -> tuple[np.ndarray, np.ndarray]:
    """(STATS as long[n, 5], FEATURES as double[n, 15]) of whole documents."""
    n = t.n_docs
    start, end, wptr = t.spans(~K.IS_SPACE)
    words = np.diff(wptr)
    chars = t.per_doc(~K.IS_SPACE[t.buf] & ~_CONT[t.buf])
    symbols = t.per_doc(_SYMBOL[t.buf])
    doc = K.doc_of(wptr)
    h = t.hashes(start, end)
    key = K.mix(h + K.mix(doc.astype(np.uint64) + K.U(1)))
    # windows of three words that are found twice or more in their document
    repeat = np.zeros(n, np.int64)
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        tri = h[:-2] * K.U(3) + K.mix(h[1:-1]) * K.U(5) + K.mix(h[2:] + K.U(11)) * K.U(7) if len(h) > 2 else h[:0]
        tri = K.mix(tri + K.mix(doc[: len(tri)].astype(np.uint64) + K.U(1)))
        inside = np.flatnonzero(doc[: len(tri)] == doc[2:]) if len(tri) else np.zeros(0, np.int64)
        if len(inside):
            _, inv, cnt = np.unique(tri[inside], return_inverse=True, return_counts=True)
            twice = inside[cnt[inv] > 1]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[twice + k] = True
            repeat = K.segment_sums(covered.astype(np.int64), wptr)
        _, first, cnt = np.unique(key, return_index=True, return_counts=True)
        distinct = np.bincount(doc[first], minlength=n).astype(float)
        np.maximum.at(top, doc[first], cnt)
    # lines with a word that equal an earlier line of the document
    cut = np.zeros(len(t.buf) + 1, bool)
    cut[np.flatnonzero(t.buf == 10) + 1] = True
    cut[t.ptr] = True
    at = np.flatnonzero(cut)
    lo, hi = at[:-1], at[1:]
    hi = hi - (t.buf[hi - 1] == 10) if len(lo) else hi
    ldoc = np.searchsorted(t.ptr, lo, "right") - 1
    has = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi, ldoc = lo[has], hi[has], ldoc[has]
    lkey = K.mix(t.hashes(lo, hi) + K.mix(ldoc.astype(np.uint64) + K.U(1)))
    lines = np.bincount(ldoc, minlength=n)
    dup = lines - np.bincount(ldoc[np.unique(lkey, return_index=True)[1]], minlength=n)
    size = np.maximum(t.per_doc(~_CONT[t.buf]), 1)
    seen, w = np.maximum(chars, 1), np.maximum(words, 1)
    ends = K.segment_sums(_END[t.buf[end - 1]].astype(np.int64), wptr) if len(end) else np.zeros(n)
    short = K.segment_sums(((end - start) <= 3).astype(np.int64), wptr) if len(end) else np.zeros(n)
    features = [
        np.log1p(words), chars / w, symbols / seen, dup / np.maximum(lines, 1), repeat / w, t.per_doc(_UPPER[t.buf]) / seen, t.per_doc(_DIGIT[t.buf]) / seen, t.per_doc(_MARK[t.buf]) / seen,
        t.per_doc(_LETTER[t.buf] & ~_CONT[t.buf]) / size, distinct / w, top / w, words / np.maximum(lines, 1), t.per_doc(t.buf >= 192) / seen, ends / w, short / w,
    ]
    return np.stack([words, chars, symbols, dup, repeat], 1), np.stack(features, 1)


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in one set of arrays; a leaf points to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees step down together."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: int = 20) -> Trees:
    """Newton boosting of the logistic loss.

    A split on a falling feature must give its right child no more than its
    left, and both subtrees stay on their side of the middle, so the whole model
    falls with the feature.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    rate0 = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    f = np.full(n, base)
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (limit, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(left) - 1

    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)

        def grow(at: int, rows: np.ndarray, level: int, lo: float, hi: float, g: np.ndarray = g, h: np.ndarray = h) -> None:
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = rate * float(np.clip(-gs / (hs + ridge), lo, hi))
            f[rows] += 0 if level < depth else value[at]
            if level == depth:
                return
            best = (1e-6, -1, -1, 0.0, 0.0)
            for j in range(m):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                c = code[rows, j]
                gl, hl, cl = (np.cumsum(np.bincount(c, w, k))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(cl < least) | (len(rows) - cl < least) | ((vr > vl) if j in falling else False)] = 0
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (gain[b], j, b, vl[b], vr[b])
            _, j, b, vl, vr = best
            if j < 0:
                f[rows] += value[at]
                return
            feature[at], limit[at] = j, edges[j][b]
            a, z = node(), node()
            left[at], right[at] = a, z
            mid = (vl + vr) / 2
            goes = code[rows, j] <= b
            grow(a, rows[goes], level + 1, mid if j in falling else lo, hi)
            grow(z, rows[~goes], level + 1, lo, mid if j in falling else hi)

        roots.append(node())
        grow(roots[-1], np.arange(n), 0, -np.inf, np.inf)
    arrays = [np.array(a, kind) for a, kind in ((feature, np.int64), (limit, float), (left, np.int64), (right, np.int64), (value, float), (roots, np.int64))]
    return Trees(*arrays, base, depth)


def measure(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns, the five statistics and the features (array) of each row."""
    keep = kept_columns(keep, *STATS, "features")
    src = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("_text_"))

    def run(b: pa.RecordBatch):
        for i, j, t in K.slices(b.column(len(keep))):
            stats, x = statistics(t)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), *(pa.array(s) for s in stats.T), lists], [*keep, *STATS, "features"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType(list(src.schema.fields[:-1]))
    for s in STATS:
        schema = schema.add(s, "long")
    return arrow_map(src, run, schema.add("features", ArrayType(DoubleType())))


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, h, t, y0, y1, ...) of labelled documents: the text, its hash and the means of their label columns.

    ``sample`` labelled ids at most, the smallest by a hash. They are broadcast;
    ``sample`` bounds their size, not how many rows have such an id.
    """
    means = (F.round(F.avg(c)).cast("int").alias(f"y{i}") for i, c in enumerate(columns))
    ids = labels.select(F.col(doc_id).cast("long").alias("id"), *columns).dropna().groupBy("id").agg(*means)
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t")).join(F.broadcast(ids), "id")


def bounded(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` of different (id, h), the smallest by a hash."""
    return rows.dropDuplicates(["id", "h"]).orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, text: str = "text") -> Trees:
    """Trees from ``sample`` labelled documents at most (a documented bound on ids, and on rows)."""
    rows = bounded(measure(labelled(docs, labels, ["quality"], sample, text), "t", "id", "h", "y0").select("id", "h", "y0", "features"), sample).toPandas().sort_values(["id", "h"])
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = rows["y0"].to_numpy(float)
    if len(np.unique(y)) < 2:
        x, y = x[:0], y[:0]
    return fit_trees(x, y, tuple(FEATURES.index(f) for f in FALLING))


def judge(docs: DataFrame, trees: Trees, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = 0.5) -> DataFrame:
    """Statistics, base rule, probability of good quality and verdict of each row."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    keep = kept_columns(keep, *STATS, "base_failed", "kept", "quality_score")
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("_text_"))

    def run(b: pa.RecordBatch):
        for i, j, t in K.slices(b.column(len(keep))):
            s, x = statistics(t)
            p = 1 / (1 + np.exp(-model.value.score(x)))
            failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
            kept = ~failed & ((p >= least) | (len(model.value.roots) == 0))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), *map(pa.array, s.T), pa.array(failed), pa.array(kept), pa.array(p)], [*keep, *STATS, "base_failed", "kept", "quality_score"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType(list(src.schema.fields[:-1]))
    for name, kind in (*((s, "long") for s in STATS), ("base_failed", "boolean"), ("kept", "boolean"), ("quality_score", "double")):
        schema = schema.add(name, kind)
    return arrow_map(src, run, schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, trees)
