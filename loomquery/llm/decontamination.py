"""Benchmark decontamination by size-partitioned MinHash containment search, exact for short items.

A match holds threshold * n of an item's n shingles, so it misses few of them: of
any n - threshold * n + 1 shingles one at least lies in the document. Items whose
matches may share fewer than ``SURE`` shingles are found in this way: that many of
their shingles, the rarest among the items first, are looked up in each document's
whole shingle set, and no match is lost.

For longer items, documents are partitioned by their number of distinct five-word shingles, in
powers of two. A partition's documents are sketched by one-permutation MinHash
with as many bins as the partition's largest size: shingles are dealt to bins by
hash, and each bin keeps its least. A test item is sketched in the same way for
every partition with fewer bins than the item has shingles; for the others, whose
sketch would hold about all of its shingles, one table has them all. A short item
that lies in a long document loses a bin
only to a smaller foreign shingle in that bin, so it shares many bins with the
document whatever the document's length; one shared bin makes a candidate. A
shared shingle loses its bin with a probability of 0.43 at most (a document that
fills its class, an item with a fifth of foreign shingles), and all of ``SURE``
lose theirs in fewer than one pair in 10^8.

All candidates are verified by exact containment of the item's shingles, as words.

Words are runs of letters, digits and underscores, A-Z in lower case, where any
multi-byte character counts as a letter.

Defined results: null and empty texts, and items of fewer than five words, have
no five-word shingle and never match. Repeated item or document rows give
repeated result rows. A document matches any number of items. An empty benchmark
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import textkernel as K
from loomquery.llm.shared import arrow_map, docs_of, extended

WIDTH = 5
SIZES = 26
#: Items whose matches share as many shingles or more are sketched, others looked up exactly.
SURE = 24
#: Items whose exact shingles a task keeps.
KEPT = 2000
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")


def five_words(text: str | bytes | None) -> set[tuple[bytes, ...]]:
    """The exact shingles: tuples of five lower-case words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    w = [x.lower() for x in _WORD.findall(raw)]
    return set(zip(*(w[k:] for k in range(WIDTH)), strict=False))


def shingle_sets(t: K.Text) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document; only of documents with five words or more."""
    low = t.lowered()
    start, end, wptr = low.spans(K.IS_WORD)
    h = low.hashes(start, end)
    s, ptr = K.shingles(h, wptr, WIDTH)
    few = np.diff(wptr) < WIDTH
    if few.any():
        own = K.doc_of(ptr)
        s, own = s[~few[own]], own[~few[own]]
        ptr = np.searchsorted(own, np.arange(t.n_docs + 1))
    return K.unique_by_doc(s, ptr)


def size_class(n: np.ndarray) -> np.ndarray:
    """log2 of the partition's largest size."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def sketch(s: np.ndarray, ptr: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each filled bin; document d has 2**bits[d] bins, chosen by a hash's low bits.

    s is sorted by document and value, so a bin's first shingle is its least.
    """
    doc = K.doc_of(ptr)
    bin_ = (s & ((K.U(1) << bits[doc].astype(np.uint64)) - K.U(1))).astype(np.int64)
    order = np.lexsort((bin_, doc))  # stable: values still rise inside a bin
    d, b = doc[order], bin_[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1])
    return d[first], s[order[first]]


def lookup(key: np.ndarray, item: np.ndarray, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(document, item) pairs of equal values; key is sorted."""
    lo, hi = np.searchsorted(key, value, "left"), np.searchsorted(key, value, "right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([np.repeat(doc, n), item[at]], 1)


def enough(s: np.ndarray, ptr: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(item, shingle): of each item so many shingles, the rarest first, that every match holds one at least."""
    item, n = K.doc_of(ptr), np.diff(ptr)
    _, which, times = np.unique(s, return_inverse=True, return_counts=True)
    order = np.lexsort((s, times[which], item))
    need = np.ceil(threshold * n - 1e-9).astype(np.int64)
    keep = np.arange(len(s)) - ptr[item] <= (n - need)[item]
    return item[keep], s[order[keep]]


class Items:
    """A block of test items: shingles to look up, sketches for the size classes under an item's own, and the texts.

    Two numbers a shingle looked up, and less than four a sketched one; exact
    shingles are made again for the items that are candidates, and kept for some.
    """

    def __init__(self, ids: list, texts: list[bytes], threshold: float):
        self.ids, self.texts, self.threshold = ids, texts, threshold
        column = pa.array(texts, pa.binary())
        self.by_class: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parts = [(i, *shingle_sets(t)) for i, _, t in K.slices(column)]
        s = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(np.diff(p[2]) for p in parts)])
        short = threshold * n < SURE
        own = np.repeat(short, n)
        self.short = self._sorted(*enough(s[own], np.r_[0, np.cumsum(np.where(short, n, 0))], threshold))
        long, ptr = s[~own], np.r_[0, np.cumsum(np.where(short, 0, n))]
        self.size = np.minimum(size_class(n), SIZES - 1)
        self.whole = self._sorted(K.doc_of(ptr), long)
        for c in range(int(self.size[~short].max(initial=0))):
            wide = self.size[K.doc_of(ptr)] > c
            at = np.r_[0, np.cumsum(np.where(~short & (self.size > c), n, 0))]
            self.by_class[c] = self._sorted(*sketch(long[wide], at, np.full(len(n), c)))
        self._exact: dict[int, set] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_exact": {}}

    def exact(self, k: int) -> set[tuple[bytes, ...]]:
        """An item's shingles as words."""
        if k not in self._exact:
            if len(self._exact) >= KEPT:
                self._exact.clear()
            self._exact[k] = five_words(self.texts[k])
        return self._exact[k]

    @staticmethod
    def _sorted(item: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        return key[order], item[order].astype(np.int64)

    def candidates(self, t: K.Text) -> np.ndarray:
        """Distinct (document, item) pairs that share a shingle looked up, or a bin's least shingle."""
        s, ptr = shingle_sets(t)
        out = [lookup(*self.short, K.doc_of(ptr), s)]
        if len(self.whole[0]):
            sizes = np.minimum(size_class(np.diff(ptr)), SIZES - 1)
            d, v = sketch(s, ptr, sizes)
            pairs = lookup(*self.whole, d, v)
            out.append(pairs[self.size[pairs[:, 1]] <= sizes[pairs[:, 0]]])
            for c in np.unique(sizes):
                if int(c) in self.by_class:
                    own = sizes[d] == c
                    out.append(lookup(*self.by_class[int(c)], d[own], v[own]))
        return np.unique(np.concatenate(out), axis=0)

    def found(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, shared shingles, item's shingles) of all verified pairs of a text column."""
        out = []
        for i, _, t in K.slices(column):
            pairs = self.candidates(t)
            if not len(pairs):
                continue
            cut = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(pairs)], strict=True):
                d = int(pairs[lo, 0])
                have = five_words(t.buf[t.ptr[d] : t.ptr[d + 1]].tobytes())
                for k in pairs[lo:hi, 1]:
                    want = self.exact(int(k))
                    shared = len(want & have)
                    if want and shared >= self.threshold * len(want) - 1e-9:
                        out.append((i + d, int(k), shared, len(want)))
        return out


def built_bytes(text: bytes) -> int:
    """About what an item takes in a block: its text, and four numbers a word at most."""
    return len(text) + 32 * (text.count(b" ") + 1) + 200


def blocks(items: DataFrame, item_id: str, item_text: str, threshold: float, block_bytes: int) -> Iterator[Items]:
    """The items, ``block_bytes`` of built tables at a time; there is one block at least."""
    ids, texts, size, none = [], [], 0, True
    for row in items.select(F.col(item_id).alias("i"), F.encode(F.col(item_text), "utf-8").alias("t")).orderBy("i").toLocalIterator():
        ids.append(row[0])
        texts.append(bytes(row[1] or b""))
        size += built_bytes(texts[-1])
        if size >= block_bytes:
            yield Items(ids, texts, threshold)
            ids, texts, size, none = [], [], 0, False
    if ids or none:
        yield Items(ids, texts, threshold)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_bytes: int = 64 << 20) -> DataFrame:
    """(item_id, doc_id, containment, n_shared, n_item) of all pairs with containment >= threshold.

    The items are a stated query set. They are sent to all rows in blocks of
    ``block_bytes``, as built (an item more at most), so what is broadcast has a
    fixed bound, and the driver reads them one block at a time.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    full = extended(src.select("doc_id"), ("containment", "double"), ("n_shared", "long"), ("n_item", "long"))
    schema = type(full)([items.select(F.col(item_id).alias("item_id")).schema[0], *full.fields])
    out = None
    for block in blocks(items, item_id, item_text, threshold, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(b: pa.RecordBatch, sent=sent):
            if rows := sent.value.found(b.column(1)):
                at, k, n, m = (np.array(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([sent.value.ids[i] for i in k]), b.column(0).take(pa.array(at)), pa.array(n / m), pa.array(n), pa.array(m)], ["item_id", "doc_id", "containment", "n_shared", "n_item"])

        part = arrow_map(src, run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_bytes: int = 64 << 20) -> DataFrame:
    """Rows of docs that hold no item, unchanged; blocks of items filter one after another, without a join."""
    at = docs.columns.index(text)
    for block in blocks(items, item_id, item_text, threshold, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(b: pa.RecordBatch, sent=sent):
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in sent.value.found(b.column(at))]] = False
            yield b.filter(pa.array(keep))

        docs = arrow_map(docs, run, docs.schema)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
