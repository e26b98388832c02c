"""Exact substring deduplication: every byte of a long repeated string goes.

A string of ``least`` bytes (200) that starts at two places, in one document or
two, is removed at all of them. Winnowing deals the starts: a window of ``least``
bytes picks the least hash among its ``gram``-byte strings, so equal windows pick
the same anchor, and each start belongs to one anchor. Starts whose anchor
occurs once in the corpus are unique. For the others, the text around the
anchors is brought together by anchor hash, equal snippets first collapse to
one, and a Burrows-Wheeler transform of the different ones tells which starts
repeat (byte for byte, so hashes decide nothing).

A task's batch sends one row at most for each anchor hash and each snippet to
the place where they meet; further copies in it are known to repeat and only
travel by document. Where more than ``most`` bytes of different snippets meet at
one anchor (a line that many documents share), they are not judged there. Each
is cut by its starts' distance to the anchor into narrower classes, whose windows
have more bytes in common than the anchor, and goes to where those bytes meet;
again, until the snippets of a place are few or a place has one window. So no
task holds all that a hot passage or a hot line brings together.

Defined results: null and empty texts have no bytes, no spans and the hash of
nothing. Repeated rows, with one id or several, are copies of each other. Texts
shorter than ``least`` stay whole. The document's rows keep their ids, null too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import textkernel as K
from loomquery.llm.bwt import repeated_starts
from loomquery.llm.shared import arrow_map, docs_of, parts, written

LEAST, GRAM, MOST = 200, 96, 1 << 20


def anchors(t: K.Text, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, last start, anchor hash, anchor's place) of each run of starts with one anchor; places count in the document."""
    none = np.zeros(0, np.int64)
    n, w = len(t.buf), least - gram + 1
    size = np.diff(t.ptr)
    long = np.flatnonzero(size >= least)
    if not len(long):
        return none, none, none, none.astype(np.uint64), none
    p = np.arange(n - gram + 1)
    s = t.prefix()
    _, inv = K.powers(n + 1)
    h = K.mix((s[gram:] - s[:-gram]) * inv[: n - gram + 1])
    key = h & ~K.U(0xFFFFFFFF) | p.astype(np.uint64)  # of equal hashes the leftmost
    pad = -len(key) % w
    m = np.concatenate([key, np.full(pad, ~K.U(0))]).reshape(-1, w)
    down = np.minimum.accumulate(m, 1).ravel()
    up = np.minimum.accumulate(m[:, ::-1], 1)[:, ::-1].ravel()
    q = np.concatenate([np.arange(t.ptr[d], t.ptr[d + 1] - least + 1) for d in long])
    a = (np.minimum(up[q], down[q + w - 1]) & K.U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lo, hi = q[cut], q[np.r_[cut[1:], len(q)] - 1]
    d = np.searchsorted(t.ptr, lo, "right") - 1
    return d, lo - t.ptr[d], hi - t.ptr[d], h[a[cut]], a[cut] - t.ptr[d]


def repeats_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its value, value occurs twice or more) flags."""
    _, first, inv, cnt = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(values), bool)
    lead[first] = True
    return lead, cnt[inv] > 1


def spans_of(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Union of [lo, hi) ranges, sorted; touching ones are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return list(zip(lo[cut].tolist(), hi[np.r_[cut[1:], len(lo)] - 1].tolist(), strict=True))


def by_key(batches: Iterator[pa.RecordBatch], most: int, weigh: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, whole): groups of the first column (sorted), of about ``most`` rows or bytes of a binary column.

    A group that alone is larger comes in pieces, which are not whole.
    """
    held: list[pa.RecordBatch] = []
    size, large = 0, None

    def weight(x) -> int:
        return x.num_rows if weigh is None else x.column(weigh).nbytes

    for b in batches:
        if not b.num_rows:
            continue
        if large is not None:  # more of the group that is in pieces
            n = int(np.searchsorted(b.column(0).to_numpy(), large, "right"))
            if n:
                held.append(b.slice(0, n))
                size += weight(held[-1])
                if size < most and n == b.num_rows:
                    continue
                yield pa.Table.from_batches(held).combine_chunks(), False
            elif held:
                yield pa.Table.from_batches(held).combine_chunks(), False
            held, size = [], 0
            if n == b.num_rows:
                continue
            b, large = b.slice(n), None
        held.append(b)
        size += weight(b)
        if size >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            k = t.column(0).to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield t.slice(0, cut), True
                t = t.slice(cut).combine_chunks()
            held, size = t.to_batches(), weight(t)
            if size >= most:
                yield t, False
                held, size, large = [], 0, k[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), large is None


def repeated_in(ah: np.ndarray, blobs: list[bytes], known: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Flags of the repeated starts of each snippet; known: it has a copy elsewhere."""
    index: dict[tuple[int, bytes], int] = {}
    of = np.array([index.setdefault(k, len(index)) for k in zip(ah.tolist(), blobs, strict=True)], np.int64)
    sure = np.bincount(of, minlength=len(index)) > 1
    np.logical_or.at(sure, of, known)
    keys = np.array([k[0] for k in index], np.int64)
    _, inv, cnt = np.unique(keys, return_inverse=True, return_counts=True)
    texts = [k[1] for k in index]
    flags = [np.full(len(x) - least + 1, y) for x, y in zip(texts, sure, strict=True)]
    open_ = np.flatnonzero(cnt[inv] > 1)
    if len(open_) and not sure[open_].all():
        size = np.array([len(texts[i]) + 1 for i in open_])
        whole = np.frombuffer(b"".join(texts[i] + b"\0" for i in open_), np.uint8).astype(np.int64) + 1
        end = np.cumsum(size)
        whole[end - 1] = 0
        found = repeated_starts(whole, least)
        for i, lo in zip(open_, end - size, strict=True):
            flags[i] = flags[i] | found[lo : lo + len(flags[i])]
    return [flags[i] for i in of]


DEALT = "ah long, spread short, row long, at long, s binary"
#: Starts lo to lo + n of a row: known to repeat if s is null, else still to be judged on the bytes s.
JUDGED = "row long, lo long, n long, known boolean, s binary"


def judge(least: int, most: int, width: int | None):
    """Judges what meets at a key; a group of over ``most`` bytes is handed on, but for copies among its pieces.

    ``width`` 1: the snippets are single windows that are equal, unless two of
    them share a 64-bit key; so a group's different ones are few, and it is judged.
    """

    def rows_of(row, lo, n, known=None, s=None) -> pa.RecordBatch:
        k = len(row)
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(np.zeros(k, bool) if known is None else known), pa.nulls(k, pa.binary()) if s is None else pa.array(s, pa.binary())], ["row", "lo", "n", "known", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, single_key = {}, None  # width 1: the window's first row, None once it is known to repeat
        for t, whole in by_key(batches, most, 4):
            ah, row, at = (t.column(k).to_numpy() for k in (0, 2, 3))
            s = t.column(4).to_pylist()
            lo, n, known = at >> 9, at >> 1 & 255, at & 1 > 0
            full = np.array([x is None for x in s])
            yield rows_of(row[full], lo[full], n[full])
            own = np.flatnonzero(~full)
            if width == 1:
                again = []
                for i in own.tolist():
                    if ah[i] != single_key:
                        single, single_key = {}, ah[i]
                    if s[i] not in single:
                        single[s[i]] = None if known[i] else i, int(row[i]), int(lo[i])
                        if known[i]:
                            again.append((int(row[i]), int(lo[i])))
                        continue
                    first, r, p = single[s[i]]
                    if first is not None:
                        again.append((r, p))
                        single[s[i]] = None, r, p
                    again.append((int(row[i]), int(lo[i])))
                yield rows_of([x[0] for x in again], [x[1] for x in again], [0] * len(again))
            elif whole:
                a, b, c = [], [], []
                for i, f in zip(own, repeated_in(ah[own], [s[i] for i in own], known[own], least), strict=True):
                    edge = np.array([0, len(f)]) if f.all() else np.flatnonzero(np.diff(np.r_[False, f, False]))
                    a += [row[i]] * (len(edge) // 2)
                    b += (lo[i] + edge[::2]).tolist()
                    c += (edge[1::2] - edge[::2] - 1).tolist()
                yield rows_of(a, b, c)
            else:
                first: dict[bytes, int] = {}
                twice = set()
                for i in own.tolist():
                    if first.setdefault(s[i], i) != i:
                        twice.add(first[s[i]])
                copies = np.array([i for i in own.tolist() if first[s[i]] != i], np.int64)
                yield rows_of(row[copies], lo[copies], n[copies])
                left = list(first.values())
                sure = np.array([known[i] or i in twice for i in left])
                yield rows_of(row[left], lo[left], n[left], sure, [s[i] for i in left])

    return run


def narrower(least: int, width: int):
    """Snippets cut into classes of ``width`` distances from a start to the anchor, by the bytes that all windows of the class hold."""

    def run(b: pa.RecordBatch):
        row, lo, n, known = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        for i, j, t in K.slices(b.column(4)):
            d, first, last, _, place = anchors(t, least)
            if (np.diff(d, prepend=-1) != 1).any() or (last - first != n[i:j]).any():
                raise ValueError("a snippet has one anchor")
            low, high = (place - n[i:j]) // width, place // width
            size = high - low + 1
            at = np.repeat(np.arange(j - i), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[at]
            start = np.maximum(place[at] - (k + 1) * width + 1, 0)  # starts of the class
            stop = np.minimum(place[at] - k * width, n[i:j][at])
            base = t.ptr[:-1][at]
            inner = base + place[at] - k * width  # bytes that windows of the class share
            key = t.hashes(inner, inner - width + 1 + least) ^ K.mix(k.astype(np.uint64))
            raw = t.buf.tobytes()
            s = [raw[x:y] for x, y in zip((base + start).tolist(), (base + stop + least).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.zeros(len(at), np.int16)), pa.array(row[i:j][at]), pa.array((lo[i:j][at] + start) << 9 | (stop - start) << 1 | known[i:j][at]), pa.array(s, pa.binary())], ["ah", "spread", "row", "at", "s"])

    return run


def repeated_spans(rows: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """rows (_row, doc_id, raw binary) -> (_row, lo, hi): ranges of repeated starts."""
    n_parts = parts(rows.sparkSession)

    def deal(b: pa.RecordBatch):
        for i, _, t in K.slices(b.column(1)):
            d, lo, hi, h, _ = anchors(t, least)
            lead, twice = repeats_of(h)
            row = b.column(0).to_numpy()[d + i]
            spread = np.where(lead, 0, 1 + (row + lo) % 1009)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(spread.astype(np.int16)), pa.array(row), pa.array(lo << 9 | (hi - lo) << 1 | twice)], ["ah", "spread", "row", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in by_key(batches, 50_000):
            ah, at = t.column(0).to_numpy(), t.column(3).to_numpy()
            keep = pa.array((at & 1 > 0) | repeats_of(ah)[1] | (not whole))
            yield from t.select(["row", "ah", "at"]).filter(keep).to_batches()

    found = arrow_map(rows.select("_row", "raw"), deal, "ah long, spread short, row long, at long").repartition(n_parts, "ah", "spread").sortWithinPartitions("ah").mapInArrow(meet, "row long, ah long, at long")
    wanted = found.groupBy("row").agg(F.collect_list(F.struct("ah", "at")).alias("anchors")).withColumnRenamed("row", "_row")
    texts = rows.join(wanted, "_row").select("_row", "doc_id", "raw", "anchors")

    def cut(b: pa.RecordBatch):
        """Snippets; of equal ones in a batch, the first carries the bytes."""
        seen: dict[tuple[int, bytes], int] = {}
        keys, rows_, ats, blobs, spread, again = [], [], [], [], [], set()
        size = 0
        row = b.column(0).to_numpy()
        off = b.column(3).offsets.to_numpy()
        ah, at = (b.column(3).values.field(k).to_numpy() for k in (0, 1))

        def out():
            known = np.array([i in again for i in range(len(keys))], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spread, pa.int16()), pa.array(rows_, pa.int64()), pa.array((np.array(ats) & ~1) | known), pa.array(blobs, pa.binary())], ["ah", "spread", "row", "at", "s"])

        for d in range(b.num_rows):
            raw = b.column(2)[d].as_py()
            for k in range(off[d], off[d + 1]):
                lo, n = int(at[k]) >> 9, int(at[k]) >> 1 & 255
                s = raw[lo : lo + n + least]
                key = (int(ah[k]), s)
                first = seen.setdefault(key, len(keys))
                keys.append(key[0])
                rows_.append(int(row[d]))
                ats.append(int(at[k]))
                if first == len(keys) - 1:
                    blobs.append(s)
                    spread.append(0)
                    size += len(s)
                else:
                    again |= {first, len(keys) - 1}
                    blobs.append(None)
                    spread.append(1 + len(keys) % 1009)
            if size > 8 << 20:
                yield out()
                seen, keys, rows_, ats, blobs, spread, again, size = {}, [], [], [], [], [], set(), 0
        if keys:
            yield out()

    dealt = arrow_map(texts, cut, "ah long, spread short, row long, at long, s binary").repartition(n_parts, "ah", "spread").sortWithinPartitions("ah")
    width, out = None, None
    while True:
        judged = written(dealt.mapInArrow(judge(least, most, width), JUDGED), "judged")
        done = judged.filter("s IS NULL").select(F.col("row").alias("_row"), "lo", (F.col("lo") + F.col("n")).alias("hi"))
        out = done if out is None else out.unionAll(done)
        left = judged.filter("s IS NOT NULL")
        if width == 1 or left.isEmpty():
            return out
        width = max(1, (least - GRAM + 1 if width is None else width) // 2)
        dealt = arrow_map(left.select("row", "lo", "n", "known", "s"), narrower(least, width), DEALT).repartition(n_parts, "ah", "spread").sortWithinPartitions("ah")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: removed byte runs and what is left.

    docs must read the same rows in the same order each time, as files do.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b"")).alias("raw"))
    found = repeated_spans(rows, least, most).groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))

    def remove(b: pa.RecordBatch):
        off = b.column(2).offsets.to_numpy()
        lo, hi = (b.column(2).values.field(k).to_numpy() for k in (0, 1))
        spans, kept, size = [], [], []
        for d, raw in enumerate(b.column(1).to_pylist()):
            size.append(len(raw))
            own = spans_of(lo[off[d] : off[d + 1]], hi[off[d] : off[d + 1]] + least) if off[d] < off[d + 1] else []
            spans.append([{"start": x, "end": y} for x, y in own])
            edge = [0, *(x for s in own for x in s), len(raw)]
            kept.append(b"".join(raw[x:y] for x, y in zip(edge[::2], edge[1::2], strict=True)) if own else raw)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    joined = rows.join(found, "_row", "left").select("doc_id", "raw", F.coalesce("found", empty).alias("found"))
    return arrow_map(joined, remove, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicate(docs_of(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
