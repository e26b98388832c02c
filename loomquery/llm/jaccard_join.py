"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles (words between blanks, as they are).
Equal sets are one vertex. Every set is embedded as a MinHash sketch, whose
(coordinate, value) pairs are the tokens of the recursion: a run deals the
coordinates out to its levels, the sets of a node that share a token sampled at
its level go to one child, and a child that holds too many sets is split again.
Small buckets are compared by brute force on the sketches. Runs are repeated
until a pair at the threshold is met with the target recall at the depth that
the recursion has reached. The pairs found link candidate clusters; inside each,
all pairs are verified on the exact sets, in blocks.

A node is counted (before any sets are brought together) and only the children
of nodes that are too large go to the next level. A node whose split would not
lower the number of pairs to compare holds sets that are alike by 1/width or
more on average. Splitting it more is no use; it is one candidate cluster, linked
by a star and verified exactly. So no node and no bucket has a cap on its sets.

Link counts need each pair of different sets in a cluster once: blocks of 128
sets meet in tasks of their own, so a cluster of g sets moves g/128 times.

Defined results: null, empty and blank texts have no shingle; each is its own
class without links. A text of one to four words has one shingle. Documents with
equal sets (repeated rows too) are linked to each other. A class has the least
doc_id of its members; null ids come last. Other columns, whatever their names,
play no part and are kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import textkernel as K
from loomquery.llm.components import components
from loomquery.llm.shared import arrow_map, checkpoint, docs_of, free_name, parts

T = 64
_rng = np.random.default_rng(5)
_MUL = _rng.integers(0, 1 << 31, T, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, T, dtype=np.uint32)


def shingle_sets(t: K.Text) -> tuple[np.ndarray, np.ndarray]:
    start, end, wptr = t.spans(~K.IS_SPACE)
    return K.unique_by_doc(*K.shingles(t.hashes(start, end), wptr))


def sketches(s: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """MinHash values [documents, T]; documents without shingles have zeros."""
    n = len(ptr) - 1
    out = np.zeros((n, T), np.uint32)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        x = (s >> K.U(32)).astype(np.uint32) ^ s.astype(np.uint32)
        for i in range(T):
            out[full, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], ptr[full])
    return out


def coordinates(run: np.ndarray, level: int, width: int) -> np.ndarray:
    """The ``width`` coordinates [runs, width] that runs sample at a level; a run takes none twice."""
    order = np.argsort(K.mix(run.astype(np.uint64)[:, None] * K.U(64) + np.arange(T, dtype=np.uint64) + K.U(77)), 1)
    return order[:, level * width : (level + 1) * width]


def children(node: np.ndarray, sk: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Child nodes [rows, width] of sets sk in nodes, by coordinates c [rows, width]."""
    v = np.take_along_axis(sk, c, 1).astype(np.uint64)
    return K.mix(node[:, None] * K.U(0x9E3779B97F4A7C15) + K.mix(v << K.U(8) | c.astype(np.uint64)))


def sketch_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, T)


def runs_for(threshold: float, width: int, depth: int, recall: float) -> int:
    """Runs after which a pair at the threshold is met with ``recall``, where the recursion is ``depth`` levels deep."""
    once = (1 - (1 - threshold) ** width) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``keys`` columns, over batch borders."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def star_edges(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the local pairs: one edge fewer than members."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()  # the least id of a component has the least rank
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[order[new]]
        if (new == label).all():
            break
        label = new
    far = label != rank
    return ids[order[label[far]]], ids[far]


def candidates(reps: DataFrame, threshold: float, recall: float, width: int, limit: int, depth: int = 3) -> DataFrame:
    """Edges (a, b) of rep numbers: spanning stars of the sets that the recursion brings together.

    The first runs are as many as a recursion of ``depth`` levels needs; more follow if it goes deeper.

    reps: (rep, sketch), read more than once. Levels end by themselves: a split
    node has fewer pairs to compare than its parent, and a run has T / width
    levels at most, after which the sets of a node share half of all coordinates.
    """
    spark = reps.sparkSession
    least = math.floor(T * (threshold - 0.25))

    def first(runs: np.ndarray):
        c, roots = coordinates(runs, 0, width), K.mix(runs.astype(np.uint64) + K.U(77))

        def deal(b: pa.RecordBatch):
            sk, n = sketch_matrix(b.column(1)), len(runs)
            node = children(np.tile(roots, b.num_rows), np.repeat(sk, n, 0), np.tile(c, (b.num_rows, 1))).ravel()
            run = np.tile(np.repeat(runs, width), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(node.view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n * width)))], ["run", "node", "rep"])

        return arrow_map(reps.select("rep", "sketch"), deal, "run long, node long, rep long")

    def deeper(opened: DataFrame, level: int):
        def split(b: pa.RecordBatch):
            run, node, sk = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), sketch_matrix(b.column(3))
            runs, at = np.unique(run, return_inverse=True)
            kids = children(node, sk, coordinates(runs, level, width)[at]).ravel()
            take = pa.array(np.repeat(np.arange(b.num_rows), width))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(kids.view(np.int64)), b.column(2).take(take)], ["run", "parent", "node", "rep"])

        return arrow_map(opened.select("run", "node", "rep", "sketch"), split, "run long, parent long, node long, rep long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning edges of the pairs in each bucket whose sketches agree about as far as the threshold."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, g in groups(batches, 1):
            ids, sk = g.column(1).to_numpy(), sketch_matrix(g.column(2))
            left, right = [], []
            for i in range(len(ids) - 1):
                j = np.flatnonzero((sk[i + 1 :] == sk[i]).sum(1) >= least)
                if len(j):
                    left.append(np.full(len(j), i))
                    right.append(j + i + 1)
            if left:
                out.append(star_edges(ids, np.concatenate(left), np.concatenate(right)))
                size += len(out[-1][0])
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in out])) for k in (0, 1)], ["a", "b"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in out])) for k in (0, 1)], ["a", "b"])

    def compared(buckets: DataFrame, sketches: DataFrame) -> DataFrame:
        rows = buckets.join(sketches, "rep").select("node", "rep", "sketch")
        return checkpoint(rows.repartition(parts(spark), "node").sortWithinPartitions("node").mapInArrow(compare, "a long, b long"))

    def level_of(entries: DataFrame, *keys: str) -> DataFrame:
        """Entries of nodes with more than one set, with the node's count; counts are combined before the shuffle."""
        counts = entries.groupBy(*keys).agg(F.count("*").alias("c"))
        return checkpoint(entries.join(counts.filter("c > 1"), list(keys)))

    edges, done, needed = [], 0, runs_for(threshold, width, depth, recall)
    while done < needed:
        kept, sketches, level = level_of(first(np.arange(done, needed)), "node"), reps.select("rep", "sketch"), 1
        done = needed
        edges.append(compared(kept.filter(F.col("c") <= limit), sketches))
        while not (hot := kept.filter(F.col("c") > limit)).isEmpty():
            opened = checkpoint(hot.join(sketches, "rep").select("run", "node", "rep", "sketch", "c"))
            sketches = opened.select("rep", "sketch").dropDuplicates(["rep"])
            own = opened.groupBy("node").agg(F.first("c").alias("own"), F.min("rep").alias("least"))
            ends = (level + 1) * width > T
            if ends:
                whole = own
            else:
                kids = checkpoint(deeper(opened, level))
                pairs = kids.groupBy("parent", "node").agg(F.count("*").alias("c")).groupBy("parent").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
                verdict = checkpoint(own.join(pairs.withColumnRenamed("parent", "node"), "node").withColumn("whole", F.expr("pairs >= double(own) * own")))
                whole = verdict.filter("whole")
            edges.append(checkpoint(opened.select("node", "rep").join(whole.select("node", "least"), "node").filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))))
            if ends:
                break
            split = verdict.filter("not whole").select(F.col("node").alias("parent"))
            kept, level = level_of(kids.join(split, "parent", "left_semi").select("run", "node", "rep"), "node"), level + 1
            if not kept.isEmpty():
                edges.append(compared(kept.filter(F.col("c") <= limit), sketches))
        needed = max(needed, runs_for(threshold, width, level, recall))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionAll(e)
    return out


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, recall: float = 0.9999, width: int = 2, limit: int = 1000, row: str = "_row", block: int = 128) -> DataFrame:
    """(_row, doc_id, class_id, n_links, first) of every row of docs, whose column ``row`` has the row numbers.

    n_links: other rows whose sets have a Jaccard similarity of ``threshold`` or
    more. ``first``: the one row of its class with the least (doc_id, _row).
    limit: sets in a node above which it is split; block: sets of a verified block.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(row).alias("_row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))

    def embed(b: pa.RecordBatch):
        """One row for each distinct set of a batch, with its rows."""
        row, ids = b.column(0), b.column(1)
        parts_, sizes, sk = [], [], []
        for _, _, t in K.slices(b.column(2)):
            s, ptr = shingle_sets(t)
            parts_.append(np.stack([K.segment_sums((K.mix(s ^ K.U(k)) >> K.U(1)).astype(np.int64), ptr) for k in (1, 2)], 1))
            sizes.append(np.diff(ptr))
            sk.append(sketches(s, ptr))
        key, n, sk = np.concatenate(parts_), np.concatenate(sizes), np.concatenate(sk)
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((row.to_numpy(), ids.fill_null(0).to_numpy(), no_id, key[:, 1], key[:, 0], n))  # a set's first row leads it
        k, m = key[order], n[order]
        first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1]).any(1)])
        off = pa.array(np.r_[first, len(order)], pa.int32())
        at = pa.array(order)
        lists = [pa.ListArray.from_arrays(off, c.take(at)) for c in (row, ids)]
        flat = np.ascontiguousarray(sk[order[first]])
        yield pa.RecordBatch.from_arrays([pa.array(k[first, 0]), pa.array(k[first, 1]), pa.array(m[first]), *lists, pa.array([r.tobytes() for r in flat], pa.binary())], ["s1", "s2", "n", "rows", "ids", "sketch"])

    sets = checkpoint(arrow_map(src, embed, "s1 long, s2 long, n long, rows array<long>, ids array<long>, sketch binary"))
    some = sets.filter("n > 0")
    reps = checkpoint(some.groupBy("s1", "s2", "n").agg(F.min(F.struct(F.col("ids")[0].isNull(), F.col("ids")[0].alias("id"), F.col("rows")[0].alias("row"))).alias("lead"), F.sum(F.size("rows")).alias("m"), F.first("sketch").alias("sketch")).select("s1", "s2", "n", "m", "sketch", F.col("lead.row").alias("rep"), F.col("lead.id").alias("min_id")))
    n_parts = parts(spark)
    clusters = components(candidates(reps, threshold, recall, width, limit))
    sizes = clusters.groupBy("c").agg(F.count("*").alias("size"))
    members = checkpoint(clusters.join(sizes, "c").join(reps.select(F.col("rep").alias("v"), "m"), "v"))

    # exact sets of the members, dealt to their cluster's pairs of blocks
    texts = members.join(docs.select(F.col(row).alias("v"), F.col(text).alias("t")), "v")

    def exact(b: pa.RecordBatch):
        for i, j, t in K.slices(b.column(3)):
            s, ptr = shingle_sets(t)
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), b.column(4).slice(i, j - i), pa.array([s[lo:hi].tobytes() for lo, hi in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())], ["c", "v", "size", "m", "s"])

    cols = texts.select("c", "v", "size", "t", "m").select("c", "v", "size", "t", F.col("m").cast("long").alias("m"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    sets_of = arrow_map(cols, exact, "c long, v long, size long, m long, s binary").withColumn("own", F.pmod(F.xxhash64("v"), blocks).cast("int"))
    tasks = sets_of.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = tasks.select("c", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v", "m", "size", "s").repartition(n_parts, "c", "lo", "hi").sortWithinPartitions("c", "lo", "hi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(v, partner links, other end of a spanning edge) of each block pair."""
        for (_, lo, hi), g in groups(batches, 3):
            own, v, m = (g.column(k).to_numpy() for k in (3, 4, 5))
            blobs = g.column(7).to_pylist()
            n = np.array([len(x) // 8 for x in blobs])
            s = np.frombuffer(b"".join(blobs), np.uint64)
            doc = np.repeat(np.arange(len(n)), n)
            u, inv, cnt = np.unique(s, return_inverse=True, return_counts=True)
            shared = np.zeros((len(n), len(n)), np.float32)
            place = np.cumsum(cnt > 1) - 1
            both = cnt[inv] > 1
            col, row = place[inv[both]], doc[both]
            order = np.argsort(col, kind="stable")
            col, row = col[order], row[order]
            step = max(256, 8_000_000 // max(len(n), 1))
            for a in range(0, int(col[-1]) + 1 if len(col) else 0, step):
                i, j = np.searchsorted(col, (a, a + step))
                x = np.zeros((len(n), min(step, int(col[-1]) + 1 - a)), np.float32)
                x[row[i:j], col[i:j] - a] = 1
                shared += x @ x.T
            same = shared.astype(np.int64)
            union = n[:, None] + n[None, :] - same
            hit = same * 1_000_000 >= round(threshold * 1_000_000) * union
            np.fill_diagonal(hit, False)
            if lo != hi:
                hit &= own[:, None] != own[None, :]
            left, right = np.nonzero(np.triu(hit))
            a, z = star_edges(v, left, right)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[v, z]), pa.array(np.r_[(hit * m[None, :]).sum(1), np.zeros(len(z), np.int64)]), pa.array(np.r_[np.full(len(v), -1), a])], ["v", "links", "to"])

    checked = checkpoint(tasks.mapInArrow(verify, "v long, links long, to long"))
    links = checked.groupBy("v").agg(F.sum("links").alias("links"))
    tops = components(checked.filter("to >= 0").select(F.col("v").alias("a"), F.col("to").alias("b"))).select("v", F.col("c").alias("top"))
    found = reps.select("s1", "s2", "n", F.col("rep").alias("v"), "m", "min_id").join(links, "v", "left").join(tops, "v", "left")
    found = checkpoint(found.withColumn("top", F.coalesce("top", "v")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("m") - 1))
    ids = found.groupBy("top").agg(F.min("min_id").alias("class_id"), F.min(F.struct(F.col("min_id").isNull(), "min_id", F.col("v"))).alias("best"))
    found = found.join(ids, "top").select("s1", "s2", "n", "class_id", "links", F.col("best.v").alias("lead"))

    # back to rows: sets of a batch first, then their rows
    wide = sets.filter("n > 0").join(found, ["s1", "s2", "n"])
    pairs = F.expr("zip_with(rows, ids, (r, i) -> struct(r, i))")
    out = wide.select(F.explode(pairs).alias("x"), "class_id", "links", "lead").select(F.col("x.r").alias("_row"), F.col("x.i").alias("doc_id"), "class_id", F.col("links").alias("n_links"), (F.col("x.r") == F.col("lead")).alias("first"))
    none = sets.filter("n = 0").select(F.explode(pairs).alias("x")).select(F.col("x.r").alias("_row"), F.col("x.i").alias("doc_id"))
    return out.unionByName(none.select("_row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One row of each class, unchanged. docs must read the same rows in the same order each time, as files do."""
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    first = classes(rows, text, doc_id, threshold, row=row).filter("first").select(F.col("_row").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    return classes(docs.withColumn("_row", F.monotonically_increasing_id())).select("doc_id", "class_id", "n_links")
