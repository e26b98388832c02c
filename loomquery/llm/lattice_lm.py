"""Language-model scoring by a subword lattice.

An existing tokenizer's pieces form the vocabulary, and its scores their first
unigram weights. The weights are fitted to the training text by expectation
maximisation over all segmentations (no round of it leaves the file's own); a
text's score is the log10 of its probability summed over all segmentations of
its words, each found by a forward recursion in log space. Segmentations never
cross blanks, so the recursion runs once a distinct word, and a document adds up
its words' results and that of its end.

Defined results: null text is empty, which has the end token alone. Rows repeat
as they are, equal texts score alike. With no training row all counts are 0, N
and V are 0 and the pieces have the file's weights. A kept column that is named
like an added one makes way for it; other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from loomquery.llm import textkernel as K
from loomquery.llm.jaccard_join import groups
from loomquery.llm.shared import arrow_map, checkpoint, crc_mod, docs_of, kept_columns, parts

LN10 = float(np.log(10))

#: Words of so many bytes are walked one by one, byte by byte, over stretches of edges.
LONG, STRETCH = 256, 1 << 16
SCALED = math.log(1e100)
#: Stands before each word in the lattice; blanks never occur inside a word.
START = b" "


def pieces_of(path: str) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased byte pieces of a sentencepiece model with their natural log weights, which sum to 1.

    All single bytes are pieces, so that every text has a segmentation. A unigram
    model's scores are log-probabilities as they are. Scores that number the
    pieces (merge ranks) become those of Zipf's law. Bytes that the file has not
    weigh as little as its last piece; pieces that differ in case add up.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: list[tuple[bytes, float]] = []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = re.sub(rb"\xe2\x96\x81", START, sp.id_to_piece(i).encode()).lower()
        if p and START not in p[1:]:
            found.append((p, sp.get_score(i)))
    scores = np.array([x for _, x in found])
    if len(scores) and (scores == np.round(scores)).all() and len(np.unique(scores)) == len(scores):
        scores = -np.log(scores.max() - scores + 2)
    weight: dict[bytes, float] = {}
    for (p, _), x in zip(found, np.exp(scores).tolist(), strict=True):
        weight[p] = weight.get(p, 0.0) + x
    for b in range(256):
        weight.setdefault(bytes([b]), min(weight.values(), default=1.0))
    pieces = sorted(weight)
    w = np.array([weight[p] for p in pieces])
    return pieces, np.log(w / w.sum())


@dataclass
class Lattice:
    """Pieces in a hash table by (length, bytes); log_p has one more entry, for a document's end."""

    pieces: list[bytes]
    log_p: np.ndarray

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        number = {p: i for i, p in enumerate(self.pieces)}
        for p in self.pieces:  # prefixes that are no piece: a search may go on behind them
            for k in range(1, len(p)):
                number.setdefault(p[:k], -1)
        keys = sorted(number)
        size = np.array([len(p) for p in keys])
        flat = np.zeros((len(keys), self.longest), np.uint64)
        for i, p in enumerate(keys):
            flat[i, : len(p)] = np.frombuffer(p, np.uint8) + np.uint64(1)
        h = np.zeros(len(keys), np.uint64)
        for k in range(self.longest):
            h = np.where(k < size, self._step(h, flat[:, k]), h)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        bits = int(np.ceil(np.log2(len(h)))) + 3
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.ids = np.full(1 << bits, -3, np.int32)  # -1: a prefix alone; -2: neither; -3: an empty place
        value = np.array([number[k] for k in keys], np.int32)
        at = (h >> self.shift).astype(np.int64)
        left = np.arange(len(h))
        self.probes = 0
        while len(left):  # linear probing, all at once
            self.probes += 1
            free = left[self.ids[at[left]] == -3]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.ids[at[free]] = h[free], value[free]
            left = np.setdiff1d(left, free)
            at[left] = at[left] + 1 & self.mask

    @staticmethod
    def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
        h = (h ^ byte) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; -1 for the prefix of a piece, -2 for anything else."""
        at = (h >> self.shift).astype(np.int64)
        here = self.ids[at]
        out = np.where(self.keys[at] == h, here, -2)
        out[here == -3] = -2
        left = np.flatnonzero((out == -2) & (here != -3))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = at[left] + 1 & self.mask
            here = self.ids[at[left]]
            hit = (self.keys[at[left]] == h[left]) & (here != -3)
            out[left[hit]] = here[hit]
            left = left[~hit & (here != -3)]
        return out

    def edges(self, m: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of a matrix of equally long byte strings."""
        n, width = m.shape
        columns = np.ascontiguousarray(m.T) + np.uint64(1)
        out = []
        for i in range(width):
            h, rows = np.zeros(n, np.uint64), np.arange(n)
            for j in range(i, min(width, i + self.longest)):
                h = self._step(h, columns[j][rows] if len(rows) < n else columns[j])
                ids = self.find(h)
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    out.append((i, j + 1, rows[hit], ids[hit]))
                on = np.flatnonzero(ids > -2)
                if not len(on):
                    break
                h, rows = h[on], rows[on]
        return out

    def forward(self, n: int, width: int, edges: list) -> np.ndarray:
        a = np.full((width + 1, n), -np.inf)
        a[0] = 0
        for i, j, rows, ids in sorted(edges, key=lambda e: (e[1], e[0])):
            a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + self.log_p[ids])
        return a

    def backward(self, n: int, width: int, edges: list) -> np.ndarray:
        b = np.full((width + 1, n), -np.inf)
        b[width] = 0
        for i, j, rows, ids in sorted(edges, key=lambda e: (-e[0], e[1])):
            b[i, rows] = np.logaddexp(b[i, rows], b[j, rows] + self.log_p[ids])
        return b

    @staticmethod
    def groups(words: list[bytes], most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, byte matrix) of equally long words under ``LONG``, a bounded number of bytes at a time."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] < LONG]
        i = 0
        while i < len(order):
            width = size[order[i]]
            j = min(int(np.searchsorted(size[order], width, "right")), i + max(1, most // int(width + 1)))
            rows = order[i:j]
            yield rows, np.frombuffer(b"".join(START + words[r] for r in rows), np.uint8).reshape(j - i, width + 1).astype(np.uint64)
            i = j

    def stretches(self, word: np.ndarray, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, piece) of one long word's edges, by their start, for ``STRETCH`` starts at a time."""
        n = len(word)
        firsts = range(0, n, STRETCH)
        for lo in reversed(firsts) if back else firsts:
            hi = min(lo + STRETCH, n)
            h, at = np.zeros(hi - lo, np.uint64), np.arange(lo, hi)
            found = []
            for k in range(self.longest):
                on = at + k < n
                h, at = self._step(h[on], word[at[on] + k]), at[on]
                ids = self.find(h)
                hit = ids >= 0
                found.append((at[hit], at[hit] + k + 1, ids[hit]))
                on = ids > -2
                h, at = h[on], at[on]
                if not len(at):
                    break
            i, j, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(-i if back else i, kind="stable")
            yield i[order], j[order], ids[order]

    def walk(self, word: np.ndarray, back: bool = False) -> np.ndarray:
        """Logs of the forward (or backward) sums at each place of one long word.

        The sums near the present place are numbers of one scale, which grows with
        what has been passed; each place's log keeps its own.
        """
        n, p, scale = len(word), np.exp(self.log_p), 0.0
        a = [0.0] * (n + 1)
        a[n if back else 0] = 1.0
        out = np.zeros(n + 1)
        for i, j, ids in self.stretches(word, back):
            last = -1
            for x, y, w in zip(i.tolist(), j.tolist(), p[ids].tolist(), strict=True):
                if x != last:
                    here = a[last] if back and last >= 0 else a[x]
                    at = last if back else x
                    if at >= 0:
                        if here < 1e-100:
                            for k in range(at, min(at + self.longest, n) + 1):
                                a[k] *= 1e100
                            scale += 1
                            here = a[at]
                        out[at] = math.log(here) - scale * SCALED
                    last = x
                if back:
                    a[x] += w * a[y]
                else:
                    a[y] += w * a[x]
            if back:
                out[last] = math.log(a[last]) - scale * SCALED
        if not back:
            out[n] = math.log(a[n]) - scale * SCALED
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        return np.frombuffer(START + word, np.uint8).astype(np.uint64) + np.uint64(1)

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, over all its segmentations."""
        out = np.zeros(len(words))
        for r, w in enumerate(words):
            if len(w) >= LONG:
                out[r] = self.walk(self.long_word(w))[-1]
        for rows, m in self.groups(words):
            out[rows] = self.forward(len(m), m.shape[1], self.edges(m))[-1]
        return out

    def expected(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, words counting ``weight`` times.

        Sums of products as they are, where a word's probability is far from
        underflow (what a part of it lost is then less than a 10^-50th of it), and
        in log space for all other words.
        """
        out = np.zeros(len(self.log_p))
        p = np.exp(self.log_p)
        for word, times in zip(words, weight.tolist(), strict=True):
            if len(word) >= LONG:
                x = self.long_word(word)
                a, b = self.walk(x), self.walk(x, True)
                for i, j, ids in self.stretches(x):
                    out += np.bincount(ids, times * np.exp(a[i] + self.log_p[ids] + b[j] - a[-1]), len(out))
        for rows, m in self.groups(words):
            edges, w = self.edges(m), weight[rows]
            n, width = m.shape
            a, b = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            a[0] = b[width] = 1
            for i, j, r, ids in sorted(edges, key=lambda e: (e[1], e[0])):
                a[j, r] += a[i, r] * p[ids]
            fine = a[-1] > 1e-250
            for i, j, r, ids in sorted(edges, key=lambda e: (-e[0], e[1])) if fine.any() else ():
                b[i, r] += b[j, r] * p[ids]
            share = np.where(fine, w / np.where(fine, a[-1], 1), 0)
            for i, j, r, ids in edges if fine.any() else ():
                np.add.at(out, ids, share[r] * a[i, r] * p[ids] * b[j, r])
            if fine.all():
                continue
            small = np.flatnonzero(~fine)
            m, w = m[small], w[small]
            edges, n = self.edges(m), len(small)
            a, b = self.forward(n, width, edges), self.backward(n, width, edges)
            for i, j, r, ids in edges:
                out += np.bincount(ids, w[r] * np.exp(a[i, r] + self.log_p[ids] + b[j, r] - a[-1, r]), len(out))
        return out


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split cuts at the six ASCII blanks and nowhere else."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit keys of words, as the text kernel gives them; equal keys of two words are detected where the table is used."""
    ptr = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return K.Text(np.frombuffer(b"".join(words), np.uint8), ptr).hashes(ptr[:-1], ptr[1:])


def word_counts(df: DataFrame, text: str, train: str) -> DataFrame:
    """(word, c) of all rows' words: c counts the training rows' uses. Each task's batch counts before the shuffle."""

    def run(b: pa.RecordBatch):
        c: Counter = Counter()
        other: set[bytes] = set()
        for t, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if learn:
                c.update(tokens(t))
            else:
                other.update(tokens(t))
        other -= c.keys()
        yield pa.RecordBatch.from_arrays([pa.array([*c, *other], pa.binary()), pa.array([*c.values(), *[0] * len(other)], pa.int64())], ["word", "c"])

    return arrow_map(df.select(F.col(text).alias("t"), F.col(train).alias("l")), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, n_docs: int, n_words: int, pieces: list[bytes], start: np.ndarray, rounds: int = 3, add: float = 0.1) -> Lattice:
    """Expectation maximisation over all (word, c), from the weights ``start``; the driver gets one sum for each piece."""
    sc = counts.sparkSession.sparkContext
    end = (n_docs + 1) / (n_docs + n_words + 2)  # a word is a piece at least
    lattice = Lattice(pieces, np.append(start + np.log1p(-end), np.log(end)))
    counts = counts.filter("c > 0")
    for _ in range(rounds):
        sent = sc.broadcast(lattice)

        def run(b: pa.RecordBatch, sent=sent):
            e = sent.value.expected(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float))
            at = np.flatnonzero(e > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(e[at])], ["piece", "e"])

        got = arrow_map(counts, run, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        e = np.full(len(pieces) + 1, add)
        e[got["piece"]] += got["e"]
        e[-1] += n_docs
        lattice.log_p = np.log(e / e.sum())
        sent.unpersist()
    return lattice


def score(df: DataFrame, train: Column, vocabulary: tuple[list[bytes], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), rounds: int = 3, common: int = 50_000) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score and score of every row of ``df``.

    Words with more than 1/common of all tokens (fewer than ``common``, so a
    bounded table) are sent to the tasks. All others are looked up in buckets of
    words: a task's batch sends each bucket one packed row, which meets that
    bucket's part of the word table; no word there has a large share.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    keep = kept_columns(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names, keep = keep, tuple(f"_keep{i}" for i in range(len(keep)))
    df = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, keep, strict=True)), F.col(text).alias("_text"), train.alias("_train"), F.monotonically_increasing_id().alias("_row"))
    counts = checkpoint(word_counts(df, "_text", "_train"))
    n_docs = df.filter("_train").count()
    total = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + n_docs, total["v"] + (n_docs > 0)
    model = fit(counts, n_docs, total["n"], *vocabulary, rounds)
    lattice = sc.broadcast(model)
    unit = n + 0.1 * (v + 1)
    rare = F.col("c") <= n / common
    hot = counts.filter(~rare).toPandas()
    words = [bytes(w) for w in hot["word"]]
    order = np.argsort(key := word_keys(words))
    c = hot["c"].to_numpy(float)[order]
    frequent = sc.broadcast((key[order], c, np.log10((c + 0.1) / unit), (model.log_prob(words) / LN10)[order]))
    end = (float(np.log10((n_docs + 0.1) / unit)), float(model.log_p[-1] / LN10))
    buckets = 2 * parts(spark)
    kinds = [df.schema[c].dataType for c in keep]
    packed = StructType().add("bucket", "integer").add("kind", "integer").add("home", "long")
    for name, kind in (("key", LongType()), ("at", IntegerType()), ("nk", LongType()), ("base", DoubleType()), ("lp", DoubleType()), *zip((f"keep{i}" for i in range(len(keep))), kinds, strict=True)):
        packed = packed.add(name, ArrayType(kind))
    arrow = to_arrow_schema(packed)

    def dealt(kind: int, home: int, bucket: np.ndarray, cut: np.ndarray, columns: dict[str, pa.Array], schema: pa.Schema = arrow) -> pa.RecordBatch:
        """One row for each run of columns; cut: where the runs begin, and the end."""
        k = len(cut) - 1
        off, none = pa.array(cut, pa.int32()), pa.array(np.zeros(k + 1), pa.int32())
        lists = [pa.ListArray.from_arrays(off, columns[f.name].cast(f.type.value_type)) if f.name in columns else pa.ListArray.from_arrays(none, pa.array([], f.type.value_type)) for f in list(schema)[3:]]
        head = [pa.array(bucket, pa.int32()), pa.array(np.full(k, kind), pa.int32()), pa.array(np.full(k, home), pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *(x.cast(f.type) for x, f in zip(lists, list(schema)[3:], strict=True))], schema=schema)

    def by_bucket(kind: int, home: int, key: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
        of = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(of, kind="stable")
        of = of[order]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        return dealt(kind, home, of[cut], np.append(cut, len(of)), {"key": pa.array(key[order].view(np.int64))} | {k: pa.array(x[order]) for k, x in columns.items()})

    def table(b: pa.RecordBatch):
        words = b.column(0).to_pylist()
        yield by_bucket(0, 0, word_keys(words), nk=b.column(1).to_numpy(), lp=lattice.value.log_prob(words) / LN10)

    def bags(b: pa.RecordBatch):
        known, hc, hb, hp = frequent.value
        for lo, hi, t in K.slices(b.column(0)):
            home, n_here = int(b.column(1)[lo].as_py()), hi - lo  # a slice is named by its first row
            low = t.lowered()
            start, stop, wptr = low.spans(~K.IS_SPACE)
            key, doc = low.hashes(start, stop), K.doc_of(wptr)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            here = known[at] == key if len(known) else np.zeros(len(key), bool)
            a, d = at[here], doc[here]
            if (~here).any():
                yield by_bucket(1, home, key[~here], at=doc[~here])
            whole = {"key": np.diff(wptr) + 1, "at": np.arange(n_here), "nk": np.bincount(d, hc[a] > 0, n_here).astype(np.int64) + (n_docs > 0), "base": np.bincount(d, hb[a], n_here) + end[0], "lp": np.bincount(d, hp[a], n_here) + end[1]}
            kept = {f"keep{j}": b.column(2 + j).slice(lo, n_here) for j in range(len(keep))}
            yield dealt(2, home, np.array([home % buckets]), np.array([0, n_here]), {k: pa.array(x) for k, x in whole.items()} | kept)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each bucket's table rows come before its documents' words; sums by document go back to the slice."""
        at, key, c, lp, ready = None, [], [], [], False
        for b in batches:
            for r in range(b.num_rows):
                bucket, kind, home = (b.column(k)[r].as_py() for k in range(3))
                if bucket != at:
                    at, key, c, lp, ready = bucket, [], [], [], False
                if kind == 2:  # needs no look-up: brings what was known, and the columns kept
                    yield b.slice(r, 1)
                    continue
                col = {f.name: b.column(k)[r].values for k, f in enumerate(arrow) if k > 2}
                if kind == 0:
                    key.append(col["key"].to_numpy().view(np.uint64))
                    c.append(col["nk"].to_numpy())
                    lp.append(col["lp"].to_numpy())
                    continue
                if not ready:
                    order = np.argsort(keys := np.concatenate(key))
                    keys = keys[order]
                    if (keys[1:] == keys[:-1]).any():
                        raise ValueError("two words have one 64-bit key")
                    cs = np.concatenate(c)[order]
                    bs, ps, ready = np.log10((cs + 0.1) / unit), np.concatenate(lp)[order], True
                found = np.searchsorted(keys, col["key"].to_numpy().view(np.uint64))
                doc, inv = np.unique(col["at"].to_numpy(), return_inverse=True)
                sums = {k: pa.array(np.bincount(inv, x[found], len(doc)).astype(kind_)) for k, x, kind_ in (("nk", cs > 0, np.int64), ("base", bs, float), ("lp", ps, float))}
                yield dealt(1, home, np.array([bucket]), np.array([0, len(doc)]), {"at": pa.array(doc)} | sums)

    result = StructType().add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    for c, kind in zip(keep, kinds, strict=True):
        result = result.add(c, kind)
    plain = to_arrow_schema(result)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each slice, summed by document."""
        for _, g in groups(batches, 1):
            g = g.combine_chunks()
            flat = {f.name: g.column(k).combine_chunks() for k, f in enumerate(g.schema)}
            at = flat["at"].flatten().to_numpy()
            own = g.filter(pa.compute.equal(flat["kind"], 2))
            n = len(own.column("at")[0])
            sums = {k: np.bincount(at, flat[k].flatten().to_numpy(), n) for k in ("nk", "base", "lp")}
            kept = [own.column(f"keep{i}").combine_chunks().flatten() for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([own.column("key").combine_chunks().flatten(), pa.array(sums["nk"].astype(np.int64)), pa.array(sums["base"]), pa.array(sums["lp"]), *kept], schema=plain)

    both = arrow_map(counts.filter(rare), table, packed).unionAll(arrow_map(df.select("_text", "_row", *keep), bags, packed))
    met = both.repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "kind")
    back = met.mapInArrow(look_up, packed).select("home", *(f.name for f in packed.fields if f.name != "home")).repartition(parts(spark), "home").sortWithinPartitions("home")
    return back.mapInArrow(add_up, result).select(*(F.col(k).alias(c) for c, k in zip(names, keep, strict=True)), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lattice_lm(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: path of a sentencepiece model whose pieces are used."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    held = crc_mod("doc_id", 10) == 0
    docs = docs_of(spark, sf_dir).select("doc_id", "text", held.alias("held_out"))
    return score(docs, ~F.col("held_out"), pieces_of(vocabulary), keep=("doc_id", "held_out"))
