"""Token ids in files of range-coded blocks, in document order.

File: ``LQTF``, then blocks of range_coder (each reset and checksummed on its
own), then a footer: deflated document ids, null flags and token counts and the
blocks' sizes, its checksum and length, and ``LQTF`` again. Files of one output
follow each other by part number; ids of a document never cross files.

Texts become ids before they are sorted, so ids move and texts do not. Writing is
a function of the sorted rows: a repeated task writes the same bytes to a name of
its own and moves them into place. The rows that describe the files are
checkpointed, so later losses read files and never write them again.

Ids are those of the tokenizer as its file says, so a special token's name inside
a text has the special id.

Defined results: null text is empty and has the end id alone. Rows with one id,
and repeated rows, are all written, by id, then a hash of the text; null ids come
first. An empty table writes no file. Other columns, whatever their names, play
no part.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm import textkernel as K
from loomquery.llm.range_coder import BLOCK, CorruptBlock, decode_blocks, encode_blocks
from loomquery.llm.shared import arrow_map, checkpoint, docs_of, fresh_path, parts, qualified

FILE = b"LQTF"
TAIL = struct.Struct("<IQ4s")
GROUP = 4 * BLOCK
#: Bytes of text encoded at once.
SLICE = 1 << 20
_MARK, _WORD = np.zeros(256, bool), np.zeros(256, bool)
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
#: A unit that is one word: ASCII and Latin-1 letters in UTF-8, or ASCII marks.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-/:-@\[-`{-~]+")


class Index:
    """64-bit keys -> numbers in their order of arrival; linear probing, many keys at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, key: np.ndarray) -> np.ndarray:
        at = (key >> self.shift).astype(np.int64)
        here = self.keys[at]
        out = np.where(here == key, self.numbers[at], -1)
        left = np.flatnonzero((here != key) & (here != 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            here = self.keys[at[left]]
            hit = here == key[left]
            out[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (here != 0)]
        return out

    def add(self, key: np.ndarray) -> None:
        """Distinct keys that are not here yet."""
        number = np.arange(self.n, self.n + len(key), dtype=np.int32)
        self.n += len(key)
        at = (key >> self.shift).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.numbers[at[free]] = key[free], number[free]
            left = np.setdiff1d(left, free, assume_unique=True)
            at[left] = at[left] + 1 & self.mask


class Encoder:
    """Ids of whole texts, from a tokenizers file; units of texts are encoded once and kept.

    The tokenizer drops blanks and never joins across them, so a text's ids are
    those of its chunks between ASCII blanks, one after another. A chunk with ASCII
    marks behind a Latin letter or a digit is two units, where the tokenizer cuts
    there; any other is one. Case is left out of a unit's name where the tokenizer folds
    it. Units are found by 64-bit hashes and then compared by length and last
    eight bytes, so up to eight bytes in full; one that differs from its hash's
    first unit is encoded by itself, and so is a chunk that holds a special
    token's name. A full store starts anew.
    """

    def __init__(self, path: str, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.bits = bits
        self.tok = Tokenizer.from_file(path)
        one = lambda t: self._encode([t])[0]
        if one("Ab, cd\t\nef") != one("Ab,") + one("cd") + one("ef"):
            raise ValueError(f"{path}: ids go across blanks")
        self.folds = one("QxzJ") == one("qxzj")
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for k, i in vocabulary.items() if k.endswith("</w>")]] = True
        self.parted = bool(self.ends[one("ab")[-1]]) and all(one(a + b) == one(a) + one(b) for a, b in (("ab", ","), ("don", "'"), ("3.1", "_<|"), ("été", "..")))
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.index = Index(self.bits)
        self.flat, self.n = np.zeros(1 << 22, np.uint16 if len(self.ends) <= 65536 else np.uint32), 0
        self.start, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.tail = np.zeros(1 << self.bits, np.uint64)

    def narrow(self, end: int) -> bool:
        """Whether two bytes hold any id."""
        return max(len(self.ends) - 1, end) < 1 << 16

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, tails: np.ndarray, units: list[bytes]) -> None:
        """Plain units are encoded many in one text: each ends with an id that ends a word, and no other does."""
        order, ids, sizes = [], [], []
        plain = np.array([_PLAIN.fullmatch(u) is not None for u in units])
        rest, at = np.flatnonzero(~plain).tolist(), np.flatnonzero(plain)
        for i in range(0, len(at), 2000):
            some = at[i : i + 2000]
            text = b" ".join([units[k] for k in some.tolist()])
            got = np.array(self._encode([text.decode("utf-8", "replace")])[0], np.int64)
            cut = np.flatnonzero(self.ends[got]) + 1
            if len(cut) == len(some):
                order.append(some)
                ids.append(got)
                sizes.append(np.diff(cut, prepend=0))
            else:
                rest += some.tolist()
        if rest:
            got = self._encode([units[k].decode("utf-8", "replace") for k in rest])
            order.append(np.array(rest))
            ids.append(np.array([x for g in got for x in g], np.int64))
            sizes.append(np.array([len(g) for g in got]))
        of = np.concatenate(order)
        self._keep(np.concatenate(ids), np.concatenate(sizes), tails[of])
        self.index.add(keys[of])

    def _keep(self, new: np.ndarray, size: np.ndarray, tails: np.ndarray) -> None:
        """Stores ids of units under the next numbers."""
        while self.index.n + len(size) > len(self.tail):
            self.start, self.size, self.tail = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.tail))
        while self.n + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        k = self.index.n
        self.flat[self.n : self.n + len(new)] = new
        self.tail[k : k + len(size)] = tails
        self.start[k : k + len(size)] = self.n + np.cumsum(size) - size
        self.size[k : k + len(size)] = size
        self.n += len(new)

    def units(self, t: K.Text, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, pointers by document, those with a special token's name) of a slice's units."""
        start, stop, wptr = t.spans(~K.IS_SPACE)
        alone = self.named(raw, start, stop)
        if not self.parted or not len(start):
            return start, stop, wptr, alone
        buf = t.buf
        at = np.flatnonzero(_MARK[buf[stop - 1]])
        other = np.append(-1, np.flatnonzero(~_MARK[buf]))
        middle = np.maximum(other[np.searchsorted(other, stop[at]) - 1] + 1, start[at])  # behind the last byte that is no mark
        last, before = buf[np.maximum(middle - 1, 0)], buf[np.maximum(middle - 2, 0)]
        wide = (before == 0xC3) & (last >= 0x80) & ((last & 0xDF) != 0x97) & (middle - 2 >= start[at])  # but for the signs of multiplication and division
        two = (middle > start[at]) & (_WORD[last] | wide) & ~np.isin(at, alone)
        at, middle = at[two], middle[two]
        count = np.ones(len(start), np.int64)
        count[at] = 2
        place = np.cumsum(count) - count
        a, z = np.repeat(start, count), np.repeat(stop, count)
        z[place[at]] = a[place[at] + 1] = middle
        return a, z, np.append(place, len(a))[wptr], place[alone]

    def named(self, raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Chunks that hold a special token's name."""
        out = [np.zeros(0, np.int64)]
        for name in self.special:
            found, at = [], raw.find(name)
            while at >= 0:
                found.append(at)
                at = raw.find(name, at + 1)
            unit = np.searchsorted(start, found, "right") - 1
            out.append(unit[np.array(found, np.int64) + len(name) <= stop[unit]] if found else out[0])
        return np.unique(np.concatenate(out))

    def ids(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(all ids, counts by document) of stretches of texts, ``end`` behind each document."""
        for _, _, t in K.slices(texts, SLICE):
            raw = t.buf.tobytes()
            start, stop, uptr, alone = self.units(t, raw)
            low = t.lowered() if self.folds else t
            key, tail = low.hashes(start, stop) | np.uint64(1), tails_of(low.buf, start, stop)
            at = self.index.find(key)
            at[alone] = 0
            if len(miss := np.flatnonzero(at < 0)):
                if self.index.n + len(miss) > 1 << self.bits - 1:
                    self._reset()
                    miss = np.setdiff1d(np.arange(len(key)), alone, assume_unique=True)
                new, first = np.unique(key[miss], return_index=True)
                first = miss[first]
                self._learn(new, tail[first], [raw[a:z] for a, z in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
                at[miss] = self.index.find(key[miss])
            alone = np.union1d(alone, np.flatnonzero(self.tail[at] != tail))  # or another unit of the same hash
            if len(alone):
                got = self._encode([raw[start[i] : stop[i]].decode("utf-8", "replace") for i in alone])
                at[alone] = self.index.n + np.arange(len(alone))
                self._keep(np.array([x for g in got for x in g], np.int64), np.array([len(g) for g in got]), tail[alone])
                self.index.n += len(alone)
            size = self.size[at].astype(np.int64)
            total = np.cumsum(size)
            out = self.flat[np.repeat(self.start[at] - total + size, size) + np.arange(total[-1] if len(total) else 0)]
            counts = K.segment_sums(size, uptr)
            yield np.insert(out if self.narrow(end) else out.astype(np.uint32), np.cumsum(counts), end), counts + 1


def tails_of(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Length and last eight bytes of each chunk in a 64-bit number; chunks of one length, up to eight, get different ones."""
    padded = np.concatenate([np.zeros(8, np.uint8), buf])
    ending = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the eight bytes before each place
    size = stop - start
    return (ending[stop] >> (64 - 8 * np.minimum(size, 8)).astype(np.uint64)) + K.mix(size.astype(np.uint64))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def footer(ids: list, counts: np.ndarray, sizes: list[int]) -> bytes:
    null = np.array([i is None for i in ids], bool)
    names = np.array([i or 0 for i in ids], np.int64)
    parts_ = [zlib.compress(a.tobytes()) for a in (names.astype("<i8"), null, counts.astype("<i8"), np.array(sizes, "<i8"))]
    body = struct.pack("<4I", *map(len, parts_)) + b"".join(parts_)
    return body + TAIL.pack(zlib.crc32(body), len(body), FILE)


def read_file(f) -> tuple[list, np.ndarray, Iterator[np.ndarray]]:
    """(document ids, token counts, decoded ids a group of blocks at a time) of a seekable file."""
    end = f.seek(0, 2)
    f.seek(end - TAIL.size)
    crc, n, magic = TAIL.unpack(f.read(TAIL.size))
    f.seek(end - TAIL.size - n)
    body = f.read(n)
    if magic != FILE or zlib.crc32(body) != crc:
        raise CorruptBlock("footer")
    at, arrays = 16, []
    for size, kind in zip(struct.unpack_from("<4I", body), ("<i8", bool, "<i8", "<i8"), strict=True):
        arrays.append(np.frombuffer(zlib.decompress(body[at : at + size]), kind))
        at += size
    names, null, counts, sizes = arrays

    def groups() -> Iterator[np.ndarray]:
        f.seek(len(FILE))
        step = GROUP // BLOCK
        for i in range(0, len(sizes), step):
            yield decode_blocks([f.read(int(s)) for s in sizes[i : i + step]])

    return [None if z else int(i) for i, z in zip(names, null, strict=True)], counts, groups()


#: Sampled rows for each range.
SAMPLED = 50


@dataclass(frozen=True)
class Ranges:
    """Bounds (null id, id, hash) of ranges of the sorted order: sorted arrays, one bound fewer than ranges."""

    nulls: int
    id: np.ndarray
    h: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, int]], n: int) -> Ranges:
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        cut = [rows[len(rows) * k // n] for k in range(1, n)] if rows else []
        nulls = sum(i is None for i, _ in cut)
        return Ranges(nulls, np.array([i for i, _ in cut[nulls:]], np.int64), np.array([h for _, h in cut], np.int64))

    def find(self, null: np.ndarray, id_: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The range of each row. Rows that equal several bounds are the same text of one id: any of these ranges will do."""
        lo = np.where(null, 0, self.nulls + np.searchsorted(self.id, id_, "left"))
        hi = np.where(null, self.nulls, self.nulls + np.searchsorted(self.id, id_, "right"))
        out = lo.copy()
        hot = np.flatnonzero(lo < hi)
        _, first, group = np.unique(lo[hot], return_index=True, return_inverse=True)
        for g, k in enumerate(first):
            rows = hot[group == g]
            bounds = self.h[lo[hot[k]] : hi[hot[k]]]
            a, z = np.searchsorted(bounds, h[rows], "left"), np.searchsorted(bounds, h[rows], "right")
            out[rows] += a + np.arange(len(rows)) % (z - a + 1)
        return out


def encoded(docs: DataFrame, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, id, h, ids) of each row: its range of the order (id, h), a hash of the text, ids as little-endian bytes.

    The ranges' bounds are those of a sample of rows, some for each shuffle partition.
    """
    spark = docs.sparkSession
    n_parts = parts(spark)
    key = F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h")
    src = docs.select(*key, F.col(text).alias("t"))
    share = min(1.0, SAMPLED * n_parts / max(docs.count(), 1))
    sent = spark.sparkContext.broadcast(Ranges.of([tuple(r) for r in docs.sample(share, 1).select(*key).collect()], n_parts))

    def run(b: pa.RecordBatch):
        at, e = 0, encoder(tokenizer)
        kind, width = ("<u2", 2) if e.narrow(end) else ("<u4", 4)
        null, id_ = b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(0).fill_null(0).to_numpy()
        part = sent.value.find(null, id_, b.column(1).to_numpy())
        for ids, n in e.ids(b.column(2), end):
            off = np.concatenate([[0], np.cumsum(n)]) * width
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([pa.array(part[at : at + len(n)], pa.int32()), b.column(0).slice(at, len(n)), b.column(1).slice(at, len(n)), pa.array(np.full(len(n), width), pa.int8()), blob.cast(pa.binary())], ["part", "id", "h", "width", "ids"])
            at += len(n)

    return arrow_map(src, run, "part int, id long, h long, width tinyint, ids binary")


def file_system(to: str) -> tuple[fs.FileSystem, str]:
    """The store and folder of a qualified path."""
    if to.startswith("s3a://"):
        to = "s3" + to[3:]
    return fs.FileSystem.from_uri(to)


def write(docs: DataFrame, to: str, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write files under ``to``, a qualified path; returns (part, path, n_docs, n_ids), a row a file, in a checkpoint."""
    rows = encoded(docs, tokenizer, end, text, doc_id).repartitionById(parts(docs.sparkSession), "part")
    rows = rows.sortWithinPartitions("id", "h", "ids").select("id", "width", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # the memory of a worker that has encoded before
        part = TaskContext.get().partitionId()
        system, folder = file_system(to)
        out, names, counts, sizes = None, [], [], []
        held: list[np.ndarray] = []

        def put(all_: bool) -> None:
            n = sum(map(len, held))
            if not all_ and n < GROUP:
                return
            ids = np.concatenate(held)
            cut = n if all_ else n - n % GROUP
            for b in encode_blocks(ids[:cut]):
                out.write(b)
                sizes.append(len(b))
            held[:] = [ids[cut:]]

        for b in batches:
            if out is None and b.num_rows:
                system.create_dir(folder, recursive=True)
                own = f"{folder}/part-{part:06d}.{uuid.uuid4().hex}.tmp"
                out = system.open_output_stream(own)
                out.write(FILE)
            names += b.column(0).to_pylist()
            if not b.num_rows:
                continue
            width = b.column(1)[0].as_py()
            blob = b.column(2).cast(pa.large_binary())
            off = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1, 8 * blob.offset)
            counts.append(np.diff(off) // width)
            for lo in range(int(off[0]), int(off[-1]), width * GROUP):
                n = min(width * GROUP, int(off[-1]) - lo) // width
                held.append(np.frombuffer(blob.buffers()[2], f"<u{width}", n, lo))
                put(False)
        if out is None:
            return
        put(True)
        total = np.concatenate(counts)
        out.write(footer(names, total, sizes))
        out.close()
        path = f"{folder}/part-{part:06d}.lqtf"
        system.move(own, path)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([len(names)]), pa.array([int(total.sum())])], ["part", "path", "n_docs", "n_ids"])

    return checkpoint(rows.mapInArrow(run, "part long, path string, n_docs long, n_ids long"))


def read(files: DataFrame, to: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, decoded and checked.

    The driver adds up the files' sizes: one number a file.
    """
    spark = files.sparkSession
    sizes = sorted((r["part"], r["n_ids"]) for r in files.select("part", "n_ids").collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n
    sent = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(to)
        for b in batches:
            for part, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as f:
                    names, counts, groups = read_file(f)
                    edge = np.concatenate([[0], np.cumsum(counts)])
                    crc, left = np.zeros(len(counts), np.int64), np.zeros(0, np.uint32)
                    d, base = 0, 0
                    for ids in groups:
                        left = np.concatenate([left, ids])
                        last = int(np.searchsorted(edge, base + len(left), "right")) - 1
                        raw = memoryview(left.astype("<u4").tobytes())
                        for k in range(d, last):
                            crc[k] = zlib.crc32(raw[4 * (edge[k] - base) : 4 * (edge[k + 1] - base)])
                        left = left[edge[last] - base :]
                        d, base = last, int(edge[last])
                    if d != len(counts) or len(left):
                        raise CorruptBlock(f"{path}: {len(left)} ids too many or too few")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sent.value[part] + edge[:-1]), pa.array(counts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Write docs' ids to a new folder of the shared place, and read them back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    to = qualified(docs.sparkSession, fresh_path(docs.sparkSession, "tokens"))
    return read(write(docs, to, tokenizer, end), to)


def op3_token_output(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: path of a tokenizers file; the default is the public word-level one."""
    return encode(docs_of(spark, sf_dir), tokenizer)
