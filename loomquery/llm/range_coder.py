"""Adaptive context-mixing range coder for token ids, in numpy.

A block is coded on its own: its models start anew and two checksums guard it.
It holds the block's alphabet and equal stretches of ids (1,024 in a full block)
that are coded side by side, so all stretches of many blocks advance in one
vector step. The id after two others is predicted thrice: by the last id after
the same two (order 2, hashed), by the last id after the same one (order 1), and
by all ids' counts so far (order 0). The mixture of the three fills the coder's
range: order 2's and order 1's candidates get shares by how often candidates of
their kind were right in this block, and the counts share the rest. A kind is a
candidate's confidence and, for order 2, how many predictions in a row were right
in this stretch, so text that was seen before costs little after its first ids.
Counts and shares are renewed every ``RENEW`` steps, and after 1, 2, 4, ... steps
before that; candidates every step. Both sides derive all of it from ids already
coded; all arithmetic is in integers.

The coder keeps a 64-bit low and range for each stripe, writes 32-bit words, and
passes carries on to words already written.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"LQR2"
BLOCK = 1 << 20
STEPS = 1024
RENEW = 256
TOTAL_BITS = 24
TOTAL = 1 << TOTAL_BITS
RUN = 7
HASH_BITS = 18
HEAD = struct.Struct("<4sIIIIIII")
U = np.uint64


class CorruptBlock(ValueError):
    """A checksum or a length does not fit."""


#: By confidence, missed then hit: the change of confidence, or -9 for a new candidate.
_MOVE = np.array([-9, -9, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0])


class _Model:
    """State of n blocks whose alphabets have sizes ``alphabet``; lanes are blocks x stripes."""

    def __init__(self, alphabet: np.ndarray, bits: int, stripes: int):
        n = len(alphabet)
        self.bits, self.alphabet = bits, alphabet
        self.block = np.repeat(np.arange(n), stripes)
        self.base = np.concatenate([[0], np.cumsum(alphabet)])
        self.of = np.repeat(np.arange(n), alphabet)
        self.count = np.zeros(self.base[-1], np.int64)
        self.at1 = self.base[:-1][self.block]
        self.hash = max(6, min(HASH_BITS, int(stripes).bit_length() + 8))
        self.at2 = self.block << self.hash
        self.one = np.zeros(self.base[-1], np.int64)  # candidate << 3 | confidence
        self.two = np.zeros(n << self.hash, np.int64)
        self.kinds = (8, 8 * (RUN + 1))
        self.hits = [np.zeros((2, n * k), np.int64) for k in self.kinds]  # (tries, hits), block and kind
        self.lane = [self.block * k for k in self.kinds]
        prior = np.array([1, 4, 8, 12, 14, 15, 15, 15])
        self.prior = [np.tile(prior, n), np.tile(np.minimum(prior + 2 * np.arange(RUN + 1)[:, None], 15).ravel(), n)]
        self.run = self.lane[1].copy()  # order 2's hits in a row, in eighths of its kinds, from the block's first kind
        self.prev = np.zeros(n * stripes, np.int64)
        self.before = np.zeros(n * stripes, np.int64)  # of the id before that, its part of the hash
        self.log: list[tuple] = []
        self.steps = 0
        self.renew()

    def renew(self) -> None:
        """Shares and counts from all that was coded."""
        if self.log:
            place, k1, k2 = (np.concatenate(x) for x in zip(*self.log, strict=True))
            self.count += np.bincount(place, minlength=len(self.count))
            for hits, k in ((self.hits[0], k1), (self.hits[1], k2)):
                both = np.bincount(k, minlength=2 * hits.shape[1]).reshape(-1, 2)
                hits += [both.sum(1), both[:, 1]]
            self.log = []
        # 1/1024ths of what is left
        share = [np.clip((hits[1] * 1024 + prior * 64) // (hits[0] + 16), 1, _most(self.bits)) for hits, prior in zip(self.hits, self.prior, strict=True)]
        self.share1, self.full2 = share[0], share[1] << TOTAL_BITS - 10
        scale = 1 << self.bits
        total = np.bincount(self.of, self.count, len(self.alphabet)).astype(np.int64)
        spare = scale - self.alphabet
        q = 1 + self.count * spare[self.of] // np.maximum(total, 1)[self.of]
        lack = scale - np.add.reduceat(q, self.base[:-1])  # rounding, or no counts yet
        size = self.alphabet[self.of]
        place = np.arange(len(q)) - self.base[:-1][self.of]
        q += lack[self.of] // size + (place < (lack % self.alphabet)[self.of])
        self.cum = np.cumsum(q) - q - (self.of << self.bits)
        self.freq = q

    def look(self) -> None:
        self.i1 = self.at1 + self.prev
        self.i2 = (self.prev * 40503 + self.before & (1 << self.hash) - 1) + self.at2
        self.e1, self.e2 = self.one.take(self.i1, mode="clip"), self.two.take(self.i2, mode="clip")
        self.c1, self.c2 = self.e1 >> 3, self.e2 >> 3
        self.s1, self.s2 = self.e1 & 7, self.e2 & 7
        self.k1, self.k2 = self.s1 + self.lane[0], self.s2 + self.run
        self.f2 = self.full2.take(self.k2, mode="clip")
        self.f1 = (TOTAL - self.f2) * self.share1.take(self.k1, mode="clip") >> 10
        self.f12 = self.f1 + self.f2
        self.rest = TOTAL - self.f12

    def learn(self, sym: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """h1, h2: where the candidates of order 1 and 2 were right."""
        new = sym << 3
        for table, at, entry, state, hit in ((self.one, self.i1, self.e1, self.s1, h1), (self.two, self.i2, self.e2, self.s2, h2)):
            move = _MOVE.take(state + 8 * hit, mode="clip")  # confidence rises by one or halves; a doubtful candidate makes way
            entry += move
            np.copyto(entry, new, where=move < -8)
            table[at] = entry
        self.log.append((self.at1 + sym, 2 * self.k1 + h1, 2 * self.k2 + h2))
        self.run = np.minimum(self.run - self.lane[1] + 8, 8 * RUN) * h2 + self.lane[1]
        self.before = self.prev * 30011
        self.prev = sym
        self.steps += 1
        if len(self.log) == RENEW or self.steps & self.steps - 1 == 0:
            self.renew()


def _bits(alphabet: int) -> int:
    """The counts' share of the range is dealt in 2**bits parts; a block's alphabet has fewer than 2**20 ids."""
    return 14 if alphabet <= 4096 else 16 if alphabet <= 1 << 14 else 18 if alphabet <= 1 << 16 else 21


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids, and each id's number among them."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    here = np.zeros(int(ids.max()) + 1, bool)
    here[ids] = True
    alphabet = np.flatnonzero(here)
    return alphabet, (np.cumsum(here, dtype=np.int32) - 1)[ids]


def _most(bits: int) -> int:
    """Of 1024 parts of the range, the most that a candidate gets: two such leave 2**bits of TOTAL."""
    return 1024 - math.ceil(1024 * 2 ** ((bits - TOTAL_BITS) / 2))


def _stripes(n: int) -> int:
    """A power of two, so that a stretch has about ``STEPS`` ids, or fewer where there are few."""
    return 1 << max(0, round(np.log2(max(n, 1) / STEPS)))


def _encode_lanes(columns: np.ndarray, alphabet: np.ndarray, bits: int, stripes: int) -> tuple[np.ndarray, np.ndarray]:
    """columns of symbols [steps, lanes] -> (words [lanes, most], counts)."""
    steps, lanes = columns.shape
    m = _Model(alphabet, bits, stripes)
    low, rng = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    out = np.zeros((steps * TOTAL_BITS // 32 + 4, lanes), U)
    n = np.zeros(lanes, np.int64)
    for t in range(steps):
        m.look()
        sym = columns[t].astype(np.int64)
        i = m.at1 + sym
        cum = m.cum.take(i, mode="clip")
        start = cum * m.rest >> bits
        size = ((cum + m.freq.take(i, mode="clip")) * m.rest >> bits) - start
        start += m.f12
        h1, h2 = m.c1 == sym, m.c2 == sym
        np.copyto(start, m.f2, where=h1)
        np.copyto(size, m.f1, where=h1)
        np.copyto(start, 0, where=h2)
        np.copyto(size, m.f2, where=h2)
        step = rng >> U(TOTAL_BITS)
        new = low + step * start.view(U)
        carry = np.flatnonzero(new < low)
        if len(carry):
            out[n[carry] - 1, carry] += U(1)
        low, rng = new, step * size.view(U)
        w = np.flatnonzero(rng < U(1 << 32))
        if len(w):
            out[n[w], w] = low[w] >> U(32)
            n[w] += 1
            low[w] <<= U(32)
            rng[w] <<= U(32)
        m.learn(sym, h1, h2)
    for shift in (32, 0):
        out[n, np.arange(lanes)] = low >> U(shift) & U(0xFFFFFFFF)
        n += 1
    out = out[: n.max(initial=1)]
    for j in range(len(out) - 1, 0, -1):
        out[j - 1] += out[j] >> U(32)
    return np.ascontiguousarray((out & U(0xFFFFFFFF)).astype(np.uint32).T), n


def _decode_lanes(words: np.ndarray, first: np.ndarray, alphabet: np.ndarray, bits: int, steps: int, stripes: int) -> np.ndarray:
    """The inverse; lane i's words begin at words[first[i]]."""
    lanes = len(first)
    m = _Model(alphabet, bits, stripes)
    words = np.concatenate([words, np.zeros(4, np.uint32)]).astype(U)
    at = first.copy()
    code = words[at] << U(32) | words[at + 1]
    at += 2
    rng = np.full(lanes, (1 << 64) - 1, U)
    out = np.empty((steps, lanes), np.int32)
    table = None
    lane_table = m.block << bits
    for t in range(steps):
        m.look()
        if table is None or not m.log:
            table = np.repeat(np.arange(len(m.freq)) - m.base[:-1][m.of], m.freq).astype(np.int32)
        step = rng >> U(TOTAL_BITS)
        v = np.minimum(code // step, U(TOTAL - 1)).view(np.int64)
        r = v - m.f12
        u = (((np.maximum(r, 0) + 1 << bits) - 1).view(U) // m.rest.view(U)).view(np.int64)
        sym = table.take(lane_table + u, mode="clip").astype(np.int64)
        i = m.at1 + sym
        cum = m.cum.take(i, mode="clip")
        start = cum * m.rest >> bits
        size = ((cum + m.freq.take(i, mode="clip")) * m.rest >> bits) - start
        start += m.f12
        near = np.flatnonzero(r < 0)
        if len(near):
            two = v[near] < m.f2[near]
            sym[near] = np.where(two, m.c2[near], m.c1[near])
            start[near] = np.where(two, 0, m.f2[near])
            size[near] = np.where(two, m.f2[near], m.f1[near])
        code = code - step * start.view(U)
        rng = step * size.view(U)
        w = np.flatnonzero(rng < U(1 << 32))
        if len(w):
            code[w] = code[w] << U(32) | words[np.minimum(at[w], len(words) - 1)]
            at[w] += 1
            rng[w] <<= U(32)
        out[t] = sym
        m.learn(sym, m.c1 == sym, m.c2 == sym)
    return out.T


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK ids (the last has fewer), coded side by side where their shapes agree."""
    todo: dict[tuple[int, int, int], list] = {}
    pieces = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    for k, x in enumerate(pieces):
        alphabet, sym = _alphabet(x)
        stripes = _stripes(len(x))
        steps = -(-len(x) // stripes)
        sym = np.pad(sym.astype(np.int32), (0, steps * stripes - len(x))).reshape(stripes, steps)
        todo.setdefault((steps, _bits(len(alphabet)), stripes), []).append((k, alphabet, sym))
    out: list[bytes] = [b""] * len(pieces)
    for (_, bits, stripes), group in todo.items():
        columns = np.concatenate([g[2].T for g in group], 1)
        words, n = _encode_lanes(columns, np.array([len(g[1]) for g in group]), bits, stripes)
        for j, (k, alphabet, _) in enumerate(group):
            lane = slice(j * stripes, (j + 1) * stripes)
            names = zlib.compress(np.diff(alphabet.astype(np.int64), prepend=0).astype("<u4").tobytes())
            flat = b"".join(w[:c].astype("<u4").tobytes() for w, c in zip(words[lane], n[lane], strict=True))
            body = n[lane].astype("<u4").tobytes() + names + flat
            raw = pieces[k].astype("<u4").tobytes()
            out[k] = HEAD.pack(MAGIC, len(pieces[k]), len(alphabet), stripes, len(names), len(body), zlib.crc32(raw), zlib.crc32(body)) + body
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """Ids of all blocks, one after another; raises CorruptBlock where a checksum fails."""
    todo: dict[tuple[int, int, int], list] = {}
    for k, b in enumerate(blocks):
        magic, n, size, stripes, names, body, crc_ids, crc_body = HEAD.unpack_from(b)
        data = b[HEAD.size : HEAD.size + body]
        if magic != MAGIC or len(data) != body or zlib.crc32(data) != crc_body or not stripes:
            raise CorruptBlock(f"block {k}: damaged")
        counts = np.frombuffer(data, "<u4", stripes).astype(np.int64)
        alphabet = np.cumsum(np.frombuffer(zlib.decompress(data[4 * stripes : 4 * stripes + names]), "<u4").astype(np.int64))
        words = np.frombuffer(data, "<u4", offset=4 * stripes + names)
        if len(alphabet) != size or counts.sum() != len(words):
            raise CorruptBlock(f"block {k}: lengths")
        todo.setdefault((-(-n // stripes), _bits(size), stripes), []).append((k, n, alphabet, counts, words, crc_ids))
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for (steps, bits, stripes), group in todo.items():
        first = np.cumsum(np.concatenate([[0], *(g[3] for g in group)]))[:-1]
        sym = _decode_lanes(np.concatenate([g[4] for g in group]), first, np.array([len(g[2]) for g in group]), bits, steps, stripes)
        for j, (k, n, alphabet, _, _, crc) in enumerate(group):
            own = alphabet[sym[j * stripes : (j + 1) * stripes].ravel()[:n]].astype("<u4")
            if zlib.crc32(own.tobytes()) != crc:
                raise CorruptBlock(f"block {k}: ids")
            out[k] = own
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
