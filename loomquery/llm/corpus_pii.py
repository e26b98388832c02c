"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

The rules give the base spans. The model is trained in numpy on labelled spans
and adds others: it tags each character with a kind's begin or inside tag, and a
conditional random field over the tags decodes a window as a whole.

No kind of span exists without a digit or an ``@``, and the decoder obeys this:
a span without one is not allowed. So windows without such a character have no
span whatever the network says, and only the others are computed; every text is
searched to its end.

Windows overlap by half, so one of them sees a span of up to half a window whole.
A span that a window's edge cuts is looked for again in windows of twice the
length, and so on until one sees it whole; a text's own end cuts nothing. Where
the run of characters round an ``@`` is longer than half a window, windows that
hold all of it are computed from the start. Each window is decoded on its own, and
each span it finds has a score, the margin of its tags over none. The document's spans are reconciled together:
the base spans stay, and of the model's spans that touch none of them the set of
the highest total score without overlaps is taken.

Defined results: null and empty texts have no spans. Repeated rows give repeated
results, null ids stay null. Without labelled spans to learn from, the base spans
are all there is. Positions are code points. Other columns, whatever their names,
play no part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.shared import arrow_map, docs_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. An address' first number is only tried from its first digit (from
#: within, it would end alike), which keeps the time on long runs of digits in proportion.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DIGITS = re.compile(r"[0-9]")
_STOPS = re.compile(r"[\s@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from their ``@`` so that texts without one cost nothing.

    The greedy local part never holds an ``@``, so a match has its own ``@`` after
    the run of local characters that ends there, cut at the match before.
    """
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and _LOCAL.match(text, lo - 1, lo):
            lo -= 1
        m = PATTERNS["email"].match(text, lo) if lo < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return out
    for m in PATTERNS["ip"].finditer(text) if "." in text else ():
        if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in PATTERNS["card"].finditer(text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PATTERNS["phone"].finditer(text) if "+" in text else ():
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


#: Characters by class; those of the patterns one by one, letters and others in groups.
_SINGLE = "@._%+-() #/:=\"'\n,"
ALPHABET = len(_SINGLE) + 6
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
WINDOW, STEP = 64, 32


def codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(cp, 255)]


_CODE = np.full(256, ALPHABET - 1, np.int8)
_CODE[97:123], _CODE[65:91], _CODE[48:58] = 1, 2, 3
_CODE[192:256] = 4
for _i, _c in enumerate(_SINGLE):
    _CODE[ord(_c)] = 5 + _i


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Weights; ``p`` maps names to arrays: embedding E, for both directions Wx, Wh, b, then output O, c and transitions A, start S."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(hidden: int, embed: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.5, (ALPHABET, embed))}
        for d in "fb":
            p |= {f"Wx{d}": r.normal(0, embed**-0.5, (embed, 4 * hidden)), f"Wh{d}": r.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        p |= {"O": r.normal(0, (2 * hidden) ** -0.5, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def _pass(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """LSTM over x [time, batch] (codes); returns h [time, batch, hidden] and what the gradient needs."""
        p = self.p
        table = p["E"] @ p[f"Wx{d}"] + p[f"b{d}"]  # one row a character class
        wh = p[f"Wh{d}"]
        n = wh.shape[0]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, tape = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = table[x[t]] + h @ wh
            s = 1 / (1 + np.exp(-z[:, : 3 * n]))
            g = np.tanh(z[:, 3 * n :])
            new = s[:, n : 2 * n] * c + s[:, :n] * g
            tc = np.tanh(new)
            if keep:
                tape.append((t, h, c, s, g, tc))
            h, c = s[:, 2 * n :] * tc, new
            out[t] = h
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._pass(x, "f", False)[0], self._pass(x, "b", False)[0]], 2)
        return h @ self.p["O"] + self.p["c"]

    def transitions(self) -> np.ndarray:
        """An inside tag follows its own begin or inside tag only."""
        a = self.p["A"].copy()
        for k in range(len(KINDS)):
            i = 2 + 2 * k
            bad = [j for j in range(TAGS) if j not in (i, i - 1)]
            a[bad, i] = -1e4
        return a

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y [time, batch], and gradients by back-propagation through time."""
        p, (steps, n) = self.p, x.shape
        hf, tf = self._pass(x, "f", True)
        hb, tb = self._pass(x, "b", True)
        h = np.concatenate([hf, hb], 2)
        e = (h @ p["O"] + p["c"]).astype(np.float64)
        a = self.transitions().astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = p["S"] + e[0]
        for t in range(1, steps):
            m = alpha[t - 1][:, :, None] + a
            top = m.max(1)
            alpha[t] = e[t] + top + np.log(np.exp(m - top[:, None]).sum(1))
        for t in range(steps - 2, -1, -1):
            m = a + (e[t + 1] + beta[t + 1])[:, None]
            top = m.max(2)
            beta[t] = top + np.log(np.exp(m - top[:, :, None]).sum(2))
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        de = np.exp(alpha + beta - z[None, :, None])
        r = np.arange(n)
        gold = p["S"][y[0]] + e[0][r, y[0]]
        da = np.zeros_like(a)
        for t in range(1, steps):
            gold = gold + a[y[t - 1], y[t]] + e[t][r, y[t]]
            da += np.exp(alpha[t - 1][:, :, None] + a + (e[t] + beta[t] - z[:, None])[:, None]).sum(0)
            np.add.at(da, (y[t - 1], y[t]), -1)
        de[np.arange(steps)[:, None], r, y] -= 1
        grad = {"A": np.where(a > -1e3, da, 0) / n, "S": de[0].sum(0) / n}
        de = (de / n).astype(np.float32)
        grad |= {"O": np.tensordot(h, de, ((0, 1), (0, 1))), "c": de.sum((0, 1)), "E": np.zeros_like(p["E"])}
        dh = de @ p["O"].T
        k = hf.shape[2]
        for d, tape, own in (("f", tf, dh[:, :, :k]), ("b", tb, dh[:, :, k:])):
            wh = p[f"Wh{d}"]
            dwh, dtab = np.zeros_like(wh), np.zeros((ALPHABET, 4 * k), np.float32)
            dh_, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            for t, h0, c0, s, g, tc in reversed(tape):
                dh_ = dh_ + own[t]
                i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
                dc = dc + dh_ * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh_ * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                dwh += h0.T @ dz
                np.add.at(dtab, x[t], dz)
                dh_, dc = dz @ wh.T, dc * f
            grad |= {f"Wh{d}": dwh, f"Wx{d}": p["E"].T @ dtab, f"b{d}": dtab.sum(0)}
            grad["E"] += dtab @ p[f"Wx{d}"].T
        return float((z - gold).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam over windows x, y [windows, WINDOW]."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, t = [], 0
        for _ in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                loss, grad = self.loss_and_gradients(x[rows].T, y[rows].T)
                total += loss * len(rows)
                t += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                clip = min(1.0, 5 / max(norm, 1e-9))
                for k, g in grad.items():
                    g = g * clip
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags [windows, time] of x [windows, time], and each tag's emission over that of none."""
        e = self.emissions(np.ascontiguousarray(x.T))
        a = self.transitions()
        steps, n = x.shape[1], len(x)
        back = np.empty((steps, n, TAGS), np.int8)
        s = self.p["S"] + e[0]
        s[:, 2::2] = -1e4  # no window begins inside
        for t in range(1, steps):
            m = s[:, :, None] + a
            back[t] = m.argmax(1)
            s = np.take_along_axis(m, back[t][:, None].astype(np.int64), 1)[:, 0] + e[t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = s.argmax(1)
        r = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][r, tags[:, t]]
        em = e.transpose(1, 0, 2)
        return tags, np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]


def windows_of(x: np.ndarray) -> np.ndarray:
    """Starts of the windows of coded text x that hold a digit or an ``@``."""
    starts = np.arange(0, max(len(x) - STEP, 1), STEP)
    has = np.concatenate([[0], np.cumsum((x == 3) | (x == 5))])
    return starts[has[np.minimum(starts + WINDOW, len(x))] > has[starts]]


def padded(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    full = np.concatenate([x, np.zeros(WINDOW, x.dtype)])
    return full[starts[:, None] + np.arange(WINDOW)]


def spans_of_tags(tags: np.ndarray, gain: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of one window's tags."""
    out, at = [], None
    for i, tag in enumerate([*tags.tolist(), 0]):
        if at is not None and tag != 2 * at[0] + 2:
            out.append((at[0], at[1], i, float(gain[at[1] : i].sum())))
            at = None
        if tag % 2:
            at = (tag // 2, i)
    return out


def plausible(kind: int, text: str) -> bool:
    """Shapes a span of the model must have: any kind needs its digits or its ``@``."""
    d = sum(c.isascii() and c.isdigit() for c in text)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\.[^\s@]*[A-Za-z]", text))
    return d >= 4 and not re.search(r"[A-Za-z]", text) and (kind != 1 or 4 <= d <= 12) and (kind != 2 or 16 <= d <= 19 and luhn("".join(c for c in text if c.isdigit()))) and (kind != 3 or 8 <= d <= 15)


def may_grow(kind: int, text: str) -> bool:
    """Whether a part of a span can belong to a plausible one."""
    if kind == 0:
        return text.count("@") < 2
    return len(_DIGITS.findall(text)) <= 19 and not re.search(r"[A-Za-z]", text)


def around_at(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The longest plausible place of an address round each ``@`` that no base span holds."""
    stops = [m.start() for m in _STOPS.finditer(text)]
    taken = Taken(base)
    stops = [-1, *stops, len(text)]
    for n in range(1, len(stops) - 1):
        i = stops[n]
        if text[i] != "@" or taken.touch(i, i + 1):
            continue
        lo, hi = n - 1, n + 1  # a blank next to the @ is part of it
        lo -= lo > 0 and stops[lo] == i - 1 and text[i - 1] != "@"
        hi += hi < len(stops) - 1 and stops[hi] == i + 1 and text[i + 1] != "@"
        yield stops[lo] + 1, stops[hi]


class Taken:
    """Places of spans that may overlap each other."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        own = sorted((a, b) for _, a, b in spans)
        self.starts, self.ends, most = [a for a, _ in own], [], 0
        for _, b in own:
            most = max(most, b)
            self.ends.append(most)

    def touch(self, a: int, b: int) -> bool:
        """Whether [a, b) has a position of any span."""
        n = bisect_left(self.starts, b)
        return n > 0 and self.ends[n - 1] > a


def search(model: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, int, float]]]:
    """The model's plausible spans (kind, start, end, score) of each text, whole at any length.

    Level k has windows of WINDOW << k characters at each half of that. Of the
    levels above 0 only the windows are computed that may hold a span which is too
    long for the level below, and only such spans are taken from them.
    """
    found: list[list] = [[] for _ in texts]
    taken = [Taken(b) for b in base]
    wider: dict[int, set[tuple[int, int]]] = defaultdict(set)
    held: list[np.ndarray] = []
    owner: list[tuple[int, int]] = []

    def widen(level: int, d: int, at: int) -> None:
        half = STEP << level
        wider[level] |= {(d, at // half * half), (d, max(at // half * half - half, 0))}

    def flush(level: int) -> None:
        if not held:
            return
        width = WINDOW << level
        tags, gain = model.decode(np.concatenate(held).astype(np.int64))
        for w in np.flatnonzero((tags % 2).any(1)):
            d, at = owner[w]
            t = texts[d]
            for k, lo, hi, s in spans_of_tags(tags[w], gain[w]):
                a, z = at + lo, min(at + hi, len(t))
                if lo == 0 and at > 0 or hi == width and at + width < len(t):
                    if may_grow(k, t[a:z]) and not taken[d].touch(a, z):
                        widen(level + 1, d, a)
                elif (level == 0 or z - a >= width // 4) and plausible(k, t[a:z]):
                    found[d].append((k, a, z, s))
        held.clear()
        owner.clear()

    for d, t in enumerate(texts):
        if "@" in t or _DIGITS.search(t):
            x = codes(t)
            starts = windows_of(x)
            for i in range(0, len(starts), 2048):
                some = starts[i : i + 2048]
                held.append(padded(x, some))
                owner.extend((d, int(s)) for s in some)
                if len(owner) >= 2048:
                    flush(0)
            for a, z in around_at(t, base[d]) if "@" in t else ():
                if z - a >= STEP:
                    widen(((z - a) // STEP).bit_length(), d, a)
    flush(0)
    while wider:
        level = min(wider)
        for d, at in sorted(wider.pop(level)):
            x = codes(texts[d][at : at + (WINDOW << level)])
            held.append(np.pad(x, (0, (WINDOW << level) - len(x)))[None])
            owner.append((d, at))
            if len(owner) << level >= 2048:
                flush(level)
        flush(level)
    return found


def reconcile(base: list[tuple[str, int, int]], found: list[tuple[int, int, int, float]]) -> list[tuple[str, int, int]]:
    """Base spans and the best set of found ones without overlaps, by kind, then start."""
    best: dict[tuple[int, int, int], float] = {}
    taken = Taken(base)
    for k, a, b, s in found:
        if s > 0 and not taken.touch(a, b):
            best[k, a, b] = max(s, best.get((k, a, b), s))
    items = sorted(((a, b, k, s) for (k, a, b), s in best.items()), key=lambda i: (i[1], i[0], i[2]))
    ends, total, take = [i[1] for i in items], [0.0], []
    for n, (a, _, _, s) in enumerate(items):
        prior = bisect_right(ends, a, 0, n)
        take.append((total[prior] + s > total[n], prior))
        total.append(max(total[n], total[prior] + s))
    chosen, n = [], len(items)
    while n:
        yes, prior = take[n - 1]
        if yes:
            chosen.append((KINDS[items[n - 1][2]], items[n - 1][0], items[n - 1][1]))
        n = prior if yes else n - 1
    return sorted([*base, *chosen], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def labelled_windows(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a digit or ``@`` and their tags."""
    x = codes(text)
    y = np.zeros(len(x) + WINDOW, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    starts = windows_of(x)
    own = y[starts[:, None] + np.arange(WINDOW)]
    first = own[:, 0]  # a span cut by the window's edge isn't labelled
    for i in np.flatnonzero((first > 0) & (first % 2 == 0)):
        j = 0
        while j < WINDOW and own[i, j] == first[i]:
            own[i, j] = 0
            j += 1
    return padded(x, starts).astype(np.int8), own


def rewritten(text: str, spans: list[tuple[str, int, int]], seed: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its phone numbers, cards and addresses in other common notations, and their new places."""
    r = np.random.default_rng(seed)
    out, new, at = [], [], 0
    n = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        old, v = text[a:b], text[a:b]
        if kind == "phone":
            v = re.sub(r"^\+[0-9]{1,3}\s?", ["", "00", "+", "1-"][r.integers(4)], old)
            v = re.sub(r"[ -]", [" ", "-", ".", "/"][r.integers(4)], v)
            v = v if r.integers(2) else re.sub(r"[()]", "", v)
        elif kind == "card":
            d = re.sub(r"[^0-9]", "", old)
            v = [".", "  ", "/", "-"][r.integers(4)].join(d[i : i + 4] for i in range(0, len(d), 4))
        elif kind == "email" and r.integers(2):
            v = old.replace("@", [" @ ", "@ ", " @"][r.integers(3)])
        out += [text[at:a], v]
        n += a - at
        new.append((kind, n, n + len(v)))
        n += len(v)
        at = b
    return "".join([*out, text[at:]]), new


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", windows: int = 3000, epochs: int = 8, hidden: int = 12, embed: int = 8, seed: int = 11) -> Tagger:
    """A tagger from at most ``windows`` labelled windows of about as many texts (documented bounds).

    Labelled spans are the base spans of the documents that have a digit or an
    ``@``, a share of them by a hash of the text, once as they are and once
    rewritten in other notations; what else such windows hold is labelled none.
    """
    having = docs.filter(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    n = having.agg(F.approx_count_distinct("h")).first()[0]
    cut = min(1 << 20, math.ceil(windows / max(n, 1) * (1 << 20)))  # of the hashes, so copies are one text
    some = having.filter(F.pmod("h", F.lit(1 << 20)) < cut).dropDuplicates(["h"])

    def run(b: pa.RecordBatch):
        for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            spans = base_spans(t)
            both = [labelled_windows(t, spans)] + ([labelled_windows(*rewritten(t, spans, len(t)))] if spans else [])
            x, y = (np.concatenate([w[k][:40] for w in both]) for k in (0, 1))  # 40 windows a text
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["h", "x", "y"])

    got = sorted(arrow_map(some, run, "h long, x binary, y binary").collect(), key=lambda r: r["h"])
    x, y = (np.frombuffer(b"".join(bytes(r[k]) for r in got), np.int8).reshape(-1, WINDOW)[: 4 * windows].astype(np.int64) for k in ("x", "y"))
    tagger = Tagger.new(hidden, embed, seed)
    if not len(x) or not y.any():
        tagger.p["c"][0] = 50  # nothing to learn: no tag ever wins
        return tagger
    hit = y.any(1)
    keep = np.r_[np.flatnonzero(hit)[: windows * 2 // 3], np.flatnonzero(~hit)[: windows // 3]]
    tagger.train(x[keep], y[keep], epochs)
    return tagger


def find(docs: DataFrame, tagger: Tagger, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end). The broadcast weights have a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(b: pa.RecordBatch):
        texts = [t or "" for t in b.column(1).to_pylist()]
        base = [base_spans(t) for t in texts]
        found = search(sent.value, texts, base)
        all_ = [reconcile(p, f) if f else p for p, f in zip(base, found, strict=True)]
        lists = [pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in s] for s in x], pa.list_(item)) for x in (base, all_)]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "base", "spans"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return arrow_map(src, run, f"doc_id {kind}, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")


def op7_corpus_pii(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    out = find(docs, fit(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select(
        "doc_id", *(F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        F.size(F.array_except("spans", "base")).cast("long").alias("n_added"),
    )
