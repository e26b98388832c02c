"""Language identification by rank-order n-gram profiles.

Every language has a profile: its most frequent letter 1- to 3-grams in rank
order, counted over all training text. A document is compared by the
out-of-place distance between its own ranks and each profile's ranks.

Defined results: null text, empty text and text without a letter give ``und``
and score 0; so does everything when no language was learned. Equal distances
go to the alphabetically first language. Rows repeat as they are; other columns
are kept unless they clash with the added names, which win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.shared import arrow_map, crc_mod, docs_of, extended

UNKNOWN = "und"
#: Texts whose n-grams are held at once.
SOME = 200
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_codes(texts: list[str | None], max_n: int) -> Iterator[np.ndarray]:
    """Codes of each document's 1..max_n-grams of lower-case letters in space-padded words (max_n <= 3)."""
    letter = _is_letter()
    for t in texts:
        cp = np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        is_l = letter[cp]
        if not is_l.any():
            yield np.zeros(0, np.int64)
            continue
        keep = is_l.copy()
        keep[1:] |= is_l[:-1]  # the first non-letter after a letter stands for a word's end
        keep[:-1] |= is_l[1:]
        c = np.where(is_l, cp, 32)[keep].astype(np.int64)
        sp = c == 32
        one = np.ones(len(c), bool)  # two pads in a row separate words: drop one of them
        one[1:] = ~(sp[1:] & sp[:-1])
        c, sp = c[one], sp[one]
        out = [c[~sp]]
        if max_n > 1:
            out.append(c[:-1] << 21 | c[1:])
        if max_n > 2:
            out.append((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[~sp[1:-1]])
        yield np.concatenate(out)


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, by falling count, then code."""
    codes.sort()
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(codes)))
    if len(at) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        at, counts = at[some], counts[some]
    return codes[at[np.argsort(-counts, kind="stable")[:top]]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of all profile n-grams: codes are sorted, ranks[code, language] is ``top`` where absent."""

    langs: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    max_n: int
    top: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, score
        base = np.arange(self.top)[:, None]
        for i, codes in enumerate(gram_codes(texts, self.max_n)):
            if not len(codes):
                continue
            own = ranked(codes, self.top)
            at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
            r = np.where((self.codes[at] == own)[:, None], self.ranks[at], self.top)
            out = np.where(r == self.top, self.top, np.abs(r - base[: len(own)])).sum(0)
            best = int(out.argmin())
            langs[i], score[i] = self.langs[best], 1 - out[best] / (self.top * len(own))
        return langs, score


def fit(df: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 3, top: int = 400) -> Profiles:
    """Profiles of all non-null languages of ``df``, counted over all its texts.

    What reaches the driver is ``top`` rows a language.
    """

    def count(b: pa.RecordBatch):
        """Counts by language; codes are kept for a few hundred texts at a time."""
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in range(0, b.num_rows, SOME):
            held: dict[str, list[np.ndarray]] = {}
            for name, codes in zip(b.column(1).slice(i, SOME).to_pylist(), gram_codes(b.column(0).slice(i, SOME).to_pylist(), max_n), strict=True):
                held.setdefault(name, []).append(codes)
            for name, codes in held.items():
                found.setdefault(name, []).append(np.unique(np.concatenate(codes), return_counts=True))
        for name, pairs in found.items():
            u, inv = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([p[1] for p in pairs]), len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u)), pa.array(u), pa.array(n)], ["lang", "code", "n"])

    counts = arrow_map(
        df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")), count, "lang string, code long, n long"
    ).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("rank") <= top)
    rows = best.select("lang", "code", "rank").toPandas()
    langs = tuple(sorted(rows["lang"].unique()))
    codes = np.unique(rows["code"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(langs)), top, np.int32)
    ranks[np.searchsorted(codes, rows["code"]), np.searchsorted(langs, rows["lang"])] = rows["rank"] - 1
    return Profiles(langs, codes, ranks, max_n, top)


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """df with lang_pred and score. The broadcast model holds ``top`` n-grams a language."""
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    model = spark.sparkContext.broadcast(profiles)
    at = keep.index(text)
    names = [*keep, "lang_pred", "score"]

    def run(b: pa.RecordBatch):
        for i in range(0, b.num_rows, SOME):
            part = b.slice(i, SOME)
            lang, score = model.value.predict(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], names)

    src = df.select(*[F.col(f"`{c}`") for c in keep])
    return arrow_map(src, run, extended(src, ("lang_pred", "string"), ("score", "double")))


def identify(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", max_n: int = 3, top: int = 400) -> DataFrame:
    """Learn from the rows where ``train`` holds, then predict all rows."""
    return predict(df, fit(df.filter(train), text, lang, max_n, top), text)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    held = crc_mod("doc_id", 4) == 2
    profiles = fit(docs.filter(~held))
    out = predict(docs.select("doc_id", "text", held.alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
