"""The registered opN_ queries, held against brute force on a small odd table: every column that the contract names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomquery.llm import decontamination, queries
from test_corpus import brute_classes, brute_spans
from test_models import brute_profile, raw_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LANGS = {"en": "the and of to in that it was for on with as at by this".split(), "fr": "le la et les des que dans une pour qui est sur avec pas".split(), "de": "der die und das ist nicht ein mit auf für sich dem wir".split()}


def crc(i):
    return zlib.crc32(str(i).encode()) if i is not None else 0


def make():
    rng = random.Random(99)
    rows = []
    for i in range(240):
        lang = rng.choice(list(LANGS))
        words = [rng.choice(LANGS[lang]) + rng.choice(["", "", "er", "é", "ing"]) for _ in range(rng.choice([4, 30, 80, 150]))]
        if i % 7 == 0:
            words += [f"mail x{i}@host{i}.example.org", f"+1 (555) 555-{1000 + i}", "4111 1111 1111 1111", f"10.0.{i % 300}.7"]
        if i % 11 == 0:
            words += ["#", "$$", "<b>"]
        text = " ".join(words).replace(" the ", "\n", 3)
        rows.append((i, text, lang, f"src{i % 5}"))
    rows += [(300 + i, rows[i][1], "en", "src0") for i in range(20)]  # copies
    rows += [(330 + i, rows[i * 3][1] + " changed", "en", "src1") for i in range(20)]
    rows += [(400, None, "en", "src1"), (401, "", None, None), (402, " \n\t ", "fr", None), (403, "1234 !!", None, "src2"), (None, "no id at all " * 5, "en", "src0"), (None, None, None, None)]
    rows += [(404, "word " * 30_000, "en", "src3"), (405, "x" * 120_000, None, "src3"), (406, "q r s t u v\x0bw\x1cx 字 　", "de", "src4"), (5, "another text of id five", "en", "src0"), (407, "same row"), (407, "same row")][:-2]
    rows += [(407, "same row", "en", "src0")] * 2
    return rows


ROWS = make()
ITEMS = [(1, " ".join(ROWS[3][1].split()[:12])), (2, "these words stand nowhere at all in any text"), (3, None), (4, "too short"), (None, " ".join(ROWS[9][1].split()[2:9]))]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    # columns whose names clash with those that operators make on the way
    docs.selectExpr("*", "CAST(length(text) AS long) AS n_chars", "1 AS _row", "2 AS id", "3 AS t", "4 AS h", "5 AS n", "6 AS dom", "7 AS quality", "8 AS _text", "9 AS kept", "10 AS score").repartition(3).write.parquet(str(d / "documents.parquet"))
    labels = [(i, i % 2, int(i % 9 == 0)) for i in range(200)] + [(400, 1, None), (None, 1, 1), (3, 0, 0), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS text").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def rows_of(spark, sf_dir, n):
    name = next(k for k in queries.QUERIES if k.startswith(f"op{n}_"))
    return queries.QUERIES[name](spark, sf_dir).collect()


def same(got, expect):
    assert Counter(map(repr, got)) == Counter(map(repr, expect))


def lowered(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]


def test_op1(spark, sf_dir):
    c = Counter()
    for i, t, *_ in ROWS:
        if crc(i) % 10:
            c.update([*lowered(t), None])
    n, v = sum(c.values()), len(c)
    expect = []
    for i, t, *_ in ROWS:
        w = [*lowered(t), None]
        expect.append((i, crc(i) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)))
    got = rows_of(spark, sf_dir, 1)
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], expect)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_op2(spark, sf_dir):
    texts = {}
    for i, t, lang, _ in ROWS:
        if crc(i) % 4 != 2 and t is not None and lang is not None:
            texts.setdefault(lang, []).append(t)
    profiles = {k: brute_profile(v) for k, v in texts.items()}
    expect = []
    for i, t, *_ in ROWS:
        own = brute_profile([t or ""])
        dist = {k: sum(abs(p.index(g) - j) if g in p else 400 for j, g in enumerate(own)) for k, p in profiles.items()}
        expect.append((i, crc(i) % 4 == 2, min(sorted(dist), key=dist.get) if own else "und", round(1 - min(dist.values()) / (400 * len(own)), 6) if own else 0.0))
    same([(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in rows_of(spark, sf_dir, 2)], expect)


def test_op3(spark, sf_dir):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(rows_of(spark, sf_dir, 3), key=lambda r: r.start)
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t, *_ in ROWS]
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], [(i, len(x), zlib.crc32(x.tobytes())) for (i, *_), x in zip(ROWS, ids, strict=True)])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_op4(spark, sf_dir):
    expect = []
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        expect.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    got = rows_of(spark, sf_dir, 4)
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], expect)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_op5(spark, sf_dir):
    expect = []
    for d, t, *_ in ROWS:
        have = decontamination.five_words(t)
        for i, q in ITEMS:
            want = decontamination.five_words(q)
            if want and len(want & have) >= 0.8 * len(want):
                expect.append((i, d, len(want & have), len(want)))
    assert len(expect) > 2
    same([(r.item_id, r.doc_id, r.n_shared, r.n_item) for r in rows_of(spark, sf_dir, 5)], expect)


def test_op7(spark, sf_dir):
    got = rows_of(spark, sf_dir, 7)
    expect = []
    for i, t, *_ in ROWS:
        base = raw_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        expect.append((i, *(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest()))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], expect)
    texts = {i: t for i, t, *_ in ROWS if i not in (None, 5, 407)}
    for r in got:
        if r.doc_id in texts:
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
            base = raw_spans(texts[r.doc_id] or "")
            assert set(base) <= set(spans) and len(spans) - len(base) == r.n_added
            kinds = ["email", "ip", "card", "phone"]
            assert spans == sorted(spans, key=lambda s: (kinds.index(s[0]), s[1], s[2]))


def test_op8(spark, sf_dir):
    got = rows_of(spark, sf_dir, 8)
    same([r.doc_id for r in got], [i for i, *_ in ROWS])
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 and r.selected == (r.tail_probability >= 0.5) for r in got)


def test_op9(spark, sf_dir):
    same([(r.doc_id, r.class_id, r.n_links) for r in rows_of(spark, sf_dir, 9)], brute_classes([r[:2] for r in ROWS]))


def test_op10(spark, sf_dir):
    raw = [(t or "").encode() for _, t, *_ in ROWS]
    expect = []
    for (i, *_), r, spans in zip(ROWS, raw, brute_spans(raw), strict=True):
        keep = b"".join(r[a:b] for a, b in zip([0, *(z for _, z in spans)], [*(a for a, _ in spans), len(r)], strict=True))
        expect.append((i, len(r), sum(b - a for a, b in spans), len(spans), hashlib.sha256(keep).hexdigest()))
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, sf_dir, 10)], expect)


def test_every_query_takes_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        df = query(spark, str(tmp_path))
        assert df.count() == 0 and df.columns, name
