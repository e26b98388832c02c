import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import corpus_pii, language_id, lattice_lm, quality_classifier, quality_rules
from loomquery.llm import textkernel as K

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "1234 !!"), (5, "x"), (6, "word " * 40_000), (6, "word " * 40_000), (7, "é字\x0b\x1c b")]


def odd(spark, n=0):
    rows = [(i, t, "en" if i % 2 else None, None, 0) for i, t in ODD][: n or None]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# text kernel
def test_hashes_do_not_depend_on_place():
    t = next(K.slices(__import__("pyarrow").array(["ab cd ab", "cd"])))[2]
    s, e, p = t.spans(~K.IS_SPACE)
    h = t.hashes(s, e)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and p.tolist() == [0, 3, 4]


# language ID
def brute_profile(texts, top=400):
    c = Counter()
    for t in texts:
        for w in "".join(x if x.isalpha() else " " for x in t.lower()).split():
            c.update(w)
            w = f" {w} "
            for n in (2, 3):
                c.update(w[i : i + n] for i in range(len(w) - n + 1))
    code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:top]]


def test_language_id_against_brute_force(spark):
    texts = {"en": ["the cat and the dog", "this is the end of the day"], "fr": ["le chat et le chien", "été à la mer, où est-il"], "de": ["der hund und die katze", "größe über alles straße"]}
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang, ts in texts.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    profiles = {lang: brute_profile(ts) for lang, ts in texts.items()}
    probe = ["the dog is", "la mer et le chat", "die straße der katze", "cat", "ÉTÉ", "xyz"]
    got, score = model.predict(probe)
    for t, lang, s in zip(probe, got, score, strict=True):
        own = brute_profile([t])
        dist = {k: sum(abs(p.index(g) - i) if g in p else 400 for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(dist), key=dist.get)
        assert lang == best and s == pytest.approx(1 - dist[best] / (400 * len(own)))


def test_language_id_odd_rows(spark):
    train = spark.createDataFrame([("the cat sat", "en"), ("le chat", "fr"), (None, "de"), ("x y", None)], "text string, lang string")
    out = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd(spark), language_id.fit(train)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= out and (5, "und") not in out and len(out) == 7
    empty = language_id.fit(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd(spark), empty).collect()} == {"und"}
    clash = odd(spark).withColumn("lang_pred", F.lit("zz")).withColumn("score", F.lit(1))
    assert language_id.predict(clash, empty).columns.count("lang_pred") == 1
    assert language_id.predict(odd(spark).limit(0), empty).count() == 0


# lattice
def brute_segmentations(word, pieces):
    if not word:
        return 1.0
    return sum(p * brute_segmentations(word[len(k) :], pieces) for k, p in pieces.items() if word.startswith(k))


def test_lattice_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in b" abc"} | {b" a", b"ab", b"abc", b"bc", b" ab"})
    r = np.random.default_rng(1).random(len(pieces) + 1)
    m = lattice_lm.Lattice(pieces, np.log(r / r.sum()))
    p = dict(zip(pieces, np.exp(m.log_p[:-1]), strict=True))
    words = [b"abc", b"a", b"cabab", b"bcbcabc" * 7]
    for w, lp in zip(words[:3], m.log_prob(words)[:3], strict=True):
        assert lp == pytest.approx(math.log(brute_segmentations(b" " + w, p)))
    # expected uses: by numeric derivative of the log-probability
    tiny = lattice_lm.Lattice(pieces, np.append(np.full(len(pieces), math.log(1e-13)), -1.0))  # a long word's probability underflows
    assert np.isfinite(use := tiny.expected([b"ab" * 20, b"c"], np.ones(2))).all()
    whole = sum(u * len(x) for u, x in zip(use, pieces, strict=False))
    assert whole == pytest.approx(41 + 2)
    e = m.expected(words, np.array([1.0, 2.0, 3.0, 1.0]))
    for i in range(len(pieces)):
        d = m.log_p.copy()
        d[i] += 1e-5
        up = lattice_lm.Lattice(pieces, d).log_prob(words)
        assert e[i] == pytest.approx(((up - m.log_prob(words)) * [1, 2, 3, 1]).sum() / 1e-5, rel=1e-3, abs=1e-3)


def test_long_words_are_walked_alike(monkeypatch):
    pieces = sorted({bytes([b]) for b in b" abc"} | {b" a", b"ab", b"abc", b"bc", b" ab", b"cabc"})
    r = np.random.default_rng(1).random(len(pieces) + 1) * 1e-3
    m = lattice_lm.Lattice(pieces, np.log(r / r.sum() * 1e-3))
    words = [b"abc", b"cabab" * 9, b"bcbcabc" * 40, b"a", b"cab" * 80]
    weight = np.array([1.0, 2.0, 3.0, 1.0, 0.5])
    plain = m.log_prob(words), m.expected(words, weight)
    monkeypatch.setattr(lattice_lm, "LONG", 3)
    for stretch in (7, 1 << 16):
        monkeypatch.setattr(lattice_lm, "STRETCH", stretch)
        assert m.log_prob(words) == pytest.approx(plain[0]) and m.expected(words, weight) == pytest.approx(plain[1])
    began = time.process_time()
    assert np.isfinite(m.log_prob([b"abc" * 100_000])).all() and time.process_time() - began < 20


def test_lattice_takes_pieces_of_any_length():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    raw = {p.replace("▁", " ").encode().lower() for p in own if "▁" not in p[1:]}
    got, weight = lattice_lm.pieces_of(path)
    assert np.exp(weight).sum() == pytest.approx(1) and weight[got.index(b" the")] > weight[got.index(b" though")] > weight[got.index(b"\xff")]
    assert set(got) == raw | {bytes([b]) for b in range(256)} and max(map(len, got)) > 16
    long = max(got, key=len).lstrip(b" ")
    m = lattice_lm.Lattice(got, np.zeros(len(got) + 1))
    assert max(j - i for i, j, _, _ in m.edges(np.frombuffer(b" " + long, np.uint8)[None].astype(np.uint64))) >= len(long)


def test_lattice_scores(spark):
    pieces = sorted({bytes([b]) for b in range(256)} | {b" the", b"th", b"at"})
    pieces = pieces, np.full(len(pieces), -np.log(len(pieces)))
    rows = [(i, t, i != 3) for i, t in enumerate(["the cat", "that Cat the", None, "new cat", "the " * 30])] + [(9, "x\x0by\x1cz", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    out = {r.doc_id: r for r in lattice_lm.score(df, F.col("train"), pieces).collect()}
    c = Counter()
    for _, t, train in rows:
        if train:
            c.update([*lattice_lm.tokens(t), None])
    n, v = sum(c.values()), len(c)
    for i, t, _ in rows:
        w = [*lattice_lm.tokens(t), None]
        assert out[i].n_tokens == len(w) and out[i].n_known == sum(c[x] > 0 for x in w) and out[i].train_tokens == n
        assert out[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert -1e6 < out[i].score < 0
    assert lattice_lm.score(df.limit(0), F.col("train"), pieces).count() == 0
    none = lattice_lm.score(df, F.lit(False), pieces).collect()
    assert all(r.n_known == 0 and r.score < 0 and r.base_score == 0 and r.train_tokens == 0 for r in none) and len(none) == len(rows)
    clash = df.selectExpr("*", "1 AS score", "2 AS _row", "3 AS _text", "4 AS Home")
    out = lattice_lm.score(clash, F.col("train"), pieces, keep=("doc_id", "score", "_row", "_text", "Home"), rounds=0)
    assert out.columns == ["doc_id", "_row", "_text", "Home", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {(r._row, r._text, r.Home) for r in out.collect()} == {(2, 3, 4)}


# quality
def test_statistics_by_brute_force():
    import re

    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(list("ab #|\n é\x0b")) for _ in range(rng.integers(0, 80))) for _ in range(300)]
    got = np.concatenate([quality_rules.statistics(t)[0] for _, _, t in K.slices(pa.array(texts), 5000)])
    for t, g in zip(texts, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert g.tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)]


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    m = quality_rules.fit_trees(x, y, (0, 1))
    assert ((m.score(x) > 0) == (x[:, 0] < 0.5)).mean() > 0.97
    for j in (0, 1):
        grid = rng.random((50, 3)).repeat(60, 0)
        grid[:, j] = np.tile(np.linspace(-0.1, 1.1, 60), 50)
        assert (np.diff(m.score(grid).reshape(50, 60), axis=1) <= 1e-12).all()


def test_quality_rules_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 1)], "doc_id long, quality int")
    trees = quality_rules.fit(odd(spark), labels)
    rows = quality_rules.judge(odd(spark), trees).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    assert quality_rules.judge(odd(spark).limit(0), trees).count() == 0
    clash = odd(spark).selectExpr("*", "7 AS Kept", "8 AS n_words", "9 AS _text", "1 AS quality", "2 AS h", "3 AS t", "4 AS y0")
    assert quality_rules.fit(clash, labels).roots.tolist() == trees.roots.tolist()
    out = quality_rules.judge(clash, trees, keep=("doc_id", "Kept", "n_words", "_text", "quality"))
    assert out.columns == ["doc_id", "_text", "quality", *quality_rules.STATS, "base_failed", "kept", "quality_score"] and {r._text for r in out.collect()} == {9}


def test_a_hot_label_is_a_bounded_sample(spark):
    """One id with many rows, equal and different ones, is learned from ``sample`` times at most."""
    docs = spark.createDataFrame([(1, f"text {i % 40}") for i in range(400)] + [(2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    rows = quality_rules.labelled(docs, labels, ["quality"], 10)
    assert rows.count() == 401 and quality_rules.bounded(rows, 10).count() == 10 and quality_rules.bounded(rows, 1000).count() == 41


def test_ordinal_regression_held_out(spark):
    rng = np.random.default_rng(2)
    vocabulary = [["bad", "worse", "awful"], ["so", "plain", "dull"], ["good", "fine", "great"]]
    rows = [(i, " ".join(rng.choice(vocabulary[g] + ["the", "a", "of"], 30)), g) for i, g in enumerate(rng.integers(0, 3, 600))]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows[:400]], "doc_id long, g int")
    m = quality_classifier.fit(df, labels, lambda g: g, ["g"])
    assert (np.diff(m.thresholds) >= 0).all()
    out = {r.doc_id: r for r in quality_classifier.rate(df, m).collect()}
    assert np.mean([round(out[i].expected_grade) == g for i, _, g in rows[400:]]) > 0.95
    assert np.mean([out[i].selected == (g == 2) for i, _, g in rows[400:]]) > 0.95
    assert len(quality_classifier.rate(odd(spark), m).collect()) == len(ODD)
    none = quality_classifier.fit(df, labels.limit(0), lambda g: g, ["g"])
    assert all(r.selected for r in quality_classifier.rate(odd(spark), none).collect())
    clash = odd(spark).selectExpr("*", "7 AS Selected", "8 AS grade", "9 AS _text", "1 AS id", "2 AS h")
    assert quality_classifier.rate(clash, m, keep=("doc_id", "Selected", "grade", "_text", "id")).columns == ["doc_id", "grade", "_text", "id", "expected_grade", "tail_probability", "selected"]


# personal data
def test_base_spans_are_the_patterns():
    rng = np.random.default_rng(5)
    for _ in range(4000):
        t = "".join(rng.choice(list("ab.@-%1+ 4()"), rng.integers(0, 40)))
        got = corpus_pii.base_spans(t)
        assert [s[1:] for s in got if s[0] == "email"] == [m.span() for m in corpus_pii.PATTERNS["email"].finditer(t)]
    assert corpus_pii.base_spans("mail a.b@c.de, 10.0.0.256 1.2.3.4, 4111 1111 1111 1111 or +1 (555) 555-1234") == [("email", 5, 13), ("ip", 26, 33), ("card", 35, 54), ("phone", 58, 75)]


def raw_spans(t):
    """The contract's patterns, as they are written there."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_contracts_patterns():
    rng = np.random.default_rng(8)
    for k in range(6000):
        t = "".join(rng.choice(list("01259.. +-()@a\n٣") if k % 2 else list("0012.. -"), rng.integers(0, 60)))
        assert corpus_pii.base_spans(t) == raw_spans(t)
    for d in range(0, 400, 7):  # the same spans at any place of a text
        t = " " * d + "4111-1111 1111 1111, 1.2.3.255, +1 555 555-1234 a@b.c" + "#" * (d % 5)
        assert corpus_pii.base_spans(t) == raw_spans(t) and len(raw_spans(t)) == 4


def test_long_runs_of_digits_take_time_in_proportion():
    """No conversion of thousands of digits, no search anew from each digit."""
    t = "9" * 300_000 + ".1.1.1 " + "0" * 5000 + "1.2.3.4 " + "1." * 100_000 + " " + "+1" * 50_000
    began = time.process_time()
    assert ("ip", 300_007, 305_014) in corpus_pii.base_spans(t)
    assert time.process_time() - began < 5
    found = [(3, i, i + 3, 1.0) for i in range(0, 400_000, 4)]
    base = [("ip", i, i + 2) for i in range(1, 400_000, 8)]
    began = time.process_time()
    assert len(corpus_pii.reconcile(base, found)) == 100_000 and time.process_time() - began < 5


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    tagger = corpus_pii.Tagger.new(4, 3, 1)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    x = rng.integers(0, corpus_pii.ALPHABET, (6, 3))
    y = np.array([[0, 1, 0], [1, 2, 0], [2, 2, 3], [0, 0, 4], [3, 0, 0], [4, 5, 0]])
    _, grad = tagger.loss_and_gradients(x, y)
    for k in tagger.p:
        at = (0, 1) if k == "A" else (x[0, 0], 0) if k == "E" else tuple(rng.integers(0, d) for d in tagger.p[k].shape)
        old, both = tagger.p[k][at], []
        for step in (1e-4, -1e-4):
            tagger.p[k][at] = old + step
            both.append(tagger.loss_and_gradients(x, y)[0])
        tagger.p[k][at] = old
        assert grad[k][at] == pytest.approx((both[0] - both[1]) / 2e-4, rel=1e-2, abs=1e-6)


def test_reconcile_takes_the_best_set_without_overlaps():
    base = [("ip", 10, 15)]
    found = [(3, 0, 5, 2.0), (3, 4, 9, 3.0), (2, 0, 4, 1.5), (0, 12, 20, 9.0)]
    assert corpus_pii.reconcile(base, found) == [("ip", 10, 15), ("card", 0, 4), ("phone", 4, 9)]


class Between:
    """Stands for a tagger: what lies between two # is an address."""

    def decode(self, x):
        inside = (x != 0) & (x != corpus_pii.codes("#")[0])
        tags = np.where(inside, 2, 0)
        first = inside.copy()
        first[:, 1:] &= ~inside[:, :-1]
        return np.where(first, 1, tags), inside.astype(float)


@pytest.mark.parametrize("n", [10, 31, 32, 43, 64, 100, 129, 1000])
def test_spans_of_any_length_are_found_at_any_place(n):
    for local in (2, n - 8):
        span = f"{'x' * local} @ y{'z' * (n - local - 7)}.de"
        assert len(span) == n and corpus_pii.base_spans(span) == []
        places = [(before, after) for before in range(70) for after in (0, 5, 200)]
        texts = ["#" * i + span + "#" * j for i, j in places] + ["#" * (-n % 32 + 64) + span]
        got = corpus_pii.search(Between(), texts, [[] for _ in texts])
        for f, t in zip(got, texts, strict=True):
            at = t.index("x")
            assert {s[:3] for s in f} == {(0, at, at + n)}, (len(t), at)


def test_long_numbers_and_neighbours_are_found():
    card = "4111" + "-" * 40 + "1111" + "-" * 40 + "1111" + "-" * 40 + "1111"
    rng = np.random.default_rng(1)

    class Card(Between):
        def decode(self, x):
            tags, gain = super().decode(x)
            return np.where(tags > 0, tags + 4, 0), gain

    texts = ["#" * int(i) + card + "#" * int(j) for i, j in rng.integers(0, 300, (60, 2))]
    for f, t in zip(corpus_pii.search(Card(), texts, [[] for _ in texts]), texts, strict=True):
        assert {s[:3] for s in f} == {(2, t.index("4"), t.index("4") + len(card))}
    t = "a@b@c @ d@" + "e" * 50 + "\n@f"
    assert [t[a:b] for a, b in corpus_pii.around_at(t, [])] == ["a@b", "b@c", "c @ d", "d@" + "e" * 50, "e" * 50 + "\n@f"]
    assert [t[a:b] for a, b in corpus_pii.around_at(t, [("email", 0, 9)])] == ["d@" + "e" * 50, "e" * 50 + "\n@f"]


def test_a_texts_own_end_cuts_no_span(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"call +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} or write x{i}@mail.example.com today, room {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tail = "call 1-555/555/1234"
    texts = [(n, ("the room of the day or today and " * 6)[len(tail) - n :] + tail) for n in (64, 70, 95, 96, 128, 160)]
    got = corpus_pii.find(spark.createDataFrame(texts, df.schema), corpus_pii.fit(df, epochs=6)).collect()
    assert all(len(r.base) == 0 and [s.end for s in r.spans] == [r.doc_id] for r in got)


def test_personal_data_query_shape(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"call +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} or write x{i}@mail.example.com today, room {i}") for i in range(150)]
    rows += [(i, t) for i, t in ODD[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tagger = corpus_pii.fit(df, epochs=6)
    out = {r.doc_id: r for r in corpus_pii.find(df, tagger).collect() if r.doc_id > 5}
    for i, t in rows[6:150]:
        base = corpus_pii.base_spans(t)
        assert [tuple(s) for s in out[i].base] == base and {tuple(s) for s in out[i].spans} >= set(base)
    x = [corpus_pii.labelled_windows(t, corpus_pii.base_spans(t)) for _, t in rows[:40]]
    tags, _ = tagger.decode(np.concatenate([a for a, _ in x]).astype(int))
    truth = np.concatenate([b for _, b in x])
    assert (tags == truth).mean() > 0.97
    assert corpus_pii.find(df.limit(0), tagger).count() == 0
    nothing = corpus_pii.fit(df.limit(0))
    assert all(r.base == r.spans for r in corpus_pii.find(df, nothing).collect())
    assert zlib.crc32(b"") == 0
