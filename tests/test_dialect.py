import datetime as dt
import json
import lzma

import pyarrow as pa
import pytest

from loomquery.errors import NotAllowed, QueryError, UnknownFunction, UnknownRelation, UnsupportedSyntax
from loomquery.functions import library
from loomquery.plans.dialect import statements, tokenize
from loomquery.plans.session import Session
from loomquery.plans.temporal import days_of
from loomquery.sources import files

TODAY = dt.date(2024, 3, 13)  # a Wednesday


@pytest.fixture
def run(spark, tmp_path):
    s = Session(spark, str(tmp_path), today=TODAY)
    return lambda q, p=None: [tuple(r) for r in s.sql(q, p).collect()]


def test_tokens_keep_strings_and_comments_whole():
    assert [t.text for t in tokenize("a->>'x;y' -- c\n/* d */ + 1_0")] == ["a", "->>", "'x;y'", "+", "1_0"]
    assert statements("SELECT ';'; -- a;b\n SELECT 2;") == ["SELECT ';'", "-- a;b\n SELECT 2"]


def test_precedence(run):
    assert run("SELECT 2 + 3 * 4 - -1 AS a, NOT 1 = 2 AND TRUE AS b, 1 + 2 = 3 OR FALSE AS c, 7 - 2 - 1 AS d") == [(15, True, True, 4)]
    assert run("SELECT 1 BETWEEN 0 AND 2 AND FALSE AS a, 5 & 3 | 8 AS b, 1 << 2 + 1 AS c") == [(False, 9, 8)]


@pytest.mark.parametrize(
    ("words", "first", "last"),
    [
        (("'2024-01-05'",), (2024, 1, 5), (2024, 1, 5)), (("TODAY",), (2024, 3, 13), (2024, 3, 13)), (("YESTERDAY",), (2024, 3, 12), (2024, 3, 12)), (("WEDNESDAY",), (2024, 3, 6), (2024, 3, 6)), (("MONDAY",), (2024, 3, 11), (2024, 3, 11)),
        (("DATES", "BETWEEN", "'2024-01-01'", "AND", "'2024-02-01'"), (2024, 1, 1), (2024, 2, 1)), (("DATES", "IN", "LAST_MONTH"), (2024, 2, 1), (2024, 2, 29)), (("DATES", "IN", "THIS_MONTH"), (2024, 3, 1), (2024, 3, 13)),
        (("DATES", "SINCE", "'2024-03-01'"), (2024, 3, 1), (2024, 3, 13)), (("LAST", "3", "DAYS"), (2024, 3, 10), (2024, 3, 13)),
    ],
)
def test_for_clauses(words, first, last):
    assert days_of(words, TODAY) == (dt.date(*first), dt.date(*last))


def test_for_clause_errors():
    for bad in (("DATES", "IN", "NEXT_MONTH"), ("'x'",), ("DATES", "BETWEEN", "'2024-02-01'", "AND", "'2024-01-01'")):
        with pytest.raises(QueryError):
            days_of(bad, TODAY)


@pytest.mark.parametrize(("day", "n"), [("1700-01-01", 6), ("1781-04-26", 7), ("1846-11-13", 8), ("1930-03-13", 9)])
def test_planets_by_day(run, day, n):
    assert run(f"SELECT COUNT(*) AS n FROM $planets FOR '{day}'") == [(n,)]


def test_null_rules(run):
    assert run("SELECT ARRAY_CONTAINS(CAST(NULL AS ARRAY<INTEGER>), 1) AS a, 3 IN (1, NULL) AS b, 3 NOT IN (1, NULL) AS c") == [(False, False, True)]
    assert run("SELECT x FROM (VALUES (TRUE), (FALSE), (NULL)) AS t(x) WHERE NOT (x IS TRUE)") == [(False,), (None,)]
    assert run("SELECT x FROM (VALUES (2), (NULL), (1)) AS t(x) ORDER BY x") == [(1,), (2,), (None,)]


def test_any_all_edges(run):
    q = "SELECT 2 = ALL(v) AS a, 2 != ANY(v) AS b FROM (SELECT {} AS v) AS t"
    assert run(q.format("CAST(ARRAY[] AS ARRAY<INTEGER>)")) == [(False, False)]
    assert run(q.format("CAST(NULL AS ARRAY<INTEGER>)")) == [(False, False)]


def test_function_traps(run):
    assert run("SELECT LPAD('abcdef', 3, '*') AS a, RPAD('a', 3, '*') AS b, ROUND(0.125, 2) AS c, ROUND(3.5) AS d") == [("abcdef", "a**", 0.12, 4.0)]
    assert run("SELECT SUBSTRING('abcdef', 0, 3) AS a, SUBSTRING('abcdef', -3, 3) AS b, LEFT('abc', -1) AS c, SPLIT('a.b.c', '.') AS d") == [("abc", "", "ab", ["a", "b", "c"])]
    assert run("SELECT -7 % 3 AS a, 7 DIV 2 AS b, DATEPART('dow', DATE '2024-03-10') AS c, LOG(8, 2) AS d") == [(2, 3, 6, 3.0)]
    assert run("SELECT CHAR(8364) AS a, SOUNDEX('') AS b, TIMEDIFF('2024-01-01 00:00:00', '2024-01-01 05:59:00') AS c") == [("€", None, 5)]
    assert run("SELECT COSINE_SIMILARITY('a b', 'a b') AS a, BASE85_DECODE(BASE85_ENCODE('xyz')) AS b") == [(pytest.approx(1.0), "xyz")]
    assert run("SELECT MATCH('The dogs ran') AGAINST ('dog') AS a, MATCH('cats') AGAINST ('dog') AS b") == [(True, False)]


def test_aggregates(run):
    assert run("SELECT ARRAY_AGG(x) AS a FROM (VALUES (1), (NULL)) AS t(x)") == [([1, None],)]
    assert run("SELECT ARRAY_AGG(x ORDER BY x DESC LIMIT 2) AS a, PRODUCT(x) AS p FROM (VALUES (1), (-3), (2)) AS t(x)") == [([2, 1], pytest.approx(-6.0))]
    assert run("SELECT STDDEV(x) AS s, COUNT(*) FILTER (WHERE x > 1) AS n FROM (VALUES (1), (3)) AS t(x)") == [(1.0, 1)]


def test_rejections(spark, run):
    for q in ("DELETE FROM x", "SELECT TOP 3 * FROM $planets", "SELECT * FROM $planets RIGHT SEMI JOIN $planets ON 1 = 1", "SELECT a FROM $planets INNER JOIN $planets"):
        with pytest.raises((UnsupportedSyntax, QueryError)):
            run(q)
    with pytest.raises(UnknownFunction, match="LENGTH"):
        run("SELECT LENGHT('a') AS a")
    with pytest.raises(QueryError, match="INTEGER"):
        run("SELECT CAST(1 AS BIGINT) AS a")
    with pytest.raises(UnknownRelation):
        run("SELECT 1 AS a FROM nowhere")
    strict = Session(spark, strict=True)
    with pytest.raises(UnsupportedSyntax):
        strict.sql("SELECT id FROM $planets INTERSECT SELECT id FROM $planets")


def test_parameters_views_prepared_and_variables(spark):
    s = Session(spark, views={"inner_planets": "SELECT id, name FROM $planets WHERE id < 5"}, prepared={"by_id": "SELECT name FROM $planets WHERE id = :id"})
    assert s.sql("SELECT COUNT(*) AS n FROM inner_planets").first()[0] == 4
    assert s.sql("EXECUTE by_id(id = 3)").first()[0] == "Earth"
    assert s.sql("SELECT name FROM $planets WHERE id = ?", [4]).first()[0] == "Mars"
    assert s.sql("SET @n = 2; SELECT id FROM $planets WHERE id = @n").first()[0] == 2
    assert "lineage" not in s.sql("EXPLAIN SELECT id FROM $planets").first()[0]
    assert s.sql("SHOW CREATE VIEW inner_planets").first()[1].startswith("SELECT")


def test_permissions_and_visibility(spark):
    s = Session(spark, roles=("reader",), permissions=[("reader", "$pla*")], visible={"$planets": [["id < 3"], ["id = 9", "name = 'Pluto'"]]})
    assert sorted(r[0] for r in s.sql("SELECT id FROM $planets").collect()) == [1, 2, 9]
    with pytest.raises(NotAllowed):
        s.sql("SELECT 1 AS a FROM $no_table")
    none = Session(spark, visible={"$planets": []})
    assert none.sql("SELECT COUNT(*) AS n FROM $planets").first()[0] == 0


def test_frames_and_arrow(spark):
    s = Session(spark)
    s.register("t", pa.table({"a": [1, 2, 3]}))
    assert s.arrow("SELECT a FROM t WHERE a > 1", limit=1).num_rows == 1
    assert sum(b.num_rows for b in s.arrow_batches("SELECT a FROM t", batch=2)) == 3
    s.register_store("lake", lambda name: spark.createDataFrame([(name,)], "n string"), remove_prefix=True)
    assert s.sql("SELECT n FROM lake.x.y").first()[0] == "x.y"


def test_files(spark, tmp_path, run):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/1.jsonl").write_text('{"a": 1, "s": {"k": [1]}}\n')
    (tmp_path / "d/2.jsonl").write_text('{"a": 2, "b": "x"}\n')
    assert run("SELECT a, b, s -> 'k' AS k FROM d ORDER BY a") == [(1, None, "[1]"), (2, "x", None)]
    assert run("SELECT COUNT(*) AS n FROM 'd/[1-2].jsonl'") == [(2,)]
    (tmp_path / "t.psv").write_text("A|B\n1|x\n")
    assert run("SELECT A, B FROM 't.psv'") == [(1, "x")]
    (tmp_path / "z.xz").write_bytes(lzma.compress(b'{"q": 5}\n'))
    assert run("SELECT q FROM 'z.xz'") == [(5,)]
    import zstandard

    (tmp_path / "y.zst").write_bytes(zstandard.compress(b'{"q": 6}\n{"q": 7}\n'))
    assert run("SELECT SUM(q) AS s FROM 'y.zst'") == [(13,)]
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("n", pa.int64())])) as w:
        w.write(pa.record_batch([pa.array([7])], ["n"]))
    assert run("SELECT n FROM 'f.arrow'") == [(7,)]
    with pytest.raises(QueryError):
        run("SELECT 1 AS a FROM '../x.parquet'")


def test_partitioned_tree(spark, tmp_path):
    def put(path, n, *marks):
        p = tmp_path / "t" / path
        p.mkdir(parents=True)
        (p / "data.jsonl").write_text(json.dumps({"n": n}) + "\n")
        for m in marks:
            (p / m).write_text("")

    day = "year_2024/month_03/day_{:02d}/"
    put(day.format(12) + "as_at_1", 1, "frame.complete")
    put(day.format(12) + "as_at_2", 2, "frame.complete")
    put(day.format(12) + "as_at_3", 3)
    put(day.format(12) + "as_at_4", 4, "frame.complete", "frame.ignore")
    put(day.format(13) + "by_hour/hour=01/as_at_1", 5, "frame.complete")
    put(day.format(13) + "by_hour/hour=02/as_at_1", 6, "frame.complete")
    s = Session(spark, str(tmp_path), today=TODAY)
    got = lambda q: sorted(r[0] for r in s.sql(q).collect())
    assert got("SELECT n FROM t FOR YESTERDAY") == [2]
    assert got("SELECT n FROM t") == [5, 6]
    assert got("SELECT n FROM t FOR LAST 2 DAYS AS x") == [2, 5, 6]
    with pytest.raises(UnknownRelation):
        got("SELECT n FROM t FOR '2020-01-01'")
    with pytest.raises(QueryError):
        files.partitioned(["/x/year_2024/month_03/day_13/by_age/age=1/a.jsonl"], TODAY, TODAY)


def test_library_knows_each_name():
    for name in ("UPPER", "SHA512", "TIME_BUCKET", "GET", "HUMANIZE", "TRY_INTEGER", "MIN_MAX"):
        assert name in library.FUNCTIONS
