"""Identities, types by analysis, DISTINCT ON, FOR, samples, variables, EXPLAIN, EXECUTE and Arrow batches."""

import datetime as dt
import math

import pyarrow as pa
import pytest

from loomquery.errors import NotAllowed, QueryError, UnknownRelation
from loomquery.plans.session import Session

TODAY = dt.date(2024, 3, 13)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("root")
    spark.createDataFrame([(i, f"R{i}") for i in range(5)], "k long, name string").coalesce(1).write.parquet(str(d / "region.parquet"))
    spark.createDataFrame([(i,) for i in range(3)], "k long").coalesce(1).write.parquet(str(d / "a" / "b"))
    spark.createDataFrame([(7,)], "k long").coalesce(1).write.parquet(str(d / "other"))
    return d


@pytest.fixture
def run(spark, root):
    s = Session(spark, str(root), today=TODAY)
    return lambda q, p=None: [tuple(r) for r in s.sql(q, p).collect()]


def ways(root):
    """Names that reach region, whole or in part."""
    link = root.parent / "link_to_root"
    if not link.exists():
        link.symlink_to(root)
    whole = ["region", "REGION.parquet", "region.parquet", "./region.parquet", "./a/.././region.parquet", f"{root}/region.parquet", f"file://{root}/region.parquet", f"{link}/region.parquet", ".//region.parquet"]
    return whole, ["./reg*.parquet", "./r?gion.parquet", "./region.parquet/*.parquet", f"{root}", "./*"]


def test_conditions_hold_for_every_name_of_a_relation(spark, root):
    whole, part = ways(root)
    s = Session(spark, str(root), visible={"Region": [["k = 1"], ["k > 2", "name = 'R4'"]]}, views={"v": "SELECT * FROM region"})
    for name in [*whole, *part]:
        try:
            n = s.sql(f"SELECT COUNT(*) AS n FROM `{name}`").first()[0]
        except (NotAllowed, UnknownRelation, QueryError):
            assert name != "region"
            continue
        assert n == 2, name
    assert s.sql("SELECT COUNT(*) AS n FROM v").first()[0] == 2 and s.sql("SELECT COUNT(*) AS n FROM other").first()[0] == 1
    assert s.sql("SELECT COUNT(*) AS n FROM region AS a INNER JOIN region.parquet AS b USING (k)").first()[0] == 2
    whole_a = Session(spark, str(root), visible={"a.b": [["k = 1"]]})
    assert whole_a.sql("SELECT COUNT(*) AS n FROM a.b").first()[0] == 1 and whole_a.sql("SELECT COUNT(*) AS n FROM `./a/b`").first()[0] == 1
    with pytest.raises(NotAllowed):
        whole_a.sql("SELECT * FROM `./a`")


def test_permissions_hold_for_every_name_of_a_relation(spark, root):
    whole, part = ways(root)
    s = Session(spark, str(root), roles=("r",), permissions=[("r", "other"), ("r", "A.*"), ("x", "*")])
    for name in [*whole, *part]:
        with pytest.raises((NotAllowed, UnknownRelation, QueryError)):
            s.sql(f"SELECT * FROM `{name}`").collect()
    assert s.sql("SELECT * FROM other").count() == 1 and s.sql("SELECT * FROM a.b").count() == 3 and s.sql("SELECT * FROM `./other`").count() == 1
    every = Session(spark, str(root), roles=("r",), permissions=[("r", "region")])
    assert {every.sql(f"SELECT * FROM `{n}`").count() for n in whole if n not in ("REGION.parquet", "./a/.././region.parquet")} == {5}


def test_distinct_on_orders_and_limits_its_rows(run):
    t = "(VALUES (1, 9, 'a'), (2, 3, 'b'), (1, 4, 'c'), (3, 5, 'd'), (2, 8, 'e')) AS t(k, v, s)"
    assert run(f"SELECT DISTINCT ON (k) k, v FROM {t} ORDER BY v LIMIT 2") == [(2, 3), (1, 4)]
    assert run(f"SELECT DISTINCT ON (k) k, s FROM {t} ORDER BY v DESC") == [(1, "a"), (2, "e"), (3, "d")]  # by a column that is not selected
    assert run(f"SELECT DISTINCT ON (k) k, v AS w FROM {t} ORDER BY w DESC LIMIT 1 OFFSET 1") == [(2, 8)]
    assert run(f"SELECT DISTINCT ON (1) k, v FROM {t} ORDER BY 2") == [(2, 3), (1, 4), (3, 5)]
    assert sorted(k for k, _ in run(f"SELECT DISTINCT ON (k) k, v FROM {t}")) == [1, 2, 3]
    assert run(f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT ON (k) * FROM {t} ORDER BY v LIMIT 2) AS x") == [(2,)]


def test_types_are_those_of_the_relation_that_is_meant(run):
    assert run("SELECT LENGTH(p) AS n FROM (SELECT SPLIT('a,b,c', ',') AS p) AS t") == [(3,)]
    both = "FROM (SELECT 1 AS k, 'four' AS v) AS l INNER JOIN (SELECT 1 AS k, ARRAY[1, 2] AS v) AS r ON l.k = r.k"
    assert run(f"SELECT LENGTH(l.v) AS a, LENGTH(r.v) AS b {both}") == [(4, 2)]
    assert run("WITH c AS (SELECT ARRAY['x', 'yz'] AS a) SELECT LENGTH(a) AS n, a[1] AS e FROM c WHERE LENGTH(a) > 1 ORDER BY LENGTH(a)") == [(2, "yz")]
    assert run("SELECT LENGTH(ARRAY_AGG(x)) AS n FROM (VALUES (1), (2), (3)) AS t(x)") == [(3,)]
    deep = "SELECT ARRAY[1, 2, 3] AS v"
    for i in range(4):
        deep = f"SELECT v, LENGTH(v) AS n{i} FROM ({deep}) AS t{i}"
    assert run(deep)[0][1:] == (3,)
    assert run("SELECT TRIM(t.v) AS a, GET(t.w, 0) AS b, SEARCH(t.w, 'p') AS c FROM (SELECT ' x ' AS v, ARRAY['P'] AS w) AS t") == [("x", "P", True)]


def test_conversions(run):
    assert run("SELECT COALESCE(x, 2.0) AS a FROM (SELECT CAST('NaN' AS DOUBLE) AS x) AS t") == [(2.0,)]
    for v in (1e20, 1e16, 123456789.5, 1.5, 1e-5, 0.0001, 12345678.0, -2.5e-7, 1e22, 9007199254740993.0, 0.00012345, -1e15, 2.0**-24, 0.1 + 0.2, 2.0**-30 * 3, 1 / 3, 123456.78901234567, 2.0**57):
        assert run("SELECT CAST(x AS VARCHAR) AS s, x::VARCHAR AS t FROM (VALUES (CAST(:v AS DOUBLE))) AS t(x)", {"v": v}) == [(str(v), str(v))]
    assert run("SELECT CAST(x AS VARCHAR) AS s, COUNT(*) AS n FROM (VALUES (1.5), (1.5), (NULL), (CAST('inf' AS DOUBLE))) AS t(x) GROUP BY CAST(x AS VARCHAR) ORDER BY s") == [("1.5", 2), ("inf", 1), (None, 1)]
    assert run("SELECT CAST(SUM(x) AS VARCHAR) AS s FROM (VALUES (1e16), (1e16)) AS t(x)") == [("2e+16",)]
    assert run("SELECT CAST(1e20 AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS n, CAST(12 AS VARCHAR) AS i") == [("1e+20", None, "12")]
    assert run("SELECT CAST(x AS TIMESTAMP) AS a FROM (VALUES (1000000), (NULL)) AS t(x)") == [(dt.datetime(1970, 1, 1, 0, 0, 1),), (None,)]
    assert run("SELECT INTEGER(TIMESTAMP '1970-01-01 00:00:01') AS a, CAST(t AS INTEGER) AS b FROM (SELECT TIMESTAMP '1970-01-01 00:00:02' AS t) AS x") == [(1_000_000, 2_000_000)]
    assert run("SELECT CONCAT(('1', '2', '3')) AS a, CONCAT_WS('-', ('x', 'y')) AS b, CONCAT('(', 'a') AS c") == [("123", "x-y", "(a")]
    assert run("SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1 1' DAY TO HOUR AS a, DATE '2024-01-31' + INTERVAL '1-1' YEAR TO MONTH AS b") == [(dt.datetime(2024, 1, 2, 1), dt.datetime(2025, 2, 28))]


def test_for_behind_an_alias_and_without_quotes(run):
    assert run("SELECT COUNT(*) AS n FROM $planets AS p FOR '1800-01-01'") == [(7,)]
    assert run("SELECT COUNT(*) AS n FROM $planets FOR 1800-01-01 AS p WHERE p.id > 0") == [(7,)]
    assert run("SELECT COUNT(*) AS n FROM $planets p FOR DATES BETWEEN 1700-01-01 AND 1850-1-1") == [(8,)]


def test_other_names_of_columns(run):
    assert run("SELECT p.escape_velocity, number_of_moons AS m FROM $planets AS p WHERE LENGTH(name) = 5 AND mean_temperature < 0 ORDER BY orbital_period DESC") == [(1.3, 5)]
    assert run("SELECT name FROM $planets WHERE mean_temperature < -200 ORDER BY orbital_period DESC") == [("Pluto",), ("Neptune",)]
    assert run("SELECT MAX(number_of_moons) AS m FROM $planets GROUP BY number_of_moons > 50 ORDER BY m") == [(27,), (82,)]


def test_samples_come_from_a_folder(spark, root, tmp_path):
    spark.createDataFrame([(1, 3, "Moon", 4.9)], "id long, planetId long, name string, gm double").write.parquet(str(tmp_path / "satellites.parquet"))
    spark.createDataFrame([("A", ["x", "y"])], "name string, missions array<string>").write.parquet(str(tmp_path / "astronauts.parquet"))
    s = Session(spark, str(root), samples=str(tmp_path))
    assert s.sql("SELECT p.name, s.name AS moon, radius FROM $satellites AS s INNER JOIN $planets AS p ON s.planet_id = p.id").collect() == [("Earth", "Moon", None)]
    assert s.sql("SELECT name, LENGTH(missions) AS n FROM $astronauts").collect() == [("A", 2)]
    with pytest.raises(UnknownRelation, match="Lauched_at"):
        s.sql("SELECT * FROM $missions")
    assert [r[0] for r in s.sql("SELECT key FROM $statistics ORDER BY key").collect()] == ["queries_executed", "uptime_seconds"]


def test_variables_have_owners(spark, root):
    s = Session(spark, str(root), roles=("reader", "writer"))
    rows = {r.name: r for r in s.sql("SET @x = 'it''s'; SHOW VARIABLES").collect()}
    assert (rows["x"].value, rows["x"].owner) == ("it's", "USER") and rows["time_zone"].owner == "SERVER" and rows["user_memberships"].type == "ARRAY"
    assert s.sql("SHOW time_zone").first().value == "UTC" and s.sql("SELECT @@time_zone AS z, @x AS x").collect() == [("UTC", "it's")]
    assert s.sql("SELECT name FROM (VALUES ('reader'), ('other')) AS t(name) WHERE name = ANY(@@user_memberships)").collect() == [("reader",)]
    with pytest.raises(NotAllowed):
        s.sql("SET time_zone = 'CET'")
    with pytest.raises(QueryError):
        s.sql("SHOW nothing_like_it")


def test_execute_takes_any_literal(spark, root):
    s = Session(spark, str(root), prepared={"p": "SELECT :one AS a", "q": "SELECT :a AS a, :b AS b"})
    for text, value in (("-3", -3), ("TRUE", True), ("'it''s, = (x)'", "it's, = (x)"), ("-2.5e3", -2500.0), ("null", None)):
        assert s.sql(f"EXECUTE p(one = {text})").collect() == [(value,)]
    assert s.sql("EXECUTE q (b = 2, a = 'x,y')").collect() == [("x,y", 2)]
    with pytest.raises(QueryError):
        s.sql("EXECUTE p(one 3)")


def test_explain_has_steps(spark, root):
    s = Session(spark, str(root))
    q = "SELECT name, COUNT(*) AS n FROM region WHERE k > 1 GROUP BY name"
    plain = s.sql(f"EXPLAIN {q}")
    assert plain.columns == ["tree", "operator", "config"] and any("Aggregate" in r.operator for r in plain.collect())
    ran = s.sql(f"EXPLAIN ANALYZE {q}")
    assert len(ran.columns) == 7 and any(r.rows_out == 3 for r in ran.collect()) and ran.first().total_ms > 0
    chart = s.sql(f"EXPLAIN ANALYZE FORMAT MERMAID {q}").first().plan
    assert chart.startswith("flowchart BT") and "rows" in chart and "-->" in chart


def test_arrow_batches_keep_names_and_types(spark, root):
    s = Session(spark, str(root))
    got = list(s.arrow_batches("SELECT k, name AS k FROM region ORDER BY 1", batch=2))
    assert [b.num_rows for b in got] and sum(b.num_rows for b in got) == 5 and all(b.num_rows <= 2 for b in got) and got[0].schema.names == ["k", "k"]
    none = list(s.arrow_batches("SELECT k, name FROM region WHERE k > 99"))
    assert [b.num_rows for b in none] == [0] and none[0].schema == pa.schema([("k", pa.int64()), ("name", pa.string())])


def test_no_views_are_left_behind(spark, root):
    before = {t.name for t in spark.catalog.listTables()}
    s = Session(spark, str(root), views={"v": "SELECT k FROM region"})
    df = s.sql("SELECT LENGTH(name) AS n FROM region INNER JOIN v USING (k)")
    with pytest.raises(UnknownRelation):
        s.sql("SELECT * FROM region AS a, nowhere AS b")
    assert {t.name for t in spark.catalog.listTables()} == before and df.count() == 5


def test_hints_say_nothing(run):
    assert run("SELECT COUNT(*) AS n FROM region WITH (NO_CACHE, NO_PARTITION) WHERE k > 0") == [(4,)]
    assert run("SELECT COUNT(*) AS n FROM GENERATE_SERIES(1, 4) AS g WITH (NO_CACHE)") == [(4,)]


def test_cosine_of_many_texts(run):
    got = run("SELECT ROUND(COSINE_SIMILARITY(s, 'a b'), 6) AS c FROM (VALUES ('a b'), ('A'), ('zz'), (''), (NULL)) AS t(s)")
    assert got[0] == (1.0,) and got[1][0] == pytest.approx(math.sqrt(0.5), abs=1e-5) and got[2:] == [(0.0,), (0.0,), (None,)]


def test_steps_of_series_and_nulls_that_are_no_numbers(run):
    assert run("SELECT COUNT(*) AS n FROM GENERATE_SERIES('2022-01-01', '2022-12-31', '1mth') AS g") == [(12,)]
    assert run("SELECT COUNT(*) AS n FROM GENERATE_SERIES('2022-01-01', '2022-01-02', '1h 30 min') AS g") == [(17,)]
    with pytest.raises(QueryError):
        run("SELECT * FROM GENERATE_SERIES('2022-01-01', '2022-12-31', '1 fortnight') AS g")
    assert run("SELECT COUNT(*) AS n FROM $planets WHERE surface_pressure / surface_pressure IS NULL") == [(5,)]
    assert run("SELECT VARCHAR(surface_pressure) AS s FROM $planets WHERE VARCHAR(surface_pressure) IS NULL OR id = 9 ORDER BY s") == [("1e-05",), (None,), (None,), (None,), (None,)]


def test_for_behind_a_subquery(run):
    assert run("SELECT COUNT(*) AS n FROM (SELECT * FROM $planets AS d) AS p FOR '1800-01-01'") == [(7,)]
    assert run("SELECT COUNT(*) AS n FROM (SELECT * FROM $planets) AS p CROSS JOIN (SELECT * FROM $planets FOR '1700-01-01') AS q FOR '1800-01-01'") == [(9 * 6,)]


def test_addresses_lists_and_strictness(spark, root, run):
    for bad in ("SELECT '!!' | '10.0.0.0/8'", "SELECT 0 | '10.0.0.0/8'", "SELECT '10.0.0.1' | 3", "SELECT '10.0.0.1/8' | '10.0.0.0/8'", "SELECT 1 IN (1, 'one')"):
        with pytest.raises(QueryError):
            run(bad)
    s = Session(spark, str(root), strict=True, prepared={"P": "SELECT 1 AS a"})
    for bad in ("SELECT name FROM $planets ORDER BY 1", "SELECT name FROM $planets ORDER BY LENGTH(name)", "SELECT id, name, id FROM $planets", "SELECT (name, id) FROM $planets", "SELECT * FROM $planets LEFT JOIN $planets USING (id)", "SET thing = 1"):
        with pytest.raises((QueryError, Exception)) as e:
            s.sql(bad)
        assert type(e.value).__module__ == "loomquery.errors", bad
    assert s.sql("SELECT a.name FROM $planets AS a INNER JOIN $planets AS b ON a.id = b.id ORDER BY a.name DESC").count() == 9 and s.sql("EXECUTE p").count() == 1
    assert len(s.sql("SHOW EXTENDED COLUMNS FROM $planets").columns) == 4


def test_positional_parameters_have_types(run):
    assert run("SELECT LENGTH(v) AS n, CAST(? AS VARCHAR) AS s, ? AS t FROM (SELECT SPLIT(?, ',') AS v) AS d FOR '2020-01-01' WHERE LENGTH(v) > ?", [1e20, "x", "a,b,c", 2]) == [(3, "1e+20", "x")]
