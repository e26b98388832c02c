"""Registered queries: the dialect's statement, and the same in DuckDB's SQL.

Every entry is (statement, oracle); an oracle of None means that SQL elsewhere
has no equal (random values, implementation-defined results).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.plans.session import Session

Q: dict[str, tuple[str, str | None]] = {}


def add(name: str, ours: str, oracle: str | None = "") -> None:
    Q[name] = (ours, ours if oracle == "" else oracle)


# scans, projection, filter
add("scan_filter_project", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
add("select_except", "SELECT * EXCEPT (c_acctbal, c_nationkey) FROM customer", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
add("between_not_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 200")
add("in_not_in_null", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_partkey NOT IN (1, 2, NULL)", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_partkey NOT IN (1, 2)")
add("like_family", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1%' AND c_name NOT LIKE '%99%' AND c_mktsegment ILIKE '%u%' AND c_mktsegment NOT ILIKE 'x%'")
add("like_any", "SELECT p_partkey FROM part WHERE p_type LIKE ANY ('%A%', '%E%') AND p_name NOT ILIKE ANY ('%zz%', '%qq%')", "SELECT p_partkey FROM part WHERE (p_type LIKE '%A%' OR p_type LIKE '%E%') AND NOT (p_name ILIKE '%zz%' OR p_name ILIKE '%qq%')")
add("regex_match", "SELECT o_orderkey FROM orders WHERE o_orderpriority RLIKE '^[12]' OR o_orderpriority ~ 'LOW' OR o_orderpriority SIMILAR TO '^4'", "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[12]') OR regexp_matches(o_orderpriority, 'LOW') OR regexp_matches(o_orderpriority, '^4')")
add("tri_state", "SELECT x, x IS TRUE AS t, x IS NOT TRUE AS nt, x IS FALSE AS f, x IS NULL AS n, NOT (x IS TRUE) AS inv FROM (VALUES (TRUE), (FALSE), (NULL)) AS v(x)")
add("xor_bits", "SELECT l_orderkey, l_linenumber, l_linenumber & 3 AS a, l_linenumber | 8 AS o, l_linenumber ^ 5 AS x, l_linenumber << 2 AS s, l_linenumber >> 1 AS r FROM lineitem WHERE l_quantity > 25 XOR l_linenumber = 1", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_linenumber & 3)::BIGINT AS a, (l_linenumber | 8)::BIGINT AS o, xor(l_linenumber, 5)::BIGINT AS x, (l_linenumber << 2)::BIGINT AS s, (l_linenumber >> 1)::BIGINT AS r FROM lineitem WHERE (l_quantity > 25) <> (l_linenumber = 1)")
add("arithmetic", "SELECT o_orderkey, o_orderkey / 4 AS q, -o_orderkey % 7 AS m, o_orderkey DIV 3 AS d, o_orderkey * 2 - 1 AS t FROM orders", "SELECT o_orderkey, o_orderkey / 4 AS q, ((-o_orderkey % 7) + 7) % 7 AS m, o_orderkey // 3 AS d, o_orderkey * 2 - 1 AS t FROM orders")
add("divide_by_zero", "SELECT x, 1 / x AS q FROM (VALUES (2), (0), (NULL)) AS v(x)", "SELECT x, CASE WHEN x = 0 THEN 'inf'::DOUBLE ELSE 1 / x END AS q FROM (VALUES (2), (0), (NULL)) AS v(x)")
add("ip_in_cidr", "SELECT a, a | '10.0.0.0/8' AS big, a | '10.1.2.0/24' AS small FROM (VALUES ('10.1.2.3'), ('10.200.0.1'), ('192.168.0.1'), (NULL)) AS v(a)", "SELECT a, coalesce(a LIKE '10.%', false) AS big, coalesce(a LIKE '10.1.2.%', false) AS small FROM (VALUES ('10.1.2.3'), ('10.200.0.1'), ('192.168.0.1'), (NULL)) AS v(a)")
add("case_forms", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS b FROM orders")
add("literals", "SELECT 0x1F AS h, 10_000 AS n, 1.5 AS d, 'it''s' AS s, \"quoted\" AS q, TRUE AS t", "SELECT 31 AS h, 10000 AS n, 1.5::DOUBLE AS d, 'it''s' AS s, 'quoted' AS q, TRUE AS t")
# joins
add("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
add("join_left_right_full", "SELECT a.x, b.y FROM (VALUES (1), (2), (NULL)) AS a(x) FULL OUTER JOIN (VALUES (2), (3), (NULL)) AS b(y) ON a.x = b.y")
add("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
add("join_right", "SELECT c.c_custkey, o.o_orderkey FROM orders AS o RIGHT OUTER JOIN customer AS c ON c.c_custkey = o.o_custkey")
add("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("join_cross", "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n")
add("join_implicit", "SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey")
add("join_using", "SELECT k, a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(k, a) INNER JOIN (VALUES (2, 'z'), (3, 'w')) AS u(k, b) USING (k)")
add("join_natural", "SELECT k, a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(k, a) NATURAL JOIN (VALUES (2, 'z'), (3, 'w')) AS u(k, b)")
add("join_theta", "SELECT a.r_name AS low, b.r_name AS high FROM region AS a INNER JOIN region AS b ON a.r_regionkey < b.r_regionkey")
add("join_residual", "SELECT COUNT(*) AS n FROM orders AS o INNER JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate")
add("join_five", "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey INNER JOIN lineitem AS l ON l.l_orderkey = o.o_orderkey INNER JOIN supplier AS s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey INNER JOIN nation AS n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n.n_name, COUNT(*) AS n, round_even(SUM(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM customer AS c INNER JOIN orders AS o ON c.c_custkey = o.o_custkey INNER JOIN lineitem AS l ON l.l_orderkey = o.o_orderkey INNER JOIN supplier AS s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey INNER JOIN nation AS n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
add("unnest_cross", "SELECT l.event_id, w FROM events AS l CROSS JOIN UNNEST(SPLIT(l.event_type, 'i')) AS w", "SELECT event_id, unnest(string_split(event_type, 'i')) AS w FROM events")
add("in_unnest_any_all", "SELECT k, 2 = ANY(v) AS e, 2 != ANY(v) AS n, 2 > ANY(v) AS g, 2 = ALL(v) AS a, k IN UNNEST(v) AS i FROM (SELECT 1 AS k, ARRAY[1, 2] AS v UNION ALL SELECT 2, ARRAY[2, 2] UNION ALL SELECT 3, NULL) AS t", "SELECT * FROM (VALUES (1, true, true, true, false, true), (2, true, false, false, true, true), (3, false, false, false, false, false)) AS t(k, e, n, g, a, i)")
add("array_contains_ops", "SELECT k, v @> (1, 5) AS part, v @>> (1, 2) AS whole, ARRAY_CONTAINS(v, 3) AS has FROM (SELECT 1 AS k, ARRAY[1, 2, 3] AS v UNION ALL SELECT 2, ARRAY[5] UNION ALL SELECT 3, NULL) AS t", "SELECT * FROM (VALUES (1, true, true, true), (2, true, false, false), (3, false, false, false)) AS t(k, part, whole, has)")
# aggregates
add("agg_group_by", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 0) AS sum_base, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, round_even(SUM(l_extendedprice), 0) AS sum_base, round_even(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus")
add("agg_filter_distinct", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 50) AS big, COUNT_DISTINCT(user_id) AS users, COUNT(DISTINCT event_type) AS kinds FROM events")
Q["agg_filter_distinct"] = (Q["agg_filter_distinct"][0], "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE value > 50) AS big, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT event_type) AS kinds FROM events")
add("agg_population", "SELECT o_orderstatus, ROUND(STDDEV(o_totalprice), 3) AS sd, ROUND(VARIANCE(o_totalprice) / 1000000, 3) AS var, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round_even(stddev_pop(o_totalprice), 3) AS sd, round_even(var_pop(o_totalprice) / 1000000, 3) AS var, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")
add("agg_bool", "SELECT user_id, ALL(value > 1) AS every, ANY(value > 99) AS some FROM events GROUP BY user_id", "SELECT user_id, bool_and(value > 1) AS every, bool_or(value > 99) AS some FROM events GROUP BY user_id")
add("agg_array", "SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_orderkey LIMIT 3) AS first3 FROM orders GROUP BY o_custkey", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:3] AS first3 FROM orders GROUP BY o_custkey")
add("agg_array_desc", "SELECT o_orderstatus, ARRAY_AGG(DISTINCT o_orderpriority ORDER BY o_orderpriority DESC) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, list(DISTINCT o_orderpriority ORDER BY o_orderpriority DESC) AS p FROM orders GROUP BY o_orderstatus")
add("agg_min_max", "SELECT s.k, s.r.min AS low, s.r.max AS high FROM (SELECT o_orderstatus AS k, MIN_MAX(o_orderkey) AS r FROM orders GROUP BY o_orderstatus) AS s", "SELECT o_orderstatus AS k, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM orders GROUP BY o_orderstatus")
add("agg_product", "SELECT l_orderkey, ROUND(PRODUCT(l_linenumber), 0) AS p FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, round_even(product(l_linenumber), 0) AS p FROM lineitem GROUP BY l_orderkey")
add("agg_group_all", "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY ALL", "SELECT p_brand, p_size::BIGINT AS p_size, COUNT(*) AS n FROM part GROUP BY ALL")
add("agg_ordinal_having", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1 HAVING COUNT(*) > 10")
add("agg_expression_key", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)")
add("agg_median", "SELECT o_orderstatus, APPROXIMATE_MEDIAN(o_totalprice) AS m FROM orders GROUP BY o_orderstatus", None)
add("agg_histogram_one", "SELECT HISTOGRAM(l_quantity) AS h, ONE(l_returnflag) AS f FROM lineitem", None)
# sort, limit, distinct, sets
add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7")
add("nulls_last", "SELECT x FROM (VALUES (2), (NULL), (1)) AS v(x) ORDER BY x DESC LIMIT 2")
add("union_all", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("cte_derived", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT COUNT(*) AS n FROM (SELECT o_custkey FROM big WHERE t > 500000) AS d")
# strings
add("str_case", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, REVERSE(c_name) AS r, LEFT(c_name, 3) AS a, RIGHT(c_name, 2) AS b, LEFT(c_name, -1) AS m FROM customer", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, REVERSE(c_name) AS r, LEFT(c_name, 3) AS a, RIGHT(c_name, 2) AS b, LEFT(c_name, -1) AS m FROM customer")
add("str_title", "SELECT TITLE(s) AS t, INITCAP(s) AS i FROM (VALUES ('hello world-foo o''neil 1st'), (''), (NULL)) AS v(s)", "SELECT * FROM (VALUES ('Hello World-Foo O''Neil 1St', 'Hello World-Foo O''Neil 1st'), ('', ''), (NULL, NULL)) AS v(t, i)")
add("str_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS a, CONCAT(c_name, '-', c_mktsegment) AS b, CONCAT_WS(':', c_name, c_mktsegment) AS c, CONCAT(SPLIT(c_name, '#')) AS d FROM customer", "SELECT c_custkey, c_name || '/' || c_mktsegment AS a, c_name || '-' || c_mktsegment AS b, c_name || ':' || c_mktsegment AS c, replace(c_name, '#', '') AS d FROM customer")
add("str_cut", "SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS a, SUBSTRING(p_name FROM 3) AS b, POSITION('a' IN p_name) AS p, REPLACE(p_name, 'a', 'AA') AS r, REGEXP_REPLACE(p_type, '(A)(.)', '\\2\\1') AS x FROM part", "SELECT p_partkey, substring(p_name, 2, 4) AS a, substring(p_name, 3) AS b, position('a' IN p_name)::BIGINT AS p, replace(p_name, 'a', 'AA') AS r, regexp_replace(p_type, '(A)(.)', '\\2\\1', 'g') AS x FROM part")
add("str_pad_trim", "SELECT LPAD(s, 5, '*') AS l, RPAD(s, 5, '*') AS r, TRIM(s) AS t, LTRIM(s) AS a, RTRIM(s) AS b, TRIM(BOTH 'x' FROM s) AS x FROM (VALUES ('abcdefg'), ('  a'), ('xyx')) AS v(s)", "SELECT * FROM (VALUES ('abcdefg', 'abcdefg', 'abcdefg', 'abcdefg', 'abcdefg', 'abcdefg'), ('**  a', '  a**', 'a', 'a', '  a', '  a'), ('**xyx', 'xyx**', 'xyx', 'xyx', 'xyx', 'y')) AS v(l, r, t, a, b, x)")
add("str_distance", "SELECT n_name, LEVENSHTEIN(n_name, 'NATION_1') AS d, STARTS_WITH(n_name, 'N') AS s, ENDS_WITH(n_name, '1') AS e, ASCII(LEFT(n_name, 1)) AS a, CHAR(8364) AS c FROM nation", "SELECT n_name, levenshtein(n_name, 'NATION_1')::INTEGER AS d, starts_with(n_name, 'N') AS s, ends_with(n_name, '1') AS e, ascii(left(n_name, 1))::BIGINT AS a, chr(8364) AS c FROM nation")
add("str_hash", "SELECT c_custkey, MD5(c_name) AS m, SHA1(c_name) AS s1, SHA256(c_name) AS s2 FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
add("str_sha", "SELECT r_name, SHA224('abc') AS a, SHA384('abc') AS b, SHA512('abc') AS c FROM region WHERE r_regionkey = 0", "SELECT r_name, '23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7' AS a, 'cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7' AS b, 'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f' AS c FROM region WHERE r_regionkey = 0")
add("get_element", "SELECT GET(s, 1) AS a, GET(s, -1) AS b, GET(s, 9) AS c FROM (VALUES ('xyz')) AS v(s)", "SELECT 'y' AS a, 'z' AS b, NULL::VARCHAR AS c")
add("str_encode", "SELECT c_custkey, BASE64_ENCODE(c_name) AS b, HEX_ENCODE(c_name) AS h, HEX_DECODE(HEX_ENCODE(c_name)) AS x, BASE64_DECODE(BASE64_ENCODE(c_name)) AS y, BASE85_DECODE(BASE85_ENCODE(c_name)) AS z FROM customer", "SELECT c_custkey, base64(c_name::BLOB) AS b, hex(c_name) AS h, c_name AS x, c_name AS y, c_name AS z FROM customer")
add("str_split", "SELECT event_id, SPLIT(event_type, 'c') AS p, LENGTH(SPLIT(event_type, 'c')) AS n FROM events", "SELECT event_id, string_split(event_type, 'c') AS p, len(string_split(event_type, 'c')) AS n FROM events")
add("str_humanize", "SELECT HUMANIZE(x) AS h FROM (VALUES (950), (12), (1200000), (2500000000)) AS v(x)", "SELECT * FROM (VALUES ('1.0 thousand'), ('12'), ('1.2 million'), ('2.5 billion')) AS v(h)")
add("text_match", "SELECT conv_id, turn FROM conversations WHERE MATCH (text) AGAINST ('whi')", """SELECT conv_id, turn FROM conversations WHERE list_contains(list_transform(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+'), lambda t: CASE WHEN length(t) > 3 THEN regexp_replace(t, '([^s])s$', '\\1') ELSE t END), 'whi')""")
add("text_cosine", "SELECT doc_id, ROUND(COSINE_SIMILARITY(text, 'the and of'), 4) AS c FROM documents", None)
add("str_random", "SELECT RANDOM() AS a, NORMAL() AS b, RANDOM_STRING(8) AS c, HASH(r_name) AS h FROM region", None)
# types
add("casts", "SELECT CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS INTEGER) AS i, CAST('12' AS INTEGER) AS n, TRY_CAST('x' AS INTEGER) AS bad, CAST('2024-02-29' AS DATE) AS d, CAST(1 AS BOOLEAN) AS b, o_orderkey::DOUBLE AS f FROM orders", "SELECT o_orderkey::VARCHAR AS s, trunc(o_totalprice)::BIGINT AS i, 12::BIGINT AS n, NULL::BIGINT AS bad, DATE '2024-02-29' AS d, true AS b, o_orderkey::DOUBLE AS f FROM orders")
add("cast_decimal", "SELECT CAST(l_extendedprice AS DECIMAL(12, 2)) AS d, CAST(l_quantity AS DECIMAL(10, 1)) AS q FROM lineitem")
add("try_functions", "SELECT TRY_INTEGER(s) AS i, TRY_DOUBLE(s) AS d, TRY_DATE(s) AS t, TRY_BOOLEAN(s) AS b FROM (VALUES ('12'), ('x'), ('2024-01-02'), ('true'), (NULL)) AS v(s)", "SELECT TRY_CAST(s AS BIGINT) AS i, TRY_CAST(s AS DOUBLE) AS d, TRY_CAST(s AS DATE) AS t, CASE WHEN s = 'true' THEN true END AS b FROM (VALUES ('12'), ('x'), ('2024-01-02'), ('true'), (NULL)) AS v(s)")
add("cast_array", "SELECT CAST(v AS ARRAY<INTEGER>) AS a FROM (SELECT ARRAY['1', '2', NULL] AS v) AS t", "SELECT [1, 2]::BIGINT[] AS a")
# numbers
add("num_round", "SELECT ROUND(x) AS r, ROUND(x, 1) AS r1, FLOOR(x) AS f, CEIL(x) AS c, TRUNC(x) AS t, ABS(x) AS a, SIGN(x) AS s FROM (VALUES (2.5), (-2.5), (3.25), (-0.75)) AS v(x)", "SELECT round_even(x, 0) AS r, round_even(x, 1) AS r1, floor(x) + 0 AS f, ceil(x) + 0 AS c, trunc(x) + 0 AS t, abs(x) AS a, sign(x)::DOUBLE AS s FROM (VALUES (2.5::DOUBLE), (-2.5::DOUBLE), (3.25::DOUBLE), (-0.75::DOUBLE)) AS v(x)")
add("num_log", "SELECT o_orderkey, ROUND(LN(o_totalprice), 6) AS l, ROUND(LOG10(o_totalprice), 6) AS t, ROUND(LOG2(o_totalprice), 6) AS b, ROUND(LOG(o_totalprice, 3), 6) AS c, ROUND(SQRT(o_totalprice), 6) AS s, ROUND(PI() + E() + PHI(), 6) AS k, POWER(2, 5) AS p FROM orders", "SELECT o_orderkey, round_even(ln(o_totalprice), 6) AS l, round_even(log10(o_totalprice), 6) AS t, round_even(log2(o_totalprice), 6) AS b, round_even(ln(o_totalprice) / ln(3), 6) AS c, round_even(sqrt(o_totalprice), 6) AS s, round_even(pi() + exp(1) + 1.618033988749895, 6) AS k, 32.0::DOUBLE AS p FROM orders")
add("array_functions", "SELECT vec_id, GREATEST(embedding) AS hi, LEAST(embedding) AS lo, embedding[0] AS f, LENGTH(embedding) AS n, embedding[99] AS none FROM embeddings", "SELECT vec_id, list_max(embedding) AS hi, list_min(embedding) AS lo, embedding[1] AS f, len(embedding) AS n, NULL::FLOAT AS none FROM embeddings")
# dates
add("date_parts", "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS mo, DAY(ts) AS d, HOUR(ts) AS h, MINUTE(ts) AS mi, WEEK(ts) AS w, QUARTER(ts) AS q, EXTRACT(dow FROM ts) AS dow, DATEPART('doy', ts) AS doy, DATEPART('century', ts) AS c, EXTRACT(isoyear FROM ts) AS iy FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, week(ts) AS w, quarter(ts) AS q, isodow(ts) - 1 AS dow, dayofyear(ts) AS doy, year(ts) // 100 + 1 AS c, isoyear(ts) AS iy FROM events")
add("date_trunc", "SELECT event_id, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('week', ts) AS w, DATE_TRUNC('month', ts) AS m FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('month', ts)::TIMESTAMP AS m FROM events")
add("time_bucket", "SELECT TIME_BUCKET(ts, 15, 'minute') AS b, COUNT(*) AS n, ROUND(AVG(value), 6) AS v FROM events GROUP BY TIME_BUCKET(ts, 15, 'minute')", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS b, COUNT(*) AS n, round_even(AVG(value), 6) AS v FROM events GROUP BY 1")
add("date_diff", "SELECT o_orderkey, DATEDIFF('day', o_orderdate, TIMESTAMP '2002-01-01 12:00:00') AS d, DATEDIFF('hour', o_orderdate, TIMESTAMP '2002-01-01 12:30:00') AS h, DATEDIFF('year', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') AS y, DATEDIFF('quarter', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') AS q, DATEDIFF('week', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') AS w FROM orders", "SELECT o_orderkey, datesub('day', o_orderdate, TIMESTAMP '2002-01-01 12:00:00') AS d, datesub('hour', o_orderdate, TIMESTAMP '2002-01-01 12:30:00') AS h, datediff('year', o_orderdate, TIMESTAMP '2002-01-01') AS y, datediff('quarter', o_orderdate, TIMESTAMP '2002-01-01') AS q, (DATE '2001-12-31' - date_trunc('week', o_orderdate)::DATE) // 7 AS w FROM orders")
add("date_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS a, o_orderdate - INTERVAL '36' HOUR AS b FROM orders WHERE o_orderdate > '2000-06-01'", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 36 HOUR AS b FROM orders WHERE o_orderdate > '2000-06-01'")
add("date_format", "SELECT event_id, DATE_FORMAT(ts, '%Y-%m-%d %H:%M') AS s, UNIXTIME(ts) AS u, FROM_UNIXTIME(UNIXTIME(ts)) AS r FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS s, floor(epoch(ts))::BIGINT AS u, date_trunc('second', ts)::TIMESTAMP AS r FROM events")
# conditions, JSON
add("conditions", "SELECT x, COALESCE(x, y) AS c, IFNULL(x, 9) AS i, IFNOTNULL(x, 7) AS n, NULLIF(x, 1) AS z, IIF(x > 1, 'hi', 'lo') AS f FROM (VALUES (1, 2), (NULL, 5), (3, NULL)) AS v(x, y)", "SELECT x, coalesce(x, y) AS c, ifnull(x, 9) AS i, CASE WHEN x IS NOT NULL THEN 7 END AS n, nullif(x, 1) AS z, CASE WHEN x > 1 THEN 'hi' ELSE 'lo' END AS f FROM (VALUES (1, 2), (NULL, 5), (3, NULL)) AS v(x, y)")
add("json_access", "SELECT event_id, props -> 'k' AS k, props ->> 'k' AS t, props @? 'k' AS has, props @? '$.z.y' AS no, JSONB_OBJECT_KEYS(props) AS keys, GET(props, 'k') AS g FROM events", "SELECT event_id, props ->> 'k' AS k, props ->> 'k' AS t, true AS has, false AS no, json_keys(props) AS keys, props ->> 'k' AS g FROM events")
add("json_null_path", "SELECT j, j @? 'a' AS a, j @? '$.b[1]' AS b1, j @? '$.b[2]' AS b2, j -> 'b' AS b FROM (VALUES ('{\"a\":null,\"b\":[1,2]}'), ('{}')) AS v(j)", "SELECT * FROM (VALUES ('{\"a\":null,\"b\":[1,2]}', true, true, false, '[1,2]'), ('{}', false, false, false, NULL)) AS v(j, a, b1, b2, b)")
add("search", "SELECT doc_id FROM documents WHERE SEARCH(text, 'the with')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the with')")
# table functions
add("generate_series", "SELECT g FROM GENERATE_SERIES(2, 20, 4) AS g", "SELECT generate_series::INTEGER::BIGINT AS g FROM generate_series(2, 20, 4)")
add("generate_dates", "SELECT d FROM GENERATE_SERIES('2024-01-30', '2024-02-03', '1d') AS d", "SELECT generate_series AS d FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)")
add("unnest_literal", "SELECT u FROM UNNEST((1, 2, 3)) AS u", "SELECT unnest([1, 2, 3]) AS u")
add("fake_rows", "SELECT COUNT(*) AS n FROM FAKE(100, 3) AS f", "SELECT 100::BIGINT AS n")
add("planets_as_of", "SELECT COUNT(*) AS n FROM $planets FOR '1800-01-01'", "SELECT 7::BIGINT AS n")
add("planets_join", "SELECT p.name, q.name AS next FROM $planets AS p INNER JOIN $planets AS q ON p.id + 1 = q.id", "SELECT * FROM (VALUES ('Mercury', 'Venus'), ('Venus', 'Earth'), ('Earth', 'Mars'), ('Mars', 'Jupiter'), ('Jupiter', 'Saturn'), ('Saturn', 'Uranus'), ('Uranus', 'Neptune'), ('Neptune', 'Pluto')) AS t(name, next)")
# statements
add("set_variable", "SET least = 30; SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > @@least", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 30")
add("show_columns", "SHOW COLUMNS FROM nation", "SELECT * FROM (VALUES ('n_nationkey', 'bigint', true), ('n_name', 'string', true), ('n_regionkey', 'bigint', true)) AS t(name, type, nullable)")
add("explain", "EXPLAIN SELECT COUNT(*) AS n FROM region", None)
add("visible_self_join", "SELECT COUNT(*) AS n FROM events AS a INNER JOIN events AS b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
add("time_series_gaps", "SELECT d.d AS day, COUNT(e.event_id) AS n FROM GENERATE_SERIES('2024-01-01', '2024-01-31', '1d') AS d LEFT JOIN events AS e ON DATE_TRUNC('day', e.ts) = d.d GROUP BY d.d", "SELECT d.day, COUNT(e.event_id) AS n FROM (SELECT generate_series AS day FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS d LEFT JOIN events AS e ON date_trunc('day', e.ts) = d.day GROUP BY d.day")
add("visible_glob", "SELECT COUNT(*) AS n FROM `./natio*.parquet`", "SELECT COUNT(*) AS n FROM nation")
# types, conversions, DISTINCT ON over tables
add("distinct_on_limit", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
add("typed_derived", "SELECT d.event_id, LENGTH(d.p) AS n, d.p[0] AS a, LENGTH(d.t) AS m FROM (SELECT event_id, SPLIT(event_type, 'c') AS p, event_type AS t FROM events) AS d ORDER BY LENGTH(d.p)", "SELECT event_id, len(string_split(event_type, 'c')) AS n, string_split(event_type, 'c')[1] AS a, length(event_type) AS m FROM events")
add("typed_by_alias", "SELECT l.c_custkey, LENGTH(l.v) AS a, LENGTH(r.v) AS b FROM (SELECT c_custkey, c_name AS v FROM customer) AS l INNER JOIN (SELECT c_custkey, SPLIT(c_name, '#') AS v FROM customer) AS r ON l.c_custkey = r.c_custkey", "SELECT c_custkey, length(c_name) AS a, len(string_split(c_name, '#')) AS b FROM customer")
add("coalesce_nan", "SELECT o_orderkey, COALESCE(t.x, -1.0) AS c FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS x FROM orders) AS t", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE -1.0::DOUBLE END AS c FROM orders")
add("double_text", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS s, CAST(POWER(2, o_orderkey % 70) AS VARCHAR) AS p, CAST(1 / POWER(2, o_orderkey % 30) AS VARCHAR) AS q FROM orders", "SELECT o_orderkey, o_totalprice::VARCHAR AS s, pow(2, o_orderkey % 70)::VARCHAR AS p, (1 / pow(2, o_orderkey % 30))::VARCHAR AS q FROM orders")
add("integer_timestamp", "SELECT event_id, CAST(event_id * 1000003 AS TIMESTAMP) AS t, INTEGER(CAST(event_id * 1000003 AS TIMESTAMP)) AS i, CAST(ts AS INTEGER) AS u FROM events", "SELECT event_id, make_timestamp(event_id * 1000003) AS t, event_id * 1000003 AS i, epoch_us(ts) AS u FROM events")
add("try_types", "SELECT event_id, TRY_TIMESTAMP(event_type) AS a, TRY_DECIMAL(props, 5, 2) AS b, TRY_VARCHAR(user_id) AS c, TRY_INTEGER(event_type) AS d, INT(user_id) AS e, PASSTHRU(event_type) AS f FROM events", "SELECT event_id, NULL::TIMESTAMP AS a, NULL::DECIMAL(5, 2) AS b, user_id::VARCHAR AS c, NULL::BIGINT AS d, user_id AS e, event_type AS f FROM events")
add("concat_tuple", "SELECT n_nationkey, CONCAT((n_name, '-', 'x')) AS a, CONCAT_WS('/', (n_name, n_name)) AS b FROM nation", "SELECT n_nationkey, n_name || '-x' AS a, n_name || '/' || n_name AS b FROM nation")
add("interval_ranges", "SELECT o_orderkey, o_orderdate + INTERVAL '1 6' DAY TO HOUR AS a, o_orderdate - INTERVAL '1-2' YEAR TO MONTH AS b FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 30 HOUR AS a, o_orderdate - INTERVAL 14 MONTH AS b FROM orders")
add("interval_compare", "SELECT event_id FROM events WHERE ts - TIMESTAMP '2024-01-01 00:00:00' > INTERVAL '10' DAY", "SELECT event_id FROM events WHERE ts - TIMESTAMP '2024-01-01 00:00:00' > INTERVAL 10 DAY")
add("seconds", "SELECT event_id, SECOND(ts) AS s, TIMEDIFF(TIMESTAMP '2024-01-01 00:00:00', ts) AS h, UNIXTIME(ts) AS u FROM events", "SELECT event_id, second(ts) AS s, datesub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS h, floor(epoch(ts))::BIGINT AS u FROM events")
add("array_any_all", "SELECT event_id, ARRAY_CONTAINS_ANY(SPLIT(event_type, 'i'), ARRAY['cl', 's']) AS a, ARRAY_CONTAINS_ALL(SPLIT(event_type, 'i'), ARRAY['cl', 'ck']) AS b, SPLIT(event_type, 'i') @> ('v', 'ck') AS c FROM events", "SELECT event_id, list_has_any(string_split(event_type, 'i'), ['cl', 's']) AS a, list_has_all(string_split(event_type, 'i'), ['cl', 'ck']) AS b, list_has_any(string_split(event_type, 'i'), ['v', 'ck']) AS c FROM events")
add("array_sort", "SELECT vec_id, SORT(embedding) AS s FROM embeddings", "SELECT vec_id, list_sort(embedding) AS s FROM embeddings")
add("agg_distinct_set", "SELECT t.k, SORT(t.p) AS p FROM (SELECT o_orderstatus AS k, DISTINCT(o_orderpriority) AS p FROM orders GROUP BY o_orderstatus) AS t", "SELECT o_orderstatus AS k, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY o_orderstatus")
add("signum_soundex", "SELECT o_orderkey, SIGNUM(o_totalprice - 100000) AS s, SOUNDEX(o_orderstatus) AS x FROM orders", "SELECT o_orderkey, sign(o_totalprice - 100000)::DOUBLE AS s, o_orderstatus || '000' AS x FROM orders")
add("json_string", "SELECT event_id, GET_STRING(props, 'k') AS k FROM events", "SELECT event_id, props ->> 'k' AS k FROM events")
add("in_table_array", "SELECT event_id, 'ck' = ANY(SPLIT(event_type, 'i')) AS a, 'ck' IN UNNEST(SPLIT(event_type, 'i')) AS b, event_type != ALL(SPLIT(event_type, 'i')) AS c FROM events", "SELECT event_id, list_contains(string_split(event_type, 'i'), 'ck') AS a, list_contains(string_split(event_type, 'i'), 'ck') AS b, NOT list_contains(string_split(event_type, 'i'), event_type) AS c FROM events")
add("planets_other_names", "SELECT name, escape_velocity, number_of_moons FROM $planets AS p FOR 1800-01-01 WHERE mean_temperature > 0", "SELECT * FROM (VALUES ('Mercury', 4.3::DOUBLE, 0), ('Venus', 10.4, 0), ('Earth', 11.2, 1)) AS t(name, escape_velocity, number_of_moons)")
# whole queries
add("priority_counts", "SELECT o_orderpriority, COUNT(*) AS n FROM orders LEFT SEMI JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' GROUP BY o_orderpriority ORDER BY o_orderpriority", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) GROUP BY o_orderpriority")
add("forecast_revenue", "SELECT ROUND(SUM(l_extendedprice * l_discount), 0) AS revenue FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24", "SELECT round_even(SUM(l_extendedprice * l_discount), 0) AS revenue FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24")
add("order_counts", "SELECT c.n AS orders, COUNT(*) AS customers FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS c GROUP BY c.n")


def run(name: str):
    statement = Q[name][0]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session(spark, sf_dir).sql(statement)

    return query


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(conf or f'file://{tempfile.gettempdir()}').rstrip('/')}/formats-{uuid.uuid4().hex}"


def stored(kind: str, table: str, **options):
    """A table of sf_dir written in another format, and read by its name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch(spark)
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.options(**options).format(kind).save(f"{root}/{table}")
        return Session(spark, root).sql(f"SELECT * FROM {table}")

    return query


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a date-partitioned tree; three days of it are read."""
    root = scratch(spark)
    day = F.date_format("ts", "'year_'yyyy'/month_'MM'/day_'dd")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", day)
    for n in range(1, 6):
        events.filter(F.col("day") == f"year_2024/month_01/day_0{n}").drop("day").write.parquet(f"{root}/events/year_2024/month_01/day_0{n}")
    return Session(spark, root).sql("SELECT event_id, ts FROM events FOR DATES BETWEEN '2024-01-02' AND '2024-01-04'")


def in_session(statement: str, **options):
    return lambda spark, sf_dir: Session(spark, sf_dir, **options).sql(statement)


#: Queries that need files or a session of their own, with their oracles.
MORE = {
    "format_orc": (stored("orc", "customer"), "SELECT * FROM customer"),
    "format_jsonl": (stored("json", "nation"), "SELECT * FROM nation"),
    "format_csv": (stored("csv", "part", header=True), "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part"),
    "dated_tree": (dated, "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'"),
    "view": (in_session("SELECT COUNT(*) AS n, SUM(t) AS t FROM big", views={"big": "SELECT o_custkey, COUNT(*) AS t FROM orders GROUP BY o_custkey"}), "SELECT COUNT(*) AS n, SUM(t)::BIGINT AS t FROM (SELECT COUNT(*) AS t FROM orders GROUP BY o_custkey)"),
    "execute_prepared": (in_session("EXECUTE dear(least = 1e5, mark = 'F')", prepared={"dear": "SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :mark"}), "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'"),
    "visible_rows": (in_session("SELECT n_name, r_name FROM nation.parquet AS n INNER JOIN `./region.parquet` AS r ON n_regionkey = r_regionkey", visible={"region": [["r_regionkey = 1"], ["r_regionkey > 2", "r_regionkey < 4"]]}), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3)"),
    "permitted": (in_session("SELECT COUNT(*) AS n FROM `./nation.parquet`", roles=("reader",), permissions=[("reader", "nat*")]), "SELECT COUNT(*) AS n FROM nation"),
}

QUERIES = {**{name: run(name) for name in Q}, **{name: q for name, (q, _) in MORE.items()}}
ORACLE_SQL = {**{name: o for name, (_, o) in Q.items() if o is not None}, **{name: o for name, (_, o) in MORE.items()}}
