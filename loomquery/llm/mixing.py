"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only.

Leaves of a domain-language-source tree hold tokens (words between blanks). A
total budget is passed down: each node shares its budget among its children by
weight, up to what a child can give (its tokens times the epochs allowed). What
a child can't give goes to its siblings first, by weight; only what all of them
together can't give is missing at the parent, where the same rule has already
passed it to the parent's siblings. All amounts are whole tokens: shares are
rounded down.

A leaf's budget is met by whole epochs and the prefix of one more, in an order
seeded by epoch: documents in the order of md5(seed:epoch:doc_id:md5(text)), while
their running sum of tokens fits. The running sums are taken in buckets of the
order, so no task sees a whole leaf; what comes of them is one key a leaf, the
last that fits. A document is chosen by comparing its key with its leaf's, so
documents are never shuffled.

Defined results: null text has no tokens and the md5 of nothing; a null language
or source counts as the name ``(null)``, as a null id does; unlisted names have
weight 1, and weight 0 gets nothing. Exact repeats share a key, and are taken
together or not at all. An empty table gives an empty one. Columns of any name
are kept, but for those named like an added one, which wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.shared import checkpoint, discard, docs_of, fresh_path, written

WORDS = r"[^\x20\x09-\x0D]+"
LEAF = ["dom", "lng", "src"]
#: Leaves of some hundred bytes that may be broadcast.
SMALL = 100_000


def weight_of(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """nodes (parent..., key, w, cap, b: the parent's budget) with ``give``: water filling by weight.

    In the order of cap/w, a node is full while its cap is no more than its share
    of what is left; full nodes give all, the rest share what remains.
    """
    dec = lambda c: c.cast("decimal(19,0)")
    p = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = p.orderBy(F.col("cap") / F.col("w"), key).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.filter("w > 0").withColumn("s", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("u", F.sum("w").over(p) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    n = n.withColumn("full", dec(F.col("cap")) * dec(F.col("u")) <= dec(F.col("w")) * dec(F.col("b") - F.col("s")))
    n = n.withColumn("s", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(p)).withColumn("u", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(p))
    return n.withColumn("give", F.expr("CASE WHEN full THEN cap ELSE w * (b - s) DIV u END")).drop("s", "u", "full", "b")


def measured(docs: DataFrame, domain: Column, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(c0, c1, ... : the kept columns; dom, lng, src: the leaf; n: tokens; own: what the order goes by) of each document."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(null)"))
    own = F.concat_ws(":", name(F.col(doc_id)), F.md5(F.coalesce(F.col(text), F.lit(""))))
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), name(domain).alias("dom"), name(F.col(lang)).alias("lng"), name(F.col(source)).alias("src"), n.alias("n"), own.alias("own"))


def order_key(seed: int) -> Column:
    """A document's place in the epoch behind its leaf's whole ones."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.col("own")))


def budgets(rows: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """(dom, lng, src, epochs, last) of each leaf that gets tokens: whole epochs, and the last key of one more (null: none).

    rows: (dom, lng, src, n, own), a table that is read more than once.
    """
    leaf = checkpoint(rows.groupBy(*LEAF).agg(F.sum("n").alias("avail"), F.count("*").alias("rows")))
    sums = leaf.agg(F.coalesce(F.sum("avail"), F.lit(0)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
    total, count = sums["n"], sums["r"]
    leaf = leaf.withColumn("cap", F.col("avail") * max_epochs).withColumn("w", weight_of("src", weights.get("source", {})))
    langs = leaf.filter("w > 0").groupBy("dom", "lng").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of("lng", weights.get("lang", {})))
    domains = langs.filter("w > 0").groupBy("dom").agg(F.sum("cap").alias("cap")).withColumn("w", weight_of("dom", weights.get("domain", {})))
    got = share(domains.withColumn("b", F.lit(total * percent // 100)), [], "dom").select("dom", F.col("give").alias("b"))
    got = share(langs.join(got, "dom"), ["dom"], "lng").select("dom", "lng", F.col("give").alias("b"))
    got = share(leaf.join(got, ["dom", "lng"]), ["dom", "lng"], "src").filter("avail > 0 AND give > 0")
    got = checkpoint(got.select(*LEAF, F.expr("give DIV avail").alias("epochs"), F.expr("give % avail").alias("rest")))

    # the running sums of the epoch after the whole ones, in buckets of the keys' first bits
    place = [*LEAF, "b"]
    bits = max(8, math.ceil(math.log2(max(count, 1) / 65536)))
    keyed = rows.select(*LEAF, "n", "own")
    keyed = beside(keyed, got).withColumn("k", order_key(seed))
    keyed = keyed.withColumn("b", F.shiftright(F.conv(F.substring("k", 1, 8), 16, 10).cast("long"), 32 - bits))
    keyed = checkpoint(keyed.groupBy(*place, "k", "rest").agg(F.sum("n").alias("n")))
    before = Window.partitionBy(*LEAF).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*place, "rest").agg(F.sum("n").alias("t")).withColumn("t", F.coalesce(F.sum("t").over(before), F.lit(0)))
    run = F.col("t") + F.sum("n").over(Window.partitionBy(*place).orderBy("k"))
    fits = keyed.drop("rest").join(totals.filter("t <= rest"), place).withColumn("run", run).filter("run <= rest")
    return checkpoint(got.drop("rest").join(fits.groupBy(*LEAF).agg(F.max("k").alias("last")), LEAF, "left"))


def beside(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with what their leaf has; up to ``SMALL`` leaves are sent to the tasks, more are joined by a shuffle."""
    few = leaves.limit(SMALL + 1).count() <= SMALL
    return rows.join(F.broadcast(leaves) if few else leaves, LEAF)


def choose(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """rows of ``measured`` with ``copies``, without those that are not taken. leaves: one row for each source and language."""
    out = beside(rows, leaves)
    return out.withColumn("copies", F.col("epochs") + F.when(order_key(seed) <= F.col("last"), 1).otherwise(0)).filter("copies > 0")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], percent: int = 80, max_epochs: int = 2, seed: int = 7, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with ``mix_domain``, ``mix_tokens`` and ``mix_copies`` (times taken); rows not taken are left out.

    ``percent``: budget as a share of all tokens. ``weights``: by level (domain,
    lang, source) and name.
    """
    spark, names = docs.sparkSession, (text, doc_id, lang, source)
    path = fresh_path(spark, "measured")
    measured(docs, domain, *names).write.parquet(path)
    leaves = budgets(spark.read.parquet(path), weights, percent, max_epochs, seed)
    discard(spark, path)
    keep = [c for c in docs.columns if c.lower() not in ("mix_domain", "mix_tokens", "mix_copies")]
    out = choose(measured(docs, domain, *names, keep=tuple(keep)), leaves, seed)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), F.col("dom").alias("mix_domain"), F.col("n").alias("mix_tokens"), F.col("copies").alias("mix_copies"))


#: Production parameters of the registered query and of the pipeline.
DOMAINS = 4
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 1}}


def domain_of(source: str = "source") -> Column:
    """The number at the end of a source's name, modulo the number of domains."""
    number = F.coalesce(F.expr(f"try_cast(substr({source}, 4) AS BIGINT)"), F.lit(0))
    return F.concat(F.lit("d"), F.pmod(number, F.lit(DOMAINS)).cast("string"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The result has no text, so texts are read once, for what is measured of them."""
    keep = ("doc_id", "lang", "source")
    rows = written(measured(docs_of(spark, sf_dir), domain_of(), keep=keep), "measured")
    out = choose(rows, budgets(rows, WEIGHTS, 80, 2, 7), 7)
    return out.select(F.col("c0").alias("doc_id"), F.col("dom").alias("domain"), F.col("c1").alias("lang"), F.col("c2").alias("source"), F.col("n").alias("n_tokens"), F.col("copies"))


def _level(name: str, of: str, parent: str, key: str) -> str:
    by = f"PARTITION BY {parent} " if parent else ""
    at = f"OVER ({by}ORDER BY cap / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    own = f"OVER ({by.strip()})"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(cap) {at}, 0) AS s, sum(w) {own} - coalesce(sum(w) {at}, 0) AS u FROM {of} WHERE w > 0),
{name}_b AS (SELECT *, cap::HUGEINT * u <= w::HUGEINT * (b - s) AS filled FROM {name}_a),
{name}_c AS (SELECT * EXCLUDE (s, u), sum(CASE WHEN filled THEN cap ELSE 0 END) {own} AS s, sum(CASE WHEN filled THEN 0 ELSE w END) {own} AS u FROM {name}_b),
{name} AS (SELECT * EXCLUDE (b, s, u, filled), CASE WHEN filled THEN cap ELSE (w * (b - s)) // u END::BIGINT AS give FROM {name}_c),"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"


OP6_SQL = f"""
WITH t AS (
  SELECT doc_id, text, lang, source, 'd' || (coalesce(TRY_CAST(substr(source, 4) AS BIGINT), 0) % {DOMAINS}) AS d,
    coalesce(lang, '(null)') AS l, coalesce(source, '(null)') AS s0, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS n FROM documents),
leaf AS (SELECT d, l, s0, sum(n)::BIGINT AS avail, 2 * sum(n)::BIGINT AS cap, 1::BIGINT AS w FROM t GROUP BY ALL),
lang_n AS (SELECT d, l, sum(cap)::BIGINT AS cap, {_case("l", WEIGHTS["lang"])}::BIGINT AS w FROM leaf GROUP BY d, l),
dom_n AS (SELECT d, sum(cap)::BIGINT AS cap, {_case("d", WEIGHTS["domain"])}::BIGINT AS w FROM lang_n GROUP BY d),
dom_in AS (SELECT *, (SELECT sum(n) * 80 // 100 FROM t) AS b FROM dom_n),{_level("dom", "dom_in", "", "d")}
lang_in AS (SELECT lang_n.*, dom.give AS b FROM lang_n JOIN dom USING (d)),{_level("lng", "lang_in", "d", "l")}
leaf_in AS (SELECT leaf.*, lng.give AS b FROM leaf JOIN lng USING (d, l)),{_level("lef", "leaf_in", "d, l", "s0")}
o AS (
  SELECT t.*, give // avail AS epochs, give % avail AS rest, md5('7:' || (give // avail + 1) || ':' || coalesce(doc_id::VARCHAR, '(null)') || ':' || md5(coalesce(text, ''))) AS k
  FROM t JOIN lef USING (d, l, s0) WHERE avail > 0 AND give > 0),
r AS (SELECT *, sum(n) OVER (PARTITION BY d, l, s0 ORDER BY k) AS run FROM o)
SELECT doc_id, d AS domain, lang, source, n AS n_tokens, (epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r WHERE epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END > 0
"""
