"""Sessions: relations, variables, views, permissions, and statements."""

from __future__ import annotations

import datetime as dt
import fnmatch
import io
import json
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomquery.errors import NotAllowed, QueryError, UnknownRelation, UnsupportedSyntax
from loomquery.functions import library, vector
from loomquery.plans import explain
from loomquery.plans.dialect import Span, Token, Translator, statements, tokenize
from loomquery.plans.temporal import days_of
from loomquery.sources import files, virtual

KINDS = {"ArrayType": "array", "TimestampType": "timestamp", "TimestampNTZType": "timestamp", "DateType": "date", "StringType": "string", "DoubleType": "double", "FloatType": "double", "LongType": "integer", "IntegerType": "integer", "ShortType": "integer", "ByteType": "integer"}
#: Translations until the types of nested queries are known; each knows one level more.
PASSES = 12


class Session:
    """Runs the dialect on a Spark session.

    views: name -> SQL. prepared: name -> SQL with :parameters. permissions:
    [(role, table glob)], where roles name this session's. visible: table ->
    conditions, any of which (each a list of ANDed conditions) shows a row. Both
    hold for what a name stands for, so by whatever path, glob or case it is read.
    strict: reject what only Spark adds to the dialect. samples: a folder with the
    sample relations' files. fetch: gives the bytes that HTTP('url') reads; without
    it, HTTP is an error, so no statement reaches a network by itself.
    """

    def __init__(
        self, spark: SparkSession, root: str = ".", views: dict[str, str] | None = None, prepared: dict[str, str] | None = None, roles: tuple[str, ...] = (), permissions: list[tuple[str, str]] | None = None,
        visible: dict[str, list[list[str]]] | None = None, strict: bool = False, today: dt.date | None = None, samples: str | None = None, fetch: Callable[[str], bytes] | None = None,
    ):
        self.spark, self.root, self.strict = spark, root.rstrip("/"), strict
        self.views, self.prepared = dict(views or {}), {k.lower(): v for k, v in (prepared or {}).items()}
        self.roles, self.permissions, self.visible = roles, permissions, {k.lower(): v for k, v in (visible or {}).items()}
        self.samples = samples or f"{self.root}/samples"
        self.started, self.executed = time.time(), 0
        self.today = today or dt.datetime.now(dt.UTC).date()
        self.variables: dict[str, object] = {}
        self.frames: dict[str, DataFrame] = {}
        self.stores: dict[str, Callable[[str], DataFrame]] = {}
        self.catalogs: dict[str, str] = {}
        self.fetch = fetch
        self.n = 0
        self._views: list[str] = []
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # timestamps have no zone here
        vector.register(spark)

    # relations
    def register(self, name: str, frame) -> None:
        """A DataFrame, pandas frame or Arrow table under a name."""
        if isinstance(frame, pa.Table):
            frame = self.spark.createDataFrame(frame)
        elif not isinstance(frame, DataFrame):
            frame = self.spark.createDataFrame(frame)
        self.frames[name.lower()] = frame

    def register_store(self, prefix: str, reader: Callable[[str], DataFrame], remove_prefix: bool = False) -> None:
        """Relations whose names begin with ``prefix.`` come from reader(name)."""
        self.stores[prefix.lower()] = (lambda n: reader(n[len(prefix) + 1 :])) if remove_prefix else reader

    def jdbc(self, prefix: str, url: str, **options: str) -> None:
        """Tables of a database; Spark pushes columns, filters and limits to it."""
        self.register_store(prefix, lambda t: self.spark.read.format("jdbc").options(url=url, dbtable=t, **options).load(), True)

    def catalog(self, prefix: str, catalog: str) -> None:
        """Tables of a Spark catalog, as an Iceberg one; FOR a day reads the table as it was at the end of that day."""
        self.catalogs[prefix.lower()] = catalog

    def relation(self, name: str, span: Span | None = None) -> DataFrame:
        """The rows of a relation that this session may see.

        Permissions and conditions go by identities. A read that reaches several
        relations, or a part of one, is refused if one of them has conditions.
        """
        df, paths = self._read(name, span)
        ids = identities(self.spark, self.root, paths) if paths and (self.permissions is not None or self.visible) else {name.lower()}
        for one in ids if self.permissions is not None else ():
            if not any(role in self.roles and fnmatch.fnmatchcase(one, glob.lower()) for role, glob in self.permissions):
                raise NotAllowed(f"no role of this session may read {name}")
        held = {k for k in self.visible if any(one == k or one.startswith(f"{k}.") or k.startswith(f"{one}.") or not one for one in ids)}
        if held and ids != held:
            raise NotAllowed(f"{name} reaches {', '.join(sorted(held))}, whose rows have conditions; read it by its own name")
        for k in held:
            shown = F.lit(False)
            for every in self.visible[k]:
                one = F.lit(True)
                for c in every:
                    one = one & F.expr(c)
                shown = shown | one
            df = df.filter(shown)
        return df

    def _read(self, name: str, span: Span | None) -> tuple[DataFrame, list[str]]:
        """A relation, and the paths or globs that it was read from."""
        low = name.lower()
        days = days_of(span.words, self.today) if span else None
        if low in self.frames:
            return self.frames[low], []
        if m := re.fullmatch(r"FAKE\((.*)\)", name, re.S):
            return self._fake(m[1].split(chr(31))), []
        if m := re.fullmatch(r"HTTP\((.*)\)", name, re.S):
            return self._http(library.literal(m[1])), []
        if low.startswith("$"):
            return self._virtual(low, days), []
        prefix = low.split(".")[0]
        if prefix in self.catalogs:
            reader = self.spark.read
            if days:
                end = dt.datetime.combine(days[1], dt.time.max, dt.UTC)
                reader = reader.option("as-of-timestamp", int(end.timestamp() * 1000))
            return files.flat(reader.table(f"{self.catalogs[prefix]}.{name[len(prefix) + 1 :]}")), []
        if prefix in self.stores:
            return self.stores[prefix](name), []
        if "://" in name or "/" in name or re.search(r"\.(\w+)$", name) and name.rsplit(".", 1)[-1].lower() in files.FORMATS:
            if ".." in name.split("/"):
                raise QueryError("a path can't leave its folder")
            tried = [name if "://" in name or name.startswith("/") else f"{self.root}/{name}"]
        else:
            tried = [f"{self.root}/{name.replace('.', '/')}", f"{self.root}/{name}.parquet"]
        for path in tried:
            if (first := files.first_file(self.spark, path)) is None:
                continue
            if (tree := files.tree_of(first)) is None:
                return files.load(self.spark, [path], first.rsplit(".", 1)[-1]), [path]
            found = files.days_between(self.spark, tree, *(days or (self.today, self.today)))
            if not found:
                raise UnknownRelation(f"{name} has no data on these days")
            return files.load(self.spark, found), [path]
        raise UnknownRelation(f"no relation {name}")

    def _virtual(self, name: str, days) -> DataFrame:
        if name == "$planets":
            return virtual.planets(self.spark, days[1] if days else None)
        if name == "$no_table":
            return virtual.no_table(self.spark)
        if name == "$derived":
            return self.spark.range(1).select()
        if name == "$variables":
            return virtual.variables(self.spark, self.variables, self.roles)
        if name == "$stop_words":
            return virtual.stop_words(self.spark)
        if name == "$user":
            return self.spark.createDataFrame([("role", r, "VARCHAR") for r in self.roles], "attribute string, value string, type string")
        if name == "$statistics":
            values = {"queries_executed": self.executed, "uptime_seconds": time.time() - self.started}
            return self.spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")
        if name in virtual.SAMPLES:
            path = f"{self.samples}/{name[1:]}.parquet"
            if files.first_file(self.spark, path) is None:
                raise UnknownRelation(f"{name} is read from {path}, with the columns {virtual.SAMPLES[name]}")
            return virtual.sample(files.load(self.spark, [path], "parquet"), name)
        raise UnknownRelation(f"no relation {name}")

    def _http(self, url: str | None) -> DataFrame:
        """A file of a web server, decoded by its ending on the driver: for small ones."""
        if not url or not re.match(r"https?://", url):
            raise QueryError("HTTP takes the literal address of a file")
        if self.fetch is None:
            raise NotAllowed("this session fetches nothing; give it fetch")
        kind = re.search(r"\.(\w+)$", re.sub(r"[?#].*", "", url))
        if not kind:
            raise QueryError(f"{url} does not say its format by its ending")
        return files.flat(self.spark.createDataFrame(files.decoded(self.fetch(url), kind[1])))

    def _fake(self, args: list[str]) -> DataFrame:
        """Random rows: a number of long columns, or a list of types."""
        rows = int(args[0])
        kinds = re.findall(r"[A-Za-z]+", args[1]) if not args[1].isdigit() else ["INTEGER"] * int(args[1])
        make = {"INTEGER": "CAST(rand({0}) * 1000000 AS BIGINT)", "DOUBLE": "rand({0})", "VARCHAR": "substr(sha2(CAST(rand({0}) AS STRING), 256), 1, 16)", "BOOLEAN": "rand({0}) < 0.5", "DATE": "date_add(DATE'2000-01-01', CAST(rand({0}) * 9000 AS INT))", "TIMESTAMP": "timestamp_ntz'2000-01-01' + make_dt_interval(CAST(rand({0}) * 9000 AS INT))", "NAME": "concat('name ', CAST(rand({0}) * 1000 AS INT))", "AGE": "CAST(18 + rand({0}) * 60 AS BIGINT)"}
        return self.spark.range(rows).select(*(F.expr(make[k.upper()].replace("{0}", str(i + 1))).alias(f"column_{i}") for i, k in enumerate(kinds)))

    # statements
    def translate(self, sql: str, expand: tuple[str, ...] = (), params: dict | None = None) -> str:
        """The Spark SQL of one query; its relations become temporary views."""

        def resolve(name: str, span: Span | None) -> str:
            if name in self.views and name not in expand:
                return f"({self.translate(self.views[name], (*expand, name), params)})"
            if (name, span) not in made:
                df = self.relation(name, span)
                self.n += 1
                made[name, span] = view = f"_loom_{id(self)}_{self.n}"
                df.createOrReplaceTempView(view)
                self._views.append(view)
                renames.update(virtual.ALIASES.get(name.lower(), {}))
            named = f"(SELECT * FROM {made[name, span]})"
            return named if "(" in name else f"{named} AS `{name}`"

        def variable(name: str) -> str:
            v = virtual.value_of(self.variables, name, self.roles)
            if isinstance(v, (list, tuple)):
                return f"array({', '.join(map(library.quoted, v))})" if v else "CAST(array() AS ARRAY<STRING>)"
            return library.quoted(v) if isinstance(v, str) else "NULL" if v is None else str(v)

        def typed(query: str) -> str:
            if query not in kinds:
                try:
                    kinds[query] = KINDS.get(type(self.spark.sql(query, args=params).schema[0].dataType).__name__, "other")
                except (AnalysisException, ParseException):  # not known yet, or not over these relations
                    return ""
            return kinds[query]

        made: dict[tuple, str] = {}
        renames: dict[str, str] = {}
        kinds: dict[str, str] = {}
        text, sources, used = None, {}, {}
        for _ in range(PASSES):
            t = Translator(sql, resolve, typed, variable, self.strict, sources, used)
            out = t.statement()
            same, text, sources = out == text, out, t.found
            if same or not t.asked and used == renames:
                break
            used = dict(renames)
        return _single_alias(text)

    def sql(self, text: str, params: list | dict | None = None) -> DataFrame:
        """Run statements; the last one's rows."""
        out = None
        try:
            for s in statements(text):
                out = self._one(s, params)
                self.executed += 1
        finally:  # a plan that was analysed needs its views no more
            for view in self._views:
                self.spark.catalog.dropTempView(view)
            self._views = []
        if out is None:
            raise QueryError("nothing to run")
        return out

    def _one(self, s: str, params: list | dict | None) -> DataFrame:
        t = tokenize(s)
        word = t[0].up
        if word in ("SELECT", "WITH", "VALUES") or t[0].text == "(":
            if params and not isinstance(params, dict):
                params = {f"_p{i}": v for i, v in enumerate(params)}
            q = self.translate(s, params=params)
            return self.spark.sql(q, args=params) if params else self.spark.sql(q)
        if word == "EXPLAIN":
            rest, analyze, form = s[t[0].end :].strip(), False, "TEXT"
            if m := re.match(r"ANALYZE\b", rest, re.I):
                rest, analyze = rest[m.end() :], True
            if m := re.match(r"\s*FORMAT\s+(\w+)", rest, re.I):
                form, rest = m[1].upper(), rest[m.end() :]
                if form not in ("TEXT", "MERMAID"):
                    raise UnsupportedSyntax(f"no format {m[1]}")
            return explain.explain(self._one(rest.strip(), params), analyze, form)
        if word == "SET" and len(t) >= 4:
            name = t[1].text.lstrip("@")
            if self.strict and not t[1].text.startswith("@") and name not in virtual.SYSTEM:
                raise QueryError(f"no variable {name}; a session's own begin with @")
            self.variables[name] = virtual.checked(name, literal_of([x.text for x in t[3:]]))
            return virtual.variables(self.spark, {name: self.variables[name]}, None)
        if word == "SHOW" and [x.up for x in t[1:4]] in (["EXTENDED", "COLUMNS", "FROM"], ["FULL", "COLUMNS", "FROM"]):
            name = "".join(x.text for x in t[4:]).strip("`")
            known = {v: k for k, v in virtual.ALIASES.get(name.lower(), {}).items()}
            rows = [(f.name, f.dataType.simpleString(), f.nullable, known.get(f.name)) for f in self.relation(name).schema.fields]
            return self.spark.createDataFrame(rows, "name string, type string, nullable boolean, alias string")
        if word == "SHOW" and [x.up for x in t[1:3]] == ["COLUMNS", "FROM"]:
            df = self.relation("".join(x.text for x in t[3:]).strip("`"))
            return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "name string, type string, nullable boolean")
        if word == "SHOW" and [x.up for x in t[1:3]] == ["CREATE", "VIEW"]:
            name = t[3].text
            if name not in self.views:
                raise UnknownRelation(f"no view {name}")
            return self.spark.createDataFrame([(name, self.views[name])], "name string, statement string")
        if word == "SHOW" and [x.up for x in t[1:]] == ["VARIABLES"]:
            return virtual.variables(self.spark, self.variables, self.roles)
        if word == "SHOW" and len(t) == 2 and t[1].kind in ("word", "var"):
            name = t[1].text.lstrip("@")
            return virtual.variables(self.spark, {name: virtual.value_of(self.variables, name, self.roles)}, None)
        if word == "EXECUTE":
            name = t[1].text.lower()
            if name not in self.prepared:
                raise QueryError(f"no statement {name}")
            return self._one(self.prepared[name], arguments(t[2:]) or None)
        raise UnsupportedSyntax(f"{word} is not part of the dialect: queries, EXPLAIN, SET, SHOW and EXECUTE are")

    def arrow(self, text: str, params: list | dict | None = None, limit: int | None = None) -> pa.Table:
        df = self.sql(text, params)
        return (df.limit(limit) if limit is not None else df).toArrow()

    def arrow_batches(self, text: str, params: list | dict | None = None, batch: int = 10_000) -> Iterator[pa.RecordBatch]:
        """Rows as Arrow batches made on the executors, a partition at a time; one empty batch if there is none."""
        df = self.sql(text, params)
        names, n = df.columns, batch
        plain = df.toDF(*(f"c{i}" for i in range(len(names))))  # names may repeat
        schema = to_arrow_schema(plain.schema)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, n):
                    sink = io.BytesIO()
                    with pa.ipc.new_stream(sink, b.schema) as out:
                        out.write_batch(b.slice(i, n))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], ["b"])

        some = False
        for row in plain.mapInArrow(pack, "b binary").toLocalIterator() if names else ():
            for b in pa.ipc.open_stream(bytes(row[0])):
                some = True
                yield b.rename_columns(names)
        if not some:
            yield pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], names)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, **more) -> Session:
        """A session whose views.json, prepared_statements.json and permissions.json lie in a folder."""

        def read(name: str):
            p = Path(folder, name)
            return json.loads(p.read_text()) if p.exists() else None

        views = {k: v["statement"] for k, v in (read("views.json") or {}).items()}
        prepared = {k: v["statement"] for k, v in (read("prepared_statements.json") or {}).items()}
        rows = read("permissions.json")
        allowed = [(r["role"], r["table"]) for r in rows] if rows else None
        return cls(spark, folder, views, prepared, permissions=allowed, **more)


def identities(spark: SparkSession, root: str, paths: list[str]) -> set[str]:
    """What paths and globs stand for: names below the root, with dots and in lower case; '' is the root itself.

    Any other place keeps its path. Files of one relation's folder are that relation.
    """
    base = files.qualified(spark, root)
    out = set()
    for path in paths:
        for p in files.matches(spark, path):
            inside = p == base or p.startswith(f"{base}/")
            name = re.sub(r"\.(%s)$" % "|".join(files.FORMATS), "", p[len(base) + 1 :], flags=re.I) if inside else p
            out.add(name.strip("/").replace("/", ".").lower() if inside else name)
    return out


def literal_of(words: list[str]) -> object:
    """The value of a literal's tokens."""
    text = "".join(words)
    if text[:1] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    if text.upper() in ("TRUE", "FALSE", "NULL"):
        return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
    try:
        return float(text) if re.search(r"[.eE]", text) else int(text.replace("_", ""))
    except ValueError:
        raise QueryError(f"{text} is no literal") from None


def arguments(t: list[Token]) -> dict[str, object]:
    """name = literal, ... between brackets."""
    out: dict[str, object] = {}
    inner = t[1:-1] if t and t[0].text == "(" and t[-1].text == ")" else t
    at = 0
    while at < len(inner):
        end = next((k for k in range(at, len(inner)) if inner[k].text == ","), len(inner))
        if end - at < 3 or inner[at + 1].text != "=":
            raise QueryError("EXECUTE takes name = literal")
        out[inner[at].text.strip("`")] = literal_of([x.text for x in inner[at + 2 : end]])
        at = end + 1
    return out


def _single_alias(q: str) -> str:
    """``(...) AS `a` AS `b` ``: the statement's own alias wins over the relation's name."""
    return re.sub(r"\) AS `[^`]*` AS (`[^`]*`)", r") AS \1", q)
