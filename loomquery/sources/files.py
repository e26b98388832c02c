"""Files, directories, globs, and date-partitioned trees."""

from __future__ import annotations

import datetime as dt
import functools
import io
import lzma
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.csv
import pyarrow.json
import pyarrow.orc
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType, MapType, StructType

from loomquery.errors import QueryError, UnknownRelation

FORMATS = {"parquet": "parquet", "orc": "orc", "jsonl": "json", "json": "json", "ndjson": "json", "csv": "csv", "tsv": "csv", "psv": "csv", "arrow": "arrow", "ipc": "arrow", "feather": "arrow", "xz": "packed", "lzma": "packed", "zst": "packed", "zstd": "packed", "gz": "json", "avro": "avro", "xlsx": "xlsx"}
SEPARATORS = {"csv": ",", "tsv": "\t", "psv": "|"}
#: Control files, never read as data.
CONTROL = ("frame.complete", "frame.ignore", ".manifest", ".complete", ".ignore")


def walk(spark: SparkSession, path: str) -> Iterator[str]:
    """Files under a path or glob as Hadoop's file systems list them, a page at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    for s in fs.globStatus(p) or []:
        if s.isFile():
            yield s.getPath().toString()
        else:
            it = fs.listFiles(s.getPath(), True)
            while it.hasNext():
                yield it.next().getPath().toString()


def qualified(spark: SparkSession, path: str) -> str:
    """A path's full name in its file system, without . and links of a local one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    scheme, _, rest = full.partition(":")
    rest = posixpath.normpath("/" + rest.lstrip("/")) if not rest.startswith("//") or rest.startswith("///") else rest
    return f"file:{os.path.realpath(rest)}" if scheme == "file" else f"{scheme}:{rest}".rstrip("/")


def matches(spark: SparkSession, path: str) -> list[str]:
    """Full names of what a path or glob matches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return [qualified(spark, s.getPath().toString()) for s in found]


def is_data(path: str) -> bool:
    return not path.endswith(CONTROL) and not re.search(r"/[._][^/]*$", path)


def first_file(spark: SparkSession, path: str) -> str | None:
    """Any data file: its ending and folders tell how to read the rest."""
    return next(filter(is_data, walk(spark, path)), None)


def days_between(spark: SparkSession, tree: str, start: dt.date, end: dt.date) -> list[str]:
    """Files of a date-partitioned tree; only the folders of these days are listed."""
    out: list[str] = []
    for n in range((end - start).days + 1):
        day = start + dt.timedelta(days=n)
        out += walk(spark, f"{tree}/year_{day.year:04d}/month_{day.month:02d}/day_{day.day:02d}")
    return partitioned(sorted(out), start, end)


#: Schemas of single files, by name, length and time of change; so many at most.
KNOWN = 1000
_schemas: dict[tuple, StructType] = {}


def stamp_of(spark: SparkSession, paths: list[str]) -> tuple | None:
    """What tells whether a single file has changed; None for folders, globs and several files."""
    if len(paths) != 1 or re.search(r"[*?\[{]", paths[0]):
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return (s.getPath().toString(), s.getLen(), s.getModificationTime()) if s.isFile() else None


def load(spark: SparkSession, paths: list[str], kind: str | None = None) -> DataFrame:
    """Files, folders or globs of one format as one relation; columns that a file lacks are null there."""
    data = [p for p in paths if is_data(p)]
    if not data:
        raise UnknownRelation("no data files")
    kind = (kind or data[0].rsplit(".", 1)[-1]).lower()
    form = FORMATS.get(kind)
    if form is None:
        raise QueryError(f"no reader for .{kind} files")
    if form == "parquet":
        reader, stamp = spark.read.option("recursiveFileLookup", True), stamp_of(spark, data)
        if stamp in _schemas:  # an unchanged file: Spark needn't run a job for its footer
            reader = reader.schema(_schemas[stamp])
        out = reader.parquet(*data)
        if stamp:
            if len(_schemas) >= KNOWN:
                _schemas.clear()
            _schemas[stamp] = out.schema
    elif form == "orc":
        out = spark.read.option("recursiveFileLookup", True).orc(*data)
    elif form == "json":
        out = spark.read.option("recursiveFileLookup", True).json(data)
    elif form == "csv":
        out = spark.read.csv(data, sep=SEPARATORS[kind], header=True, inferSchema=True, multiLine=True, escape='"', recursiveFileLookup=True)
    elif form == "avro":
        out = spark.read.format("avro").option("recursiveFileLookup", True).load(data)
    elif form == "packed":  # compressed JSON lines that Hadoop has no codec for
        lines = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data).select("content").mapInArrow(_unpack, "value string")
        texts = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        out = DataFrame(spark._jsparkSession.read().json(texts), spark)
    else:
        opened = _sheet if form == "xlsx" else _open
        first = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data[0]).select("content").first()[0]
        schema = opened(bytes(first)).schema

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column(0):
                    yield from opened(content.as_py()).cast(schema).to_batches()

        out = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data).select("content").mapInArrow(read, from_arrow_schema(schema))
    return flat(out)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of xz or zstd files, a bounded number at a time."""
    for b in batches:
        for content in b.column(0):
            raw = io.BytesIO(content.as_py())
            if raw.getbuffer()[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            else:
                stream = lzma.open(raw)
            lines: list[str] = []
            for line in io.TextIOWrapper(stream, "utf-8"):
                if line.strip():
                    lines.append(line)
                if len(lines) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines = []
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def _open(raw: bytes) -> pa.Table:
    try:
        return pa.ipc.open_file(io.BytesIO(raw)).read_all()
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(io.BytesIO(raw)).read_all()


def _sheet(raw: bytes) -> pa.Table:
    """The first sheet of a workbook: its first row has the names; a column's cells have one type, or are text."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    tag = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    sheet = min((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    rows: list[dict[int, object]] = []
    for row in (e for e in ElementTree.fromstring(book.read(sheet)).iter() if tag(e) == "row"):
        cells: dict[int, object] = {}
        for n, c in enumerate(e for e in row if tag(e) == "c"):
            place = re.match(r"[A-Z]+", c.get("r", ""))
            at = functools.reduce(lambda k, x: k * 26 + ord(x) - 64, place[0], 0) - 1 if place else n
            value = next((v.text for v in c if tag(v) == "v"), None)
            kind = c.get("t", "n")
            if kind == "inlineStr":
                cells[at] = text(c)
            elif value is not None:
                cells[at] = shared[int(value)] if kind == "s" else value == "1" if kind == "b" else float(value) if kind == "n" else value
        rows.append(cells)
    names = rows[0] if rows else {}
    columns = {}
    for k, name in sorted(names.items()):
        values = [r.get(k) for r in rows[1:]]
        if len({type(v) for v in values if v is not None}) > 1:
            values = [None if v is None else str(v) for v in values]
        elif all(isinstance(v, float) and v.is_integer() for v in values if v is not None):
            values = [None if v is None else int(v) for v in values]
        columns[str(name)] = pa.array(values, None if any(v is not None for v in values) else pa.string())
    return pa.table(columns)


def decoded(raw: bytes, kind: str) -> pa.Table:
    """A file's bytes as a table, by its ending."""
    form = FORMATS.get(kind.lower())
    if form == "parquet":
        return pyarrow.parquet.read_table(io.BytesIO(raw))
    if form == "orc":
        return pyarrow.orc.ORCFile(io.BytesIO(raw)).read()
    if form == "csv":
        return pyarrow.csv.read_csv(io.BytesIO(raw), parse_options=pyarrow.csv.ParseOptions(delimiter=SEPARATORS[kind.lower()], newlines_in_values=True))
    if form == "json" and kind.lower() != "gz":
        return pyarrow.json.read_json(io.BytesIO(raw))
    if form in ("arrow", "xlsx"):
        return (_sheet if form == "xlsx" else _open)(raw)
    raise QueryError(f"no decoder for .{kind}")


def flat(df: DataFrame) -> DataFrame:
    """Structs as JSON text, small integers as long, floats as double: the types the dialect has."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        name = t.typeName()
        if isinstance(t, (StructType, MapType)):
            c = F.to_json(c).alias(f.name)
        elif isinstance(t, ArrayType) and isinstance(t.elementType, (StructType, MapType)):
            c = F.transform(c, F.to_json).alias(f.name)
        elif name in ("byte", "short", "integer"):
            c = c.cast("long").alias(f.name)
        elif name == "float":
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


_DAY = re.compile(r"/year_(\d{4})/month_(\d{2})/day_(\d{2})/")


def partitioned(paths: list[str], start: dt.date, end: dt.date) -> list[str]:
    """Files of year_/month_/day_ folders between two days.

    In a day, or an hour of by_hour, the latest as_at_ frame that is complete and
    not ignored counts; files outside frames count all. Other segments than
    by_hour are an error.
    """
    days: dict[str, list[str]] = {}
    for p in paths:
        m = _DAY.search(p)
        if m and start <= dt.date(*map(int, m.groups())) <= end:
            days.setdefault(p[: m.end()], []).append(p)
    out = []
    for root, files in sorted(days.items()):
        groups: dict[str, dict[str, list[str]]] = {}
        for p in files:
            rest = p[len(root) :]
            if (s := re.match(r"by_(\w+)/", rest)) and s[1] != "hour":
                raise QueryError(f"segments by {s[1]} are not supported")
            place = re.match(r"(by_hour/hour=\d+/)?(as_at_[^/]*)?", rest)
            groups.setdefault(place[1] or "", {}).setdefault(place[2] or "", []).append(p)
        for frames in groups.values():
            done = [f for f, ps in frames.items() if f and any(p.endswith("frame.complete") for p in ps) and not any(p.endswith("frame.ignore") for p in ps)]
            out += frames.get("", [])
            if done:
                out += frames[max(done)]
    return [p for p in out if not p.endswith(CONTROL)]


def tree_of(path: str) -> str | None:
    """The folder above the years, for a file of a date-partitioned tree."""
    m = _DAY.search(path)
    return path[: m.start()] if m else None
