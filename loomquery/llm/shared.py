"""What several operators of this subpackage need from Spark."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = "file:///tmp/loomquery-shared"
    return conf.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the store that Hadoop finds it in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return out if not out.startswith("file:/") or out.startswith("file://") else "file://" + out[5:]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of fresh_path that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor costs a read, not a recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage like a checkpoint, in less space."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def parts(spark: SparkSession) -> int:
    """Shuffle partitions, as the session sizes them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn on each Arrow batch of df, no state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_columns(keep: Iterable[str], *added: str) -> tuple[str, ...]:
    """keep without the columns that an added one's name replaces."""
    return tuple(c for c in keep if c.lower() not in added)


def crc_mod(doc_id: str, m: int):
    """crc32 of the id's decimal text, modulo m; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % m, F.lit(0))


def extended(df: DataFrame, *fields: tuple[str, str]):
    """df's schema with more fields."""
    from pyspark.sql.types import StructType

    out = StructType(list(df.schema.fields))
    for name, kind in fields:
        out = out.add(name, kind)
    return out
