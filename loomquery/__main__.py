"""python -m loomquery "SELECT ..." [--o file.parquet|.csv|.jsonl|.orc] [--root folder]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomquery.plans.session import Session

WRITERS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "jsonl": "json"}


def main() -> None:
    p = argparse.ArgumentParser(prog="loomquery")
    p.add_argument("sql")
    p.add_argument("--o", default="console", help="console, or a folder name that ends in parquet, orc, csv or jsonl")
    p.add_argument("--root", default=".")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = Session(spark, a.root).sql(a.sql)
    if a.o == "console":
        df.show(50, truncate=False)
        return
    kind = a.o.rsplit(".", 1)[-1].lower()
    if kind not in WRITERS:
        p.error(f"no writer for {a.o}")
    df.write.mode("overwrite").options(header=True).format(WRITERS[kind]).save(a.o)


if __name__ == "__main__":
    main()
