"""A small PEP 249 facade. Connections are read-only, so commit and rollback do nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from loomquery.plans.session import Session

apilevel, threadsafety, paramstyle = "2.0", 1, "named"


def connect(spark: SparkSession | None = None, **options) -> Connection:
    return Connection(Session(spark or SparkSession.builder.getOrCreate(), **options))


class Connection:
    def __init__(self, session: Session):
        self.session = session

    def cursor(self) -> Cursor:
        return Cursor(self.session)

    def commit(self) -> None: ...

    def rollback(self) -> None: ...

    def close(self) -> None: ...


class Cursor:
    """Rows are pulled a partition at a time."""

    arraysize = 1

    def __init__(self, session: Session):
        self.session = session
        self.frame: DataFrame | None = None
        self._rows: Iterator = iter(())

    @property
    def description(self) -> list[tuple] | None:
        return None if self.frame is None else [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in self.frame.schema.fields]

    def execute(self, sql: str, params: dict | list | None = None) -> Cursor:
        self.frame = self.session.sql(sql, params)
        self._rows = (tuple(r) for r in self.frame.toLocalIterator())
        return self

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [r for _, r in zip(range(size or self.arraysize), self._rows, strict=False)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def close(self) -> None:
        self._rows = iter(())
