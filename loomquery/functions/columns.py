"""The dialect's functions as Columns: call("LPAD", "name", 5, lit("*"))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquery.functions import library


def text_of(x: object) -> str:
    """A column name, or a literal: numbers and booleans as they are, Lit for text."""
    if isinstance(x, Lit):
        return library.quoted(x.value)
    if isinstance(x, str):
        return ".".join(f"`{p}`" for p in x.split("."))
    if isinstance(x, bool):
        return str(x).lower()
    return f"{x}D" if isinstance(x, float) else str(x)


class Lit:
    """A text literal among the arguments."""

    def __init__(self, value: str):
        self.value = value


def call(name: str, *args: object, kinds: dict[str, str] | None = None) -> Column:
    """A Column of built-in expressions; ``kinds`` tells which columns are arrays or timestamps."""
    known = {text_of(k): v for k, v in (kinds or {}).items()}
    return F.expr(library.call(name, [text_of(a) for a in args], lambda e: known.get(e, "")))
