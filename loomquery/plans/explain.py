"""EXPLAIN: a physical plan as rows, or as a flow chart."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Wrappers that only say how their child runs.
THROUGH = ("WholeStageCodegen", "InputAdapter", "AQEShuffleRead", "ColumnarToRow")


def _nodes(node, depth: int, parent: int, count: list[int]) -> Iterator[tuple[int, int, int, object]]:
    """(number, parent's number, depth, node) of a plan that may be adaptive."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from _nodes(node.executedPlan(), depth, parent, count)
        return
    if re.search("QueryStage$", name):
        yield from _nodes(node.plan(), depth, parent, count)
        return
    own = parent
    if not name.startswith(THROUGH):
        own = count[0]
        count[0] += 1
        yield own, parent, depth, node
        depth += 1
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i), depth, own, count)


def _metric(node, *names: str) -> int | None:
    found = node.metrics()
    for n in names:
        if found.contains(n):
            return int(found.apply(n).value())
    return None


def explain(df: DataFrame, analyze: bool = False, form: str = "TEXT") -> DataFrame:
    """tree, operator, config of each step; analyze runs it and adds rows_out, bytes_out, step_ms and total_ms."""
    spark, run = df.sparkSession, df._jdf.queryExecution()
    began = time.time()
    if analyze:
        run.toRdd().count()
    total = round((time.time() - began) * 1000, 3)
    steps = list(_nodes(run.executedPlan(), 0, -1, [0]))
    if form == "MERMAID":
        lines = ["flowchart BT", ""]
        for n, _, _, node in steps:
            lines.append(f'  NODE_{n}["{node.nodeName().replace(chr(34), chr(39))}"]')
        for n, up, _, node in steps:
            if up >= 0:
                rows = _metric(node, "numOutputRows", "shuffleRecordsWritten") if analyze else None
                lines.append(f"  NODE_{n} --> NODE_{up}" if rows is None else f'  NODE_{n} -- "{rows:,} rows" --> NODE_{up}')
        return spark.createDataFrame([("\n".join(lines),)], "plan string")
    out = []
    for _, _, depth, node in steps:
        row = ("  " * depth + ("└─ " if depth else "") + node.nodeName().strip(), node.nodeName().strip(), node.simpleString(25))
        out.append((*row, _metric(node, "numOutputRows", "shuffleRecordsWritten"), _metric(node, "dataSize", "shuffleBytesWritten"), _metric(node, "pipelineTime", "sortTime", "scanTime"), total) if analyze else row)
    columns = "tree string, operator string, config string" + (", rows_out long, bytes_out long, step_ms long, total_ms double" if analyze else "")
    return spark.createDataFrame(out, columns)
