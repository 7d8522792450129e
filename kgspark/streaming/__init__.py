"""The same functions applied to what arrives: file events, new files, deletions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import chunk_fixed
from ..operators.lifecycle import mark_source_deleted
from ..operators.state import update_version
from ..sources.files import file_gate

FILES = "path string, modificationTime timestamp, length long, content binary"
EVENT = "type string, raw string, ts timestamp"
LINES = "conn_id long, line_no long, line string"


def event_records(lines: DataFrame) -> DataFrame:
    """lines (conn_id, line_no, line) of server-sent events: a row (conn_id, line_no, type, raw) for each data line; the type is that of an event line since the last data line, else message."""
    marked = lines.withColumns({"event": F.trim(F.regexp_extract("line", "^event:(.*)$", 1)), "is_event": F.startswith("line", F.lit("event:")), "is_data": F.startswith("line", F.lit("data:"))})
    order = Window.partitionBy("conn_id").orderBy("line_no")
    block = marked.withColumn("block", F.coalesce(F.sum(F.col("is_data").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = F.last(F.when(F.col("is_event"), F.col("event")), ignorenulls=True).over(Window.partitionBy("conn_id", "block").orderBy("line_no"))
    return block.withColumn("type", F.coalesce(seen, F.lit("message"))).filter("is_data").select("conn_id", "line_no", "type", F.trim(F.substring("line", 6, 1 << 30)).alias("raw"))


def stream_file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Complete event records (JSON lines of type, raw, ts) that land in a folder."""
    return spark.readStream.schema(EVENT).json(folder)


def stream_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """New files: gated by name, read as text, cut into chunks, appended as Parquet. All steps are narrow."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    some = file_gate(files.withColumn("filename", F.element_at(F.split("path", "/"), -1))).filter("should_process")
    docs = some.select(F.col("path").alias("uri"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    return chunk_fixed(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_lifecycle(events: DataFrame, root: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Delete events (raw: the uri) mark sources deleted. A micro-batch rewrites only the buckets of documents and evidence that its uris fall in (update_version), as the version of its number: repeated, it changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        uris = batch.filter("type = 'deleted' and raw is not null").select(F.col("raw").alias("uri"))
        at = batch.agg(F.max("ts")).first()[0]

        def change(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
            d, e, _ = mark_source_deleted(state["documents"], state["evidence"], uris, F.lit(at))
            return {"documents": d, "evidence": e}

        update_version(root, uris, f"{number:012d}", f"{number + 1:012d}", change)
        if after:
            after(number)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of server-sent events (JSON lines of conn_id, line_no, line) that land in a folder, those of a connection in order."""
    return spark.readStream.schema(LINES).json(folder)


def typed_events(lines: DataFrame) -> DataFrame:
    """A stream of lines: conn_id, line_no, type, raw for each data line, as event_records gives them for a table.

    The type that an event line has set, and no data line has used yet, is the state of its connection: it is carried from one micro-batch to the next. Other lines are passed over.
    """

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("line_no", kind="stable")  # of one connection in one micro-batch
        kind = state.get[0] if state.exists else None
        numbers, kinds, raws = [], [], []
        for number, line in zip(rows.line_no.tolist(), rows.line.tolist(), strict=True):
            head, mark, text = (line or "").partition(":")
            if mark and head == "event":
                kind = text.strip(" ")
            elif mark and head == "data":
                numbers.append(number)
                kinds.append("message" if kind is None else kind)
                raws.append(text.strip(" "))
                kind = None
        if kind is not None:
            state.update((kind,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"conn_id": key[0], "line_no": numbers, "type": kinds, "raw": raws})

    return lines.groupBy("conn_id").applyInPandasWithState(take, "conn_id long, line_no long, type string, raw string", "type string", "append", GroupStateTimeout.NoTimeout)
