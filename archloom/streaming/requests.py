"""Streams over append-only logs: the request tail, invalidation as changed files arrive, imports, and retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from archloom.operators import insight, mutate, trust
from archloom.schema import PAYLOAD_SCHEMA
from archloom.sources import payload
from archloom.store import GraphStore


def tail(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], after: int = 0, once: bool = False, key: str = "request_id") -> StreamingQuery:
    """Rows newer than `after` as files are added; the checkpoint remembers which files were read."""
    rows = spark.readStream.schema(schema).parquet(path).where(F.col(key) > after)
    return _started(rows, sink, checkpoint, once)


def _started(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def import_payloads(store: GraphStore, path: str, checkpoint: str, once: bool = False, clock: str | None = None) -> StreamingQuery:
    """Import payload files (one JSON object each) as they arrive, one after another by name, and look for discoveries after
    each. A file that breaks a rule changes nothing and ends the stream with its error; it is tried again on a restart."""

    def step(batch: DataFrame, _: int) -> None:
        for (name,) in batch.select("file").distinct().orderBy("file").collect():
            store.import_payload(payload.split(batch.where(F.col("file") == name)))
            store.discover(clock)

    rows = store.spark.readStream.schema(PAYLOAD_SCHEMA).option("multiLine", True).json(path)
    return _started(rows.withColumn("file", F.col("_metadata.file_path")), step, checkpoint, once)


def retries(requests: DataFrame, session: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """insight.retries over a stream: each session keeps its next number and its last ten errors. Calls of a session have to
    arrive in the order of request_id; those of one batch are sorted."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, numbers, tools = state.get if state.exists else (0, [], [])
        memory, out = insight.RetryMemory(seq, list(zip(numbers, tools, strict=True))), []
        calls = sorted((int(i), t, bool(f)) for frame in frames for i, t, f in zip(frame.request_id, frame.tool_name, frame.failed, strict=True))
        for call, tool, bad in calls:
            now, again = memory.step(tool, bad)
            if again is not None:
                out.append((key[0], call, tool, now, again))
        state.update((memory.seq, [n for n, _ in memory.errors], [t for _, t in memory.errors]))
        yield pd.DataFrame(out, columns=[session, "request_id", "tool_name", "seq", "failed_seq"])

    rows = requests.select(session, "request_id", "tool_name", insight.failed().alias("failed"))
    found = rows.groupBy(session).applyInPandasWithState(step, f"{session} bigint, request_id bigint, tool_name string, seq int, failed_seq int", "seq int, numbers array<int>, tools array<string>", "append", GroupStateTimeout.NoTimeout)
    return _started(found, sink, checkpoint, once)


def invalidate_changed(spark: SparkSession, path: str, checkpoint: str, evidence: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], once: bool = False) -> StreamingQuery:
    """Files that arrive as (revision, file_path) make evidence stale; `write` gets the evidence afterwards and the trust of
    the targets that were hit."""

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        after = mutate.invalidate(evidence(), batch.select("file_path"))
        hit = mutate.invalidated_targets(after, batch.select("file_path"))
        write(after, trust.trust(after.join(hit, ["target_kind", "target_key"], "left_semi"), ["target_kind", "target_key"]))

    rows = spark.readStream.schema("revision bigint, file_path string").parquet(path)
    return _started(rows, step, checkpoint, once)
