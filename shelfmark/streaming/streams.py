"""Ingest, running status, sessions, group completion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.functions import paths as P
from shelfmark.operators import sync
from shelfmark.session import working_path


def stream_assets(spark: SparkSession, folder: str, delay: str = "1 day",
                  pattern: str = "*", schema: str | None = None) -> DataFrame:
    """New assets as they appear; the same state of a file seen again within the delay is dropped.

    ``schema`` given: Parquet catalogue files (path, mtime, ...); else a file
    listing whose bytes are not read.
    """
    if schema is None:
        listed = (
            spark.readStream.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(folder)
            .select(P.without_scheme("path").alias("path"),
                    F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    else:
        listed = (
            spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder))
    return once_per_state(listed, delay)


def once_per_state(assets: DataFrame, delay: str = "1 day", key: str = "path",
                   time: str = "mtime") -> DataFrame:
    """Duplicates are ignored; a file saved again is another state and passes."""
    state = [c for c in (key, time, "size") if c in assets.columns]
    return assets.withWatermark(time, delay).dropDuplicatesWithinWatermark(state)


def sync_batches(stream: DataFrame, existing: DataFrame, sink: str, overwrite: str = "smart",
                 checkpoint: str | None = None):
    """Each micro-batch of planned rows (with dest, mtime) synced like J1.

    A batch is written under its epoch and replaces what an earlier try left.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        sync.sync_plan(batch, existing, overwrite).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    spark = existing.sparkSession
    return (
        stream.writeStream.foreachBatch(one).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint or working_path(spark, "sync-state")).start())


def stream_status(results: DataFrame, window: str = "1 hour", slide: str | None = None,
                  delay: str = "10 minutes", time: str = "ts", status: str = "status") -> DataFrame:
    """Running status counts per window; rows later than the delay are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        results.withWatermark(time, delay).groupBy(span.alias("span"), F.col(status))
        .agg(F.count(F.lit(1)).alias("results"))
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
                status, "results"))


def stream_sessions(results: DataFrame, gap: str = "3 minutes", key: str = "entry",
                    delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Run sessions; a gap without results closes one."""
    return (
        results.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("span"), F.col(key))
        .agg(F.count(F.lit(1)).alias("results"))
        .select(F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"),
                key, "results"))


_GROUP_OUT = (
    "folder string, group_id string, pages int, declared int, outcome string")
_GROUP_NAMES = [c.split()[0] for c in _GROUP_OUT.split(", ")]
#: Documents of a bucket, as packed tables: one of documents, one of their pages.
_GROUP_STATE = "documents binary, members binary"
_OPEN, _WHOLE, _OVERFULL = 0, 1, 2
_DOCUMENTS = {"declared": "int64", "told": "int8", "deadline": "int64"}


def _group_step(timeout_ms: int, time: str):
    keys = ["folder", "group_id"]

    # Helpers stand inside: the workers that run a step need not have this package.
    def packed(frame: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(frame, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def unpacked(data: bytes) -> pd.DataFrame:
        with pa.ipc.open_stream(data) as reader:
            return reader.read_all().to_pandas()

    def outcomes(documents: pd.DataFrame, outcome) -> pd.DataFrame:
        return documents.assign(outcome=outcome).astype({"pages": "int32", "declared": "int32"})[_GROUP_NAMES]

    def step(_bucket, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = {k: "object" for k in keys}
        if state.exists:
            documents, members = map(unpacked, state.get)
        else:
            documents = pd.DataFrame(columns=[*keys, *_DOCUMENTS]).astype(text | _DOCUMENTS)
            members = pd.DataFrame(columns=[*keys, "member"]).astype(text | {"member": "int32"})
        mark = state.getCurrentWatermarkMs()
        arrived = [] if state.hasTimedOut else [b for b in batches if len(b)]
        if arrived:
            rows = pd.concat(arrived, ignore_index=True)
            rows[time] = rows[time].dt.tz_localize(None) if rows[time].dt.tz is not None else rows[time]
            rows["_ms"] = rows[time].astype("datetime64[ms]").astype("int64")
            members = pd.concat([members, rows[[*keys, "member"]].astype({"member": "int32"})], ignore_index=True).drop_duplicates(ignore_index=True)
            news = rows.groupby(keys, sort=False, dropna=False, as_index=False).agg(_declared=("declared", "max"), _latest=("_ms", "max"))
            documents = documents.merge(news, on=keys, how="outer")
            touched = documents["_latest"].notna()
            documents["declared"] = documents[["declared", "_declared"]].max(axis=1).fillna(0).clip(lower=0).astype("int64")
            documents["told"] = documents["told"].fillna(_OPEN).astype("int8")
            # Counted from the latest page: before the first batch is over, the mark has not moved yet.
            documents["deadline"] = (documents["_latest"].clip(lower=mark) + timeout_ms).where(touched, documents["deadline"]).astype("int64")
            documents = documents.drop(columns=["_declared", "_latest"])
            counts = members.groupby(keys, sort=False, dropna=False, as_index=False).agg(pages=("member", "size"))
            documents = documents.merge(counts, on=keys, how="left")
            known = touched.to_numpy() & (documents["declared"] > 0).to_numpy()
            # Said once, when it becomes known; a document that was complete is corrected.
            over = known & (documents["pages"] > documents["declared"]).to_numpy()
            whole = known & (documents["pages"] == documents["declared"]).to_numpy() & (documents["told"] != _WHOLE).to_numpy()
            yield outcomes(documents[whole], "complete")
            yield outcomes(documents[over & (documents["told"] != _OVERFULL).to_numpy()], "overfull")
            documents.loc[whole, "told"], documents.loc[over, "told"] = _WHOLE, _OVERFULL
            documents = documents.drop(columns="pages")
        late = (documents["deadline"] < mark).to_numpy()
        if late.any():
            gone = documents[late].merge(members, on=keys).groupby([*keys, "declared", "told"], sort=False, dropna=False, as_index=False).agg(
                pages=("member", "size"))
            # A told outcome is not told again.
            yield outcomes(gone[gone["told"] == _OPEN], "truncated")
            documents = documents[~late]
            members = members.merge(documents[keys], on=keys)
        # A closed document is remembered until its time is over, so late pages don't open it anew.
        if len(documents):
            state.update((packed(documents), packed(members)))
            state.setTimeoutTimestamp(max(int(documents["deadline"].min()), mark + 1))
        elif state.exists:
            state.remove()

    return step


def stream_groups(pages: DataFrame, timeout_ms: int = 3_600_000, delay: str = "10 minutes",
                  time: str = "ts", buckets: int = 256) -> DataFrame:
    """T4: a document when its declared pages are all there, truncated on timeout, overfull beyond them.

    ``pages``: folder, group_id, page, is_thumb, declared, ts.  Repeats of a
    page are dropped before the grouping, keyed by page, so a document whose
    copies flood the stream reaches its state once per page; the state holds
    page numbers only.  Documents are dealt to ``buckets`` by their names, and a
    bucket's documents are judged together: the calls of a micro-batch are as
    many as its buckets, not its documents.  More open documents ask for more
    buckets; the number is fixed for a checkpoint.
    """
    member = F.col("page") * 2 + F.col("is_thumb").cast("int")
    unique = (
        pages.withColumn("member", member.cast("int")).withWatermark(time, delay)
        .dropDuplicatesWithinWatermark(["folder", "group_id", "member"])
        .select("folder", "group_id", "member", F.col("declared").cast("int"), time,
                F.pmod(F.xxhash64("folder", "group_id"), F.lit(buckets)).alias("_bucket")))
    return unique.groupBy("_bucket").applyInPandasWithState(
        _group_step(timeout_ms, time), _GROUP_OUT, _GROUP_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Drain a stream into a table in the shared folder and read it back."""
    spark = stream.sparkSession
    sink = working_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(output_mode)
        .option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start(sink))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)

