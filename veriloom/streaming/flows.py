"""Streams: gateway flow, rate limits, deduplication, windows and campaigns, each with its batch form's results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriloom.operators import gates
from veriloom.operators.rollups import insert_new
from veriloom.sources.shared import kept, shared_dir


def file_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A stream over a Parquet file or folder, so many files a trigger; the schema is that of the files there are.

    The path is given as a pattern that only it fits, since streams take a plain path for a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its rows; state and rows lie in the shared folder."""
    spark, top = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).outputMode(mode).start()
    else:  # complete and update results replace one another, batch by batch
        put = lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{top}/rows")
        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).outputMode(mode).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")


def with_time(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(stream: DataFrame, time: str, size: str, *keys: str) -> DataFrame:
    return stream.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    return stream.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def first_seen(stream: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def rate_limited(stream: DataFrame, key: str, time: str, limit: int, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Rows with accepted: whether fewer than `limit` accepted rows of the key lie in the span before; refused rows don't count.

    A key is forgotten once the watermark has passed the span behind its last row, so that state doesn't grow with all
    keys ever seen; rows later than `late` are dropped.
    """
    stream = with_time(stream, time, late)
    names = stream.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", accepted boolean"

    def step(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        ok = []
        for t in rows[time].astype("datetime64[us]").astype("int64").tolist():
            seen = [s for s in seen if s > t - seconds * 1_000_000]
            ok.append(len(seen) < limit)
            if ok[-1]:
                seen.append(t)
        state.update((seen,))
        state.setTimeoutTimestamp(int(rows[time].max().timestamp() * 1000) + 1000 * seconds + 1)
        yield rows[names].assign(accepted=ok)

    return stream.groupBy(key).applyInPandasWithState(step, kind, "seen array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


#: Folders of the ids that the gateway has taken.
BUCKETS = 64


def gateway(stream: DataFrame, sink: str, state: str, verdict: Callable[[DataFrame], DataFrame]):
    """Messages to stored verdicts, exactly once by message id: what fails to be judged is delivered as unverified.

    stream has message_id, sender, subject, body. The ids that were taken lie beside the sink, in BUCKETS folders by
    their hash: a batch reads the ids of its own buckets only, and never the messages. A batch writes its rows and ids
    under its number, so that one that is run again replaces what it left.
    """

    def batch(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        one = df.groupBy("message_id").agg(F.min(F.struct(*[c for c in df.columns if c != "message_id"])).alias("m")).select("message_id", "m.*")
        bucket = F.pmod(F.xxhash64("message_id"), F.lit(BUCKETS)).cast("int")
        one = one.withColumn("bucket", bucket)
        touched = [r[0] for r in one.select("bucket").distinct().collect()]  # at most BUCKETS
        try:
            old = spark.read.schema("message_id string, batch int, bucket int").parquet(f"{sink}-ids").filter(F.col("bucket").isin(touched) & (F.col("batch") != i))
            one = one.join(old.select("bucket", "message_id"), ["bucket", "message_id"], "left_anti")
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        one = kept(one.drop("bucket"), "gateway")
        judged = one.join(verdict(one), "message_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNVERIFIED")))
        tag = F.when(F.col("verdict") == "FRAUDULENT", "[FRAUD] ").when(F.col("verdict") == "UNVERIFIED", "[UNVERIFIED] ").otherwise("")
        judged.withColumn("subject", F.concat(tag, F.coalesce("subject", F.lit("")))).write.mode("overwrite").parquet(f"{sink}/batch={i}")
        one.select("message_id", bucket.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}-ids/batch={i}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def stamp(headers, verdict, prefix: str = "X-Veriloom"):
    """Headers without forged verdicts of ours, and with ours."""
    own = F.map_filter(headers, lambda k, v: ~F.lower(k).startswith(prefix.lower()))
    return F.map_concat(own, F.create_map(F.lit(f"{prefix}-Verdict"), verdict))


def simple_verdict(messages: DataFrame) -> DataFrame:
    """message_id and verdict by whether a body asks for value."""
    return messages.select("message_id", F.when(gates.has_ask(F.col("body")), "FRAUDULENT").otherwise("GENUINE").alias("verdict"))


def sweep(spark: SparkSession, store: str, landed: list[str], key: str = "url") -> DataFrame:
    """Inserts what was landed; a source that can't be read is passed over, the others stay."""
    old = spark.read.parquet(store)
    for path in landed:
        try:
            old = insert_new(old, spark.read.schema(old.schema).json(path), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return old


def delivered(stream: DataFrame, verdict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the gateway stores for the messages that there are: runs it to its end on a sink in the shared folder."""
    spark, top = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/gateway-{uuid.uuid4().hex}"
    gateway(stream, f"{top}/rows", f"{top}/state", verdict).awaitTermination()
    return spark.read.parquet(f"{top}/rows")
