"""Sweep of landed records: several sources in one stream, a high-water mark for each, and quarantine of what can't be read.

Every batch writes into folders of its own number (rows, bad, marks) and reads those of the numbers before, so that a
batch that is run again after a failure replaces what the first try left. A record is taken if it lies above its
source's mark; landing the same records again, in whatever files, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "rows": "source string, key string, mark long, body string",
    "bad": "source string, cause string, line string",
    "marks": "source string, mark long, taken long, stale long, bad long",
}


def stored(spark: SparkSession, store: str, name: str, before: int | None = None) -> DataFrame:
    """Rows of a table of the store, of all batches or of those before one; a store that is new is empty."""
    try:
        rows = spark.read.schema(TABLES[name] + ", batch int").parquet(f"{store}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLES[name] + ", batch int")
    return rows if before is None else rows.filter(F.col("batch") < before)


def checked(lines: DataFrame, key: str, mark: str) -> DataFrame:
    """Lines (source, line) with key, mark, and the cause why a line can't be taken: not_json, no_key, no_mark or null."""
    parsed = F.try_parse_json("line")
    rows = lines.select("source", "line", parsed.alias("v")).select("source", "line", "v", F.try_variant_get("v", f"$.{key}", "string").alias("key"), F.try_variant_get("v", f"$.{mark}", "bigint").alias("mark"))
    cause = F.when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "not_json").when(F.col("key").isNull(), "no_key").when(F.col("mark").isNull(), "no_mark")
    return rows.select("source", "line", "key", "mark", cause.alias("cause"))


def sweep(spark: SparkSession, sources: dict[str, str], store: str, key: str, mark: str) -> None:
    """Takes what has landed in the sources (folders of JSON lines) into a store, until nothing is left.

    Blank lines are no records. Of one key and mark, the least line counts; a key with a greater mark is a further
    version of it. A source without a folder is empty until it has one. The sources of a store are always the same.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    for folder in sources.values():
        path = at(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    streams = [spark.readStream.schema("value string").text(folder).select(F.lit(name).alias("source"), F.col("value").alias("line")) for name, folder in sorted(sources.items())]
    stream = streams[0]
    for more in streams[1:]:
        stream = stream.unionByName(more)

    def put(rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{store}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(TABLES[name]).parquet(path)

    def batch(df: DataFrame, i: int) -> None:
        path = f"{store}/incoming/batch={i}"
        checked(df.filter(F.trim("line") != ""), key, mark).write.mode("overwrite").parquet(path)
        rows = spark.read.schema("source string, line string, key string, mark long, cause string").parquet(path)
        known = stored(spark, store, "marks", i).groupBy("source").agg(F.max("mark").alias("until"))
        rows = rows.join(known, "source", "left")  # a row a source
        bad = rows.filter("cause is not null").select("source", "cause", "line").distinct()
        bad = put(bad.join(stored(spark, store, "bad", i).select("source", "line"), ["source", "line"], "left_anti"), "bad", i)
        good = rows.filter("cause is null").withColumn("fresh", F.col("until").isNull() | (F.col("mark") > F.col("until")))
        taken = put(good.filter("fresh").groupBy("source", "key", "mark").agg(F.min("line").alias("body")), "rows", i)
        parts = taken.select("source", "mark", F.lit(1).alias("taken"), F.lit(0).alias("stale"), F.lit(0).alias("bad"))
        parts = parts.unionByName(good.filter("not fresh").select("source", F.col("until").alias("mark"), F.lit(0).alias("taken"), F.lit(1).alias("stale"), F.lit(0).alias("bad")))
        parts = parts.unionByName(bad.select("source", F.lit(None).cast("long").alias("mark"), F.lit(0).alias("taken"), F.lit(0).alias("stale"), F.lit(1).alias("bad")))
        put(parts.groupBy("source").agg(F.max("mark").alias("mark"), *[F.sum(c).cast("long").alias(c) for c in ("taken", "stale", "bad")]), "marks", i)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start().awaitTermination()


def summary(spark: SparkSession, store: str) -> DataFrame:
    """What each source has given so far: mark, records taken, passed over as known, and kept apart."""
    return stored(spark, store, "marks").groupBy("source").agg(F.max("mark").alias("mark"), *[F.sum(c).alias(c) for c in ("taken", "stale", "bad")])
