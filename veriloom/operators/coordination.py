"""Coordinated posting: accounts that post nearly the same text in a short time, over a table or over a stream.

Posts of one bag of words are one content; contents link where their TF-IDF vectors' cosine reaches a threshold, and
linked contents are a cluster. With the word weights stated (an idf table), whether two contents link doesn't depend
on what else was posted, so that clusters can be kept while posts arrive: a new content meets the stored ones through
its rarest words, what it links to is one cluster from then on, and only clusters that were touched are scored anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions.urls import status_url
from veriloom.operators.rollups import latest
from veriloom.operators.scoring import fuse
from veriloom.operators.similar import HALF, connected, similar_pairs
from veriloom.sources.shared import kept

LEAST = 0.85
#: Fewer accounts than this are no campaign.
ACCOUNTS = 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def posts(items: DataFrame, id: str, url: str, text: str) -> DataFrame:
    """post, handle, at, words and content of items whose URL gives an account and a time and whose text has words.

    content is a digest of the sorted words: posts that say the same in another order are one content."""
    rows = items.select(F.col(id).alias("post"), status_url(F.col(url)).alias("s"), F.array_sort(tokens(F.col(text))).alias("words")).filter("s is not null and size(words) > 0")
    return rows.select("post", F.col("s.handle").alias("handle"), F.col("s.at").alias("at"), "words", F.sha2(F.array_join("words", " "), 256).alias("content"))


def idf(rows: DataFrame) -> DataFrame:
    """token and idf = ln((1 + n) / (1 + df)) + 1 of a table of posts, and a row of token null for words not in it."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    df = rows.select(F.explode(F.array_distinct("words")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = df.unionByName(n.select(F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("df")))
    return df.crossJoin(n).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row


def weights(contents: DataFrame, idfs: DataFrame) -> DataFrame:
    """content, token, weight of contents with words; vectors have length one."""
    tf = contents.select("content", F.explode("words").alias("token")).groupBy("content", "token").agg(F.count(F.lit(1)).alias("tf"))
    rest = idfs.filter("token is null").select(F.col("idf").alias("unseen"))
    raw = tf.join(idfs.filter("token is not null"), "token", "left").crossJoin(rest).withColumn("w", F.col("tf") * F.coalesce("idf", "unseen"))  # rest is one row
    return raw.select("content", "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("content")))).alias("weight"))


def burst_score(accounts: Column, first: Column, last: Column) -> Column:
    """Half by the number of accounts, half by how close in time the posts are; null for too few accounts."""
    span = (F.unix_micros(last) - F.unix_micros(first)) / 6e7
    burst = F.when(span <= 60, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (span - 60) / 1440))
    return F.when(accounts >= ACCOUNTS, F.round(F.least(F.lit(1.0), 0.5 * F.least(F.lit(1.0), (accounts - ACCOUNTS + 1) / 12) + 0.5 * burst), 4))


def summed(sightings: DataFrame) -> DataFrame:
    """Clusters with n, accounts, first, last and score of sightings (cluster, handle, n, first, last)."""
    got = sightings.groupBy("cluster").agg(F.sum("n").alias("posts"), F.count_distinct("handle").alias("accounts"), F.min("first").alias("first"), F.max("last").alias("last"))
    return got.withColumn("score", burst_score(F.col("accounts"), F.col("first"), F.col("last")))


def seen(rows: DataFrame, *keys: str) -> DataFrame:
    """Posts of one account and content as one row."""
    return rows.groupBy(*keys, "handle").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def analyse(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """post and cluster (a digest) of all posts (see posts), the word weights being those of the posts themselves."""
    contents = rows.groupBy("content").agg(F.any_value("words").alias("words"))
    pairs = similar_pairs(weights(contents, idf(rows)), "content", least)
    tied = connected(pairs).select(F.col("id").alias("content"), F.col("component").alias("cluster"))
    return rows.join(tied, "content", "left").select("post", "handle", "at", F.coalesce("cluster", "content").alias("cluster"))


def signal(clusters: DataFrame, analysed: DataFrame) -> DataFrame:
    """One row: score of the strongest cluster, available (enough posts to tell), n_clusters, posts_analysed and a summary."""
    top = clusters.filter("score is not null").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_clusters"), F.max_by(F.struct("accounts", ((F.unix_micros("last") - F.unix_micros("first")) / 6e7).alias("span")), F.struct("score", "accounts", "cluster")).alias("x"))
    rows = top.crossJoin(analysed.agg(F.count(F.lit(1)).alias("posts_analysed")))  # both are one row
    enough = F.col("posts_analysed") >= ACCOUNTS
    says = F.when(~enough, F.format_string("only %d post(s) with an account and a time: too few to tell", "posts_analysed")).when(F.col("n_clusters") == 0, F.format_string("no coordinated clusters in %d posts", "posts_analysed"))
    says = says.otherwise(F.format_string("%d accounts posted nearly the same within %d minutes", "x.accounts", F.round("x.span").cast("long")))
    return rows.select(F.coalesce("score", F.lit(0.0)).alias("score"), enough.alias("available"), "n_clusters", "posts_analysed", says.alias("summary"))


class Campaigns:
    """Clusters kept over a stream of posts.

    Every batch writes its rows into tables of its own number and reads those of the numbers before, so that a batch
    that is run again after a failure gives the same rows again, whatever was left of the first try. Tables: posts,
    vectors (of new contents), sightings (posts summed by content and account), labels (the cluster of contents that
    are new or whose cluster was merged), clusters (touched ones, and merged ones as gone), verdicts (of posts whose
    signal is new or changed). What stands is the last row of a key.
    """

    TABLES = {
        "posts": "post long, content string, base double",
        "vectors": "content string, token string, weight double, rare boolean",
        "sightings": "content string, handle string, n long, first timestamp, last timestamp",
        "labels": "content string, cluster string",
        "clusters": "cluster string, posts long, accounts long, first timestamp, last timestamp, score double, gone boolean",
        "verdicts": "post long, cluster string, signal double, score double, band string",
    }

    def __init__(self, spark: SparkSession, folder: str, idfs: DataFrame, least: float = LEAST):
        self.spark, self.folder, self.idfs, self.least = spark, folder, idfs, least

    def stored(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one, with their batch."""
        kind = self.TABLES[name] + ", batch int"
        try:
            rows = self.spark.read.schema(kind).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kind)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def standing(self, name: str, key: str, before: int | None = None) -> DataFrame:
        """The last row of each key."""
        rows = self.stored(name, before)
        rest = [c for c in rows.columns if c not in (key, "batch")]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(key, "x.*")

    def _put(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.TABLES[name]).parquet(path)

    def add(self, rows: DataFrame, batch: int) -> None:
        """One batch: rows has post, handle, at, words, content (see posts) and base, the score of the post's other signals.

        Posts that are known stay as they are; of several rows of a post in one batch the first in time counts. The batch
        is written first and read by the session that campaigns were made with: it is looked at several times.
        """
        kind, path = rows.schema, f"{self.folder}/incoming/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(kind).parquet(path)
        fresh = latest(rows, ["post"], [F.col("at"), F.col("handle"), F.col("content")]).join(self.stored("posts", batch).select("post"), "post", "left_anti")
        self._put(fresh.select("post", "content", "base"), "posts", batch)
        new_posts = self._new(rows, batch)
        old_vectors = self.stored("vectors", batch)
        contents = new_posts.groupBy("content").agg(F.any_value("words").alias("words")).join(old_vectors.select("content").distinct(), "content", "left_anti")
        order = Window.partitionBy("content").orderBy(F.desc("idf"), "token").rowsBetween(Window.unboundedPreceding, -1)
        w = weights(contents, self.idfs).join(self.idfs.filter("token is not null"), "token", "left").withColumn("idf", F.coalesce("idf", F.lit(float("inf"))))
        # words behind a rare prefix can't make up the threshold alone; half of a vector, at least, is its prefix
        rare = F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(order), F.lit(0.0)) <= max(1 - self.least * self.least, 1 - HALF) + 1e-9
        vectors = self._put(w.select("content", "token", "weight", rare.alias("rare")), "vectors", batch)
        seen(new_posts, "content").transform(lambda d: self._put(d, "sightings", batch))

        every = old_vectors.drop("batch", "rare").unionByName(vectors.drop("rare"))
        often = every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
        every = kept(every.join(often, "token", "left_semi"), "contents")  # words of one content only add to no link
        rest = vectors.groupBy(F.col("content").alias("a")).agg(F.coalesce(F.sum(F.when(~F.col("rare"), F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("rest"))
        met = vectors.filter("rare").select(F.col("content").alias("a"), "token", F.col("weight").alias("wa")).join(every.select(F.col("content").alias("b"), "token", F.col("weight").alias("wb")), "token").filter("a <> b")
        met = met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wb") * F.col("wb")).alias("used"))
        met = met.join(rest, "a").filter(F.col("dot") + F.sqrt(F.col("rest") * F.greatest(1 - F.col("used"), F.lit(0.0))) >= self.least - 1e-9).select("a", "b")
        fresh_ = every.join(vectors.select("content").distinct(), "content", "left_semi")
        x, y = fresh_.select(F.col("content").alias("a"), "token", F.col("weight").alias("wa")), every.select(F.col("content").alias("b"), "token", F.col("weight").alias("wb"))
        links = met.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s")).filter(F.col("s") >= self.least).select("a", "b")

        labels = self.standing("labels", "content", batch)
        known = labels.select(F.col("content").alias("b"), "cluster")
        tied = connected(links.join(known, "b", "left").select("a", F.coalesce("cluster", "b").alias("b"))).withColumnsRenamed({"id": "was", "component": "now"})
        first = vectors.select("content").distinct().select("content", F.col("content").alias("was"))
        moved = labels.select("content", F.col("cluster").alias("was")).join(tied.filter("was <> now").select("was"), "was", "left_semi")
        relabelled = first.unionByName(moved.select("content", "was")).join(tied, "was", "left").select("content", F.coalesce("now", "was").alias("cluster"))
        self._put(relabelled, "labels", batch)

        labels = self.standing("labels", "content", batch + 1)
        touched = new_posts.select("content").distinct().join(labels, "content").select("cluster").distinct()
        members = labels.join(touched, "cluster", "left_semi")
        gone = tied.filter("was <> now").select(F.col("was").alias("cluster")).join(self.stored("clusters", batch).select("cluster").distinct(), "cluster", "left_semi")
        scored = summed(self.stored("sightings", batch + 1).drop("batch").join(members, "content")).withColumn("gone", F.lit(False))
        dead = gone.select("cluster", F.lit(0).cast("long").alias("posts"), F.lit(0).cast("long").alias("accounts"), F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("last"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("gone"))
        now = self._put(scored.unionByName(dead), "clusters", batch)

        due = self.stored("posts", batch + 1).drop("batch").join(members, "content").join(now.filter("not gone").select("cluster", F.coalesce("score", F.lit(0.0)).alias("signal")), "cluster")
        before = self.standing("verdicts", "post", batch).select("post", F.col("cluster").alias("had"), F.col("signal").alias("was"))
        due = due.join(before, "post", "left").filter("was is null or was <> signal or had <> cluster")
        self._put(refused(due), "verdicts", batch)

    def _new(self, rows: DataFrame, batch: int) -> DataFrame:
        """The posts of a batch that it stored."""
        own = self.spark.read.schema(self.TABLES["posts"]).parquet(f"{self.folder}/posts/batch={batch}").select("post", "content")
        return latest(rows, ["post"], [F.col("at"), F.col("handle"), F.col("content")]).join(own, ["post", "content"], "left_semi")

    def clusters(self) -> DataFrame:
        return self.standing("clusters", "cluster").filter("not gone").drop("gone")

    def verdicts(self) -> DataFrame:
        return self.standing("verdicts", "post")


def refused(rows: DataFrame) -> DataFrame:
    """post, cluster, signal, score and band of rows with post, cluster, base (null: unavailable) and signal, fused again."""
    signals = rows.select(F.col("post").alias("content_id"), F.explode(F.array(F.struct(F.lit("text").alias("name"), F.coalesce("base", F.lit(0.0)).alias("score"), F.col("base").isNotNull().alias("available")), F.struct(F.lit("coordination").alias("name"), F.col("signal").alias("score"), F.lit(True).alias("available")))).alias("s")).select("content_id", "s.*")
    fused = fuse(signals).select(F.col("content_id").alias("post"), "score", "band")
    return rows.select("post", "cluster", "signal").join(fused, "post")


def run(stream: DataFrame, campaigns: Campaigns, base: Column, id: str, url: str, text: str) -> Campaigns:
    """Feeds a stream of items to campaigns until it is used up; its progress is kept beside the tables."""

    def batch(df: DataFrame, i: int) -> None:
        scored = df.withColumn("_base", base)
        rows = posts(scored, id, url, text).join(scored.select(F.col(id).alias("post"), F.col("_base").alias("base")).groupBy("post").agg(F.max("base").alias("base")), "post")
        campaigns.add(rows, i)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{campaigns.folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return campaigns
