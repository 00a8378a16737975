"""Readers of filings, registers, packs, feeds, mailboxes and harvests, as DataFrames.

Every reader takes a path that Spark can read. What the network would fetch is read from where it was landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions import entities, markup, text
from veriloom.operators.rollups import latest


def filings(spark: SparkSession, path: str, known: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Filings of a JSON cache: without blank or known source ids, text of their PDF added, fields derived, hashed."""
    df = spark.read.json(path).filter("coalesce(trim(source_id), '') <> ''")
    if known is not None:
        df = df.join(known.select("source_id"), "source_id", "left_anti")
    body = F.regexp_replace("body_text", "''", "'")
    if texts is not None:
        df = df.join(texts.select("source_id", F.col("text").alias("_pdf")), "source_id", "left")
        body = F.concat_ws("\n", body, F.col("_pdf"))
    df = df.withColumn("body_text", body)
    return df.withColumns({"dividend_per_share": entities.dividend(body), "record_date": entities.date_near(body, "record date"), "doc_type": entities.document_type(body), "content_sha256": F.sha2(text.hash_text(body), 256)}).drop("_pdf")


def companies(spark: SparkSession, path: str, name: str = "name", kind: str = "type") -> DataFrame:
    """A register of companies from CSV, the first row of each normalised name and type."""
    df = spark.read.csv(path, header=True).withColumn("ord", F.monotonically_increasing_id()).withColumn("normalised", text.company_name(F.col(name)))
    return latest(df, ["normalised", kind], [F.col("ord")]).drop("ord")


def intermediaries(spark: SparkSession, path: str) -> DataFrame:
    """A register of intermediaries from JSON, first row a number; a mail domain that isn't free is official."""
    df = spark.read.json(path).withColumn("ord", F.monotonically_increasing_id())
    d = entities.address_domain(F.col("email"))
    free = F.split(d, r"\.")[0].isin(*entities.FREE_MAIL)
    return latest(df, ["reg_no"], [F.col("ord")]).drop("ord").withColumn("official_domain", F.when(~free, d))


def domain_map(spark: SparkSession, path: str, register: DataFrame | None = None) -> DataFrame:
    df = spark.read.csv(path, header=True).withColumn("domain", text.domain(F.col("domain"))).dropDuplicates(["domain", "entity_name"])
    if register is None:
        return df
    return df.withColumn("_n", text.company_name(F.col("entity_name"))).join(register.select(F.col("normalised").alias("_n"), F.col("id").alias("entity_id")), "_n", "left").drop("_n")


def csv_pack(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """Rows of a CSV pack that state the needed columns."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for c in needed:
        df = df.filter(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    return df


def blocklist_host(line: Column) -> Column:
    """Host of a line of a plain list, a hosts file or an ad-block list; null for comments, exceptions and local names."""
    t = F.trim(F.lower(line))
    h = F.regexp_extract(t, r"^(?:(?:0\.0\.0\.0|127\.0\.0\.1)\s+|\|\|)?([a-z0-9.-]+\.[a-z0-9-]+)", 1)
    skip = t.rlike(r"^(#|!|@@|\[|$)") | h.isin("localhost.localdomain", "") | h.rlike(r"^\d+(\.\d+){3}$")
    return F.when(~skip, F.regexp_replace(h, r"^www\.", ""))


def blocklist(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.text(path).select(blocklist_host(F.col("value")).alias("host")).filter("host is not null").distinct().withColumn("list", F.lit(name))


def json_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a folder of files: path, kind and the parsed message."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "modificationTime", "length", markup.kind_of(F.col("content"), F.col("path")).alias("kind"), markup.message(F.col("content")).alias("m")).select("path", "modificationTime", "length", "kind", "m.*")


def announcements(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """Announcements whose payload is JSON within a JSON string, or a note that there is none."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "string"), F.col("value"))
    rows = raw.filter(~inner.contains("No Record Found")).select(F.explode(F.from_json(inner, "array<struct<headline:string,summary:string,company:string,url:string,dt:string>>")).alias("r")).select("r.*")
    return rows.withColumn("summary", F.substring(F.coalesce("summary", "headline"), 1, 200)).orderBy(F.desc("dt"), "url").limit(most)


def bars(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumn("ticker", F.when(F.col("ticker").contains("."), F.col("ticker")).otherwise(F.concat("ticker", F.lit(".NS"))))


def url_corpus(spark: SparkSession, path: str, share: float = 1.0, seed: int = 42) -> DataFrame:
    """URLs with y = 1 for bad ones (the file marks good ones), sampled alike from both classes."""
    df = spark.read.parquet(path).na.drop(subset=["url", "label"]).withColumn("y", 1 - F.col("label"))
    return df if share >= 1 else df.sampleBy("y", {0: share, 1: share}, seed)


def date_windows(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """Spans of at most so many days that cover a range of dates."""
    one = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval {days} days)) as first")
    return one.select("first", F.least(F.date_add("first", days - 1), F.lit(end).cast("date")).alias("last"))


def select_companies(df: DataFrame, most: int, groups=("A", "B", "T", "M", "MT", "X", "XT")) -> DataFrame:
    """Companies with an ISIN, one a scrip, by group then scrip, so many."""
    rank = F.array_position(F.array(*map(F.lit, groups)), F.col("grp"))
    one = latest(df.filter("isin is not null").withColumn("_r", rank).filter("_r > 0"), ["scrip"], [F.col("_r")])
    return one.orderBy("_r", "scrip").limit(most).drop("_r")


def validity(c: Column) -> Column:
    """Start and end of a text like `01-Jan-2020 to 31-Dec-2024`, the end null if it is perpetual."""
    d = lambda i: F.try_to_date(F.regexp_extract(c, r"(\d{2}-[A-Za-z]{3}-\d{4})(?:\s*(?:to|-)\s*(\d{2}-[A-Za-z]{3}-\d{4}))?", i), "dd-MMM-yyyy")
    return F.struct(d(1).alias("start"), d(2).alias("end"))


def prefix_shapes(df: DataFrame, column: str) -> DataFrame:
    """Count, and least and greatest number of digits, of each prefix."""
    digits = F.length(F.regexp_replace(F.col(column), "[^0-9]", ""))
    return df.groupBy(F.regexp_extract(F.upper(F.col(column)), "^[A-Z]+", 0).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min(digits).alias("least"), F.max(digits).alias("most"))


def minimise(df: DataFrame, private: list[str], website: str = "website") -> DataFrame:
    return df.withColumn("domain_anchor", text.domain(F.col(website))).drop(*private)


def top_by_group(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def handle_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of payment handles from CSV, ord being the order of the rows: pattern, match_type (REGEX or SUFFIX), category, severity."""
    df = csv_pack(spark, path, ["pattern", "category"])
    return df.select(F.col("ord").cast("int").alias("ord"), F.lower("pattern").alias("pattern"), F.when(F.upper("match_type") == "REGEX", "REGEX").otherwise("SUFFIX").alias("match_type"), "category", F.coalesce(F.col("severity").try_cast("int"), F.lit(0)).alias("severity"))


def classify_handles(rows: DataFrame, key: str, handle: str, rules: DataFrame) -> DataFrame:
    """Category and severity of each payment handle: suffix rules by an equi-join on what stands behind the at sign, then
    patterns; within each the first rule in its order. Handles without a rule are UNKNOWN, with 0."""
    low = F.lower(handle)
    suffix = rules.filter("match_type = 'SUFFIX'").select(F.ltrim("pattern", F.lit("@")).alias("_s"), F.struct(F.lit(0).alias("kind"), "ord", "category", "severity").alias("r"))
    a = rows.join(suffix, F.substring_index(low, "@", -1) == F.col("_s")).select(key, "r")
    pattern = rules.filter("match_type = 'REGEX'").select("pattern", F.struct(F.lit(1).alias("kind"), "ord", "category", "severity").alias("r"))
    b = rows.select(key, low.alias("_h")).join(pattern, F.expr("_h rlike pattern")).select(key, "r")
    best = a.unionByName(b).groupBy(key).agg(F.min("r").alias("r"))
    return rows.join(best, key, "left").select(*rows.columns, F.coalesce("r.category", F.lit("UNKNOWN")).alias("category"), F.coalesce("r.severity", F.lit(0)).alias("severity"))


def bank_codes(spark: SparkSession, path: str) -> DataFrame:
    """Banks by the four letters of their branch codes; a prefix stated twice keeps its first bank by name."""
    df = csv_pack(spark, path, ["ifsc_prefix", "bank_name"])
    return latest(df.withColumn("ifsc_prefix", F.upper(F.trim("ifsc_prefix"))), ["ifsc_prefix"], [F.col("bank_name")])


def aliases(spark: SparkSession, path: str, register: DataFrame) -> DataFrame:
    """Aliases with the registered name they stand for; an alias of a name that isn't registered is left out."""
    df = csv_pack(spark, path, ["alias", "entity_name"]).select(text.company_name(F.col("alias")).alias("alias"), text.company_name(F.col("entity_name")).alias("_n"))
    return df.join(register.select(F.col("registered"), F.col("normalised").alias("_n")), "_n").select("alias", "registered").distinct()


def behaviour_pack(spark: SparkSession, path: str) -> DataFrame:
    """Tactics of a JSON pack, one a row: id, weight, patterns; tactics without id or patterns are left out."""
    df = json_pack(spark, path).select(F.explode("tactics").alias("t")).select("t.*")
    return df.filter("id is not null and size(patterns) > 0").select("id", F.coalesce(F.col("weight").cast("int"), F.lit(0)).alias("weight"), "patterns")


def organisations(spark: SparkSession, path: str) -> DataFrame:
    """Organisations of a JSON register with ord, their place in it, and their lists in lower case."""
    kind = "organisations array<struct<name string, domains array<string>, email_domains array<string>, handles array<string>>>"
    df = spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("organisations").alias("ord", "o")).select("ord", "o.*")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    return df.select("ord", "name", *[low(F.col(c)).alias(c) for c in ("domains", "email_domains", "handles")])


def harvest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a register that were landed as JSON lines: number, name and the validity as two dates; the last landed
    row of a number counts."""
    df = spark.read.json(path).withColumn("v", validity(F.col("validity")))
    return latest(df.filter("number is not null"), ["number"], [F.col("landed").desc(), F.col("name")]).select("number", "name", F.col("v.start").alias("valid_from"), F.col("v.end").alias("valid_to"))


def refreshed(landed: DataFrame, most: int) -> DataFrame:
    """The manifest of a refresh of feeds from feed and content (null: it couldn't be read): status and bytes, cut at `most`."""
    size = F.length(F.encode("content", "UTF-8")).cast("long")
    status = F.when(F.col("content").isNull(), "failed").when(size > most, "truncated").when(size == 0, "empty").otherwise("ok")
    return landed.select("feed", status.alias("status"), F.least(F.coalesce(size, F.lit(0).cast("long")), F.lit(most)).alias("bytes"))
