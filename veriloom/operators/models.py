"""Features of URLs, logistic regression with grouped splits, scoring and its measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import urls

SUSPICIOUS = ("xyz", "top", "click", "loan", "zip")


def host_features(h: Column) -> dict[str, Column]:
    """Features of a host, none of which looks at scheme, path or query."""
    reg = urls.without_www(h)
    label = F.regexp_extract(urls.plain_registrable(h), r"^[^.]*", 0)
    labels = F.filter(F.split(reg, r"\."), lambda x: x != "")
    letters, digits = F.length(F.regexp_replace(reg, "[^A-Za-z]", "")), F.length(F.regexp_replace(reg, "[^0-9]", ""))
    tld = F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    runs = F.transform(F.regexp_extract_all(label, F.lit("[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]+"), F.lit(0)), F.length)
    return {
        "host_len": F.length(reg), "host_entropy": urls.entropy(reg), "label_count": F.size(labels), "hyphens": F.length(reg) - F.length(F.replace(reg, F.lit("-"), F.lit(""))),
        "digits": digits, "digit_ratio": ratio(digits, F.length(reg)), "vowel_ratio": ratio(F.length(F.regexp_replace(reg, "[^aeiou]", "")), letters),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)), "tld_len": F.length(tld), "suspicious_tld": tld.isin(*SUSPICIOUS).cast("int"),
        "has_ip": reg.rlike(urls.IPV4).cast("int"), "brand_tokens": sum((reg.contains(b).cast("int") for b in urls.BRANDS), F.lit(0)), "label_entropy": urls.entropy(label), "label_len": F.length(label),
        "repeats": F.regexp_count(reg, F.lit(r"(.)\1\1+")), "consonant_run": F.coalesce(F.array_max(runs), F.lit(0)), "mix": (label.rlike("[0-9]") & label.rlike("[A-Za-z]")).cast("int"),
    }


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("_h", urls.host(F.col(url))).withColumns({k: v.cast("double") for k, v in host_features(F.col("_h")).items()}).drop("_h")


def split(df: DataFrame, group: Column, share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test parts; all rows of a group are in one of them."""
    side = F.pmod(F.xxhash64(F.lit(seed), group), F.lit(1000)) < int(1000 * share)
    return df.filter(side), df.filter(~side)


def fit(train: DataFrame, names: list[str], label: str = "y"):
    """Scaler and logistic regression with weights that balance the classes."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    weights = counts.join(total).select(F.col(label).alias("_y"), (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))
    data = VectorAssembler(inputCols=names, outputCol="raw").transform(train.join(weights, F.col(label) == F.col("_y")).drop("_y"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data)
    model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=100).fit(scaler.transform(data))
    return scaler, model


def score(df: DataFrame, fitted, names: list[str]) -> DataFrame:
    scaler, model = fitted
    out = model.transform(scaler.transform(VectorAssembler(inputCols=names, outputCol="raw").transform(df)))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def linear_score(weights: dict[str, float], bias: float) -> Column:
    """Probability and the five features that weigh most, by expressions alone."""
    parts = F.array(*[F.struct((-F.abs(F.col(k) * w)).alias("order"), F.lit(k).alias("name"), (F.col(k) * w).alias("value")) for k, w in weights.items()])
    total = F.lit(bias)
    for k, w in weights.items():
        total += F.col(k) * w
    return F.struct((1 / (1 + F.exp(-total))).alias("p"), F.transform(F.slice(F.array_sort(parts), 1, 5), lambda x: x["name"]).alias("top"))


def route(p: Column, state: Column, low: float = 0.3, high: float = 0.8) -> Column:
    return F.when((p >= high) | state.isin("invalid", "collision"), "warn").when((p < low) & (state == "valid"), "allow").otherwise("escalate")


def measures(df: DataFrame, p: str = "p", y: str = "y", rate: float = 0.01, digits: int = 4) -> DataFrame:
    """Average precision, recall at a false positive rate, and Brier score, from counts at each distinct score.

    Scores lie between 0 and 1 and rank by so many digits, so that the window without a key has 10**digits + 1 rows at most.
    """
    at = df.withColumn(p, F.round(p, digits)).groupBy(p).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc(p))
    cum = at.withColumns({"tp": F.sum("pos").over(w), "all": F.sum("n").over(w)}).withColumn("fp", F.col("all") - F.col("tp"))
    ends = df.agg(F.sum(y).alias("positives"), (F.count(F.lit(1)) - F.sum(y)).alias("negatives"), F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))
    return cum.join(ends).agg(F.sum(F.col("pos") / F.col("positives") * F.col("tp") / F.col("all")).alias("average_precision"), F.max(F.when(F.col("fp") <= rate * F.col("negatives"), F.col("tp") / F.col("positives"))).alias("recall_at_rate"), F.first("brier").alias("brier"))


def bootstrap_mcc(df: DataFrame, got: str, y: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """5th, 50th and 95th percentile of the correlation coefficient over Poisson resamples.

    In a Poisson bootstrap every row counts Poisson(1) times, so that a cell of n rows counts Poisson(n) times: drawing
    the four cells is the same thing, whatever the number of rows.
    """
    cells = df.agg(F.count_if((F.col(got) == 1) & (F.col(y) == 1)).alias("tp"), F.count_if((F.col(got) == 1) & (F.col(y) == 0)).alias("fp"), F.count_if((F.col(got) == 0) & (F.col(y) == 1)).alias("fn"), F.count_if((F.col(got) == 0) & (F.col(y) == 0)).alias("tn"))

    @F.pandas_udf("double")
    def drawn(n: pd.Series, i: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng((seed, r, k)).poisson(m)) for m, r, k in zip(n, i, cell, strict=True)])

    from veriloom.operators.scoring import mcc

    names = ("tp", "fp", "fn", "tn")
    draws = cells.select(F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("i"), *names).select("i", *[drawn(F.col(c), F.col("i"), F.lit(k)).alias(c) for k, c in enumerate(names)])
    m = draws.select(mcc(*[F.col(c) for c in names]).alias("m"))
    return m.agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.5)).alias("mid"), F.percentile("m", F.lit(0.95)).alias("high"))


def folds(df: DataFrame, group: Column, k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(k)).cast("int"))


def parity(left: DataFrame, right: DataFrame, key: str, measures_: list[str], tolerance: float = 0.02) -> DataFrame:
    """Two implementations' measures side by side: how many keys were compared, how many either side lacks, the
    greatest difference, and whether it is within the tolerance."""
    a = left.select(F.col(key).alias("_k"), F.struct(*measures_).alias("a"))
    b = right.select(F.col(key).alias("_l"), F.struct(*measures_).alias("b"))
    both = a.join(b, F.col("_k") == F.col("_l"), "full_outer")
    each = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"a.{m}").cast("double").alias("x"), F.col(f"b.{m}").cast("double").alias("y")) for m in measures_])).alias("e")).select("e.*")
    gap = F.max(F.abs(F.col("x") - F.col("y")))
    return each.groupBy("measure").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("compared"), F.count_if(F.col("x").isNull()).alias("lost_left"), F.count_if(F.col("y").isNull()).alias("lost_right"), gap.alias("most"), (F.coalesce(gap, F.lit(0.0)) <= tolerance).alias("within"))
