"""Operator 4, URL filters: host rules, and for the rest a logistic regression on hashed character n-grams.

Everything runs as Spark columns and aggregates. The model is trained from a small labelled table of URLs:
at most TRAIN_ROWS of them, taken in the order of a hash. Its weights, one for each of BUCKETS n-gram
buckets and a bias, are a bounded array that travels with the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.scratch import Scratch

#: Rule and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRAIN_ROWS = 4096
BUCKETS = 512
GRAM = 3
ROUNDS = 24
RATE = 4.0
DECAY = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """array<int>: buckets of all character GRAM-grams of '^host' and of '/path$'."""

    def of(text: Column, tag: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
        return F.transform(starts, lambda k: F.pmod(F.crc32(F.concat(F.lit(tag), F.substr(text, k, F.lit(GRAM))).cast("binary")), F.lit(buckets)).cast("int"))

    return F.concat(of(F.concat(F.lit("^"), host), "h"), of(F.concat(path, F.lit("$")), "p"))


def logit(found: Column, weights: list[float]) -> Column:
    """Mean weight of the n-grams, plus the bias, which is the last weight. Weights are folded into one array."""
    table = F.split(F.lit(",".join(repr(float(w)) for w in weights)), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1))
    return total / F.sqrt(F.size(found).cast("double")) + F.lit(float(weights[-1]))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS, rounds: int = ROUNDS) -> list[float]:
    """Weights fitted to labelled(url, bad 0/1) by full-batch gradient descent.

    At most `rows` rows take part, in the order of a hash of the URL. Each round is one aggregate over
    them, in whole billionths, so that the order of addition changes nothing; it returns `buckets` + 1 sums.
    Without rows, or with one class only, the weights say that class (or allow).
    """
    spark = labelled.sparkSession
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    sample = labelled.where("bad is not null and url is not null").select("url", F.col("bad").cast("double"))
    sample = sample.orderBy(F.xxhash64("url"), "url", "bad").limit(rows).select("bad", grams(host, path, buckets).alias("found"))
    scratch = Scratch(spark, "url-train")
    sample = scratch.table(sample, "sample")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    weights = [0.0] * (buckets + 1)
    if not n or bad in (0.0, float(n)):
        weights[-1] = 20.0 if n and bad else -20.0
        return weights
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-logit(F.col("found"), weights)))
        pulls = sample.select("found", (F.col("bad") - p).alias("pull"))
        cells = F.concat(F.transform("found", lambda b: F.struct(b.alias("b"), F.lit(True).alias("gram"))), F.array(F.struct(F.lit(buckets).alias("b"), F.lit(False).alias("gram"))))
        step = F.when(F.col("c.gram"), F.col("pull") / F.sqrt(F.size("found").cast("double"))).otherwise(F.col("pull"))
        sums = pulls.select(F.explode(cells).alias("c"), "pull", "found").select(F.col("c.b").alias("b"), F.round(step * 1e9).cast("long").alias("g")).groupBy("b").agg(F.sum("g").alias("g"))
        for b, g in sums.collect():  # at most one row a bucket
            weights[b] += RATE * g / 1e9 / n
        weights = [w * (1 - DECAY) for w in weights[:-1]] + weights[-1:]
    scratch.drop("sample")
    return [round(w, 9) for w in weights]


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row: the rule's verdict, else the model's.

    A null url, or one without ://, has an empty host and path and is judged by the model. score is the
    model's probability of block. Repeated rows stay; other columns are not read.
    """
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = url.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    score = 1.0 / (1.0 + F.exp(-logit(grams(F.col("host"), F.col("path"), len(weights) - 1), weights)))
    scored = ruled.withColumn("score", score)
    verdict = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, bad): the URLs that a rule decides."""
    said = pages.select("url", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("rule")).where("rule is not null")
    return said.select("url", F.col("rule").isin([r for r, v in rules if v == "block"]).cast("int").alias("bad"))


def filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_by_rules(pages)))
