"""Operator 11, importance resampling towards a target distribution of hashed word features.

Words and word runs fall into buckets by a checksum. A bucket's gain is the log ratio of its smoothed shares in the
target and in all documents; gains are an array of one number a bucket, from which each document's weight is read. A
score is the weight plus Gumbel noise from a hash of the id, so that the highest scores are a draw without replacement.

Scores are persisted once. The cutoff between drawn and undrawn rows is found by bisection: exact count jobs over the
persisted columns narrow the score, then the id among ties, then, for rows that repeat an id, the number of
features and the row's place in its file. Each job answers several levels of the bisection. Drawn rows are dealt by
range of their order and written sorted; a row's rank is the number of rows in the files before its own plus its place there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.llm.scratch import Scratch

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GRAMS = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
LEVELS = 5  # of the bisection that one count job answers
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = ("score", "doc_id", "n_features", "_file", "_row")  # the first descending


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def features(found: Column, grams: int = GRAMS) -> Column:
    """All runs of 1 to `grams` consecutive words, joined by one space."""
    out = found
    for n in range(2, grams + 1):
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        out = F.concat(out, F.transform(starts, lambda k: F.array_join(F.slice(found, k, F.lit(n)), " ")))  # noqa: B023
    return out


def bucketed(table: DataFrame, keep: list[str], grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The columns `keep` of table(text), n_words, and features: the bucket of each feature, in their order."""
    held = table.select(*keep, words(F.col("text")).alias("_w"))
    bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
    return held.select(*keep, F.size("_w").cast("long").alias("n_words"), F.transform(features(F.col("_w"), grams), bucket).alias("features"))


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n) of found(features): as many rows as buckets; tasks count before they are shuffled."""
    return found.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, from two tables (bucket, n) of at most `buckets` rows each."""
    s, t = (df.select("bucket", F.col("n").alias(c)) for df, c in ((corpus, "s"), (target, "t")))
    totals = [int(df.agg(F.sum("n")).first()[0] or 0) for df in (corpus, target)]
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    held = every.join(s.hint("merge"), "bucket", "left").join(t.hint("merge"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = [F.lit(float(x + buckets)) for x in totals]
    ratio = ((F.col("t") + 1).cast("double") * whole[0]) / ((F.col("s") + 1).cast("double") * whole[1])
    return [r["gain"] for r in held.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def floored(total: Column, n: Column) -> Column:
    """total / n rounded down, in whole numbers."""
    return F.call_function("div", total - F.pmod(total, n), n)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, scratch: Scratch, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row, as a persisted table; a null id has no score."""
    rows = scratch.table(bucketed(docs, ["doc_id"], grams, buckets), "features")
    wanted = scratch.table(bucket_counts(bucketed(target, [], grams, buckets)), "target")
    have = scratch.table(bucket_counts(rows), "corpus")
    gain = F.array(*map(F.lit, gains(have, wanted, buckets))).cast("array<long>")
    n = F.size("features").cast("long")
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, b: a + F.get(gain, b))
    weight = F.when(n > 0, floored(total, n)).otherwise(F.lit(0).cast("long"))
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", n.alias("n_features"), weight.alias("weight"))
    out = scratch.table(found.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")), "scores")
    scratch.drop("features", "target", "corpus")
    return out


def bisect(rows: DataFrame, column: str, need: int, descending: bool = False, levels: int = LEVELS) -> tuple[int, int]:
    """(cut, before): the value that the need-th row in the order of a whole-number column has, and how many rows lie before that value.

    Every job counts the rows on this side of each middle of `levels` levels of the bisection, over one column.
    """
    sign = -1 if descending else 1
    key = F.col(column) * sign
    lo, hi = map(int, rows.agg(F.min(key), F.max(key)).first())
    before = 0  # rows below lo
    while lo < hi:
        middles = sorted(_middles(lo, hi, levels))
        counts = rows.agg(*(F.count(F.when(key <= m, 1)).alias(str(k)) for k, m in enumerate(middles))).first()
        first = next((k for k, c in enumerate(counts) if c >= need), None)
        if first is None:
            lo, before = middles[-1] + 1, counts[-1]
        else:
            hi = middles[first]
            if first:
                lo, before = middles[first - 1] + 1, counts[first - 1]
    return lo * sign, before


def _middles(lo: int, hi: int, levels: int) -> set[int]:
    if lo >= hi or not levels:
        return set()
    middle = (lo + hi) // 2
    return {middle} | _middles(lo, middle, levels - 1) | _middles(middle + 1, hi, levels - 1)


def cutoff(rows: DataFrame, need: int) -> Column:
    """Whether a row is among the first `need`, at least one, of rows in ORDER; rows has at least as many."""
    steps: list[tuple[str, object]] = []
    left = need
    for column in ORDER[:3]:
        cut, before = bisect(rows, column, left, column == ORDER[0])
        rows, left = rows.where(F.col(column) == cut), left - before
        steps.append((column, cut))
    # rows that agree in all these: whole files, then a place in the next one; a row a file
    for name, n in sorted((r["_file"], r["n"]) for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()):
        if left <= n:
            cut, _ = bisect(rows.where(F.col("_file") == name), "_row", left)
            steps += [("_file", name), ("_row", cut)]
            break
        left -= n
    inside = F.col(steps[-1][0]) <= F.lit(steps[-1][1])
    for column, cut in reversed(steps[:-1]):
        nearer = F.col(column) > cut if column == ORDER[0] else F.col(column) < cut
        inside = nearer | ((F.col(column) == cut) & inside)
    return F.coalesce(inside, F.lit(False))


def ranked(drawn: DataFrame, scratch: Scratch) -> DataFrame:
    """drawn with rank, from 1, in ORDER. Rows are sorted over ranges; no two agree in ORDER, so a hot id is split too."""
    order = [F.col(c).desc() if c == ORDER[0] else F.col(c).asc() for c in ORDER]
    scratch.table(drawn.repartitionByRange(*order).sortWithinPartitions(*order), "drawn")
    rows = scratch.spark.read.schema(drawn.schema).parquet(scratch.path("drawn")).select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_at"))
    # a range is a file, or several in order; their names begin with its number
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n")).collect()
    before, listed = 0, []
    for r in sorted(sizes, key=lambda r: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", r["_part"])[:3] + [r["_part"]]]):
        listed.append((r["_part"], before))
        before += r["n"]
    files = F.broadcast(scratch.spark.createDataFrame(listed, "_part string, _before long"))  # a row a range
    return rows.join(files, "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: float = PERCENT, least: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_features, weight, score, rank, the last null for rows that aren't drawn.

    Of the rows with a non-null id and at least `least` words, `percent` in a hundred, rounded down, are drawn: those of the highest
    scores, ties to the smaller doc_id. A null or empty text has no feature and weight 0; a text of any length counts
    whole; a null id has a null score and is never drawn. Repeated rows are rows of their own, of which as many as
    are needed are drawn; those that share an id go by fewer features first. Where target has no text, its shares are
    all alike. An empty table gives an empty one. Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    scored(docs, target, scratch, grams, buckets, seed)
    table = docs.sparkSession.read.schema("doc_id long, n_words long, n_features long, weight long, score long").parquet(scratch.path("scores"))
    rows = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    fit = F.col("score").isNotNull() & (F.col("n_words") >= least)
    able = rows.where(fit)
    need = int(percent * able.count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    if need < 1:
        return table.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = fit & cutoff(able, need)
    rest = rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(rows.where(drawn), scratch).select(*out, "rank").unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of docs whose id is drawn, with all their columns and _rank, the best rank of the id; settings as in resample()."""
    found = resample(docs, target, **settings).where("rank is not null").groupBy(F.col("doc_id").alias("_drawn")).agg(F.min("rank").alias("_rank"))
    return docs.join(found.hint("merge"), F.col("doc_id") == F.col("_drawn")).drop("_drawn")


def importance_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


SQL = f"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
both_ AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS row, translate(text, '{UPPER}', '{LOWER}') AS text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), translate(text, '{UPPER}', '{LOWER}') FROM benchmark),
words AS (SELECT side, id, row, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM both_),
each_ AS (SELECT side, row, unnest(w) AS word FROM words),
known AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each_)),
bytes AS (SELECT word, list_transform(range(length(h) // 2), lambda k: (('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT)) AS b FROM known),
checked AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8))) % {BUCKETS} AS bucket FROM bytes, tab),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM each_ JOIN checked USING (word) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + {BUCKETS})) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM counted, totals),
sums AS (SELECT row, count(*) AS n, sum(gain) AS g FROM each_ JOIN checked USING (word) JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
weighed AS (
  SELECT id AS doc_id, len(w) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT::DOUBLE AS h
  FROM words LEFT JOIN sums USING (row) WHERE side = 0),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features) AS place,
    count(*) FILTER (n_features >= {LEAST_WORDS} AND score IS NOT NULL) OVER () AS able FROM scores)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {LEAST_WORDS} AND score IS NOT NULL AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM placed
"""
