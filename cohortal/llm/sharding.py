"""Operator 1, sharding: a permutation-filled lookup table places every row on a shard.

Each shard lists the slots of a prime-sized table in an order of its own; the shards take turns, each
claiming the first free slot of its list, until no slot is free. The filled table has as many rows as it has
slots, whatever the size of the data, so a broadcast of it gives each row its shard in constant time. A shard
that joins or leaves moves about its own share of the slots and few others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{k:02d}" for k in range(16))
SLOTS = 2039  # a prime of over 100 slots a shard
MAX_SLOTS = 1_000_003  # the bound of what is broadcast


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in `shards`) of every slot. The work is bounded by the parameters, not by data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(slots) or slots > MAX_SLOTS or slots <= len(shards):
        raise ValueError(f"slots must be a prime above the number of shards and at most {MAX_SLOTS}")
    start = [_number(f"start:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turn, table, free = [0] * len(shards), [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[slot := (start[i] + turn[i] * skip[i]) % slots] >= 0:
                turn[i] += 1
            table[slot], free = i, free - 1
            if not free:
                return table


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first eight hex digits of the sha-256 of its text, modulo the table's size.

    Keys are joined with a unit separator; a null counts as the text \\N.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % F.lit(slots)


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot long, shard string), `slots` rows."""
    csv = ",".join(shards[i] for i in fill_table(shards, slots))
    return spark.range(1).select(F.posexplode(F.split(F.lit(csv), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), "shard")


def place(df: DataFrame, keys: list[str], shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`, which must not be columns of df.

    Rows of equal keys meet on one shard; null and empty keys have a shard of their own like any key; repeated
    rows stay repeated; an empty table gives an empty one; other columns pass through.
    """
    if clash := {"slot", "shard"} & set(df.columns):
        raise ValueError(f"rename {sorted(clash)} first")
    table = lookup_table(df.sparkSession, list(shards), slots)
    return df.withColumn("slot", slot_of(*(F.col(k) for k in keys), slots=slots)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, keys: list[str], path: str, files_per_shard: int = 8, **table) -> None:
    """Writes df under path/shard=.../; a shard's rows are spread over several tasks by a hash of the whole row."""
    placed = place(df, keys, **table)
    spread = F.pmod(F.xxhash64(*(c for c in df.columns)), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), spread).drop("slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, ["doc_id"]).select("doc_id", "slot", "shard")


#: Fills the table by recursion over turns, then places each document.
SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%02d', i) AS shard,
    ('0x' || substr(sha256('start:' || printf('shard-%02d', i)), 1, 8))::UBIGINT % {SLOTS} AS start,
    ('0x' || substr(sha256('skip:' || printf('shard-%02d', i)), 1, 8))::UBIGINT % {SLOTS - 1} + 1 AS skip
  FROM range({len(SHARDS)}) t(i)),
prefs AS (
  SELECT i, j, ((start + j * skip) % {SLOTS})::BIGINT AS slot FROM shards, range({SLOTS}) t(j)),
lists AS (SELECT i, list(slot ORDER BY j) AS slots FROM prefs GROUP BY i),
fill(step, taken, slot) AS (
  SELECT 0, []::BIGINT[], NULL::BIGINT
  UNION ALL
  SELECT step + 1, list_append(taken, pick), pick FROM (
    SELECT f.step, f.taken, list_filter(l.slots, lambda s: NOT list_contains(f.taken, s))[1] AS pick
    FROM fill f JOIN lists l ON l.i = f.step % {len(SHARDS)} WHERE f.step < {SLOTS})),
filled AS (SELECT slot, printf('shard-%02d', (step - 1) % {len(SHARDS)}) AS shard FROM fill WHERE step > 0)
SELECT d.doc_id, d.slot, f.shard FROM (
  SELECT doc_id, (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '\\N')), 1, 8))::UBIGINT % {SLOTS})::BIGINT AS slot
  FROM documents) d JOIN filled f USING (slot)
"""
