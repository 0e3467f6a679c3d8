"""The driver's tables in the shapes of the operators: orders play molecules, their lines play atoms.

Each binding stands here twice: as a DataFrame, and as the SQL of a common table expression for the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortal.operators.loops import MOST_LOCAL, shared_folder

ROWS_OF_A_BUCKET = 1_000_000
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[tuple[str, str, str], str] = {}


def buckets(spark: SparkSession, d: str) -> int:
    """Into how many files the rows of molecules are dealt: as many as a shuffle has tasks, more where these would get over ROWS_OF_A_BUCKET lines."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, d, "lineitem").count() // ROWS_OF_A_BUCKET))


def kept(spark: SparkSession, d: str, name: str, build, key: str | None = None) -> DataFrame:
    """A derived table that many queries read, written once a session beside the checkpoints.

    With a key its rows are written in buckets of that key, as build() has dealt them, so that joins and groupings by the key, alone or
    with further columns, read them without a shuffle.
    """
    held = (spark.sparkContext.applicationId, d, name)
    if held not in _written:
        out = build().write.option("compression", "zstd")
        path = f"{shared_folder(spark, 'bindings')}/{name}"
        if key is None:
            out.parquet(path)
            _written[held] = path
        else:
            table = f"{name}_{uuid.uuid4().hex}"
            out.format("parquet").option("path", path).bucketBy(buckets(spark, d), key).saveAsTable(table)
            _written[held] = table
    return spark.read.parquet(_written[held]) if key is None else spark.table(_written[held])


def atoms(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "atoms", lambda: _atoms(spark, d), "mol_id")


def bonds(spark: SparkSession, d: str, several: bool = False) -> DataFrame:
    return kept(spark, d, "parts" if several else "bonds", lambda: _bonds(spark, d, several), "mol_id")


def small_molecules(spark: SparkSession, d: str) -> bool:
    """Whether a task can take all rows of any molecule."""
    held = (spark.sparkContext.applicationId, d, "largest")
    if held not in _written:
        _written[held] = str(atoms(spark, d).groupBy("mol_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    return int(_written[held]) <= MOST_LOCAL


def molecules(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "molecules", lambda: _molecules(spark, d), "mol_id")


def bits(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "bits", lambda: _bits(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "features", lambda: _features(spark, d), "item")


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """(mol_id, atom_id, element, formal_charge, total_hcount, aromatic, partial_charge, radical_electrons, isotope, hybridization, lone_pairs)"""
    lines = read(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER).repartition(buckets(spark, d), "l_orderkey")
    kind = F.concat("l_returnflag", "l_linestatus")
    element = F.when(kind.isin("NO", "NF"), "C").when(kind.isin("AF", "AO"), "N").when(kind.isin("RF", "RO"), "O").otherwise("S")
    return lines.select(
        F.col("l_orderkey").alias("mol_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).alias("atom_id"),
        element.alias("element"),
        F.when(F.col("l_discount") >= 0.095, 1).when(F.col("l_discount") < 0.005, -1).otherwise(0).alias("formal_charge"),
        (F.col("l_linenumber") % 4).cast("int").alias("total_hcount"),
        (F.col("l_tax") >= 0.055).alias("aromatic"),
        (F.col("l_discount") - 0.05).alias("partial_charge"),
        F.when(F.col("l_quantity") >= 50, 1).otherwise(0).alias("radical_electrons"),
        F.when(F.col("l_quantity") < 2, 13).otherwise(0).alias("isotope"),
        F.when(F.col("l_linenumber") % 4 == 0, "SP").when(F.col("l_linenumber") % 4 == 1, "SP2").otherwise("SP3").alias("hybridization"),
        F.when(kind.isin("NO", "NF"), 0).otherwise(1).alias("lone_pairs"),
    )


def _bonds(spark: SparkSession, d: str, several: bool = False) -> DataFrame:
    """(mol_id, a, b, bond_order, bond_aromatic, conjugated): a chain plus closures. several: without those of some atoms, so that molecules fall apart."""
    p = atoms(spark, d).select("mol_id", F.col("atom_id").alias("a"), "total_hcount", "aromatic")
    q = p.select("mol_id", F.col("a").alias("b"), F.col("aromatic").alias("other"))
    step = (F.col("b") == F.col("a") + 1) | ((F.col("b") == F.col("a") + 3) & (F.col("a") % 2 == 1))
    joined = p.join(q.hint("merge"), "mol_id").where(step)
    if several:
        joined = joined.where("total_hcount <> 3")
    place = F.col("a") + F.col("b") + F.col("total_hcount")
    order = F.when(place % 12 == 0, 3.0).when(place % 3 == 0, 2.0).otherwise(1.0)
    return joined.select("mol_id", "a", "b", order.alias("bond_order"), (F.col("aromatic") & F.col("other")).alias("bond_aromatic"), (place % 4 == 1).alias("conjugated"))


def long_atoms(spark: SparkSession, d: str) -> DataFrame:
    """(mol_id, atom_id, element): customers as molecules, whose orders are the atoms."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("mol_id"), place.alias("atom_id"), F.when(F.col("o_orderkey") % 4 == 0, "N").otherwise("C").alias("element"))


def long_bonds(spark: SparkSession, d: str) -> DataFrame:
    """(mol_id, a, b): chains of all atoms of a customer with a closure at every eighth."""
    p = long_atoms(spark, d).select("mol_id", F.col("atom_id").alias("a"))
    ends = p.select("mol_id", "a", F.explode(F.expr("IF(a % 8 = 1, array(a + 1, a + 4), array(a + 1))")).alias("b"))
    return ends.join(p.select("mol_id", F.col("a").alias("b")).hint("merge"), ["mol_id", "b"], "left_semi").select("mol_id", "a", "b")


def _molecules(spark: SparkSession, d: str) -> DataFrame:
    """(mol_id, formula, n_atoms, label)"""
    count = lambda e: F.sum(F.when(F.col("element") == e, 1).otherwise(0)).cast("string")
    per = atoms(spark, d).groupBy("mol_id").agg(F.concat(F.lit("C"), count("C"), F.lit("N"), count("N"), F.lit("O"), count("O")).alias("formula"), F.count("*").alias("n_atoms"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("mol_id"), (F.col("o_totalprice") / 1000).alias("label"))
    return per.join(orders.hint("merge"), "mol_id").select("mol_id", "formula", "n_atoms", "label")


def items(spark: SparkSession, d: str) -> DataFrame:
    """(item, grp, label): customers in groups of nation and segment."""
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("item"), F.concat(F.col("c_nationkey").cast("string"), F.lit("|"), "c_mktsegment").alias("grp"), F.col("c_acctbal").alias("label"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(item, grp, label, prediction): items with a prediction that follows the label loosely."""
    return items(spark, d).withColumn("prediction", F.col("label") * 0.5 + F.sqrt(F.col("item").cast("double")) * 20)


def raw(spark: SparkSession, d: str) -> DataFrame:
    """(s, location): three-part strings to harvest."""
    p = read(spark, d, "part")
    return p.select(F.translate(F.concat("p_brand", F.lit("."), "p_type", F.lit(">"), "p_name", F.lit(">"), "p_type", F.lit("."), "p_name"), " ", "_").alias("s0"), F.col("p_partkey").alias("location")).select(F.concat("s0", F.lit(" |f:0.1|")).alias("s"), "location")


def _bits(spark: SparkSession, d: str) -> DataFrame:
    """(item, grp, bit): positions with a positive value."""
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("item"), F.col("label").alias("grp"), F.posexplode("embedding").alias("pos", "x")).where("x > 0").select("item", "grp", (F.col("pos") + 1).alias("bit"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    """(item, grp, name, value): degree features of molecules, in groups of one formula; zeros are absent."""
    b, m = bonds(spark, d), molecules(spark, d)
    per = b.groupBy("mol_id").agg(F.count("*").cast("double").alias("edges"), F.sum(F.when(F.col("bond_order") == 2.0, 1.0).otherwise(0.0)).alias("doubles"), F.sum(F.when(F.col("b") == F.col("a") + 3, 1.0).otherwise(0.0)).alias("closures"))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("edges", "doubles", "closures")))
    long = per.select("mol_id", F.explode(names).alias("f")).where("f.value <> 0")
    return long.join(m.hint("merge"), "mol_id").select(F.col("mol_id").alias("item"), F.col("formula").alias("grp"), "f.name", "f.value")


def mol_items(spark: SparkSession, d: str) -> DataFrame:
    """(item, grp, label): the molecules."""
    return molecules(spark, d).select(F.col("mol_id").alias("item"), F.col("formula").alias("grp"), "label")


ATOMS = f"""atoms AS (
  SELECT l_orderkey AS mol_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS INT) AS atom_id,
    CASE concat(l_returnflag, l_linestatus) WHEN 'NO' THEN 'C' WHEN 'NF' THEN 'C' WHEN 'AF' THEN 'N' WHEN 'AO' THEN 'N' WHEN 'RF' THEN 'O' WHEN 'RO' THEN 'O' ELSE 'S' END AS element,
    CAST(CASE WHEN l_discount >= 0.095 THEN 1 WHEN l_discount < 0.005 THEN -1 ELSE 0 END AS INT) AS formal_charge,
    CAST(l_linenumber % 4 AS INT) AS total_hcount, l_tax >= 0.055 AS aromatic, l_discount - 0.05 AS partial_charge,
    CAST(CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END AS INT) AS radical_electrons, CAST(CASE WHEN l_quantity < 2 THEN 13 ELSE 0 END AS INT) AS isotope,
    CASE l_linenumber % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'SP2' ELSE 'SP3' END AS hybridization, CASE WHEN concat(l_returnflag, l_linestatus) IN ('NO', 'NF') THEN 0 ELSE 1 END AS lone_pairs
  FROM lineitem)"""
_BONDS = """(
  SELECT p.mol_id, p.atom_id AS a, q.atom_id AS b, CAST(CASE WHEN (p.atom_id + q.atom_id + p.total_hcount) % 12 = 0 THEN 3.0 WHEN (p.atom_id + q.atom_id + p.total_hcount) % 3 = 0 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS bond_order,
    p.aromatic AND q.aromatic AS bond_aromatic, (p.atom_id + q.atom_id + p.total_hcount) % 4 = 1 AS conjugated
  FROM atoms p JOIN atoms q ON p.mol_id = q.mol_id AND (q.atom_id = p.atom_id + 1 OR (q.atom_id = p.atom_id + 3 AND p.atom_id % 2 = 1)) {where})"""
BONDS = "bonds AS " + _BONDS.format(where="")
PARTS = "bonds AS " + _BONDS.format(where="WHERE p.total_hcount <> 3")
LONG = """atoms AS (
  SELECT o_custkey AS mol_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS atom_id, CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE 'C' END AS element FROM orders),
bonds AS (SELECT p.mol_id, p.atom_id AS a, q.atom_id AS b FROM atoms p JOIN atoms q ON p.mol_id = q.mol_id AND (q.atom_id = p.atom_id + 1 OR (q.atom_id = p.atom_id + 4 AND p.atom_id % 8 = 1)))"""
MOLECULES = """molecules AS (
  SELECT t.mol_id, t.formula, t.n_atoms, o.o_totalprice / 1000 AS label FROM (
    SELECT mol_id, concat('C', CAST(sum(CASE WHEN element='C' THEN 1 ELSE 0 END) AS VARCHAR), 'N', CAST(sum(CASE WHEN element='N' THEN 1 ELSE 0 END) AS VARCHAR),
      'O', CAST(sum(CASE WHEN element='O' THEN 1 ELSE 0 END) AS VARCHAR)) AS formula, count(*) AS n_atoms FROM atoms GROUP BY mol_id) t
  JOIN orders o ON o.o_orderkey = t.mol_id)"""
ITEMS = "items AS (SELECT c_custkey AS item, concat(CAST(c_nationkey AS VARCHAR), '|', c_mktsegment) AS grp, c_acctbal AS label FROM customer)"
SCORED = ITEMS + ", scored AS (SELECT *, label * 0.5 + sqrt(CAST(item AS DOUBLE)) * 20 AS prediction FROM items)"
RAW = "raw AS (SELECT concat(replace(concat(p_brand, '.', p_type, '>', p_name, '>', p_type, '.', p_name), ' ', '_'), ' |f:0.1|') AS s, p_partkey AS location FROM part)"
BITS = """bits AS (SELECT vec_id AS item, label AS grp, bit FROM (
  SELECT vec_id, label, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) AS INT) AS bit FROM embeddings) WHERE x > 0)"""
FEATURES = f"""{ATOMS}, {BONDS}, {MOLECULES}, per AS (
  SELECT mol_id, CAST(count(*) AS DOUBLE) AS edges, sum(CASE WHEN bond_order = 2 THEN 1.0::DOUBLE ELSE 0 END) AS doubles, sum(CASE WHEN b = a + 3 THEN 1.0::DOUBLE ELSE 0 END) AS closures FROM bonds GROUP BY 1),
long AS (SELECT mol_id, 'edges' AS name, edges AS value FROM per UNION ALL SELECT mol_id, 'doubles', doubles FROM per UNION ALL SELECT mol_id, 'closures', closures FROM per),
mol_items AS (SELECT mol_id AS item, formula AS grp, label FROM molecules),
features AS (SELECT l.mol_id AS item, m.formula AS grp, l.name, l.value FROM long l JOIN molecules m USING (mol_id) WHERE l.value <> 0)"""
