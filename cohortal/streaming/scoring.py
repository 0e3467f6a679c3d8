"""The stateless operators on streams: domain checks and scoring against a static model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.functions.scalars import finite_label, reaction_components


def score_stream(rows: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """rows(item, features map<string,double>) of a stream or table, with the prediction; unknown names score 0."""
    known = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*(F.lit(float(w)) for w in weights.values()))) if weights else F.create_map().cast("map<string,double>")
    total = F.aggregate(F.map_entries("features"), F.lit(float(intercept)), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(known, e["key"]), F.lit(0.0)))
    return rows.withColumn("prediction", total)


def split_stream(rows: DataFrame) -> DataFrame:
    """(component, side, location) of a stream of three-part strings (s, location)."""
    return rows.select(F.explode(reaction_components(F.col("s"))).alias("c"), "location").select("c.component", "c.side", "location")


def label_stream(rows: DataFrame, *aliases: str) -> DataFrame:
    """rows with label and reason, from the first alias that holds something."""
    value, reason = finite_label(*(F.col(a) for a in aliases))
    return rows.withColumn("label", value).withColumn("reason", reason)
