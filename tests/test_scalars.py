"""Column functions on the shapes that they must tell apart."""

import hashlib
import math

from pyspark.sql import functions as F

from cohortal.functions import hashing as H
from cohortal.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hashes_equal_python(spark):
    digest = hashlib.sha256(b"ns: a: b").hexdigest()
    assert one(spark, H.stable_hash("ns", F.lit("a"), F.lit("b"))) == digest
    assert one(spark, H.hash_fraction(F.lit(digest))) == int(digest[:16], 16) / 2**64
    assert one(spark, H.hash_bucket("ns", F.lit("a"), 7)) == int(hashlib.sha256(b"ns:a").hexdigest()[:8], 16) % 7
    raw = hashlib.sha256(b"sig").digest()
    place, sign = H.signed_bin(F.lit("sig"), 128)
    assert one(spark, place) == int.from_bytes(raw[:8], "big") % 128 and one(spark, sign) == (1.0 if raw[8] % 2 == 0 else -1.0)
    assert one(spark, H.record_fraction(F.lit("k"))) == int(hashlib.sha256(b"k").hexdigest()[:8], 16) / 0xFFFFFFFF


def test_reaction_strings(spark):
    parts = one(spark, S.reaction_components(F.lit("A. B>c>D |x|")))
    assert parts == []  # what stands before the first space has one part
    parts = one(spark, S.reaction_components(F.lit(" A.B..>>D rest")))
    assert [tuple(p) for p in parts] == [("reactant", 0, "A"), ("reactant", 1, "B"), ("product", 0, "D")]
    assert one(spark, S.reaction_components(F.lit("A>B"))) == []
    assert one(spark, S.reaction_sides(F.lit("A.B>>C")))["left"] == ["A", "B"]
    assert one(spark, S.reaction_sides(F.lit("A>> "))) is None


def test_formulas(spark):
    parts = one(spark, S.formula_parts(F.lit("CH3CH2Cl")))
    assert [tuple(p) for p in parts] == [("C", 1), ("H", 3), ("C", 1), ("H", 2), ("Cl", 1)]
    assert one(spark, S.formula_leftover(F.lit("C2x?"))) == "x?"
    counts = lambda **n: F.array(*(F.struct(F.lit(e).alias("element"), F.lit(k).alias("n")) for e, k in n.items()))
    assert one(spark, S.hill_formula(counts(O=1, H=4, C=2, N=0))) == "C2H4O"
    assert one(spark, S.hill_formula(counts(N=1, H=3, Cl=1))) == "ClH3N"
    assert one(spark, S.hill_formula(counts(N=1, H=3, Cl=1), hydrogen_first=True)) == "H3ClN"
    assert one(spark, S.hill_formula(counts(C=0))) == "-"


def test_labels(spark):
    for text, want in (("1.5", (1.5, None)), ("", (None, "missing_label")), ("x", (None, "missing_label")), ("NaN", (None, "nonfinite_label")), ("Infinity", (None, "nonfinite_label"))):
        value, reason = S.finite_label(F.lit(None).cast("string"), F.lit(text))
        assert (one(spark, value), one(spark, reason)) == want
    assert one(spark, S.clean_value(F.lit(float("nan")))) == 0.0
    assert one(spark, S.first_reason((F.lit(False), "a"), (F.lit(True), "b"), (F.lit(True), "c"))) == "b"
    assert one(spark, S.reasons((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(True), "c"))) == ["a", "c"]


def test_bonds_and_pairs(spark):
    for order, aromatic, want in ((1.5, True, "aromatic"), (2.5, False, "triple"), (1.5, False, "double"), (1.4, False, "single")):
        assert one(spark, S.bond_class(F.lit(order), F.lit(aromatic))) == want
    assert one(spark, S.canonical_path(F.array(F.lit("b"), F.lit("a"), F.lit("a")))) == "a|a|b"
    gap = lambda h, l: [one(spark, c) for c in S.pair_gap(F.lit(h).cast("double"), F.lit(l).cast("double"), F.lit(0.5), 0.05)]  # noqa: E731, E741
    assert gap(1.0, 0.5) == [None, 0.0, "INVALID_DIRECTIONAL_GAP"]
    assert gap(0.0, 0.01) == [0.05, 10.0, "FRONTIER_GAP_REGULARIZED"]
    assert gap(None, 1.0)[1:] == [0.0, "FRONTIER_UNAVAILABLE"]
    assert math.isclose(gap(0.0, 2.0)[1], 0.25)
