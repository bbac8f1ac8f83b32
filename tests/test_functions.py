import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockweave.functions import refdes, similarity, text, units
from stockweave.operators import headers


def evaluate(spark, inputs, *exprs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *[e(F.col("x")).alias(f"o{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


REFDES = {
    "D1-D4": "D1, D2, D3, D4", "R1-R3, R5, R7-R9": "R1, R2, R3, R5, R7, R8, R9", "R10, R2, R1,": "R1, R2, R10", "U1, R01, X?, R1": "R1, R1, U1, X?",
    "R5-R1": "R5-R1", "R5-R1, C1": "C1", "R1-C3": "C3, R1", "": "", " , ": "", "C1-6, C10-15": "C1-6, C10-15", "-R1": "-R1",
}


def test_refdes(spark):
    got = evaluate(spark, REFDES, refdes.expand)
    assert [g[0] for g in got] == list(REFDES.values())
    assert evaluate(spark, [None, "R1-R999999999"], refdes.expand) == [("",), ("R1-R999999999",)]


def test_refdes_is_idempotent(spark):
    once = evaluate(spark, REFDES, refdes.expand)
    assert evaluate(spark, [x[0] for x in once], refdes.expand) == once


def test_quantity_and_tolerance(spark):
    assert [r[0] for r in evaluate(spark, ["1.0", "2.7", "abc", "", " 1e2 ", "-4.9", "nan", "inf", "1f", "1_000", None], text.quantity)] == [1, 2, None, None, 100, -4, None, None, None, 1000, None]
    assert [r[0] for r in evaluate(spark, ["Tolerance: 5%", "TOLERANCE 0.1%", "none", None], text.tolerance)] == ["5%", "0.1%", None, None]


def test_units(spark):
    cases = {"42": (42.0, None), "0805": (805.0, None), "10n": (1e-8, "n"), "100k": (1e5, "k"), "470R": (470.0, "R"), "3.3V": (3.3, "V"), "100kΩ": (1e5, "kΩ"), "5mm": (5.0, "m"), "4k7": (4000.0, "k"), "1N4148": (1e-9, "N")}
    got = evaluate(spark, cases, units.normalize_unit)
    for (value, unit), (u,) in zip(cases.values(), got, strict=True):
        assert u.num == pytest.approx(value) and u.unit_in == unit
    assert [u.text for (u,) in evaluate(spark, ["n/a", None, "  "], units.normalize_unit)] == ["n/a", None, "  "]


def test_checksum_goldens(spark):
    df = spark.createDataFrame([(1.0, {"reference_designator": "C3"}), (None, {}), (1.0, {"reference_designator": " C3 ", "row_index": "7"})], "q double, a map<string,string>")
    got = [r[0] for r in df.select(text.checksum(F.col("q"), F.col("a"))).collect()]
    assert got[0] == "42d9352918574a5483893ac14a5e92bf0b20c804cb10bacd3f433dbb94da08a7"
    assert got[1] == "7fd27078a9b700fe8c4c1105d8a4694df0f35abbe56357f90d223ca276b01981"
    assert got[2] == got[0]


def test_checksum_is_json(spark):
    attrs = {"b": 'x "y"\\', "a": "1  2"}
    df = spark.createDataFrame([(2.5, attrs)], "q double, a map<string,string>")
    want = json.dumps({"attributes": {"a": "1 2", "b": 'x "y"\\'}, "quantity": 2.5})
    assert df.select(text.checksum(F.col("q"), F.col("a"))).first()[0] == hashlib.sha256(want.encode()).hexdigest()


def test_headers(spark):
    cases = {"Part_Number": "manufacturer_part_number", "partnumber": "part_number", "Comments": "notes", "Designation": "reference_designator", "Ref": "reference_designator", "Qnty": "quantity", "Cmp name": "description",
             "Item#": "part_number", "Supplier Name": "manufacturer", "_": "manufacturer_part_number", "": None, "zzz": None, "_qty": "quantity"}
    assert {k: headers.resolve(k) for k in cases} == cases
    assert [r[0] for r in evaluate(spark, cases, headers.resolve_column)] == list(cases.values())
    assert headers.mapping_report([]) == {"mapped": {}, "unmapped": []}
    assert headers.mapping_report(["Ref", "zzz"])["unmapped"] == ["zzz"]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_similarity_bounds(a, b):
    assert 0.0 <= similarity.string_ratio(a, b) <= 1.0
    assert similarity.map_ratio({"k": a}, {"k": a}) in (0.0, 1.0)


def test_similarity_values():
    assert similarity.map_ratio({}, None) == 1.0 and similarity.map_ratio({"a": "x"}, {}) == 0.0
    assert similarity.map_ratio({"a": "X", "b": "1"}, {"a": "x"}) == 0.5


def test_long_functions_run_in_compiled_code(spark):
    """Spark's lambdas are interpreted: 160 us a cell of designators, 50 us a checksum."""
    df = spark.createDataFrame([(1.0, "R3, X?,R1-R2", {"b": "é\U0001f600～  x ", "～": None, "\U0001f600": "/\x7f", "row_index": "1"})], "q double, c string, a map<string,string>")
    got = df.select(refdes.expand(F.col("c")).alias("r"), text.checksum(F.col("q"), F.col("a")).alias("s"), text.json_map(text.semantic(F.col("a"))).alias("j"))
    assert "lambda" not in got.drop("j")._jdf.queryExecution().optimizedPlan().toString()
    row = got.first()
    assert row.r == "R1, R2, R3, X?"
    assert row.j == '{"b": "\\u00E9\\uD83D\\uDE00\\uFF5E \\u2003x ", "\\uFF5E": null, "\\uD83D\\uDE00": "/\x7f"}'
    clean = row.j.replace(" \\u2003x ", " x")
    assert row.s == hashlib.sha256(f'{{"attributes": {clean}, "quantity": 1}}'.encode()).hexdigest()
