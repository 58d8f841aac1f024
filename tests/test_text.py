from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetspark.functions.text import (classifier_text, cut_marker, extract_fields, extraction_pattern,
                                       last_word, num_text, render_fields, strip_line, strip_ws, to_json_text)

ATTRS = ("supergroup", "group", "module", "brand")


def test_num_text_matches_python_float_repr(spark):
    vals = [0.0, 5.0, 4.5, 12345678.0, 1e5, 1e16, 1.5e16, 123456789012345.6, 9e-5, 1e-4, 0.001, 0.000123,
            1e-7, 2.5e-10, 999.9, 1e7, 9999999.999, 3.141592653589793, 1e22, 1.7976931348623157e308,
            5e-324, -12345678.5, -0.0001]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(num_text("x")).collect()]
    assert got == [str(float(v)) for v in vals]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-1e16, max_value=1e16, allow_nan=False, exclude_min=True, exclude_max=True),
                min_size=1, max_size=40))
def test_num_text_property(spark, xs):
    # parity is claimed for |x| < 1e16 (beyond it two 17-digit forms can both read back)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(num_text("x")).collect()]
    assert got == [str(float(x)) for x in xs]


def test_num_text_from_digits_and_nulls(spark):
    df = spark.createDataFrame([("5",), ("12345678",), (None,), ("abc",)], "s string")
    got = [r[0] for r in df.select(num_text("s")).collect()]
    assert got == ["5.0", "12345678.0", None, None]


def test_strip_line_and_ws(spark):
    df = spark.createDataFrame([("\t {\"a\": 1}} \n",)], "s string")
    r = df.select(strip_ws("s").alias("w"), strip_line("s").alias("l")).first()
    assert r.w == '{"a": 1}}'
    assert r.l == '"a": 1'


def test_extraction_pattern_from_one_attribute_list():
    assert extraction_pattern(["a", "b"]) == "(?d)^a: (.*?) b: (.*)"


def test_extract_fields_fixtures(spark):
    cases = [
        ("supergroup: A group: B module: C brand: D E", ("A", "B", "C", "D E")),
        ("x supergroup: A group: B module: C brand: D", ("na",) * 4),
        ("supergroup: A group: B", ("na",) * 4),
        ("supergroup:  group:  module:  brand: ", ("", "", "", "")),
        ("supergroup: A group: B module: C brand: D\nE", ("A", "B", "C", "D")),
        ("supergroup: A group: B module: C brand: D E", ("A", "B", "C", "D E")),
        ("supergroup: A group: G group: B module: C brand: D", ("A", "G group: B", "C", "D")),
        (None, ("na",) * 4),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = df.select("i", *extract_fields("t", ATTRS)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [e for _, e in cases]


def test_classifier_text_null_modes(spark):
    df = spark.createDataFrame([("widget", None, 4.5), ("cog", "acme", None)], "d string, r string, p double")
    r = df.select(classifier_text("d", "r", "p").alias("a"),
                  classifier_text("d", "r", "p", null_text=None).alias("b")).collect()
    assert r[0].a == "Product Name: widget, Sold by retailer: None, Price: 4.5"
    assert r[0].b == "Product Name: widget, Price: 4.5"
    assert r[1].a == "Product Name: cog, Sold by retailer: acme, Price: None"
    assert r[1].b == "Product Name: cog, Sold by retailer: acme"


def test_render_fields_and_helpers(spark):
    df = spark.createDataFrame([("a b c", None)], "x string, y string")
    r = df.select(render_fields([("x", F.col("x")), ("y", F.col("y"))]).alias("t"),
                  render_fields([("x", F.col("x")), ("y", F.col("y"))], null_text=None).alias("t2"),
                  last_word("x").alias("lw"), cut_marker(F.lit("k: v brand: x brand: y"), " brand").alias("c"),
                  to_json_text("x", "y").alias("j")).first()
    assert r.t == "x: a b c y: None"
    assert r.t2 == "x: a b c"
    assert r.lw == "c"
    assert r.c == "k: v"
    assert r.j == '{"x":"a b c","y":null}'
