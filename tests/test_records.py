from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from facetspark.sources.records import parse_records, project_keys, read_numbered_lines, read_template, split_from_file_name

LINES = [
    '{"indoml_id": 1, "description": "9 mm copper elbow", "retailer": "northgate", "price": 2.25}',
    '{"indoml_id": 2, "description": "14\\" blade", "retailer": "", "price": null}',
    '{"indoml_id": 3, "description": "a", "price": -4.5, "x": 1e5}',
    '{"indoml_id": 4, "description": "a: \\"b\\": 5", "price": 12345678}',
    '{"indoml_id": 5, "a": "1", "a": "2", "price": 900}',
    '{"indoml_id": 6,  "a":  "two spaces", "tags": ["q","r"], "n": {"k": "v"}}',
    '{"indoml_id": 0.0, "a": "bad id"}',
    'not a record',
]


def test_lenient_parse_fixtures(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    good, rejects = parse_records(lines)
    got = {r.id: dict(r.fields) for r in good.collect()}
    assert got[1] == {"indoml_id": "1", "description": "9 mm copper elbow", "retailer": "northgate", "price": "2.25"}
    assert got[2] == {"indoml_id": "2", "description": "14\\"}
    assert got[3] == {"indoml_id": "3", "description": "a", "x": "1.0"}
    assert got[4] == {"indoml_id": "4", "description": "a: \\", "price": "12345678.0"}
    assert got[5] == {"indoml_id": "5", "a": "2", "price": "900.0"}
    assert got[6] == {"indoml_id": "6", "k": "v"}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert rejects.count() == 2


def test_project_keys_missing_is_null(spark):
    lines = spark.createDataFrame([(LINES[0],), (LINES[2],)], "value string")
    good, _ = parse_records(lines)
    r = project_keys(good, ["retailer", "price"]).orderBy("id").collect()
    assert [tuple(x) for x in r] == [(1, "northgate", "2.25"), (3, None, None)]


def test_strict_parse_routes_malformed_rows(spark):
    lines = spark.createDataFrame([('{"indoml_id": 7, "brand": "b"}',), ("{broken",), ('{"brand": "x"}',)],
                                  "value string")
    good, rejects = parse_records(lines, mode="strict", schema="indoml_id bigint, brand string")
    assert [(r.id, r.brand) for r in good.collect()] == [(7, "b")]
    assert rejects.count() == 2


def test_strict_parse_of_any_schema(spark):
    rows = ['{"a": 1, "indoml_id": 3}', '{"a": "x", "indoml_id": 4}', '{"a": null}', "", None, "[1]"]
    lines = spark.createDataFrame([(x,) for x in rows], "value string")
    good, rejects = parse_records(lines, mode="strict", schema="a bigint")
    assert sorted(str(r.a) for r in good.collect()) == ["1", "None"]
    assert {r.value: r._corrupt for r in rejects.collect()} == {rows[1]: rows[1], "": "", None: "", "[1]": "[1]"}
    good, rejects = parse_records(lines, mode="strict", schema="a bigint, indoml_id bigint")
    assert [(r.id, r.a) for r in good.collect()] == [(3, 1)] and rejects.count() == 5


def test_template_is_one_file(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.txt").write_text(" hello\n{x}\n")
    assert read_template(spark, str(tmp_path / "one")) == read_template(spark, str(tmp_path / "one" / "a.txt")) == "hello\n{x}"
    (tmp_path / "one" / "b.txt").write_text("other")
    with pytest.raises(ValueError, match="several"):
        read_template(spark, str(tmp_path / "one"))


def test_part_files_are_read_by_number(spark, tmp_path):
    for n in (99999, 100000, 7):
        (tmp_path / f"part-{n:05d}-x.txt").write_text(f"line {n}\n")
    got = read_numbered_lines(spark, str(tmp_path), "n").collect()
    assert [r.value for r in sorted(got, key=lambda r: r.n)] == ["line 7", "line 99999", "line 100000"]


def test_split_from_file_name(spark):
    df = spark.createDataFrame([("attribute_train.data",), ("attribute_val.solution",),
                                ("attribute_test_stratified.data",)], "f string")
    got = [r[0] for r in df.select(split_from_file_name(F.col("f"))).collect()]
    assert got == ["train", "val_sol", "test"]
