import pytest
from conftest import rows
from pyspark.sql import functions as F

from trendspark.operators import dedup, validation


def test_valid_ids(spark):
    df = spark.createDataFrame([(None,), ("",), ("None",), (" none ",), ("  ",), ("a",)], "id string")
    assert rows(dedup.valid_ids(df)) == [("  ",), ("a",)]


def test_dedup_is_global_and_idempotent(spark):
    df = spark.range(5000).select((F.col("id") % 1700).cast("string").alias("id"), F.col("id").alias("ingest_seq"))
    once = dedup.dedup_first(df.repartition(7))
    assert once.count() == 1700 and once.agg(F.max("ingest_seq")).first()[0] == 1699
    assert rows(dedup.dedup_first(once)) == rows(once)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


LINES = [
    '{"id":"a","source":"reddit","x":null}',
    '{"id":"a","source":"Reddit","x":1} trailing',
    "",
    "[1]",
    '{"source":"reddit"}',
    '{"x":2}',
    '{"id":"a","id":"b","source":"mars"}',
    '{"id":"b","source":null,"x":1}',
    '{"id":"a","source":"REDDIT","x":1}',
]


@pytest.fixture()
def parsed(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text("\n".join(LINES) + "\n")
    return validation.parsed_lines(validation.read_lines(spark, str(tmp_path / "lines.jsonl")))


def test_json_errors(parsed):
    assert [r[0] for r in rows(validation.json_errors(parsed), "line")] == [2, 3, 4]


def test_missing_fields_count_nulls_as_present(parsed):
    found = rows(validation.missing_fields(parsed, ["id", "x"]), "line", "detail")
    assert found == [(5, "id"), (5, "x"), (6, "id"), (7, "x")]


def test_duplicate_ids_with_absent_ids(parsed):
    keys = ("file", "line")
    found = validation.duplicate_ids(parsed, keys, scope=("file",))
    assert [r[0] for r in rows(found, "line")] == [6, 8, 9]


def test_mixed_contracts_and_report(parsed):
    keys = ("file", "line")
    contract = {"reddit": ("id", "x")}
    found = rows(validation.validate_mixed(parsed, contract, keys=keys), "line", "rule", "detail")
    assert found == [
        (5, "missing", "id"), (5, "missing", "x"), (6, "unknown_source", ""),
        (7, "unknown_source", "mars"), (8, "unknown_source", ""),
    ]
    report = validation.validation_report(parsed, contract, keys=keys, scope=("file",))
    summary = dict(rows(validation.report_summary(parsed, report)))
    assert summary == {"lines": 9, "json": 3, "missing": 2, "unknown_source": 3, "duplicate": 3}
    with pytest.raises(ValueError):
        validation.report_summary(parsed, report, fail=True)
    assert {"detected_language", "id", "source"} == set(validation.NORMALIZED_COMMON)
