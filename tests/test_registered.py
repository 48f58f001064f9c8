import pytest

from __spark_entry__ import entry, oracle_sql, queries
from casewatch.functions.columns import with_name_keys
from casewatch.operators import batch, reports
from casewatch.oracle import ORACLE
from casewatch.plans import sizing, skew
from casewatch.registered import QUERIES
from tests.conftest import rows
from tools.check_oracle import compare_one, open_engine

# Results that depend on where k-means puts its cells.
ROWS_ONLY = {"n4", "n4_index", "n4_index_recall"}
# Reports over the case tables with work per hot case.
SKEWED = ["b1", "b2", "b2_requested", "b3", "b4", "b5", "b6", "a3", "a3_cube", "n2_index"]


@pytest.fixture(scope="module")
def engine(data):
    return open_engine(data)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark, data):
    assert len(rows(entry(spark))) == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql_and_pairs_nothing_blindly(spark, data, engine, name):
    df = QUERIES[name](spark, data)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert compare_one(engine, name, df) == ""


@pytest.mark.parametrize("name", SKEWED)
def test_nothing_changes_when_every_case_is_hot_and_nothing_is_small(spark, data, engine, name, monkeypatch):
    monkeypatch.setattr(skew, "MAX_KEY_PRODUCT", -1)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(batch, "PAIR_PART_ROWS", 2)
    assert compare_one(engine, name, QUERIES[name](spark, data)) == ""


def test_one_hot_keys_list_is_bounded(spark):
    sides = [skew.Side(spark.range(500).selectExpr("id % 50 AS k", "id AS v"), ("v",))]
    assert skew.hot_keys(sides, "k", max_product=1, max_keys=7).keys.count() == 7


def test_scans_read_needed_columns_and_push_filters(spark, tmp_path, request):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.maxMetadataStringLength"))
    wide = ["id AS primaryid", "'PS' AS role_cod", "concat('Drug ', id) AS drugname", "'x' AS route", "'y' AS lot_num"]
    with_name_keys(spark.range(100).selectExpr(*wide)).write.parquet(f"{tmp_path}/drug")
    spark.range(100).selectExpr("id AS primaryid", "'p' AS pt", "'z' AS drug_rec_act").write.parquet(f"{tmp_path}/reac")
    drug, reac = spark.read.parquet(f"{tmp_path}/drug"), spark.read.parquet(f"{tmp_path}/reac")
    text = plan(reports.top_side_effects(drug, reac, "Drug 7"))
    assert "EqualTo(role_cod,PS)" in text and "EqualTo(drugname_lower,drug 7)" in text
    assert "ReadSchema: struct<primaryid:bigint,role_cod:string,drugname_lower:string>" in text
    assert "ReadSchema: struct<primaryid:bigint,pt:string>" in text
    assert "TakeOrderedAndProject" in text
    ranked = plan(batch.top_side_effects_by_drug(drug, reac))
    assert ranked.count("WindowGroupLimit") == 2
