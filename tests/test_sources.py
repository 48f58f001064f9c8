import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from casewatch.functions import table_functions
from casewatch.operators import batch, reports
from casewatch.schemas import SCHEMAS, TABLE_COMMENTS
from casewatch.sources import case_files, tables
from casewatch.streaming import intake
from tests.conftest import rows
from tests.small_cases import tables as small_tables

HEADER = "primaryid$caseid$outc_cod\n"


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.txt").write_text(text)
        return str(tmp_path)

    return write


def test_reads_a_family_as_strings(spark, folder):
    base = folder(OUTC24Q1=HEADER + "1$10$DE\n2$$HO\n", OUTC24Q2=HEADER + "3$30$OT\n", OTHER=HEADER + "9$9$XX\n")
    found = case_files.read_family(spark, base, "outcome")
    assert found.schema == SCHEMAS["outcome"]
    assert sorted(rows(found), key=repr) == [("1", "10", "DE"), ("2", None, "HO"), ("3", "30", "OT")]
    manifest = {r["file_name"]: r["row_count"] for r in case_files.file_manifest(found).collect()}
    assert manifest == {"OUTC24Q1.txt": 2, "OUTC24Q2.txt": 1}


def test_headers_are_checked(spark, folder):
    base = folder(OUTC1=HEADER + "1$10$DE\n", OUTC2="caseid$primaryid$outc_cod\n20$2$HO\n")
    pattern = case_files.family_path(base, "outcome")
    found = {r["file_path"].rsplit("/", 1)[1]: r["matches"] for r in case_files.check_headers(spark, pattern, SCHEMAS["outcome"]).collect()}
    assert found == {"OUTC1.txt": True, "OUTC2.txt": False}
    assert len(rows(case_files.read_family(spark, base, "outcome", strict=False))) == 2
    with pytest.raises(Exception, match="CSV header|header"):
        case_files.read_family(spark, base, "outcome").collect()


def test_files_without_rows_are_listed(spark, folder):
    base = folder(OUTC1=HEADER + "1$10$DE\n", OUTC2=HEADER)
    found = case_files.read_family(spark, base, "outcome")
    listed = case_files.file_manifest(found, case_files.family_path(base, "outcome")).collect()
    assert {r["file_name"]: (r["row_count"], r["file_size"] > 0) for r in listed} == {"OUTC1.txt": (1, True), "OUTC2.txt": (0, True)}


def test_short_and_long_rows_are_kept_apart(spark, folder):
    base = folder(OUTC1=HEADER + "1$10$DE\n2$20\n3$30$HO$extra\n")
    found = case_files.read_family(spark, base, "outcome", keep_corrupt=True)
    assert {r["primaryid"]: r["_corrupt"] for r in found.collect()} == {"1": None, "2": "2$20", "3": "3$30$HO$extra"}


def test_quotes_can_be_read_as_text(spark, folder):
    base = folder(OUTC1=HEADER + '1$"a$DE\n2$"b$c"$HO\n')
    literal = case_files.read_family(spark, base, "outcome", quote=None, keep_corrupt=True)
    assert rows(literal.filter("primaryid = '1'"))[0][:3] == ("1", '"a', "DE")
    quoted = case_files.read_family(spark, base, "outcome")
    assert ("2", "b$c", "HO") in rows(quoted)


def test_written_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([("1", None, "DE"), ("2", "a$b", "HO"), ("3", 'say "x"', "OT")], SCHEMAS["outcome"])
    case_files.write_case_files(df, f"{tmp_path}/OUTC25Q1.txt")
    assert sorted(rows(case_files.read_family(spark, str(tmp_path), "outcome"))) == sorted(rows(df))


def test_typed_columns_never_fail(spark):
    raw = spark.createDataFrame(
        [("1", "30", "MON", "20240131"), ("2", "x", "YR", "2024"), ("3", "5", "?", "20240231"), ("4", None, None, None),
         *[(str(i), age, "YR", None) for i, age in enumerate(["NaN", "Infinity", "70d", "-5", "1e3", ""], 5)], ("11", " 90.5 ", "YR", None)],
        "primaryid string, age string, age_cod string, event_dt string",
    )
    typed = tables.typed_demographics(raw).select("age_years", "age_status", F.col("event_date").cast("string"))
    assert rows(typed) == [
        (2.5, "known", "2024-01-31"),
        (None, "not_a_number", None),
        (None, "unknown_unit", None),
        (None, "missing", None),
        *[(None, "not_a_number", None)] * 6,
        (90.5, "known", None),
    ]


@pytest.fixture
def database(spark, tmp_path):
    name = "t_" + "".join(c for c in tmp_path.name if c.isalnum())
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_declared_tables_have_comments(spark, database):
    names = tables.create_tables(spark, database)
    assert len(names) == 4
    for name in names:
        schema = SCHEMAS[name.split(".")[1]]
        columns = {r["name"]: (r["dataType"], r["description"]) for r in map(lambda c: c._asdict(), spark.catalog.listColumns(name))}
        assert columns == {f.name: ("string", f.metadata["comment"]) for f in schema.fields}
        assert spark.catalog.getTable(name).description == TABLE_COMMENTS[name.split(".")[1]]
    df = spark.createDataFrame([("1", "DE")], "primaryid string, outc_cod string")
    tables.insert_table(df, f"{database}.outcome")
    tables.insert_table(df, f"{database}.outcome")
    assert rows(tables.read_table(spark, f"{database}.outcome")) == [("1", None, "DE")]


def test_write_replaces_and_counts(spark, database):
    df = spark.range(100).selectExpr("cast(id % 7 as string) AS drugname", "id")
    assert tables.write_table(spark.range(3).toDF("x"), f"{database}.t") == 3
    assert tables.write_table(df, f"{database}.t", sort_by=["drugname"]) == 100
    stored = tables.read_table(spark, f"{database}.t", "a")
    assert tables.row_count(stored.select("a.id")) == 100
    assert rows(tables.preview(stored.select("id"), 2, ["id"])) == [(0,), (1,)] and tables.preview(stored, 5).count() == 5
    tables.create_table_as(spark, f"{database}.u", f"SELECT DISTINCT drugname FROM {database}.t")
    tables.create_table_as(spark, f"{database}.u", f"SELECT DISTINCT drugname FROM {database}.t")
    assert spark.table(f"{database}.u").count() == 7


def test_bucketed_tables_join_without_a_shuffle(spark, database):
    df = spark.range(1000).selectExpr("id % 100 AS primaryid", "id AS v")
    for name in ("a", "b"):
        tables.write_table(df.withColumnRenamed("v", name), f"{database}.{name}", bucket_by="primaryid", buckets=4)
    joined = spark.table(f"{database}.a").hint("merge").join(spark.table(f"{database}.b"), "primaryid")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_table_functions_equal_the_operators(spark):
    t = small_tables(spark)
    views = {name: f"v_{name}" for name in ("drug", "reac", "outcome", "demographics")}
    for name, view in views.items():
        getattr(t, name).createOrReplaceTempView(view)
    names = table_functions.register_table_functions(spark, views)
    assert table_functions.list_table_functions(spark) == names
    call = lambda text: rows(spark.sql(f"SELECT * FROM {text}"))
    assert call("get_top_side_effects('ASPIRIN')") == rows(reports.top_side_effects(t.drug, t.reac, "aspirin"))
    assert call("get_top_side_effects(drug => NULL)") == []
    assert call("get_drug_pair_interactions('aspirin', 'warfarin')") == rows(
        reports.drug_pair_interactions(t.drug, t.reac, "aspirin", "warfarin")
    )
    assert call("get_side_effect_by_demographics('aspirin', 'Adult', sex_code => 'F')") == rows(
        reports.side_effect_by_demographics(t.drug, t.reac, t.demographics, "aspirin", "Adult", "F")
    )
    assert call("get_severe_side_effects('aspirin')") == rows(
        reports.severe_side_effects(t.drug, t.reac, t.outcome, "aspirin")
    )
    lateral = spark.sql(
        "SELECT n.name, f.* FROM (SELECT DISTINCT lower(drugname) AS name FROM v_drug WHERE drugname = trim(drugname)) n, "
        "LATERAL get_top_side_effects(n.name) f"
    )
    clean = t.drug.filter("drugname = trim(drugname)")
    assert sorted(rows(lateral), key=repr) == sorted(
        rows(batch.top_side_effects_by_drug(clean, t.reac).drop("rank")), key=repr
    )


def test_persistent_table_functions(spark, database):
    for name in table_functions.FUNCTIONS:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
    t = small_tables(spark)
    for name in ("drug", "reac", "outcome", "demographics"):
        tables.write_table(getattr(t, name), f"{database}.{name}")
    before = spark.catalog.currentDatabase()
    spark.sql(f"USE {database}")
    try:
        table_functions.register_table_functions(spark, {n: f"{database}.{n}" for n in table_functions.DEFAULT_TABLES}, k=2, temporary=False)
        assert rows(spark.sql("SELECT * FROM get_top_side_effects('aspirin')")) == [("Nausea", 4), ("Pain", 2)]
    finally:
        spark.sql(f"USE {before}")


def test_replaced_in_one_step(spark, tmp_path):
    folder = str(tmp_path / "versions")
    first = tables.replace_table(spark, "replaced", spark.range(3), folder)
    reading = tables.read_table(spark, "replaced")
    second = tables.replace_table(spark, "replaced", "SELECT id, 'x' AS more FROM range(5)", folder)
    assert reading.count() == 3  # a reader of the old version finishes
    with pytest.raises(Exception, match="no rows"):
        tables.replace_table(spark, "replaced", spark.range(2).select(F.raise_error(F.lit("no rows")).alias("id")), folder)
    assert tables.read_table(spark, "replaced").columns == ["id", "more"] and tables.read_table(spark, "replaced").count() == 5
    gone = tables.drop_versions(spark, folder, second)
    assert first.rsplit("/", 1)[1] in gone and second.rsplit("/", 1)[1] not in gone
    assert tables.read_table(spark, "replaced").count() == 5


def scanned(df):
    """Rows that leave the scans of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_clustered_table_skips_files_and_row_groups(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id AS primaryid", "if(id % 3 = 0, 'hot', concat('drug ', id % 5000)) AS name")
    assert tables.write_clustered(rows, "clustered", "name", files=6, path=str(tmp_path / "clustered")) == 60_000
    files = [f for f in (tmp_path / "clustered").glob("*.parquet")]
    assert len(files) >= 5
    hot = [pq.read_table(f, columns=["name"]).column(0).to_pylist().count("hot") for f in files]
    assert sum(hot) == 20_000 and max(hot) < 15_000  # a frequent key fills several files
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
    one = tables.read_table(spark, "clustered").where("name = 'drug 77'")
    assert one.count() == rows.where("name = 'drug 77'").count()
    assert scanned(one.select("primaryid", "name")) <= 20_000
    # Within the range of a file, but not there: the Bloom filter says so.
    assert scanned(tables.read_table(spark, "clustered").where("name = 'drug 77x'").select("primaryid", "name")) == 0


def test_intake_reads_only_new_files(spark, tmp_path):
    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()

    def arrive(name, *lines, header="primaryid$caseid$outc_cod"):
        (inbox / name).write_text("\n".join([header, *lines]) + "\n")

    def run():
        intake.start_intake(spark, str(inbox), store, "outcome", files_per_batch=1).awaitTermination()
        found = intake.read_store(spark, store, "outcome")
        return sorted((r["file_name"], r["primaryid"], r["outc_cod"]) for r in found.collect())

    arrive("OUTC25Q1.txt", "1$1$DE", "2$2$HO", "2$2$HO")
    first = [("OUTC25Q1.txt", "1", "DE"), ("OUTC25Q1.txt", "2", "HO"), ("OUTC25Q1.txt", "2", "HO")]
    assert run() == first == run()
    stored = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "outcome").rglob("*.parquet")}
    arrive("OUTC25Q2.txt", "3$3$LT")
    assert run() == [*first, ("OUTC25Q2.txt", "3", "LT")]
    assert all(f.stat().st_mtime_ns == when for f, when in stored.items())
    ledger = {r["file_name"]: (r["file_size"], r["row_count"]) for r in intake.read_ledger(spark, store, "outcome").collect()}
    assert ledger == {n: ((inbox / n).stat().st_size, c) for n, c in (("OUTC25Q1.txt", 3), ("OUTC25Q2.txt", 1))}
    # A batch that runs again replaces what it wrote.
    again = spark.read.csv(str(inbox / "OUTC25Q2.txt"), header=True, sep="$").withColumn("file_name", F.lit("OUTC25Q2.txt"))
    intake._replace(again, f"{store}/outcome")
    assert run() == [*first, ("OUTC25Q2.txt", "3", "LT")]
    arrive("OUTC25Q3.txt", "4$4$DS", header="caseid$primaryid$outc_cod")
    with pytest.raises(Exception):
        run()
    assert intake.read_store(spark, store, "outcome").count() == 4


def test_latest_versions(spark):
    rows = [("10", "1", "1"), ("12", "1", "2"), ("11", "1", "10"), ("20", "2", "x"), ("21", "2", None), ("30", None, "1"), ("31", None, "1")]
    found = intake.latest_versions(spark.createDataFrame(rows, "primaryid string, caseid string, caseversion string"))
    kept = {r["primaryid"] for r in found.collect()}
    assert kept == {"11", "21", "30", "31"}
    reac = spark.createDataFrame([("10", "a"), ("11", "b"), ("11", "b"), ("99", "c")], "primaryid string, pt string")
    assert sorted(r["pt"] for r in intake.of_reports(reac, found).collect()) == ["b", "b"]
