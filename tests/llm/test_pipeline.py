import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from casewatch.llm import decontaminate, pii, quality, simhash
from casewatch.llm.queries import ORACLE, QUERIES
from casewatch.plans.lineage import cut_lineage
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_packing import check_places
from tests.llm.test_simhash import groups, plain_fingerprint
from tools.check_oracle import compare_one, open_engine


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, data, name):
    assert compare_one(open_engine(data), name, QUERIES[name](spark, data)) == ""


def test_stages_are_the_plain_ones(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]

    def next_of(name, before):
        after = cut_lineage(stages[name](spark, before, data))
        if name != "packing":
            assert after.schema.simpleString() == docs.schema.simpleString()
        return after, {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}

    good, before, after = next_of("quality", docs)
    selected = quality.weigh(docs, spark.read.parquet(f"{data}/labels.parquet")).where("selected")
    assert after == {r["doc_id"]: before[r["doc_id"]] for r in selected.collect()}

    single, before, after = next_of("near_duplicates", good)
    ids = sorted(before)
    root = groups([plain_fingerprint(before[i]["text"]) for i in ids], 4)
    assert sorted(after) == sorted(ids[g] for g in set(root)) and all(after[i] == before[i] for i in after)

    clean, before, after = next_of("decontamination", single)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert after.keys() == before.keys()
    hits = plain_hits([before[i]["text"] for i in ids if i in before], items, 10)
    for i, (_, hit, _) in zip([i for i in ids if i in before], hits, strict=True):
        assert (after[i] == before[i]) == (not hit)
        assert after[i]["n_chars"] == (len(after[i]["text"]) if hit else before[i]["n_chars"])
    assert not any(h for _, h, _ in plain_hits([r["text"] for r in after.values()], items, 10))

    hidden, before, after = next_of("personal_data", clean)
    assert after.keys() == before.keys()
    model = pii.fit(clean)
    assert {i: r["text"] for i, r in after.items()} == {i: pii.redacted(r["text"], pii.all_spans(r["text"], model)) for i, r in before.items()}

    packed = stages["packing"](spark, hidden, data).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    check_places(packed, 4096)


def test_run_and_defined_cases(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame(
        [(1, None, None), (2, "", 0), (None, "some words", 10), (2, "", 0), (3, "long " * 30_000, 150_000)], "doc_id long, text string, n_chars long"
    ).withColumn("perturbed", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == {1, 3, None} and sum(r["length"] for r in rows if r["doc_id"] == 3) == 30_001
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


CLASHING = ["_n", "_f", "_keep", "keep", "place", "fingerprint", "_fingerprint", "_cut_words", "words", "Spans", "items", "_quality_weight", "weight", "selected"]


def test_columns_of_any_name_stay(spark):
    """Stages keep the columns of their documents, whatever they are called."""
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"start {passage} end"), (2, f"start {passage} end"), (3, "something else altogether here"), (4, None)]
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], ", ".join(["doc_id long", "text string", *[f"`{c}` int" for c in CLASHING]]))
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for kept in (
        simhash.drop_near_duplicates(docs),
        decontaminate.remove_contamination(docs, items),
        quality.keep_good(docs, labels),
    ):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in found)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == {1, 3, 4}
    assert decontaminate.remove_contamination(docs, items).where("doc_id = 1").first()["text"] == "start  end"
