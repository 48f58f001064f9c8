import random

import numpy as np
import pytest

from casewatch.operators import case_sets, cube
from casewatch.plans import sizing, skew
from tests import small_cases
from tests.conftest import rows
from tests.small_cases import best, joined_counts, pair_counts, skewed, tables


def pairs_of(found):
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("dense", [case_sets.DENSE, 3])
@pytest.mark.parametrize("source", ["small", "skewed"])
def test_pairs_are_those_of_a_plain_loop(spark, monkeypatch, dense, source):
    monkeypatch.setattr(case_sets, "DENSE", dense)
    monkeypatch.setattr(case_sets, "BLOCK", 50)
    monkeypatch.setattr(case_sets, "UNPACKED", 3)
    drug, reac, *_ = (small_cases.DRUG, small_cases.REAC) if source == "small" else skewed()
    t = tables(spark, drug=drug, reac=reac)
    counts, cases = pair_counts(drug, reac)
    sets = case_sets.drug_and_reaction_sets(t.drug, t.reac)
    assert pairs_of(case_sets.pair_interactions_from_sets(sets, k=4)) == best(counts, 4, keys=2)
    few = {key: n for key, n in counts.items() if cases[key[:2]] >= 3}
    assert pairs_of(case_sets.pair_interactions_from_sets(sets, k=4, min_cases=3)) == best(few, 4, keys=2)


@pytest.mark.parametrize("dense", [case_sets.DENSE, 3])
def test_asked_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(case_sets, "DENSE", dense)
    drug, reac, *_ = skewed(5)
    t = tables(spark, drug=drug, reac=reac)
    counts, _ = pair_counts(drug, reac)
    asked = [(" D0 ", "d1"), ("d2", "d0"), ("d3", "d3"), ("d4", "nobody"), (None, "d1"), ("d0", "d1")]
    sets = case_sets.drug_and_reaction_sets(t.drug, t.reac)
    found = case_sets.pair_interactions_from_sets(sets, k=3, pairs=spark.createDataFrame(asked, "drug1 string, drug2 string"))
    own = {}
    for case in {c for c, _, name in drug if name == "d3"}:
        for term in {r for c, r in reac if c == case}:
            own["d3", "d3", term] = own.get(("d3", "d3", term), 0) + 1
    turned = {("d2", "d0", key[2]): n for key, n in counts.items() if key[:2] == ("d0", "d2")}
    plain = {key: n for key, n in counts.items() if key[:2] == ("d0", "d1")}
    assert pairs_of(found) == best({**own, **turned, **plain}, 3, keys=2)


def test_numbers_over_many_chunks(spark):
    rng = random.Random(2)
    drug = [(rng.randrange(0, 200_000), "PS", f"d{rng.randrange(6)}") for _ in range(3_000)]
    drug += [(0, "PS", "d0"), (32_768, "PS", "d0"), (32_769, "PS", "d0"), (65_536, "SS", "d1"), (None, "PS", "d1")]
    reac = [(case, f"r{rng.randrange(3)}") for case, _, _ in drug]
    of_numbers = [
        spark.createDataFrame(drug, "primaryid bigint, role_cod string, drugname string"),
        spark.createDataFrame(reac, "primaryid bigint, pt string"),
    ]
    counts, _ = pair_counts(drug, [r for r in reac if r[0] is not None])
    assert case_sets.case_numbers(*[df.limit(0) for df in of_numbers[:1]]) is None
    for gaps in (1_000, 0):  # keys as numbers, and dense numbers
        case_sets.MOST_GAPS, kept = gaps, case_sets.MOST_GAPS
        try:
            sets = case_sets.drug_and_reaction_sets(*of_numbers)
        finally:
            case_sets.MOST_GAPS = kept
        assert pairs_of(case_sets.pair_interactions_from_sets(sets, k=None)) == best(counts, None, keys=2)
        drugs = case_sets.drug_sets(sets)
        sizes = dict(rows(case_sets.set_sizes(drugs)))
        assert sizes == {f"d{n}": len({c for c, _, d in drug if d == f"d{n}" and c is not None}) for n in range(6)}
        merged = dict(rows(case_sets.set_sizes(case_sets.merge_sets(drugs, drugs.where("drug < 'd3'")))))
        assert merged == sizes


def test_pairs_need_no_exchange_by_case(spark):
    t = tables(spark)
    sets = case_sets.drug_and_reaction_sets(t.drug, t.reac).checkpoint()
    text = case_sets.pair_interactions_from_sets(sets)._jdf.queryExecution().executedPlan().toString()
    assert "primaryid" not in text and "hashpartitioning(chunk" in text and "SortMergeJoin" not in text


def test_places_of_bits():
    rng = np.random.default_rng(0)
    bits = rng.random((7, case_sets.CHUNK)) < np.array([0, 0.5, 0.01, 1, 0.0001, 0.2, 0])[:, None]
    row, place = case_sets._places(np.packbits(bits, axis=1, bitorder="little"))
    want = np.nonzero(bits)
    assert (row == want[0]).all() and (place == want[1]).all()


def test_cube_reports_are_those_of_a_plain_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cube, "MAX_CASE_PAIRS", 20)
    drug, reac, outcome, demographics = skewed(7)
    t = tables(spark, drug, reac, outcome, demographics)
    folder = str(tmp_path / "cube")
    for n in (0, 1, 2, 0):
        parts = [df.where(f"pmod(crc32(primaryid), 3) = {n}") for df in (t.drug, t.reac, t.outcome, t.demographics)]
        cube.write_cube(cube.count_cube(*parts), folder, f"q{n}")
    stored = cube.read_cube(spark, folder)
    reacs, severe = [r[:2] for r in reac], [o for o in outcome if o[1] != "OT"]
    segments = [d[:3] for d in demographics]
    for distinct in (False, True):
        counts = joined_counts(drug, reacs, distinct=distinct)
        assert pairs_of(cube.top_from_cube(stored, 3, distinct_cases=distinct)) == best(counts, 3)
        counts = {(d, term, code): n for (d, code, term), n in joined_counts(drug, reacs, [severe], distinct).items()}
        assert pairs_of(cube.severe_from_cube(stored, 3, distinct_cases=distinct)) == best(counts, 3)
        counts = joined_counts(drug, reacs, [segments], distinct)
        assert pairs_of(cube.segments_from_cube(stored, 3, distinct_cases=distinct)) == best(counts, 3, keys=3)


def test_a_part_touches_only_its_own_files(spark, tmp_path):
    t = tables(spark)
    counts = cube.count_cube(t.drug, t.reac, t.outcome, t.demographics)
    folder = tmp_path / "cube"
    cube.write_cube(counts, str(folder), "q1")
    before = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    cube.write_cube(counts, str(folder), "q2")
    after = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    assert before and all(after[f] == when for f, when in before.items())
    assert {f.parts[len(folder.parts)] for f in set(after) - set(before)} == {"part=q2"}
    text = cube.top_from_cube(cube.read_cube(spark, str(folder)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "PartitionFilters: [isnotnull(level" in text


def test_empty_tables(spark):
    t = tables(spark)
    none = [df.limit(0) for df in (t.drug, t.reac, t.outcome, t.demographics)]
    assert cube.count_cube(*none).count() == 0
    assert case_sets.pair_interactions_from_sets(case_sets.drug_and_reaction_sets(*none[:2])).count() == 0


@pytest.mark.parametrize("task_rows", [100, 1_000_000])
def test_sets_of_few_cases_are_stored_small(spark, monkeypatch, task_rows):
    monkeypatch.setattr(sizing, "TASK_ROWS", task_rows)
    many = [(n, "many") for n in range(3_000)] * 2
    few = [(n * 50, f"few {n % 4}") for n in range(40)] + [(7, None), (7, None), (None, "many")]
    given = spark.createDataFrame([*many, *few], "primaryid bigint, name string")
    sets = case_sets.case_sets(given, ["name"])
    found = {row["name"]: row["cases"] for row in sets.where("chunk = 1").collect()}
    assert len(found["many"]) == case_sets.BYTES and len(found[None]) == 2 and len(found["few 1"]) == 2 * 10
    want = {"many": 3_000, None: 1, **{f"few {n}": 10 for n in range(4)}}
    assert dict(rows(case_sets.set_sizes(sets))) == want
    other = case_sets.case_sets(given.union(spark.createDataFrame([(n + 9_000, "few 1") for n in range(3_000)], given.schema)), ["name"])
    assert dict(rows(case_sets.set_sizes(case_sets.merge_sets(sets, other)))) == {**want, "few 1": 3_010}


def test_tasks_that_count_the_cube_are_bounded(spark, monkeypatch):
    given = tables(spark, *skewed(7))
    plain = cube.count_cube(given.drug, given.reac, given.outcome, given.demographics)
    monkeypatch.setattr(cube, "TASK_LEVELS", 10)
    dealt = cube.count_cube(given.drug, given.reac, given.outcome, given.demographics)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (plain, dealt)]
    assert ["REPARTITION_BY_NUM" in p for p in plans] == [False, True]
    assert pairs_of(dealt) == pairs_of(plain)


@pytest.mark.parametrize("heavy_tasks, broadcast", [(1, 500_000), (10**9, 0)])
def test_levels_of_the_cube_are_counted_where_they_are_made(spark, monkeypatch, heavy_tasks, broadcast):
    given = tables(spark, *skewed(7))
    plain = cube.count_cube(given.drug, given.reac, given.outcome, given.demographics)
    monkeypatch.setattr(cube, "TASK_LEVELS", 20)
    monkeypatch.setattr(skew, "HEAVY_TASKS", heavy_tasks)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", broadcast)
    dealt = cube.count_cube(given.drug, given.reac, given.outcome, given.demographics)
    text = dealt._jdf.queryExecution().executedPlan().toString()
    # Only what is counted before its shuffle moves by level.
    assert text.count("hashpartitioning(level") == (1 if heavy_tasks == 1 else 0)
    assert pairs_of(dealt) == pairs_of(plain)


def test_case_tables_move_once(spark):
    given = tables(spark)
    text = cube.case_rows(given.drug, given.reac, given.outcome, given.demographics)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_a_frequent_drug_is_written_by_several_tasks(spark, monkeypatch, tmp_path):
    given = tables(spark, *skewed(7))
    monkeypatch.setattr(cube, "TASK_LEVELS", 200)
    cube.write_cube(cube.count_cube(given.drug, given.reac, given.outcome, given.demographics), str(tmp_path / "cube"), "q1")
    frequent = cube.read_cube(spark, str(tmp_path / "cube")).where("drug = 'd0' AND level = 'effect'")
    assert frequent.selectExpr("input_file_name() file").distinct().count() > 1
