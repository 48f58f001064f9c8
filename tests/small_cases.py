"""Hand-made case tables, and the reports computed on them by plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from casewatch.sources.star_schema import CaseTables

SEVERE = ("DE", "LT", "HO", "DS")

DRUG = [
    ("1", "PS", "Aspirin"),
    ("1", "PS", "aspirin"),  # same drug twice in one case, other letter case
    ("1", "SS", "Warfarin"),
    ("2", "PS", "ASPIRIN"),
    ("2", "C", "warfarin"),
    ("3", "SS", "aspirin"),  # not a primary suspect
    ("4", "PS", " Aspirin "),  # outer spaces
    ("5", "PS", None),
    ("6", "PS", "warfarin"),
    ("7", "PS", "aspirin"),  # no reaction, no outcome, no demographics
    ("8", "PS", "aspirin"),
    ("8", "PS", "ibuprofen"),
]
REAC = [
    ("1", "Nausea"),
    ("1", "Pain"),
    ("2", "Nausea"),
    ("2", None),
    ("3", "Rash"),
    ("4", "Fever"),
    ("5", "Pain"),
    ("6", "Bleeding"),
    ("8", "Nausea"),
    *[("8", f"Term {i:02d}") for i in range(12)],  # ties at the last place
]
OUTCOME = [
    ("1", "DE"),
    ("1", "HO"),
    ("1", "OT"),
    ("2", "HO"),
    ("2", "HO"),
    ("3", "DE"),
    ("6", "OT"),
    ("8", "DS"),
]
DEMOGRAPHICS = [
    ("1", "Adult", "F", "70", "YR"),
    ("2", "Adult", "M", "9", "DEC"),
    ("3", "adult", "F", "30", "YR"),
    ("4", "Elderly", "F", "old", "YR"),
    ("6", "Adult", "F", "40", "XX"),
    ("8", "Adult", None, "600", "MON"),
    ("8", "Adult", "F", None, "YR"),
]


def tables(spark, drug=DRUG, reac=REAC, outcome=OUTCOME, demographics=DEMOGRAPHICS) -> CaseTables:
    return CaseTables(
        spark.createDataFrame(drug, "primaryid string, role_cod string, drugname string"),
        spark.createDataFrame(reac, "primaryid string, pt string"),
        spark.createDataFrame(outcome, "primaryid string, outc_cod string"),
        spark.createDataFrame(
            demographics, "primaryid string, age_grp string, sex string, age string, age_cod string"
        ),
    )


def skewed(seed: int = 3, cases: int = 60, rows: int = 400):
    """Random rows where case c0 holds a third of every table, and drug d0 and reaction r0 are frequent."""
    rng = random.Random(seed)

    def case():
        return "c0" if rng.random() < 1 / 3 else f"c{rng.randrange(1, cases)}"

    def pick(letter, many):
        return f"{letter}0" if rng.random() < 1 / 3 else f"{letter}{rng.randrange(1, many)}"

    drug = [(case(), rng.choice(["PS", "PS", "SS"]), pick("d", 25)) for _ in range(rows)]
    reac = [(case(), pick("r", 40) if rng.random() < 0.9 else None) for _ in range(rows)]
    outcome = [(case(), rng.choice([*SEVERE, "OT"])) for _ in range(rows // 4)]
    demographics = [(case(), rng.choice("AB"), rng.choice("FM"), "70", "YR") for _ in range(cases * 2)]
    return drug, reac, outcome, demographics


def _by_case(pairs):
    found = defaultdict(list)
    for key, *values in pairs:
        found[key].append(tuple(values))
    return found


def joined_counts(drug, reac, extra=(), distinct=False):
    """Counter of (drug, *extra values, reaction) over the join of the tables on the case, primary suspects only."""
    reactions = _by_case(reac)
    others = [_by_case(table) for table in extra]
    seen = set()
    counts: Counter = Counter()
    for case, role, name in drug:
        if role != "PS" or name is None:
            continue
        combined = [()]
        for table in others:
            combined = [left + right for left in combined for right in table[case]]
        for values in combined:
            for (term,) in reactions[case]:
                key = (name.strip().lower(), *values, term)
                if distinct and (case, key) in seen:
                    continue
                seen.add((case, key))
                counts[key] += 1
    return counts


def pair_counts(drug, reac):
    reactions = _by_case(set(reac))
    names = defaultdict(set)
    for case, _, name in drug:
        if name is not None:
            names[case].add(name.strip().lower())
    counts: Counter = Counter()
    cases: Counter = Counter()
    for case, found in names.items():
        for first in found:
            for second in found:
                if first < second:
                    cases[(first, second)] += 1
                    for (term,) in reactions[case]:
                        counts[(first, second, term)] += 1
    return counts, cases


def best(counts, k, keys=1):
    """The k largest per leading key columns, as (keys..., rank, rest..., count) rows."""
    groups = defaultdict(list)
    for key, n in counts.items():
        groups[key[:keys]].append((key[keys:], n))
    result = []
    for key, found in groups.items():
        found.sort(key=lambda item: (-item[1], [(v is None, v or "") for v in item[0]]))
        result += [(*key, place, *rest, n) for place, (rest, n) in enumerate(found[:k], 1)]
    return sorted(result, key=repr)
