"""The registered queries as plain SQL over the same tables, for checking on another engine."""

from __future__ import annotations

from casewatch.registered import (
    AGE_GROUP,
    AGE_OVER,
    DRUG,
    EFFECT,
    OTHER_DRUG,
    SEX,
    SYSTEM_TEXT,
    THIRD_DRUG,
    WEIGHTS,
)

_VIEWS = {
    "drug": """SELECT l_orderkey AS primaryid, l_linenumber AS drug_seq,
        CASE l_returnflag WHEN 'R' THEN 'PS' WHEN 'A' THEN 'SS' WHEN 'N' THEN 'C' END AS role_cod,
        p_name AS drugname, p_type AS prod_ai FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "reac": "SELECT l_orderkey AS primaryid, s_name AS pt FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "outcome": """SELECT l_orderkey AS primaryid, CASE l_linenumber WHEN 1 THEN 'DE' WHEN 2 THEN 'LT'
        WHEN 3 THEN 'HO' WHEN 4 THEN 'DS' ELSE 'OT' END AS outc_cod FROM lineitem""",
    "demographics": """SELECT o_orderkey AS primaryid, o_custkey AS caseid, o_orderpriority AS age_grp,
        o_orderstatus AS sex, o_orderdate AS event_dt, CAST(o_custkey % 100 AS VARCHAR) AS age, 'YR' AS age_cod,
        n_name AS occr_country FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
}


def _sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    named = {**{v: _VIEWS[v] for v in views}, **(extra or {})}
    if not named:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in named.items()) + "\n" + body


_SEVERE = "outc_cod IN ('DE', 'LT', 'HO', 'DS')"
_TOP = """SELECT pt AS side_effect, COUNT(*) AS report_count FROM drug JOIN reac USING (primaryid)
    WHERE role_cod = 'PS' AND lower(drugname) = '{drug}' GROUP BY pt
    ORDER BY report_count DESC, side_effect LIMIT 10"""
_PAIR = """SELECT pt AS shared_side_effect, COUNT(DISTINCT d1.primaryid) AS shared_report_count
    FROM drug d1 JOIN drug d2 USING (primaryid) JOIN reac USING (primaryid)
    WHERE lower(d1.drugname) = '{a}' AND lower(d2.drugname) = '{b}' GROUP BY pt
    ORDER BY shared_report_count DESC, shared_side_effect LIMIT 10"""
_SEGMENT = """SELECT pt AS side_effect, COUNT(*) AS report_count FROM drug JOIN reac USING (primaryid)
    JOIN demographics USING (primaryid) WHERE role_cod = 'PS' AND lower(drugname) = '{drug}' {more}
    GROUP BY pt ORDER BY report_count DESC, side_effect LIMIT 10"""
_SEVERE_TOP = """SELECT pt AS side_effect, outc_cod AS outcome_code, COUNT(*) AS report_count
    FROM drug JOIN reac USING (primaryid) JOIN outcome USING (primaryid) {join}
    WHERE role_cod = 'PS' AND lower(drugname) = '{drug}' AND {severe} {more}
    GROUP BY pt, outc_cod ORDER BY report_count DESC, side_effect, outcome_code LIMIT 10"""


def _severe_top(join: str = "", more: str = "") -> str:
    return _SEVERE_TOP.format(drug=DRUG, severe=_SEVERE, join=join, more=more)


def _names(column: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY drug_name) - 1 AS id, drug_name FROM
    (SELECT DISTINCT lower(trim({column})) AS drug_name FROM drug WHERE trim({column}) <> '')"""


def _best(keys: str, ties: str, source: str, k: int, count: str = "report_count") -> str:
    """The k best rows per key of a counting query."""
    order = ", ".join(f"{tie} ASC NULLS LAST" for tie in ties.split(", "))
    return f"""SELECT {keys}, rank, {ties}, {count} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
    ORDER BY {count} DESC, {order}) AS rank FROM ({source})) WHERE rank <= {k}"""


_KEYED = "lower(trim(drugname)) AS drug"
_B1 = f"""SELECT {_KEYED}, pt AS side_effect, {{count}} AS report_count FROM drug JOIN reac USING (primaryid)
    WHERE role_cod = 'PS' {{more}} GROUP BY 1, 2"""
_B3 = f"""SELECT {_KEYED}, age_grp, sex, pt AS side_effect, COUNT(*) AS report_count FROM drug
    JOIN reac USING (primaryid) JOIN demographics USING (primaryid) WHERE role_cod = 'PS' GROUP BY 1, 2, 3, 4"""
_B4 = f"""SELECT {_KEYED}, pt AS side_effect, outc_cod AS outcome_code, COUNT(*) AS report_count FROM drug
    JOIN reac USING (primaryid) JOIN outcome USING (primaryid) WHERE role_cod = 'PS' AND {_SEVERE} GROUP BY 1, 2, 3"""
_CASE_DRUG = "SELECT DISTINCT primaryid, lower(trim(drugname)) AS drug FROM drug"
_CASE_REAC = "SELECT DISTINCT primaryid, pt FROM reac"
_PAIRS = """SELECT a.drug AS drug1, b.drug AS drug2, pt AS shared_side_effect, COUNT(*) AS shared_report_count
    FROM cd a JOIN cd b ON a.primaryid = b.primaryid AND {pair} JOIN cr ON cr.primaryid = a.primaryid
    GROUP BY 1, 2, 3"""
_PAIR_CTES = {"cd": _CASE_DRUG, "cr": _CASE_REAC}


def _pairs(pair: str, k: int) -> str:
    return _best("drug1, drug2", "shared_side_effect", _PAIRS.format(pair=pair), k, "shared_report_count")


def _severity(weights: dict[str, float]) -> str:
    score = " + ".join(f"CASE WHEN bool_or(outc_cod = '{c}') THEN {float(w)} ELSE 0 END" for c, w in weights.items())
    return _sql(
        """SELECT *, rank() OVER (ORDER BY serious_cases DESC) AS severity_rank FROM (
        SELECT drug, COUNT(*) AS case_count, CAST(COALESCE(SUM(death), 0) AS BIGINT) AS death_cases,
        CAST(COALESCE(SUM(serious), 0) AS BIGINT) AS serious_cases,
        CAST(COALESCE(SUM(weight), 0) AS DOUBLE) AS severity_score
        FROM cases LEFT JOIN flags USING (primaryid) GROUP BY drug)""",
        "drug",
        "outcome",
        extra={
            "cases": f"SELECT DISTINCT primaryid, {_KEYED} FROM drug WHERE role_cod = 'PS'",
            "flags": f"""SELECT primaryid, MAX(CASE WHEN outc_cod = 'DE' THEN 1 ELSE 0 END) AS death,
            MAX(CASE WHEN {_SEVERE} THEN 1 ELSE 0 END) AS serious, {score} AS weight FROM outcome GROUP BY primaryid""",
        },
    )


_MATRIX_CODES = {f"n_{c.lower()}": f"outc_cod = '{c}'" for c in ("DE", "LT", "HO", "DS")}
_MATRIX_CODES["n_other"] = f"NOT {_SEVERE}"
_MATRIX = f"""SELECT drug, side_effect, CAST(SUM(n) AS BIGINT) AS report_count,
    {", ".join(f"CAST(SUM(n * COALESCE({c}, 0)) AS BIGINT) AS {c}" for c in _MATRIX_CODES)},
    CAST(SUM(n * COALESCE(n_de + n_lt + n_ho + n_ds, 0)) AS BIGINT) AS severe_count
    FROM (SELECT primaryid, {_KEYED}, pt AS side_effect, COUNT(*) AS n FROM drug JOIN reac USING (primaryid)
    WHERE role_cod = 'PS' GROUP BY 1, 2, 3) LEFT JOIN (SELECT primaryid,
    {", ".join(f"COUNT(*) FILTER (WHERE {t}) AS {c}" for c, t in _MATRIX_CODES.items())}
    FROM outcome GROUP BY primaryid) USING (primaryid) GROUP BY drug, side_effect"""

_WORDS = """SELECT {id}, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM
    (SELECT {id}, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS words FROM {table})"""
_NAMES = "SELECT DISTINCT word AS drug_name FROM bw"
_RUNS = """SELECT {id}, unnest([word, word || ' ' || lead(word, 1) OVER w,
    word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w]) AS phrase
    FROM {source} WINDOW w AS (PARTITION BY {id} ORDER BY place)"""
_TEXT_CTES = {
    "bw": _WORDS.format(id="item_id", table="benchmark"),
    "dw": _WORDS.format(id="doc_id", table="documents"),
}

_NEAREST = """SELECT query_id, rank, id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id,
    round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id {more})) WHERE rank <= 10"""

# Answers per request, as one union.
_ANSWER_SQL = """SELECT 'top:' || drug AS request_id, 'top' AS kind, rank, side_effect, NULL AS outcome_code,
    report_count FROM b1
    UNION ALL SELECT 'severe:' || drug, 'severe', rank, side_effect, outcome_code, report_count FROM b4
    UNION ALL SELECT 'pair:' || drug1, 'pair', rank, shared_side_effect, NULL, shared_report_count FROM b2
    UNION ALL SELECT 'segment:' || drug, 'segment', rank, side_effect, NULL, report_count FROM b3
    UNION ALL SELECT 'age:' || drug, 'segment', rank, side_effect, NULL, report_count FROM b3age
    UNION ALL SELECT 'sex:' || drug, 'segment', rank, side_effect, NULL, report_count FROM b3sex
    UNION ALL SELECT 'anyone:' || drug, 'segment', rank, side_effect, NULL, report_count FROM b3any"""


def _segment_of(more: str) -> str:
    return _best(
        "drug",
        "side_effect",
        f"""SELECT {_KEYED}, pt AS side_effect, COUNT(*) AS report_count FROM drug JOIN reac USING (primaryid)
        JOIN demographics USING (primaryid) WHERE role_cod = 'PS' {more} GROUP BY 1, 2""",
        10,
    )


_ALL = ("drug", "reac", "outcome", "demographics")
_ANSWERS = _sql(
    _ANSWER_SQL,
    *_ALL,
    extra={
        **_PAIR_CTES,
        "b1": _best("drug", "side_effect", _B1.format(count="COUNT(*)", more=""), 10),
        "b2": _pairs(f"b.drug = '{OTHER_DRUG}'", 10),
        "b3": _segment_of(f"AND age_grp = '{AGE_GROUP}' AND sex = '{SEX}'"),
        "b3age": _segment_of(f"AND age_grp = '{AGE_GROUP}'"),
        "b3sex": _segment_of(f"AND sex = '{SEX}'"),
        "b3any": _segment_of(""),
        "b4": _best("drug", "side_effect, outcome_code", _B4, 10),
    },
)

_OLD = f"AND TRY_CAST(age AS DOUBLE) > {AGE_OVER}"

ORACLE: dict[str, str] = {
    "q1": _sql(_TOP.format(drug=DRUG), "drug", "reac"),
    "q1_distinct_cases": _sql(
        _TOP.format(drug=DRUG).replace("COUNT(*)", "COUNT(DISTINCT primaryid)").replace("LIMIT 10", "LIMIT 5"),
        "drug",
        "reac",
    ),
    "q2": _sql(_PAIR.format(a=DRUG, b=OTHER_DRUG), "drug", "reac"),
    "q2_same_drug": _sql(_PAIR.format(a=DRUG, b=DRUG), "drug", "reac"),
    "q3": _sql(
        _SEGMENT.format(drug=DRUG, more=f"AND age_grp = '{AGE_GROUP}' AND sex = '{SEX}'"),
        "drug",
        "reac",
        "demographics",
    ),
    "q3_any_age": _sql(_SEGMENT.format(drug=DRUG, more=f"AND sex = '{SEX}'"), "drug", "reac", "demographics"),
    "q4": _sql(_severe_top(), "drug", "reac", "outcome"),
    "q5": _sql(_names("drugname"), "drug"),
    "q5_ingredients": _sql(_names("prod_ai"), "drug"),
    "b1": _sql(_best("drug", "side_effect", _B1.format(count="COUNT(*)", more=""), 10), "drug", "reac"),
    "b1_distinct_cases": _sql(
        _best("drug", "side_effect", _B1.format(count="COUNT(DISTINCT primaryid)", more=""), 10), "drug", "reac"
    ),
    "b1_requested": _sql(
        _best("drug", "side_effect", _B1.format(count="COUNT(*)", more="AND drugname LIKE 'red %'"), 3), "drug", "reac"
    ),
    "b2": _sql(_pairs("a.drug < b.drug", 10), "drug", "reac", extra=_PAIR_CTES),
    "b2_min_cases": _sql(
        f"""SELECT * FROM ({_pairs('a.drug < b.drug', 3)}) JOIN (SELECT a.drug AS drug1, b.drug AS drug2 FROM cd a
        JOIN cd b ON a.primaryid = b.primaryid AND a.drug < b.drug GROUP BY 1, 2 HAVING COUNT(*) >= 64)
        USING (drug1, drug2)""",
        "drug",
        "reac",
        extra=_PAIR_CTES,
    ),
    "b2_requested": _sql(_pairs(f"b.drug = '{OTHER_DRUG}'", 10), "drug", "reac", extra=_PAIR_CTES),
    "b3": _sql(_best("drug, age_grp, sex", "side_effect", _B3, 10), "drug", "reac", "demographics"),
    "b4": _sql(_best("drug", "side_effect, outcome_code", _B4, 10), "drug", "reac", "outcome"),
    "b5": _severity({c: 1.0 for c in WEIGHTS}),
    "b5_weighted": _severity(WEIGHTS),
    "b6": _sql(_MATRIX, "drug", "reac", "outcome"),
    "b7": _sql(_severe_top("JOIN demographics USING (primaryid)", _OLD), *_ALL),
    "b7_one_sex": _sql(_severe_top("JOIN demographics USING (primaryid)", f"{_OLD} AND sex = '{SEX}'"), *_ALL),
    "b7_bad_ages": _sql(
        _severe_top("JOIN demographics USING (primaryid)", _OLD),
        *_ALL,
        extra={
            "demographics": f"""SELECT * REPLACE (CASE WHEN age IN ('1', '2', '3', '4', '5') THEN NULL WHEN age = '6'
            THEN '90.5' ELSE age END AS age) FROM ({_VIEWS["demographics"]})"""
        },
    ),
    "b7_ages": _sql(
        """SELECT CASE WHEN age = '1' THEN 'unknown_unit' ELSE 'known' END AS age_status, COUNT(*) AS row_count
        FROM demographics GROUP BY 1""",
        "demographics",
    ),
    "b8": _sql(
        f"""SELECT pt AS side_effect, outc_cod AS outcome_code, COUNT(DISTINCT primaryid) AS report_count
        FROM (SELECT DISTINCT primaryid FROM drug WHERE lower(drugname) = '{DRUG}')
        JOIN (SELECT DISTINCT primaryid FROM drug WHERE lower(drugname) = '{OTHER_DRUG}') USING (primaryid)
        JOIN reac USING (primaryid) JOIN outcome USING (primaryid) JOIN demographics USING (primaryid)
        WHERE {_SEVERE} {_OLD} GROUP BY pt, outc_cod
        ORDER BY report_count DESC, side_effect, outcome_code LIMIT 10""",
        *_ALL,
    ),
    "b9": _sql(
        f"""SELECT * FROM (SELECT drug, side_effect, report_count,
        CAST(SUM(report_count) OVER (PARTITION BY drug) AS BIGINT) AS total_count,
        report_count / SUM(report_count) OVER (PARTITION BY drug) AS share,
        rank() OVER (PARTITION BY drug ORDER BY report_count DESC) AS effect_rank
        FROM ({_B1.format(count="COUNT(*)", more="")})) WHERE side_effect = '{EFFECT}'""",
        "drug",
        "reac",
    ),
    "n1": _sql(
        """SELECT doc_id, drug_name, COUNT(*) AS mention_count FROM dw JOIN names ON word = drug_name
        GROUP BY doc_id, drug_name""",
        extra={**_TEXT_CTES, "names": _NAMES},
    ),
    "n1_phrases": _sql(
        """SELECT doc_id, drug_name, COUNT(*) AS mention_count FROM runs JOIN names ON phrase = drug_name
        GROUP BY doc_id, drug_name""",
        extra={
            **_TEXT_CTES,
            "runs": _RUNS.format(id="doc_id", source="dw"),
            "names": f"""SELECT DISTINCT phrase AS drug_name FROM
            ({_RUNS.format(id="item_id", source="bw")}) WHERE phrase IS NOT NULL""",
        },
    ),
    "n2": """WITH known AS (SELECT DISTINCT p_name AS drug_name FROM part)
        SELECT name, rank, drug_name, distance FROM (SELECT *, row_number() OVER
        (PARTITION BY name ORDER BY distance, drug_name) AS rank FROM (SELECT q.name, k.drug_name,
        CAST(levenshtein(q.name, k.drug_name) AS BIGINT) AS distance FROM
        (SELECT DISTINCT substr(drug_name, 1, 2) || substr(drug_name, 4) AS name FROM known) q, known k))
        WHERE rank <= 3""",
    "n3": _NEAREST.format(more=""),
    "n4_all_probes": _NEAREST.format(more=""),
    "n4_given_cells": _NEAREST.format(more="AND q.label = v.label"),
    "n4_candidates": """SELECT CAST(SUM(n * n) AS BIGINT) AS candidates,
        CAST(SUM(n) * SUM(n) AS BIGINT) AS possible, SUM(n * n) / CAST(SUM(n) * SUM(n) AS DOUBLE) AS share
        FROM (SELECT COUNT(*) AS n FROM embeddings GROUP BY label)""",
    "a1": """SELECT conv_id, turn, role, text, role = 'user' AS asks_tool FROM (SELECT *, row_number() OVER
        (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place = 1""",
    "a2": f"""SELECT conv_id, turn, role, text FROM conversations UNION ALL
        SELECT DISTINCT conv_id, -1, 'system', '{SYSTEM_TEXT}' FROM conversations""",
    "a3": _ANSWERS,
    "a4": _sql(
        """SELECT e.drug AS question_id, COUNT(*) AS fact_count, COUNT(a.side_effect) AS found_count,
        COUNT(a.side_effect) / COUNT(*) AS recall FROM expected e LEFT JOIN answered a
        ON e.drug = a.drug AND e.side_effect = a.side_effect GROUP BY e.drug""",
        "drug",
        "reac",
        extra={
            "expected": _best(
                "drug",
                "side_effect",
                f"""SELECT {_KEYED}, pt AS side_effect, COUNT(*) AS report_count FROM drug
                JOIN reac USING (primaryid) GROUP BY 1, 2""",
                5,
            ),
            "answered": _best("drug", "side_effect", _B1.format(count="COUNT(*)", more=""), 10),
        },
    ),
    "a5": _ANSWERS,
    "a6": _sql(
        """SELECT e.query_id, COUNT(*) AS expected_count, COUNT(a.id) AS found_count,
        COUNT(a.id) / COUNT(*) AS recall FROM exact e LEFT JOIN approx a
        ON e.query_id = a.query_id AND e.id = a.id GROUP BY e.query_id""",
        extra={"exact": _NEAREST.format(more=""), "approx": _NEAREST.format(more="AND q.label = v.label")},
    ),
    "s1": _sql(
        """SELECT CAST(primaryid AS VARCHAR) AS primaryid, CAST(drug_seq AS VARCHAR) AS drug_seq, role_cod, drugname,
        prod_ai FROM drug""",
        "drug",
    ),
    "s2": _sql(
        """SELECT outc_cod, COUNT(*) AS row_count, true AS matches, 'primaryid$caseid$outc_cod' AS header
        FROM outcome GROUP BY outc_cod""",
        "outcome",
    ),
    "s3": _sql(
        " UNION ALL ".join(f"SELECT '{v}' AS family, COUNT(*) AS row_count FROM {v}" for v in _ALL), *_ALL
    ),
    "s4": _sql(
        """SELECT lower(trim(drugname)) AS drugname_key, COUNT(*) AS row_count,
        (SELECT COUNT(*) FROM drug) AS written FROM drug GROUP BY 1""",
        "drug",
    ),
    "s5": _sql("SELECT CAST(primaryid AS VARCHAR) AS primaryid, outc_cod FROM outcome", "outcome"),
    "s6": _sql(
        """SELECT role_cod, outc_cod, COUNT(*) AS row_count FROM drug JOIN outcome USING (primaryid)
        GROUP BY role_cod, outc_cod""",
        "drug",
        "outcome",
    ),
    "s8": _sql(
        " UNION ALL ".join(f"SELECT '{v}' AS table_name, COUNT(*) AS row_count FROM {v}" for v in _ALL), *_ALL
    ),
    "typed": _sql(
        """SELECT strftime(event_dt, '%Y-%m') AS month, 'known' AS age_status, COUNT(*) AS row_count,
        SUM(CAST(age AS DOUBLE)) AS years FROM demographics GROUP BY 1""",
        "demographics",
    ),
    "s9": _sql(
        """SELECT primaryid, drug_seq, role_cod, drugname, prod_ai FROM drug
        ORDER BY primaryid, drug_seq, drugname, role_cod, prod_ai LIMIT 20""",
        "drug",
    ),
}
ORACLE["b2_bitmap"], ORACLE["b2_bitmap_min_cases"] = ORACLE["b2"], ORACLE["b2_min_cases"]
ORACLE["b2_bitmap_requested"] = ORACLE["b2_requested"]
ORACLE["case_counts"] = _sql(
    f"SELECT {_KEYED}, COUNT(DISTINCT primaryid) AS case_count FROM drug WHERE drugname IS NOT NULL GROUP BY 1", "drug"
)
ORACLE["b1_cube"], ORACLE["b3_cube"], ORACLE["b4_cube"] = (ORACLE[q] for q in ("b1_distinct_cases", "b3", "b4"))
ORACLE["a3_cube"], ORACLE["n1_anchored"] = ORACLE["a3"], ORACLE["n1_phrases"]
ORACLE["a3_status"] = f"""WITH a3 AS ({ORACLE["a3"]}), parts AS (SELECT DISTINCT p_name AS drug FROM part)
    SELECT *, 'answered' AS status FROM a3 WHERE rank <= 3
    UNION ALL SELECT label || ':' || drug, kind, NULL, NULL, NULL, NULL, 'no_reports' FROM parts, (VALUES ('top', 'top'), ('severe', 'severe'),
    ('pair', 'pair'), ('segment', 'segment'), ('age', 'segment'), ('sex', 'segment'), ('anyone', 'segment')) AS kinds(label, kind)
    WHERE label || ':' || drug NOT IN (SELECT request_id FROM a3)
    UNION ALL SELECT odd || ':top:' || drug, kind, NULL, NULL, NULL, NULL, status FROM parts,
    (VALUES ('drugless', 'top', 'no_drug'), ('unheard', 'top', 'no_reports'), ('strange', 'horoscope', 'unknown_kind'),
    ('half', 'pair', 'no_drug')) AS odds(odd, kind, status)"""
ORACLE["n2_index"], ORACLE["s7_replaced"], ORACLE["s4_clustered"] = ORACLE["n2"], ORACLE["q5"], ORACLE["q4"]
ORACLE["s10"] = _sql(
    """SELECT outc_cod, COUNT(*) AS row_count, (SELECT COUNT(*) FROM outcome) AS in_files FROM outcome GROUP BY outc_cod""", "outcome"
)
ORACLE["s10_versions"] = _sql(
    """SELECT pt, COUNT(*) AS row_count FROM reac WHERE primaryid IN (SELECT arg_max(primaryid, (primaryid % 100) * 1000000000 + primaryid)
    FROM demographics GROUP BY caseid) GROUP BY pt""",
    "demographics",
    "reac",
)
_B7 = f"""SELECT {_KEYED}, {{age}} AS age_over, {{sex}} AS sex, pt AS side_effect, outc_cod AS outcome_code, COUNT(*) AS report_count
    FROM drug JOIN reac USING (primaryid) JOIN outcome USING (primaryid) JOIN demographics USING (primaryid)
    WHERE role_cod = 'PS' AND {_SEVERE} AND TRY_CAST(age AS DOUBLE) > {{age}} {{more}} GROUP BY 1, 4, 5"""


def _b7(age: int, sex: str | None) -> str:
    name, more = (f"'{sex}'", f"AND sex = '{sex}'") if sex else ("CAST(NULL AS VARCHAR)", "")
    counted = _B7.format(age=f"CAST({age} AS DOUBLE)", sex=name, more=more)
    return _best("drug, age_over, sex", "side_effect, outcome_code", counted, 10)


ORACLE["b7_requested"] = _sql(f"{_b7(AGE_OVER, SEX)} UNION ALL {_b7(30, None)}", *_ALL)
# Answers to the questions; every question is about one drug of the list, some about two more.
_ASKED = f"SELECT DISTINCT p_name AS drug FROM part WHERE p_name NOT IN ('{OTHER_DRUG}', '{THIRD_DRUG}')"
_A7 = """WITH answers AS (
    SELECT 'top:' || drug AS request_id, 'top' AS kind, rank, drug, NULL AS drug2, side_effect, NULL AS outcome_code, NULL AS share,
        report_count FROM b1 WHERE rank <= 5
    UNION ALL SELECT 'wrong:' || drug, 'top', rank, drug, NULL, side_effect, NULL, NULL, report_count FROM b1
    UNION ALL SELECT 'pair:' || drug, 'pair', rank, least(drug, other), greatest(drug, other), shared_side_effect, NULL, NULL,
        shared_report_count FROM (SELECT *, drug1 AS drug, drug2 AS other FROM b2)
    UNION ALL SELECT 'severe:' || drug, 'severe', rank, drug, NULL, side_effect, outcome_code, NULL, report_count FROM b7
    UNION ALL SELECT 'females:' || drug, 'segment', rank, drug, NULL, side_effect, NULL, NULL, report_count FROM b3
    UNION ALL SELECT 'compare:' || asked.drug, 'compare', row_number() OVER (PARTITION BY asked.drug ORDER BY serious_cases DESC, b5.drug),
        b5.drug, NULL, NULL, NULL, NULL, CAST(serious_cases AS BIGINT) FROM asked JOIN b5 ON b5.drug IN (asked.drug, '{other}', '{third}')
    UNION ALL SELECT 'profile:' || drug, 'profile', effect_rank, drug, NULL, side_effect, NULL, share, report_count FROM b9
    UNION ALL SELECT 'severe_pair:' || drug, 'severe_pair', rank, least(drug, '{other}'), greatest(drug, '{other}'), side_effect, outcome_code,
        NULL, report_count FROM b8
) SELECT a.request_id, a.kind, CAST(a.rank AS BIGINT) AS rank, a.drug, a.drug2, a.side_effect, a.outcome_code, CAST(a.share AS DOUBLE) AS share,
    a.report_count FROM answers a JOIN asked ON a.request_id LIKE '%:' || asked.drug"""
_A7_PARTS = {
    "asked": _ASKED,
    **_PAIR_CTES,
    "b1": _best("drug", "side_effect", _B1.format(count="COUNT(*)", more=""), 10),
    "b2": _pairs(f"b.drug = '{OTHER_DRUG}'", 10),
    "b3": _segment_of("AND sex = 'F'"),
    "b5": f"""SELECT {_KEYED}, COUNT(DISTINCT primaryid) AS serious_cases FROM drug JOIN outcome USING (primaryid)
        WHERE role_cod = 'PS' AND {_SEVERE} GROUP BY 1""",
    "b7": _b7(65, None),
    "b8": _best(
        "drug",
        "side_effect, outcome_code",
        f"""SELECT a.drug, pt AS side_effect, outc_cod AS outcome_code, COUNT(DISTINCT primaryid) AS report_count
        FROM cd a JOIN cd b USING (primaryid) JOIN reac USING (primaryid) JOIN outcome USING (primaryid)
        JOIN demographics USING (primaryid) WHERE b.drug = '{OTHER_DRUG}' AND {_SEVERE} AND TRY_CAST(age AS DOUBLE) > 65 GROUP BY 1, 2, 3""",
        10,
    ),
    "b9": f"""SELECT drug, side_effect, report_count, report_count / SUM(report_count) OVER (PARTITION BY drug) AS share,
        rank() OVER (PARTITION BY drug ORDER BY report_count DESC) AS effect_rank
        FROM ({_B1.format(count="COUNT(*)", more="")}) QUALIFY side_effect = '{EFFECT}'""",
}
_ANSWERS_TEXT = _sql("SELECT * FROM a7", *_ALL, extra={**_A7_PARTS, "a7": _A7.format(other=OTHER_DRUG, third=THIRD_DRUG)})
ORACLE["a7"] = _ANSWERS_TEXT
ORACLE["a7_status"] = _sql(
    """SELECT request_id, kind, CASE WHEN request_id IN (SELECT request_id FROM a7) THEN 'answered' ELSE other END AS status FROM (
    SELECT label || ':' || drug AS request_id, kind, other FROM asked, (VALUES ('top', 'top', 'no_reports'), ('wrong', 'top', 'no_reports'),
    ('pair', 'pair', 'no_reports'), ('severe', 'severe', 'no_reports'), ('females', 'segment', 'no_reports'), ('compare', 'compare', 'no_reports'),
    ('profile', 'profile', 'no_reports'), ('severe_pair', 'severe_pair', 'no_reports'), ('many', NULL, 'too_many_drugs'),
    ('none', NULL, 'no_drug')) AS kinds(label, kind, other))""",
    *_ALL,
    extra={**_A7_PARTS, "a7": _A7.format(other=OTHER_DRUG, third=THIRD_DRUG)},
)
ORACLE["q4_stored_key"] = ORACLE["q4"]
ORACLE["s7"] = ORACLE["q5"]
ORACLE["f1"], ORACLE["f2"], ORACLE["f3"], ORACLE["f4"] = (ORACLE[q] for q in ("q1", "q2", "q3", "q4"))
ORACLE["f1_lateral"] = f"SELECT drug, side_effect, report_count FROM ({ORACLE['b1']})"
