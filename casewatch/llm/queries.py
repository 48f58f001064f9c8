"""The operators as queries over the test tables, with production parameters, and the same as SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import (
    decontaminate,
    divergence,
    lm_score,
    packing,
    pieces,
    pii,
    quality,
    ranked_search,
    simhash,
    suffix_dedup,
    token_files,
    topk,
    url_filter,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return url_filter.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.weigh(docs, table(spark, folder, "labels")).drop("text")


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer())


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, folder, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op7_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, folder, "documents"), tokenizer())


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs)

    def number(kind: str):
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = F.filter("pii_spans", lambda s: s["kind"] != pii.SECRET)
    return found.select(
        "doc_id",
        *[number(k) for k in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii_spans")).alias("spans"),
    )


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(table(spark, folder, "documents").select("doc_id", "text"), model)
    decoded = pieces.decode_pieces(encoded.select("doc_id", "piece_ids"), model)
    return decoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("piece_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"), min_docs=10, k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm_score": op7_lm_score,
    "op8_token_files": op8_token_files,
    "op9_pii": op9_pii,
    "op10_top_k": op10_top_k,
    "op11_ranked_search": op11_ranked_search,
    "op12_pieces": op12_pieces,
    "op13_divergence": op13_divergence,
}

# Windows of ten consecutive words (or the whole of a shorter item), met by equality.
_OP6 = r"""
WITH words AS (
    SELECT 'd' AS kind, rowid_ AS id, doc_id AS name, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)
), items AS (
    SELECT DISTINCT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase, least(10, len(w)) AS n
    FROM (
        SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
        FROM (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        )
        WHERE len(w) > 0
    )
), windows AS (
    SELECT id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (
        SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words, (SELECT DISTINCT n FROM items)
        WHERE len(w) >= n
    )
), hits AS (
    SELECT id, i, windows.n, item_id FROM windows JOIN items ON windows.phrase = items.phrase AND windows.n = items.n
), covered AS (
    SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id
), found AS (
    SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY id
)
SELECT name AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (id) LEFT JOIN found USING (id)
"""

_OP3 = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), ruled AS (
    SELECT page_id, coalesce(host, '') AS host, path, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
        END AS rule
    FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP10 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

_OP11 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), sized AS (
    SELECT r, doc_id, w, len(w) AS n FROM docs WHERE len(w) > 0
), totals AS (
    SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), postings AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) SEMI JOIN asked USING (term) GROUP BY r, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight
    FROM postings, totals GROUP BY term, big_n
), impacts AS (
    SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS impact
    FROM postings JOIN sized USING (r) JOIN weights USING (term), totals
), scored AS (
    SELECT item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored JOIN sized USING (r) WHERE score > 0
)
WHERE rank <= 50
"""

_OP13 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), occurring AS (
    SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
    SELECT lang, term, CAST(count(*) AS BIGINT) AS in_lang FROM occurring GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
    SELECT lang, count(*) AS v, CAST(sum(in_lang) AS BIGINT) AS total FROM kept GROUP BY lang
), kinds AS (
    SELECT DISTINCT lang, source FROM docs
), counted AS (
    SELECT lang, source, term, count(*) AS c FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
    SELECT lang, source, term, coalesce(c, 0) AS c, in_lang FROM kinds JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
), totals AS (
    SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM dense GROUP BY lang, source
), shares AS (
    SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (n + 2 * v) AS p,
           1 + (1000000000 * (in_lang + 2)) // (total + 2 * v) AS q
    FROM dense JOIN totals USING (lang, source) JOIN langs USING (lang)
), apart AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM kinds a JOIN kinds b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
WHERE part = 'pair' OR rank <= 10
"""

ORACLE: dict[str, str] = {
    "op3_url_filter": _OP3,
    "op6_decontaminate": _OP6,
    "op10_top_k": _OP10,
    "op11_ranked_search": _OP11,
    "op13_divergence": _OP13,
}
