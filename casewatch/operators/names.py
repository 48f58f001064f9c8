"""Drug names in free text, and misspelled names."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.functions.columns import name_key
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import top_k_per_key
from casewatch.plans.sizing import is_small
from casewatch.plans.skew import Side, product_join

# Executors need not have this package: what runs in tasks travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Everything but letters and digits separates words.
WORD_GAP = r"[^\p{L}\p{N}]+"
# Edits within which closest names are looked for by shared deletions before the others are compared in blocks.
NEAR = 2
# Names on each side of a block.
BLOCK = 2_048
# Words of texts that are looked up at a time in a task, a longer text alone.
WORDS_AT_ONCE = 500_000

# Words of some texts as codes (0: in no name), and the end of each word's text, to (place, phrase) of all occurrences.
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def words(text: str | Column, gap: str = WORD_GAP) -> Column:
    """The lower-cased words of a text, in order."""
    return F.array_remove(F.split(F.lower(text), gap), "")


def phrases(tokens: str | Column, length: int) -> Column:
    """All runs of `length` neighbouring words, joined by single spaces."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    if length == 1:
        return tokens
    last = F.size(tokens) - (length - 1)
    run = F.transform(F.sequence(F.lit(1), last), lambda start: F.array_join(F.slice(tokens, start, length), " "))
    return F.when(last >= 1, run).otherwise(F.array().cast("array<string>"))


def _flat(lists: pa.Array, codes: np.ndarray) -> list[np.ndarray]:
    """The codes of each list."""
    ends = lists.offsets.to_numpy()
    return np.split(codes, (ends - ends[0])[1:-1])


def _coded(phrases: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """Different words of the phrases, and each phrase as their places in that list, from 1."""
    held = phrases.flatten().dictionary_encode()
    return held.dictionary, _flat(phrases, held.indices.to_numpy().astype(np.int64) + 1)


def _runs(phrases: list[np.ndarray], width: int) -> Finder:
    """All phrases at once: the phrases that begin with the same words share a number for them, so each further word of
    a text is looked up only where a phrase goes on."""
    longest = max(map(len, phrases))
    nodes, steps, ends = np.zeros(len(phrases), np.int64), [], []
    which = np.arange(len(phrases))
    for depth in range(longest):
        which = which[[len(phrases[i]) > depth for i in which]]
        keys = nodes[which] * width + np.array([phrases[i][depth] for i in which])
        edges, node = np.unique(keys, return_inverse=True)
        nodes[which] = node
        end = np.full(len(edges), -1)
        done = which[[len(phrases[i]) == depth + 1 for i in which]]
        end[nodes[done]] = done
        steps.append(edges)
        ends.append(end)

    def find(codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, node = np.flatnonzero(codes), None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for depth, (edges, end) in enumerate(zip(steps, ends)):
            if depth:
                inside = places + depth < stops[places]
                places, node = places[inside], node[inside]
            keys = codes[places + depth] + (node * width if depth else 0)
            at = np.minimum(np.searchsorted(edges, keys), len(edges) - 1)
            hit = edges[at] == keys
            places, node = places[hit], at[hit]
            whole = end[node] >= 0
            found.append((places[whole], end[node[whole]]))
        return np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found])

    return find


def _anchored(phrases: list[np.ndarray], before: np.ndarray, width: int) -> Finder:
    """Phrases by their anchors, the words with `before` others before them: the words around are compared there."""
    sizes = np.array([len(p) for p in phrases])
    first, flat = np.cumsum(sizes) - sizes, np.concatenate(phrases)
    anchors = flat[first + before]
    filed = np.argsort(anchors, kind="stable")
    begin = np.searchsorted(anchors[filed], np.arange(width + 1))

    def find(codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(np.diff(begin)[codes])
        counts = np.diff(begin)[codes[places]]
        rows = np.repeat(np.arange(len(places)), counts)
        phrase = filed[begin[codes[places]][rows] + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]]
        anchor = places[rows]
        start = anchor - before[phrase]
        # In the same text: no text ends between the first word and the last.
        fits = (start >= 0) & (start + sizes[phrase] <= stops[anchor])
        phrase, start, anchor = phrase[fits], start[fits], anchor[fits]
        same = stops[start] == stops[anchor]
        phrase, start = phrase[same], start[same]
        for depth in range(int(sizes.max())):
            more = sizes[phrase] > depth
            keep = ~more
            keep[more] = codes[start[more] + depth] == flat[first[phrase[more]] + depth]
            phrase, start = phrase[keep], start[keep]
        return start, phrase

    return find


def _counting(vocabulary: pa.Array, find: Finder, phrases: int):
    """(id, tokens) rows to (id, number, n): the phrases of each text and how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = batch["tokens"], batch["id"]
            ends = tokens.offsets.to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(int(np.searchsorted(ends, ends[begin] + WORDS_AT_ONCE, "right")) - 1, begin + 1)
                own = ends[begin : end + 1] - ends[begin]
                said = tokens.values.slice(int(ends[begin]), int(own[-1]))
                codes = pa.compute.fill_null(pa.compute.index_in(said, vocabulary.cast(said.type)), -1).to_numpy().astype(np.int64) + 1
                text = np.repeat(np.arange(end - begin), np.diff(own))
                place, phrase = find(codes, own[1:][text])
                key, n = np.unique(text[place] * phrases + phrase, return_counts=True)
                columns = [ids.take(pa.array(key // phrases + begin)), pa.array((key % phrases).astype(np.int32)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "number", "n"])
                begin = end

    return run


def _count_in_place(texts: DataFrame, id_column: str, tokens: Column, vocabulary: pa.Array, find: Finder, phrases: int) -> DataFrame:
    """(id, number, mention_count): every text is looked through where it is read, and only counts of a text's phrases,
    by number, are shuffled."""
    rows = texts.select(F.col(id_column).alias("id"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("number", T.IntegerType()), T.StructField("n", T.LongType())]
    counted = rows.mapInArrow(_counting(vocabulary, find, phrases), T.StructType(fields))
    return counted.groupBy("id", "number").agg(F.sum("n").alias("mention_count"))


def _with_names(counted: DataFrame, numbers: list[int], names: list[str], id_column: str, name_column: str) -> DataFrame:
    """Counts by number as counts by name; as many names as were counted before."""
    table = pa.table([pa.array(numbers, pa.int32()), pa.array(names, pa.string())], names=["number", "name"])
    known = F.broadcast(counted.sparkSession.createDataFrame(table))
    return counted.join(known, "number").select(F.col("id").alias(id_column), F.col("name").alias(name_column), "mention_count")


def extract_mentions(
    texts: DataFrame,
    dictionary: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    name_column: str = "drug_name",
    gap: str = WORD_GAP,
) -> DataFrame:
    """(id, name, mention_count) for every dictionary name occurring in a text as whole words.

    Names of any length are found: the word counts present in the dictionary decide which runs of
    words are looked up. Each lookup is an equality, whatever the number of names. Where the names are few enough to be
    sent to every task, a text is looked through where it is read.
    """
    tokens = words(F.col(name_column), gap)
    names = (
        dictionary.select(name_column, F.array_join(tokens, " ").alias("phrase"), F.size(tokens).alias("length"))
        .filter("length > 0")
        .distinct()
    )
    if is_small(names):
        held = names.select(F.col(name_column).alias("name"), F.split("phrase", " ").alias("words"), "phrase").toArrow().combine_chunks()
        if not held.num_rows:
            return texts.select(id_column, F.lit("").alias(name_column), F.lit(0).cast("bigint").alias("mention_count")).limit(0)
        # Names that are the same words share a number.
        shared = held["phrase"].combine_chunks().dictionary_encode()
        numbers = shared.indices.to_numpy()
        _, firsts = np.unique(numbers, return_index=True)
        vocabulary, coded = _coded(held["words"].combine_chunks().take(pa.array(firsts)))
        found = _count_in_place(texts, id_column, words(F.col(text_column), gap), vocabulary, _runs(coded, len(vocabulary) + 1), len(coded))
        return _with_names(found, numbers.tolist(), held["name"].to_pylist(), id_column, name_column)
    # One small number per length, bounded by the longest name.
    lengths = sorted(row["length"] for row in names.select("length").distinct().collect())
    names = names.drop("length")
    tokenised = texts.select(id_column, words(F.col(text_column), gap).alias("tokens"))
    runs = F.flatten(F.array(*[phrases("tokens", n) for n in lengths]).cast("array<array<string>>"))
    found_runs = tokenised.select(id_column, F.explode(runs).alias("phrase"))
    found = product_join([Side(found_runs, (id_column,)), Side(names)], "phrase")
    return found.groupBy(id_column, name_column).agg(F.sum("n").alias("mention_count"))


def anchored_names(dictionary: DataFrame, name_column: str = "drug_name", gap: str = WORD_GAP) -> DataFrame:
    """(anchor, before, words, name): each different name once, filed under the one of its words that the fewest names
    have (of equal ones the longest, then the first), with the number of words before it. Names without words are left
    out."""
    named = dictionary.select(name_column, words(F.col(name_column), gap).alias("words")).filter(F.size("words") > 0).distinct()
    each = named.select(name_column, "words", F.posexplode("words").alias("before", "anchor"))
    frequency = each.groupBy("anchor").agg(F.count_distinct(name_column).alias("names"))
    order = F.struct("names", (-F.length("anchor")).alias("short"), "before", "anchor")
    # The dictionary is small beside the texts; its frequent words are split by adaptive execution.
    best = each.join(frequency, "anchor").groupBy(name_column, "words").agg(F.min(order).alias("best"))
    return best.select(F.col("best.anchor").alias("anchor"), F.col("best.before").alias("before"), "words", F.col(name_column).alias("name"))


def extract_mentions_anchored(
    texts: DataFrame,
    dictionary: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    name_column: str = "drug_name",
    gap: str = WORD_GAP,
) -> DataFrame:
    """As `extract_mentions`, for dictionaries with names of many lengths: each word of a text is looked up once.

    A word that is some name's anchor makes a candidate place for it, and the words around are compared there. The work
    does not depend on how many lengths the names have. Where the names are few enough to be sent to every task, texts are
    compared where they are read, and nothing but counts is shuffled. Else texts are cut into words once and written, and
    so are the candidates, one row for each text and name; those of longer names meet the text's words. Rows with the same
    id count as one text's; NULL ids are kept.
    """
    anchors = cut_lineage(anchored_names(dictionary, name_column, gap), "anchors")
    if is_small(anchors):
        held = anchors.select("before", "words", "name").toArrow().combine_chunks()
        if not held.num_rows:
            return texts.select(id_column, F.lit("").alias(name_column), F.lit(0).cast("bigint").alias("mention_count")).limit(0)
        vocabulary, coded = _coded(held["words"].combine_chunks())
        find = _anchored(coded, held["before"].to_numpy().astype(np.int64), len(vocabulary) + 1)
        found = _count_in_place(texts, id_column, words(F.col(text_column), gap), vocabulary, find, len(coded))
        return _with_names(found, list(range(len(coded))), held["name"].to_pylist(), id_column, name_column)
    rows = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), words(F.col(text_column), gap).alias("tokens"))
    tokenised = cut_lineage(rows, "tokens")
    exploded = tokenised.select("row", F.posexplode("tokens").alias("place", "anchor"))
    filed = anchors.select("anchor", F.struct("before", "words", "name").alias("filed"))
    hits = product_join([Side(exploded, ("row", "place")), Side(filed, ("filed",))], "anchor")
    start = F.col("place") - F.col("filed.before")
    longer = F.size("filed.words") > 1
    grouped = hits.filter(start >= 0).groupBy("row", "filed.words", "filed.name")
    found = cut_lineage(grouped.agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(longer, start)).alias("starts")), "candidates")
    there = F.size(F.filter("starts", lambda s: F.slice("tokens", s + 1, F.size("words")) == F.col("words"))).cast("bigint")
    compared = found.filter(F.size("words") > 1).join(tokenised.select("row", "tokens"), "row").select("row", "name", there.alias("n"))
    counted = found.filter(F.size("words") == 1).select("row", "name", "n").unionByName(compared.filter("n > 0"))
    named = counted.join(tokenised.select("row", "id"), "row").groupBy("id", "name").agg(F.sum("n").alias("mention_count"))
    return named.select(F.col("id").alias(id_column), F.col("name").alias(name_column), "mention_count")


def deletion_variants(name: str, max_distance: int) -> Column:
    """Hashes of the name with up to `max_distance` characters taken out.

    The last and largest level is hashed as it is made, so a long name costs eight bytes per variant.
    """
    level = F.array(F.col(name))
    hashes = F.transform(level, lambda text: F.xxhash64(text))
    for step in range(1, max_distance + 1):
        if step == max_distance:
            last = F.flatten(F.transform(level, lambda text: _one_shorter(text, hashed=True)))
            hashes = F.concat(hashes, last)
        else:
            level = F.array_distinct(F.flatten(F.transform(level, lambda text: _one_shorter(text))))
            hashes = F.concat(hashes, F.transform(level, lambda text: F.xxhash64(text)))
    return F.array_distinct(hashes)


def _one_shorter(text: Column, hashed: bool = False) -> Column:
    """The text without its first, second, ... character."""

    def without(place: Column) -> Column:
        shorter = F.concat(text.substr(F.lit(1), place - 1), text.substr(place + 1, F.length(text)))
        return F.xxhash64(shorter) if hashed else shorter

    kind = "array<bigint>" if hashed else "array<string>"
    shorter = F.transform(F.sequence(F.lit(1), F.length(text)), without)
    return F.when(F.length(text) > 0, shorter).otherwise(F.array().cast(kind))


def normalize_names_fuzzy(
    names: DataFrame,
    dictionary: DataFrame,
    k: int | None = 10,
    max_distance: int | None = None,
    name_column: str = "name",
    dictionary_column: str = "drug_name",
) -> DataFrame:
    """(name, rank, drug_name, distance): the `k` closest dictionary names, or those within `max_distance` edits.

    Two texts within d edits share a text left over from at most d deletions on each side, so an
    equi-join on those leftovers finds every partner. Without a `max_distance` a name that has `k` partners within
    `NEAR` edits is finished; the others are compared with the dictionary in blocks, and every task keeps its best `k`.
    """
    wanted = names.select(name_key(name_column).alias("name")).filter("name is not null").distinct()
    known = dictionary.select(name_key(dictionary_column).alias("drug_name")).filter("drug_name <> ''").distinct()
    if max_distance is not None:
        return _best(_within(wanted, known, max_distance), k)
    if k is None:
        raise ValueError("give k or max_distance")
    wanted, known = cut_lineage(wanted), cut_lineage(known)
    near = cut_lineage(_best(_within(wanted, known, NEAR), k))
    finished = near.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("name")
    rest = cut_lineage(wanted.join(finished, "name", "left_anti"))
    return near.join(finished, "name", "left_semi").unionByName(_best(_in_blocks(rest, known), k))


def _best(pairs: DataFrame, k: int | None) -> DataFrame:
    ranked = top_k_per_key(pairs, ["name"], k, [F.asc("distance"), F.asc("drug_name")])
    return ranked.select("name", "rank", "drug_name", "distance")


def _within(wanted: DataFrame, known: DataFrame, max_distance: int) -> DataFrame:
    left = wanted.select("name", F.explode(deletion_variants("name", max_distance)).alias("variant"))
    right = known.select("drug_name", F.explode(deletion_variants("drug_name", max_distance)).alias("variant"))
    distance = F.levenshtein("name", "drug_name", max_distance)
    return (
        left.join(right, "variant")
        .select("name", "drug_name")
        .distinct()
        .withColumn("distance", distance.cast("bigint"))
        .filter("distance >= 0")
    )


def _in_blocks(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Distances of the names left over to the whole dictionary, a block of each at a time."""
    rows, columns = (max(1, -(-df.count() // BLOCK)) for df in (wanted, known))

    def dealt(df: DataFrame, name: str, own: int, other: int, order: tuple[str, str]) -> DataFrame:
        mine, copies = F.pmod(F.xxhash64(name), F.lit(own)), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select(name, mine.cast("int").alias(order[0]), copies.alias(order[1]))

    left = dealt(wanted, "name", rows, columns, ("row", "column"))
    right = dealt(known, "drug_name", columns, rows, ("column", "row"))
    pairs = left.join(right, ["row", "column"])
    return pairs.select("name", "drug_name", F.levenshtein("name", "drug_name").cast("bigint").alias("distance"))
