"""Misspelled names against a stored index of three-letter pieces.

A name is cut into its three-letter pieces, with two marks before and after it; equal pieces of a name are numbered. One
edit changes at most three pieces, so names within d edits share all but 3 * d of them, at places at most d apart. Of
two such names the 3 * d + 1 rarest pieces must have one in common: only those are looked up. Names too short to have
that many pieces meet names of like length instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.functions.columns import name_key
from casewatch.plans import sizing
from casewatch.plans.lineage import cut_lineage
from casewatch.plans.ranking import top_k_per_key
from casewatch.plans.sizing import broadcast_if_small
from casewatch.plans.skew import Side, product_join

SIZE = 3
FIRST_RADIUS = 2


def pieces(name: str) -> Column:
    """(piece, place) of a name, in order; a piece holds its number among equal ones of the name."""
    padded = F.concat(F.lit("\u0002" * (SIZE - 1)), F.col(name), F.lit("\u0003" * (SIZE - 1)))
    places = F.sequence(F.lit(1), F.length(name) + (SIZE - 1))
    plain = F.transform(places, lambda place: padded.substr(place, F.lit(SIZE)))
    # Occurrences before each place: names are short, so the quadratic count stays small.
    numbered = F.transform(
        plain, lambda piece, i: F.concat(piece, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda other: other == piece)).cast("string"))
    )
    return F.transform(numbered, lambda piece, i: F.struct(piece.alias("piece"), i.cast("int").alias("place")))


def _exploded(names: DataFrame, name: str) -> DataFrame:
    return names.select(name, F.inline(pieces(name)))


@dataclass(frozen=True)
class NameIndex:
    """`entries` (drug_name, length, piece, place, rarity: from 1 for the rarest piece of the name) and `counts`
    (piece, names)."""

    entries: DataFrame
    counts: DataFrame

    def names(self) -> DataFrame:
        """(drug_name, length), from the one entry of each name that is its rarest."""
        return self.entries.where("rarity = 1").select("drug_name", "length")


def _by_rarity(each: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """(name, length, piece, place, rarity): pieces of each name numbered from the rarest; unknown ones first."""
    known = each.join(broadcast_if_small(counts), "piece", "left")
    order = F.struct(F.coalesce("names", F.lit(0).cast("bigint")).alias("names"), "piece", "place")
    rows = known.groupBy(name).agg(F.array_sort(F.collect_list(order)).alias("found"))
    flat = rows.select(name, F.length(name).alias("length"), F.posexplode("found").alias("at", "one"))
    return flat.select(name, "length", "one.piece", "one.place", (F.col("at") + 1).alias("rarity"))


def write_name_index(dictionary: DataFrame, folder: str, column: str = "drug_name") -> None:
    """Write the index of a dictionary's names, as `name_key`; empty and NULL names are left out."""
    known = dictionary.select(name_key(column).alias("drug_name")).filter("drug_name <> ''").distinct()
    each = cut_lineage(_exploded(known, "drug_name"), "pieces")
    each.groupBy("piece").agg(F.count(F.lit(1)).alias("names")).write.mode("overwrite").parquet(f"{folder}/counts")
    counts = dictionary.sparkSession.read.parquet(f"{folder}/counts")
    _by_rarity(each, counts, "drug_name").write.mode("overwrite").parquet(f"{folder}/entries")


def read_name_index(spark: SparkSession, folder: str) -> NameIndex:
    return NameIndex(spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/counts"))


def _met(asked: DataFrame, known: DataFrame, key: str, small: bool) -> DataFrame:
    """Equi-join; few asked rows (counted) go to every task, of many a frequent key is split."""
    if small:
        return known.join(F.broadcast(asked), key)
    return product_join([Side(asked, ("name",)), Side(known, ("drug_name",))], key)


def _within(asked: DataFrame, index: NameIndex, radius: int, small: bool) -> DataFrame:
    """(name, drug_name, distance) of all names within `radius` edits; `asked` is made by `_by_rarity`."""
    needed = SIZE * radius + 1
    # A name has SIZE - 1 pieces more than letters.
    long_enough = needed - (SIZE - 1)
    first = asked.where((F.col("rarity") <= needed) & (F.col("length") >= long_enough))
    other = index.entries.where((F.col("rarity") <= needed) & (F.col("length") >= long_enough))
    first = first.select("name", F.col("length").alias("asked_length"), F.col("place").alias("asked_place"), "piece")
    shared = _met(first, other.select("drug_name", "length", "place", "piece"), "piece", small)
    near = (F.abs(F.col("length") - F.col("asked_length")) <= radius) & (F.abs(F.col("place") - F.col("asked_place")) <= radius)
    shared = shared.where(near).select("name", "drug_name")

    # Pairs with a name too short for that meet by their lengths, at most `radius` apart.
    lengths = F.explode(F.sequence(F.greatest(F.col("length") - radius, F.lit(1)), F.col("length") + radius))
    some = asked.where("rarity = 1").where(F.col("length") < long_enough + radius)
    some = some.select("name", F.col("length").alias("asked_length"), lengths.alias("length"))
    some = some.where((F.col("asked_length") < long_enough) | (F.col("length") < long_enough))
    like = _met(some, index.names(), "length", small).select("name", "drug_name")

    distance = F.levenshtein("name", "drug_name", radius).cast("bigint")
    pairs = shared.union(like).distinct().withColumn("distance", distance)
    return pairs.where("distance >= 0")


def normalize_names_indexed(
    names: DataFrame, index: NameIndex, k: int | None = 10, max_distance: int | None = None, name_column: str = "name"
) -> DataFrame:
    """(name, rank, drug_name, distance): as `normalize_names_fuzzy`, the `k` closest names of the index, or those
    within `max_distance` edits.

    Without a `max_distance` the radius starts at `FIRST_RADIUS` and doubles: a name that has `k` partners inside the
    radius is finished, the others go on until the radius is as long as the longest name. Wide radii compare a name with
    all names of like length; only names without near partners get there. An empty name has no partners but by length.
    """
    wanted = names.select(name_key(name_column).alias("name")).filter("name is not null").distinct()
    asked = cut_lineage(_by_rarity(_exploded(wanted, "name"), index.counts, "name"), "asked")

    def best(pairs: DataFrame) -> DataFrame:
        ranked = top_k_per_key(pairs, ["name"], k, [F.asc("distance"), F.asc("drug_name")])
        return ranked.select("name", "rank", "drug_name", "distance")

    # Radii up to the longest name make so many rows of a name at most.
    names, longest = asked.where("rarity = 1").agg(F.count(F.lit(1)), F.max("length")).first()
    small = names * (2 * (longest or 0) + 1) <= sizing.BROADCAST_ROWS
    if max_distance is not None:
        return best(_within(asked, index, max_distance, small))
    if k is None:
        raise ValueError("give k or max_distance")
    longest = max(longest or 0, index.names().agg(F.max("length")).first()[0] or 0)
    radius, found, left = FIRST_RADIUS, None, names
    while True:
        near = cut_lineage(best(_within(asked, index, radius, small)), "near")
        finished = near.where(F.col("rank") == k).select("name")
        if radius >= longest or (left := left - finished.count()) <= 0:
            return near if found is None else found.union(near)
        finished = F.broadcast(finished) if small else finished
        ready = near.join(finished, "name", "left_semi")
        found = ready if found is None else found.union(ready)
        asked = asked.join(finished, "name", "left_anti")
        radius = min(2 * radius, longest)
