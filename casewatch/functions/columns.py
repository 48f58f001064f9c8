"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.schemas import DEATH, PRIMARY_SUSPECT, SEVERE_OUTCOMES

# Stored name columns written by `with_name_keys`: an equality on them reaches the Parquet statistics,
# one on lower(drugname) does not.
LOWER_NAME = "drugname_lower"
NAME_KEY = "drugname_key"

# Years in one unit of age_cod (fixed values).
AGE_UNITS: dict[str, float] = {
    "DEC": 10.0,
    "YR": 1.0,
    "MON": 1.0 / 12.0,
    "WK": 7.0 / 365.25,
    "DY": 1.0 / 365.25,
    "HR": 1.0 / 8766.0,
}


def name_key(column: str | Column) -> Column:
    """The form of a drug name all batch results are keyed by."""
    return F.lower(F.trim(column))


def with_name_keys(drug: DataFrame) -> DataFrame:
    """Store the two lookup forms of the name next to it, before writing the table."""
    return drug.withColumn(LOWER_NAME, F.lower("drugname")).withColumn(NAME_KEY, name_key("drugname"))


def drug_key(drug: DataFrame) -> Column:
    return F.col(NAME_KEY) if NAME_KEY in drug.columns else name_key("drugname")


def name_is(drug: DataFrame, name: str | None, trim: bool = False) -> Column:
    """Case-insensitive equality with a drug name; `trim` also ignores outer spaces."""
    wanted = F.lit(name).cast("string")
    if trim:
        return drug_key(drug) == name_key(wanted)
    stored = F.col(LOWER_NAME) if LOWER_NAME in drug.columns else F.lower("drugname")
    return stored == F.lower(wanted)


def is_suspect() -> Column:
    return F.col("role_cod") == PRIMARY_SUSPECT


def is_severe() -> Column:
    return F.col("outc_cod").isin(*SEVERE_OUTCOMES)


def is_death() -> Column:
    return F.col("outc_cod") == DEATH


def lookup(column: str, values: Mapping[str, float]) -> Column:
    """The number a small fixed table gives for a code, NULL for other codes."""
    found = F.lit(None).cast("double")
    for code, value in reversed(list(values.items())):
        found = F.when(F.col(column) == code, F.lit(float(value))).otherwise(found)
    return found


def age_number() -> Column:
    """The number an age text spells in plain digits; NULL for a sign, an exponent, a unit, NaN or Infinity."""
    return F.when(F.col("age").rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.regexp_replace("age", r"\s", "").try_cast("double"))


def age_years(units: Mapping[str, float] = AGE_UNITS) -> Column:
    """Age in years; NULL when the text is no number or the unit is unknown."""
    return age_number() * lookup("age_cod", units)


def age_status(units: Mapping[str, float] = AGE_UNITS) -> Column:
    """Why an age can or cannot be used: known, missing, not_a_number or unknown_unit."""
    return (
        F.when(F.col("age").isNull(), "missing")
        .when(age_number().isNull(), "not_a_number")
        .when(lookup("age_cod", units).isNull(), "unknown_unit")
        .otherwise("known")
    )


def date_of(column: str, pattern: str = "yyyyMMdd") -> Column:
    """A date column from text; NULL when the text does not fit the pattern."""
    return F.try_to_timestamp(F.col(column), F.lit(pattern)).cast("date")
