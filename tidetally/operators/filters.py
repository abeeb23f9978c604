"""Request filters as Column predicates."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.functions.dates import year_of
from tidetally.schema import OTHER_YEAR, SALMON, SPECIES

# Longer area lists are joined instead of being written into the plan.
MAX_AREAS_IN_PLAN = 200


def species_list(wanted: Sequence[str] | None) -> list[str]:
    """Species asked for, lower-cased; the salmon when none or ``all`` is asked for."""
    named = [name for name in wanted or () if name]
    if not named or "all" in named:
        return list(SALMON)
    chosen = list(dict.fromkeys(name.lower() for name in named))
    unknown = [name for name in chosen if name not in SPECIES]
    if unknown:
        raise ValueError(f"unknown species: {', '.join(unknown)}")
    return chosen


@dataclass(frozen=True)
class FilterSpec:
    """Filters of a request. ``None`` and empty lists mean "no filter"."""

    year_start: str | None = None
    year_end: str | None = None
    catch_area: tuple[str, ...] = ()
    species: tuple[str, ...] = ()
    time_unit: str = "yearly"

    @classmethod
    def from_params(cls, params: Mapping[str, str | Sequence[str]]) -> "FilterSpec":
        """From a parsed query string: one text or a list of texts per name."""

        def texts(name: str) -> list[str]:
            value = params.get(name, [])
            return [value] if isinstance(value, str) else list(value)

        def first(name: str) -> str | None:
            return next(iter(texts(name)), None)

        return cls(
            year_start=first("year_start"),
            year_end=first("year_end"),
            catch_area=tuple(area for area in texts("catch_area") if area),
            species=tuple(texts("species")),
            time_unit=first("time_unit") or "yearly",
        )

    @property
    def species_names(self) -> list[str]:
        return species_list(self.species)


def _year_predicates(year_start: str | None, year_end: str | None, partitioned: bool) -> list[Column]:
    """Bounds on the year text, and with ``partitioned`` also on the partition.

    Years are compared as text, so a blank date passes an upper bound and fails
    a lower one. The partition of odd dates is always kept and left to the exact
    predicate.
    """
    bounds = []
    if year_start is not None:
        bounds.append(lambda year: year >= F.lit(str(year_start)))
    if year_end is not None:
        bounds.append(lambda year: year <= F.lit(str(year_end)))
    found = [bound(year_of(F.col("sample_date"))) for bound in bounds]
    if partitioned:
        partition = F.col("survey_year")
        found += [bound(partition) | (partition == OTHER_YEAR) for bound in bounds]
    return found


def _named(areas: Sequence[str]) -> list[str]:
    return sorted({area for area in areas if area})


def filter_year_range(
    df: DataFrame, year_start: str | None = None, year_end: str | None = None
) -> DataFrame:
    """Year text between the bounds, each optional; prunes a table partitioned by ``survey_year``."""
    for predicate in _year_predicates(year_start, year_end, "survey_year" in df.columns):
        df = df.where(predicate)
    return df


def filter_areas(df: DataFrame, areas: Sequence[str]) -> DataFrame:
    """Rows of the named areas; blanks in the list are ignored, an empty list filters nothing."""
    named = _named(areas)
    if not named:
        return df
    if len(named) <= MAX_AREAS_IN_PLAN:
        return df.where(F.col("catch_area").isin(named))
    wanted = df.sparkSession.createDataFrame([(area,) for area in named], "catch_area string")
    return df.join(wanted, "catch_area", "left_semi")


def filter_area_present(df: DataFrame) -> DataFrame:
    return df.where(F.col("catch_area") != "")


def filter_date_present(df: DataFrame) -> DataFrame:
    return df.where(F.length("sample_date") > 0)


def filter_updated(df: DataFrame) -> DataFrame:
    """Records changed after they were inserted."""
    return df.where(F.col("updated_at") > F.col("created_at"))


def where_clause(spec: FilterSpec, partitioned: bool = False) -> Column:
    """All predicates of the request as one Column; true when there is none.

    The rows are those of ``filtered_records``. With ``partitioned`` the clause
    also prunes a table that is partitioned by ``survey_year``.
    """
    predicates = _year_predicates(spec.year_start, spec.year_end, partitioned)
    named = _named(spec.catch_area)
    if named:
        predicates.append(F.col("catch_area").isin(named))
    return reduce(and_, predicates, F.lit(True))


def filtered_records(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """The records a request asks for (the species filter picks columns, never rows)."""
    spec = spec or FilterSpec()
    df = filter_year_range(df, spec.year_start, spec.year_end)
    return filter_areas(df, spec.catch_area)
