"""Identifiers, dates and categories of papers, and defaults of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_key(paper_id: Column) -> Column:
    return F.translate(paper_id, "./", "__")


def last_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def infer_categories(paper_id: Column) -> Column:
    """Old ids name their category before the slash; some new ones start with its name."""
    return (
        F.when(paper_id.contains("/"), F.array(F.substring_index(paper_id, "/", 1)))
        .when(paper_id.rlike("^(astro|cond|hep|math|physics)"), F.array(F.substring_index(paper_id, "-", 1)))
        .otherwise(F.array(F.lit("uncategorized")))
    )


def infer_date(paper_id: Column) -> Column:
    """YYMM.number is of 20YY; category/YYMM... is of 19YY for YY above 90, else 20YY; anything else is 2020-01-01."""
    new = paper_id.rlike(r"^\d{4}\.[\d.]*\d$")
    tail = F.split_part(paper_id, F.lit("/"), F.lit(2))
    old = paper_id.contains("/") & tail.rlike(r"^\d{4}")
    yy = F.substring(tail, 1, 2)
    return (
        F.when(new, F.concat(F.lit("20"), F.substring(paper_id, 1, 2), F.lit("-"), F.substring(paper_id, 3, 2), F.lit("-01")))
        .when(old, F.concat(F.when(yy.cast("int") > 90, "19").otherwise("20"), yy, F.lit("-"), F.substring(tail, 3, 2), F.lit("-01")))
        .otherwise("2020-01-01")
    )


def iso_time(text: Column) -> Column:
    """ISO time, with or without Z; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def year_of(date_text: Column, default: int = 2020) -> Column:
    return F.coalesce(F.try_to_number(F.substring(date_text, 1, 4), F.lit("9999")).cast("int"), F.lit(default))


def first_truthy(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def first_category(categories: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.try_element_at(categories, F.lit(1)), F.lit(default))
