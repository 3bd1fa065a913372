"""Text clean-up, labels and templates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"
BOM = "﻿"


def strip(value: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(value, F.lit(BLANKS))


def strip_bom(value: Column) -> Column:
    return strip(F.replace(value, F.lit(BOM), F.lit("")))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def single(value: Column) -> Column:
    """``value`` as a generated column, evaluated once per row: a filter on it stays above it, where one on a plain column is
    pushed below and evaluates the whole expression again."""
    return F.explode(F.array(value))


def first_filled(*values: Column, default: Column | None = None) -> Column:
    """First value that is neither NULL nor empty (``a or b or default``)."""
    filled = [F.nullif(v, F.lit("")) for v in values]
    return F.coalesce(*filled, default) if default is not None else F.coalesce(*filled)


def capitalised(value: Column) -> Column:
    """First character upper-cased, the rest lower-cased."""
    return F.concat(F.upper(value.substr(1, 1)), F.lower(value.substr(2, 2147483647)))


def title_case(value: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalised), "")


def slug(value: Column) -> Column:
    """Lower-case, keep ASCII letters, digits and spaces, join words with a hyphen."""
    kept = F.regexp_replace(F.lower(value), r"[^a-z0-9\s]", "")
    return F.regexp_replace(strip(kept), r"\s+", "-")


def breadcrumb_leaf(value: Column) -> Column:
    """Last part of ``a > b > c``."""
    return strip(F.regexp_extract(value, r"([^>]*)$", 1))


def breadcrumb_root(value: Column) -> Column:
    """First part of ``a > b > c``."""
    return strip(F.regexp_extract(value, r"^([^>]*)", 1))


def company_name(domain: Column) -> Column:
    """Company name guessed from a domain; a missing domain gives the neutral ``Partner``."""
    bare = strip(F.replace(domain, F.lit("www."), F.lit("")))
    return F.coalesce(capitalised(F.regexp_extract(bare, r"^([^.]*)", 1)), F.lit("Partner"))


def fill_template(body: str, name: Column, mark: str = "[Name]") -> Column:
    return F.replace(F.lit(body), F.lit(mark), name)


def anchor_text(raw_json: Column, keys: Sequence[str], no_anchor: str, unknown: str) -> Column:
    """Anchor of a raw row: text, ``no_anchor`` when it has none, ``unknown`` when the row cannot be read."""

    def read(fields: Column) -> Column:
        found = first_filled(*[F.element_at(fields, F.lit(k)) for k in keys], default=F.lit(no_anchor))
        return F.when(fields.isNull(), F.lit(unknown)).otherwise(found)

    return bind(F.from_json(raw_json, "map<string,string>"), read)


def joined(values: Column, separator: str) -> Column:
    """Sorted array of distinct strings as one text."""
    return F.array_join(F.sort_array(F.array_distinct(values)), separator)
