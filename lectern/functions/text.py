"""Tokens, identifiers and text shaping, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a DOI looks like, and what is cut from its end.
DOI_PATTERN = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI_TRAILING = ".,;:)]}>\"'"
_CJK = r"\x{4e00}-\x{9fff}"
_TOKEN = rf"[{_CJK}]|[\p{{L}}\p{{N}}_&&[^{_CJK}]]+"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it (the optimiser would repeat it)."""
    return F.transform(F.array(value), body)[0]


def blank(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def tokenize(text: Column) -> Column:
    """Lower-case words; each CJK character is a word of its own."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def extract_doi(value: Column) -> Column:
    """The first DOI in a text without trailing punctuation; null without one."""
    return blank(F.rtrim(F.regexp_extract(value, DOI_PATTERN, 0), F.lit(DOI_TRAILING)))


def doi_bare(value: Column) -> Column:
    """A DOI as the bibliographic services get it: resolver and scheme go, case stays."""
    v = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.rtrim(F.regexp_replace(v, "(?i)^doi:", ""), F.lit(DOI_TRAILING))


def doi_key(value: Column) -> Column:
    """A DOI as the citation graph compares it: lower case, each known prefix cut once in turn."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        v = F.regexp_replace(v, "^" + prefix.replace(".", r"\."), "")
    return v


def plain_key(value: Column) -> Column:
    """Lower case with blanks collapsed, as duplicates and cached lookups compare texts."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def split_list(value: Column) -> Column:
    """A comma-joined list as its trimmed, non-empty members."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_list(values: Column) -> Column:
    return F.array_join(values, ", ")


def chunk_id(source_path: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_path, F.lit(":"), index.cast("string"), F.lit(":"), text), 256), 1, 24)


def abstract_id(source_path: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_path, F.lit(":abstract")), 256), 1, 24)


def truncated(text: Column, most: int | None) -> Column:
    """Cut to ``most`` characters with an ellipsis; texts that fit stay."""
    if most is None:
        return text
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit(" …"))).otherwise(text)


def contains_ci(hay: Column, needle: str) -> Column:
    """Case-insensitive containment without wildcards; an empty needle is no filter."""
    return F.contains(F.lower(F.coalesce(hay, F.lit(""))), F.lit(needle.lower())) if needle else F.lit(True)


def timestamp_of(value: Column) -> Column:
    """An ISO 8601 time; without a zone it is in UTC."""
    zoned = F.when(value.rlike(r"(Z|[+-]\d\d:?\d\d)$"), value).otherwise(F.concat(value, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def shown_time(value: Column, zone: str = "UTC", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time as people of a zone read it. The session's zone has to be UTC."""
    return F.date_format(F.from_utc_timestamp(timestamp_of(value), zone), pattern)
