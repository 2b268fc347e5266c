"""What a usable title is, and where to find one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
URL_PATTERN = r"(?i)https?://|www\.|[a-z0-9-]+\.(com|cn|net|org|top|xyz)\b"
AD_KEYWORDS = ("google自动化", "外推软件", "最新版", "top233", "seo", "代发", "引流", "推广", "广告", "下载", "破解", "免费版", "官网", "加微信", "telegram", "whatsapp")
SECTION_NAMES = (
    "abstract|keywords?|introduction|related works?|background|methods?|materials and methods|results?|experiments?|"
    "discussion|conclusions?|references?|bibliography|acknowledg(e?)ments?|contents?"
)
SYMBOL_LIMIT, TITLE_CHARS, LINE_CHARS, SCAN_LINES = 0.28, (3, 260), (12, 200), 12
_CJK = r"[\x{4e00}-\x{9fff}]"


def clean(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[\s\x{a0}]+", " "))


def symbol_ratio(title: Column) -> Column:
    """Share of visible characters that are neither letters, digits nor usual punctuation; 1 without visible ones."""

    def share(seen: Column) -> Column:
        odd = F.length(F.regexp_replace(seen, r"[\p{L}\p{N}:,.;()\[\]/-]", ""))
        return F.when(F.length(seen) == 0, F.lit(1.0)).otherwise(odd / F.length(seen))

    return let(F.regexp_replace(title, r"\s", ""), share)


def trusted(title: Column) -> Column:
    """Whether a title is worth keeping; false for null."""
    return title.isNotNull() & F.coalesce(let(clean(title), _fits), F.lit(False))


def _fits(t: Column) -> Column:
    ad = F.lower(t).rlike("|".join(AD_KEYWORDS))
    return F.length(t).between(*TITLE_CHARS) & t.rlike(rf"[A-Za-z][A-Za-z0-9-]+|{_CJK}") & ~t.rlike(URL_PATTERN) & ~ad & (symbol_ratio(t) <= SYMBOL_LIMIT)


def stem(file_name: Column) -> Column:
    """The last part of a path without its suffix."""
    name = F.regexp_extract(F.replace(F.coalesce(file_name, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)/?$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*[^.]$", "")


def from_file_name(file_name: Column) -> Column:
    return clean(F.translate(stem(file_name), "_-", "  "))


def file_name_parts(file_name: Column) -> Column:
    """struct(title, year) of ``Authors - Year - Title.pdf``; ('', null) of other names."""
    parts = F.transform(F.split(stem(file_name), " - "), lambda x: F.trim(x))
    fits = (F.size(parts) >= 3) & F.coalesce(F.get(parts, 1).rlike(r"^(19|20)\d{2}$"), F.lit(False))
    title = F.when(fits, F.trim(F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " - "))).otherwise(F.lit(""))
    return F.struct(title.alias("title"), F.when(fits, F.get(parts, 1).try_cast("int")).alias("year"))


def best(candidates: list[Column], file_name: Column) -> Column:
    """The first trusted candidate, cleaned; else the file's name."""
    return F.coalesce(*[F.when(trusted(c), clean(c)) for c in candidates], from_file_name(file_name))


def looks_like_title(line: Column) -> Column:
    header = line.rlike(rf"(?i)^\s*\d*\.?\s*({SECTION_NAMES})\s*:?\s*$")
    return F.length(line).between(*LINE_CHARS) & ~header & trusted(line)


def pick_line(text: Column, file_name: Column) -> Column:
    """The first of the leading lines that looks like a title; else the file's name."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n|\r"), clean), lambda x: (x != "") & ~F.startswith(x, F.lit("[Page ")))
    found = F.get(F.filter(F.slice(lines, 1, SCAN_LINES), looks_like_title), 0)
    return F.coalesce(found, from_file_name(file_name))


def infer(metadata_title: Column, text: Column, file_name: Column) -> Column:
    return F.when(trusted(metadata_title), clean(metadata_title)).otherwise(pick_line(text, file_name))


def compare_form(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the word sets of two titles in compare_form; 0 if either is empty."""
    x, y = (F.array_distinct(F.split(c, " ")) for c in (a, b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
