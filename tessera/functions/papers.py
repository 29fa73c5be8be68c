"""Expressions over paper metadata: categories, dates, authors, rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of primary categories, tried in this order.
GROUPS = {
    "cs": "Computer Science", "math": "Mathematics", "physics": "Physics", "cond-mat": "Condensed Matter",
    "astro-ph": "Astrophysics", "hep": "High Energy Physics", "quant-ph": "Quantum Physics", "stat": "Statistics",
}
# Prefixes for profiling, tried in this order.
PROFILE_PREFIXES = ("cond-mat", "astro-ph", "hep-ph", "hep-th", "hep-ex", "hep-lat", "quant-ph", "gr-qc", "math-ph", "nlin", "nucl-th", "nucl-ex", "cs", "math", "physics", "stat", "q-bio", "econ")
# Kinds of rules, by what the sides hold, tried in this order.
RULE_KINDS = (
    ("keyword:", "cluster:", "keyword_to_topic"), ("cluster:", "keyword:", "topic_to_keyword"), ("keyword:", "author:", "keyword_to_author"),
    ("author:", "keyword:", "author_to_keyword"), ("author:", "cluster:", "author_to_topic"), ("cluster:", "author:", "topic_to_author"),
    ("author:", "author:", "author_to_author"), ("keyword:", "keyword:", "keyword_to_keyword"), ("cluster:", "cluster:", "topic_to_topic"),
)


def primary(categories: Column) -> Column:
    """The first category; null if there is none."""
    return F.nullif(F.element_at(F.split(F.trim(F.coalesce(categories, F.lit(""))), r"\s+"), 1), F.lit(""))


def first_prefix(value: Column, prefixes) -> Column:
    return F.coalesce(*[F.when(value.startswith(p), F.lit(p)) for p in prefixes])


def primary_group(categories: Column) -> Column:
    """The first of the groups that the primary category starts with; null if none does."""
    return first_prefix(primary(categories), GROUPS)


def profile_group(categories: Column) -> Column:
    """The first profiling prefix, or else the primary category itself."""
    return F.coalesce(first_prefix(primary(categories), PROFILE_PREFIXES), primary(categories))


def group_name(group: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])[group], F.lit("Unknown"))


def year_of(date: Column) -> Column:
    """The first four characters as a number; null if they are none."""
    head = F.substring(date, 1, 4)
    return F.when(head.rlike(r"^\d{4}$"), head.try_cast("int"))


def month_of_id(paper_id: Column) -> Column:
    """The month that a paper's id encodes, new style (YYMM.) or old (/YYMMNNN); null unless 1 to 12."""
    found = F.coalesce(F.nullif(F.regexp_extract(paper_id, r"^(\d{2})(\d{2})\.\d+", 2), F.lit("")), F.nullif(F.regexp_extract(paper_id, r"/(\d{2})(\d{2})\d{3}$", 2), F.lit("")))
    month = found.try_cast("int")
    return F.when(month.between(1, 12), month)


def parsed_authors(nested: Column) -> Column:
    """``First Last`` of every [last, first, ...]; shorter entries go."""
    whole = F.filter(nested, lambda a: F.size(a) >= 2)
    return F.transform(whole, lambda a: F.trim(F.concat_ws(" ", F.trim(a[1]), F.trim(a[0]))))


def split_authors(text: Column) -> Column:
    """Authors from text: a list literal, or names between ; or ,; null-like text gives an empty list."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    body = F.regexp_replace(plain, r"^\[|\]$|['\"]", "")
    names = F.filter(F.transform(F.split(body, "[;,]"), lambda a: F.trim(a)), lambda a: a != "")
    return F.when(F.lower(plain).isin("", "nan", "none", "null", "[]"), F.array().cast("array<string>")).otherwise(names)


def author_score(authors: Column, query: str) -> Column:
    """1 for the queried author, 0.8 if one name holds the other, by the first author that matches; else 0."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(0.0)
    def one(a: Column) -> Column:
        name = F.lower(F.trim(a))
        return F.when(name == wanted, F.lit(1.0)).when(name.contains(wanted) | F.contains(F.lit(wanted), name), F.lit(0.8)).otherwise(F.lit(0.0))
    hits = F.filter(F.transform(authors, one), lambda s: s > 0)
    return F.coalesce(F.when(F.size(hits) > 0, hits[0]), F.lit(0.0))


def overlap(values: Column, wanted: Column) -> Column:
    """Size of the intersection of two lists of strings, without case."""
    fold = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.size(F.array_intersect(fold(values), fold(wanted))), F.lit(0))


def rule_kind(left: Column, right: Column) -> Column:
    """What a rule leads from and to."""
    has = lambda side, prefix: F.exists(side, lambda x: x.startswith(prefix))
    return F.coalesce(*[F.when(has(left, a) & has(right, b), F.lit(kind)) for a, b, kind in RULE_KINDS], F.lit("mixed_rule"))


def null_kind(value: Column) -> Column:
    """null, empty, none_text or value."""
    return F.when(value.isNull(), "null").when(value == "", "empty").when(value == "None", "none_text").otherwise("value")


def year_in(text: Column) -> Column:
    """The first four digits in a row of a text, as a year; null without."""
    return F.nullif(F.regexp_extract(text, r"\d{4}", 0), F.lit("")).cast("int")


def is_present(value: Column) -> Column:
    """Whether text holds something: not null, not empty, not an empty list or object, not None."""
    return F.coalesce(~value.isin("", "[]", "{}", "None"), F.lit(False))
