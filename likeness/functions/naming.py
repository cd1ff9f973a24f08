"""Tags written into file names as ``[tag]`` groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from likeness.functions import paths


def clean_tag(tag: Column) -> Column:
    """White space collapsed and trimmed; null where the tag can't stand in a name."""
    own = F.trim(F.regexp_replace(tag, r"\s+", " "))
    return F.when((own != "") & ~own.rlike(r"[\[\]/\\]") & ~own.startswith("."), own)


def split_list(text: Column) -> Column:
    """The items of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def ordered_union(first: Column, second: Column) -> Column:
    """Both lists' items, each at its first place."""
    return F.array_distinct(F.concat(first, second))


def _group(known: list[str]) -> str:
    return r"(?iu)\s*\[\s*(" + "|".join(r"\Q" + re.sub(r"\\E", "", t) + r"\E" for t in sorted(known, key=len, reverse=True)) + r")\s*\]"


def tags_in(stem: Column, known: list[str]) -> Column:
    """Known tags of a stem in order, in their canonical case, without repeats."""
    if not known:
        return F.array().cast("array<string>")
    canonical = F.create_map(*[F.lit(x) for pair in {t.lower(): t for t in known}.items() for x in pair])
    found = F.regexp_extract_all(stem, F.lit(_group(known)), 1)
    return F.array_distinct(F.transform(found, lambda t: F.element_at(canonical, F.lower(t))))


def base_of(stem: Column, known: list[str]) -> Column:
    """The stem without known groups; other groups stay in place."""
    return F.trim(F.regexp_replace(stem, _group(known), "")) if known else F.trim(stem)


def format_stem(base: Column, tags: Column) -> Column:
    """The base with its tags, sorted without regard to case, behind it."""
    ordered = F.array_sort(F.array_distinct(tags), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).otherwise(0))
    groups = F.array_join(F.transform(ordered, lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ")
    return F.when(F.size(tags) <= 0, F.trim(base)).otherwise(F.trim(F.concat(F.trim(base), F.lit(" "), groups)))


def retag(name: Column, tags: Column, known: list[str]) -> Column:
    """The name a file has when it carries exactly ``tags``; never a bare extension."""
    own = paths.stem(name)
    new = format_stem(base_of(own, known), F.coalesce(tags, F.array().cast("array<string>")))
    return F.concat(F.when(new == "", own).otherwise(new), paths.suffix(name))
