"""Parsers for semi-structured model answers and the issue-type taxonomy.

Answers are plain text with fixed headers (see ``fixed.py``).  Parsing is pure
column arithmetic (split_part / substring_index / transform), so it runs in
codegen and never needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.text import ColumnOrName, _c, after_last_until, strip_ws


def parse_filter_answer(answer: ColumnOrName) -> Column:
    """Filter answer -> struct(is_perf, issue_type, bad_format, positive).

    ``positive`` is true unless the issue type mentions ``N/A``; an answer in
    the wrong format has both fields set to the bad-format marker and therefore
    counts as positive, exactly like the source pipeline.
    """
    a = _c(answer)
    has_type = a.contains(fixed.FILTER_TYPE_HEADER)
    is_perf = strip_ws(after_last_until(a, fixed.FILTER_IS_PERF_HEADER, "\n" + fixed.FILTER_TYPE_HEADER))
    issue = strip_ws(F.substring_index(a, fixed.FILTER_TYPE_HEADER, -1))
    bad = F.lit(fixed.BAD_FORMAT)
    is_perf = F.when(has_type, is_perf).otherwise(bad)
    issue = F.when(has_type, issue).otherwise(bad)
    return F.struct(
        is_perf.alias("is_perf"),
        issue.alias("issue_type"),
        (~has_type).alias("bad_format"),
        (~issue.contains(fixed.NA_MARKER)).alias("positive"),
    )


def _items(text: Column, drop_unpadded_na: bool) -> Column:
    parts = F.split(F.regexp_replace(text, r"[\[\]]", ""), ",")
    if drop_unpadded_na:
        parts = F.filter(parts, lambda x: x != fixed.NA_MARKER)
    return F.transform(parts, lambda x: strip_ws(x))


def parse_class_answer(answer: ColumnOrName) -> Column:
    """Classification answer -> struct(types_text, causes_text, pi_types, root_causes, is_na).

    ``[N/A]`` is kept as the one-element marker array ``['N/A']`` and flagged
    with ``is_na``; an item that is exactly ``N/A`` (no padding) is dropped from
    the types list, a padded one is kept, as in the source pipeline.
    """
    a = _c(answer)
    types_text = strip_ws(F.split_part(F.split_part(a, F.lit(fixed.CLASS_CAUSE_HEADER), F.lit(1)),
                                       F.lit(fixed.CLASS_TYPE_HEADER), F.lit(2)))
    causes_text = strip_ws(F.split_part(a, F.lit(fixed.CLASS_CAUSE_HEADER), F.lit(2)))
    marker = F.array(F.lit(fixed.NA_MARKER))
    na = f"[{fixed.NA_MARKER}]"
    types = F.when(types_text == na, marker).otherwise(_items(types_text, True))
    causes = F.when(causes_text == na, marker).otherwise(_items(causes_text, False))
    return F.struct(
        types_text.alias("types_text"),
        causes_text.alias("causes_text"),
        types.alias("pi_types"),
        causes.alias("root_causes"),
        (types_text == na).alias("is_na"),
    )


def _taxonomy_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in fixed.TAXONOMY for x in pair])


def taxonomy_categories(labels: ColumnOrName, strict: bool = False) -> Column:
    """Map raw labels to categories, keeping order and duplicates.

    Ignored labels are dropped.  Unknown labels are dropped too and reported by
    :func:`taxonomy_unmapped`; with ``strict=True`` they raise at run time.
    """
    known = _taxonomy_map()
    ignored = F.array(*[F.lit(x) for x in fixed.TAXONOMY_IGNORED])
    kept = F.filter(_c(labels), lambda x: ~F.array_contains(ignored, x))
    mapped = F.transform(kept, lambda x: F.element_at(known, x))
    if strict:
        mapped = F.transform(kept, lambda x: F.coalesce(
            F.element_at(known, x), F.raise_error(F.concat(F.lit("Unknown issue type: "), x))))
    return F.filter(mapped, lambda x: x.isNotNull())


def taxonomy_unmapped(labels: ColumnOrName) -> Column:
    """Labels that are neither mapped nor deliberately ignored."""
    names = [k for k, _ in fixed.TAXONOMY] + list(fixed.TAXONOMY_IGNORED)
    allowed = F.array(*[F.lit(x) for x in names])
    return F.filter(_c(labels), lambda x: ~F.array_contains(allowed, x))
