"""Column expressions over text, URLs, dates and versions.

All helpers return ``pyspark.sql.Column`` built from JVM-side built-ins, so
they stay inside whole-stage codegen.  Regexes go through the DataFrame API
(never through SQL text) to avoid string-literal escaping differences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Line breaks recognised by Python's str.splitlines.
_LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Characters Python's str.strip() removes (str.isspace), as a regex class.
PY_WHITESPACE = (r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Whitespace as seen by the word counter (ASCII whitespace incl. vertical tab).
_WORD = r"[^ \t\n\r\f\x0B]+"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c: ColumnOrName) -> Column:
    """True iff the text is non-empty and every character is 7-bit ASCII."""
    return _c(c).rlike(r"^[\x00-\x7F]+\z")


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), f"^{PY_WHITESPACE}+|{PY_WHITESPACE}+$", "")


def in_list_ci(c: ColumnOrName, values: list[str]) -> Column:
    """Case-insensitive membership in a fixed list."""
    return F.lower(_c(c)).isin(sorted({v.lower() for v in values}))


def after_last_until(c: ColumnOrName, w1: str, w2: str) -> Column:
    """Text after the last ``w1`` up to the next ``w2`` (whole text when absent)."""
    return F.substring_index(F.substring_index(_c(c), w1, -1), w2, 1)


def after_first_until(c: ColumnOrName, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the next ``start`` or ``end``; NULL if absent."""
    s = F.split_part(_c(c), F.lit(start), F.lit(2))
    return F.nullif(F.split_part(s, F.lit(end), F.lit(1)), F.lit(""))


def first_between(c: ColumnOrName, w1_regex: str, w2_regex: str) -> Column:
    """First non-greedy capture between two regexes, dot matching newlines."""
    return F.nullif(F.regexp_extract(_c(c), f"(?s){w1_regex}(.*?){w2_regex}", 1), F.lit(""))


def split_lines(c: ColumnOrName) -> Column:
    """``str.splitlines()``: split on every line break, no trailing empty line."""
    return let(F.split(_c(c), _LINE_BREAKS), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def indent_lines(c: ColumnOrName, n: int = 1) -> Column:
    """Prefix every line with ``n`` tabs and join the lines with ``\\n``."""
    tabs = "\t" * n
    return F.array_join(F.transform(split_lines(c), lambda x: F.concat(F.lit(tabs), x)), "\n")


# --- URLs ---------------------------------------------------------------------

def project_link(commit_link: ColumnOrName) -> Column:
    """``https://host/owner/repo/commit/<hash>`` -> ``https://host/owner/repo``."""
    return F.split_part(_c(commit_link), F.lit("/commit/"), F.lit(1))


def last_segment(link: ColumnOrName) -> Column:
    """Last path segment, e.g. the hash of a commit link."""
    return F.element_at(F.split(_c(link), "/"), -1)


def owner_repo_key(link: ColumnOrName) -> Column:
    """``owner___repo`` key of a project or commit link."""
    parts = F.split(project_link(link), "/")
    return F.concat_ws("___", F.element_at(parts, -2), F.element_at(parts, -1))


def short_commit_key(commit_link: ColumnOrName) -> Column:
    """``repo/commit/hash`` suffix used when only the repo name is known."""
    parts = F.split(_c(commit_link), "/")
    return F.concat_ws("/", F.element_at(parts, -3), F.lit("commit"), F.element_at(parts, -1))


def safe_name(link: ColumnOrName) -> Column:
    """File-system safe name of a URL."""
    return F.translate(F.regexp_replace(_c(link), r"^https?://", ""), "/?", "__")


def strip_suffix(c: ColumnOrName, suffix: str) -> Column:
    """Remove ``suffix`` once from the end (not a character-set strip)."""
    col = _c(c)
    return F.when(col.endswith(suffix), F.substring(col, F.lit(1), F.length(col) - len(suffix))).otherwise(col)


# --- dates and versions -------------------------------------------------------

def store_date(c: ColumnOrName) -> Column:
    """'Aug 21, 2024' -> DATE."""
    return F.to_date(strip_ws(c), "MMM d, yyyy")


def iso_date(c: ColumnOrName) -> Column:
    """'2023-09-04T09:52:15Z' -> DATE of the text (no zone shift)."""
    return F.to_date(F.split_part(_c(c), F.lit("T"), F.lit(1)))


def ntz_as_utc(c: ColumnOrName) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP, reading the wall clock as UTC whatever the
    session zone is (exact also in daylight-saving gaps and overlaps)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), _c(c)).cast("timestamp")


def normalized_version(c: ColumnOrName) -> Column:
    """First dotted number in a version label ('Release 1.2' -> '1.2'); NULL if none."""
    return F.nullif(F.regexp_extract(_c(c), r"\d+(\.\d+)+", 0), F.lit(""))


def digits_number(c: ColumnOrName) -> Column:
    """All digits of a text as a number ('1,234 commits' -> 1234); NULL if none."""
    return F.nullif(F.regexp_replace(_c(c), r"\D", ""), F.lit("")).cast("long")


# --- sizes --------------------------------------------------------------------

def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace-separated words: the prompt length budget."""
    return F.coalesce(F.size(F.regexp_extract_all(_c(c), F.lit(_WORD), 0)), F.lit(0)).cast("long")


def ends_with_any(c: ColumnOrName, suffixes: list[str]) -> Column:
    col = _c(c)
    out = F.lit(False)
    for s in suffixes:
        out = out | col.endswith(s)
    return out


def file_extension(path: ColumnOrName) -> Column:
    """``os.path.splitext`` extension of the base name ('' for dot-files)."""
    base = last_segment(path)
    return F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body`` (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
