"""Row filters.

Every filter is one conjunctive predicate on columns, so Catalyst combines it
with neighbouring filters, pushes what it can into the scan and compiles the
rest into a single codegen stage.  No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.text import in_list_ci, is_ascii, let


def ascii_ok(title: str = "commit_title", description: str = "commit_description",
             check_description: bool = True) -> Column:
    """Title present and ASCII; description absent or ASCII (F1 first stage / F1b)."""
    cond = F.col(title).isNotNull() & is_ascii(title)
    if check_description:
        cond = cond & (F.col(description).isNull() | is_ascii(description))
    return cond


def rule_hits(title: str = "commit_title", description: str = "commit_description",
              stop_titles: list[str] | None = None,
              patterns: list[tuple[str, str]] | None = None) -> list[tuple[str, Column]]:
    """(rule name, predicate) pairs; a row is useless when any predicate holds."""
    stop = fixed.USELESS_TITLES if stop_titles is None else stop_titles
    pats = fixed.TITLE_PATTERNS if patterns is None else patterns
    no_desc = F.col(description).isNull()
    rules = [("useless_title", no_desc & in_list_ci(title, stop))]
    rules += [(name, no_desc & F.col(title).rlike(p)) for name, p in pats]
    return rules


def heuristic_filter(df: DataFrame, title: str = "commit_title", description: str = "commit_description",
                     check_description: bool = True, stop_titles: list[str] | None = None,
                     patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """keep informative English commits.

    Drops rows whose title is NULL or non-ASCII, whose description is non-ASCII,
    and rows without description whose title is in the stop list or matches one
    of the title patterns.
    """
    return df.filter(heuristic_keep(title, description, check_description, stop_titles, patterns))


def heuristic_keep(title: str = "commit_title", description: str = "commit_description",
                   check_description: bool = True, stop_titles: list[str] | None = None,
                   patterns: list[tuple[str, str]] | None = None) -> Column:
    """The F1 predicate as a column (true = keep)."""
    stop = fixed.USELESS_TITLES if stop_titles is None else stop_titles
    pats = fixed.TITLE_PATTERNS if patterns is None else patterns
    # One alternation = one regex scan per title (searching for any pattern is
    # the same as searching for each); ten separate RLIKEs made the generated
    # code too large for whole-stage codegen and ran ~3x slower.
    any_pattern = "|".join(f"(?:{p})" for _, p in pats)
    useless = in_list_ci(title, stop) | F.col(title).rlike(any_pattern) if pats else in_list_ci(title, stop)
    return ascii_ok(title, description, check_description) & ~(F.col(description).isNull() & useless)


def title_only_filter(df: DataFrame, title: str = "commit_title", description: str = "commit_description") -> DataFrame:
    """The title-only variant used before scoring."""
    return df.filter(ascii_ok(title, description, check_description=False))


def rule_audit(df: DataFrame, title: str = "commit_title", description: str = "commit_description") -> DataFrame:
    """for every rule, how many rows (that pass the ASCII stage) it would remove.

    One pass: each row carries the array of rule names it hits, which is
    exploded and counted (partial aggregation before the shuffle).
    """
    hits = rule_hits(title, description)
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in hits]))
    return (df.filter(ascii_ok(title, description))
            .select(F.explode(names).alias("rule"))
            .groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows")))


def rule_masks(df: DataFrame, rules: list[tuple[str, Column]] | None = None, title: str = "commit_title", description: str = "commit_description",
               name: str = "rule_mask") -> DataFrame:
    """rows that pass the ASCII stage with a bit mask of the rules they hit (bit i: rule i of ``rules``)."""
    rules = rule_hits(title, description) if rules is None else rules
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(0).cast("long") for i, (_, c) in enumerate(rules)), F.lit(0).cast("long"))
    return df.filter(ascii_ok(title, description)).withColumn(name, mask)


def mask_counts(masked: DataFrame, name: str = "rule_mask") -> DataFrame:
    """rows per mask, one pre-aggregated pass; every rule order can be answered from this small table (2^rules rows at most)."""
    return masked.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))


def first_rule(mask: Column, names: list[str], order: list[str]) -> Column:
    """the rule that removes a row when rules are applied in ``order``; NULL if none does."""
    # the mask is evaluated once: its patterns must not be repeated for every rule
    return let(mask, lambda m: F.coalesce(*[F.when(F.call_function("getbit", m, F.lit(names.index(n))) == 1, F.lit(n)) for n in order]))


def removed_first(counts: DataFrame, names: list[str], order: list[str], name: str = "rule_mask") -> DataFrame:
    """for a rule order, what each rule still removes after the rules before it, what it would remove alone, and what only it removes."""
    bit = lambda n: F.call_function("getbit", F.col(name), F.lit(names.index(n))) == 1
    first = first_rule(F.col(name), names, order)
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("rule"), F.when(first == n, F.col("n_rows")).otherwise(0).alias("f"),
                                       F.when(bit(n), F.col("n_rows")).otherwise(0).alias("a"),
                                       F.when(F.col(name) == (1 << names.index(n)), F.col("n_rows")).otherwise(0).alias("o")) for i, n in enumerate(order)]))
    return counts.select(one.alias("s")).groupBy("s.step", "s.rule").agg(F.sum("s.f").alias("n_first"), F.sum("s.a").alias("n_alone"), F.sum("s.o").alias("n_only"))


def fanout_cap(df: DataFrame, key: str = "commit_link", max_rows: int = fixed.MAX_FILES_PER_COMMIT) -> DataFrame:
    """keep keys with at most ``max_rows`` rows.

    Counted with a partially aggregated groupBy and joined back on the key
    with ``joins.skew_safe_join`` (AQE splits a hot key), so neither a window nor a join task ever holds a whole hot key.
    """
    from commitlens.operators.joins import skew_safe_join

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.filter(F.col("_n") <= max_rows).select(key)
    return skew_safe_join(df, kept, [key], "left_semi")


def size_threshold(df: DataFrame, count_col: str, max_value: int = fixed.MAX_COMMITS_PER_PROJECT) -> DataFrame:
    """keep rows whose (known) count is at most ``max_value``; NULL is dropped."""
    return df.filter(F.col(count_col) <= max_value)


def prefix_filter(df: DataFrame, col: str, prefix: str = "https://github.com/") -> DataFrame:
    """keep one host."""
    return df.filter(F.col(col).startswith(prefix))


def unprocessed(df: DataFrame, col: str) -> DataFrame:
    """rows whose result column is still NULL."""
    return df.filter(F.col(col).isNull())


def drop_na_marker(df: DataFrame, flag_col: str = "is_na") -> DataFrame:
    """drop rows whose classification is the N/A marker."""
    return df.filter(~F.col(flag_col))


def positive_answers(df: DataFrame, parsed_col: str = "parsed", drop_bad_format: bool = False) -> DataFrame:
    """F8: keep positive filter answers (bad-format answers kept unless asked)."""
    cond = F.col(f"{parsed_col}.positive")
    if drop_bad_format:
        cond = cond & ~F.col(f"{parsed_col}.bad_format")
    return df.filter(cond)


def require(df: DataFrame, *cols: str) -> DataFrame:
    """drop rows with a NULL in any of ``cols``."""
    return df.na.drop(subset=list(cols))
