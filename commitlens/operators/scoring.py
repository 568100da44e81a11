"""Batch scoring of text with a pluggable model (M1-M4).

* M2 ``lexicon_answer`` -- the native default scorer: a term lexicon matched
  with one JVM regex; it writes answers in the filter-answer format.
* M1 ``score_with`` -- any picklable ``Callable[[pd.Series], pd.Series]`` run
  through ``mapInPandas`` (Arrow batches, one scorer load per task).
* M3 ``score_with_fallback`` -- second scorer only for rows where the first
  raised or answered NULL.
* M4 ``score_missing`` -- score only rows without a verdict and write it back.

Dedup before scoring (``dedup.first_per_key``) and propagate afterwards
(``joins.propagate``): Catalyst does not push filters below ``mapInPandas``,
so the caller keeps the cheap steps in front.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.functions import fixed

# Default lexicon: the rubric's issue terms plus the plain words the rubric's
# examples use ('slow', 'fast', 'memory', ...).  Callers pass their own list.
DEFAULT_LEXICON = list(fixed.RUBRIC_ISSUE_TERMS) + [
    "memory leak", "battery", "energy", "slow", "speed up", "faster", "lag", "freeze",
    "performance", "latency", "cpu", "main thread",
]


_META = set(".^$*+?()[]{}|\\-")


def _escape(term: str) -> str:
    """Escape regex metacharacters only (valid for Java, RE2 and Python)."""
    return "".join("\\" + ch if ch in _META else ch for ch in term)


def lexicon_pattern(lexicon: list[str] | None = None) -> str:
    """One alternation, longest terms first, lower case."""
    terms = sorted({t.lower() for t in (lexicon or DEFAULT_LEXICON)}, key=lambda t: (-len(t), t))
    return "(" + "|".join(_escape(t) for t in terms) + ")"


def _answer(found: Column) -> Column:
    yes = F.concat(F.lit(f"{fixed.FILTER_IS_PERF_HEADER}\n    Yes\n\n\n{fixed.FILTER_TYPE_HEADER}\n    "), found)
    no = F.lit(f"{fixed.FILTER_IS_PERF_HEADER}\n    No\n\n\n{fixed.FILTER_TYPE_HEADER}\n    {fixed.NA_MARKER}")
    return F.when(found != "", yes).otherwise(no)


# Default classifier lexicon (our own re-aimed default): raw issue-type label -> terms.
# Labels are taken from the taxonomy's raw vocabulary so the taxonomy merge applies.
CLASS_LEXICON = [
    ("Energy Consumption", ["battery", "energy", "power"]),
    ("Memory Consumption", ["memory", "leak"]),
    ("Responsiveness", ["main thread", "scroll", "slow", "speed", "lag", "freeze", "anr"]),
    ("CPU Usage", ["cpu"]),
    ("Network Traffic", ["network", "bandwidth", "traffic"]),
    ("Graphics Rendering", ["render", "frame", "draw"]),
    ("Build Time", ["build", "compile", "gradle"]),
    ("Storage Consumption", ["storage", "disk"]),
]


def lexicon_class_answer(text: str | Column, lexicon: list[tuple[str, list[str]]] | None = None) -> Column:
    """Classification answer (types + root causes) from a type lexicon, in the
    class-answer format; no match gives the ``[N/A]`` marker for both parts."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    lex = lexicon or CLASS_LEXICON
    types = F.filter(F.array(*[F.when(t.rlike(lexicon_pattern(terms)), F.lit(label)) for label, terms in lex]),
                     lambda x: x.isNotNull())
    causes = F.filter(F.array(*[F.nullif(F.regexp_extract(t, lexicon_pattern(terms), 1), F.lit(""))
                                for _, terms in lex]), lambda x: x.isNotNull())
    na = f"[{fixed.NA_MARKER}]"
    types_txt = F.when(F.size(types) > 0, F.concat(F.lit("["), F.array_join(types, ", "), F.lit("]"))).otherwise(na)
    causes_txt = F.when(F.size(causes) > 0, F.concat(F.lit("["), F.array_join(causes, ", "), F.lit("]"))).otherwise(na)
    return F.concat(F.lit(fixed.CLASS_TYPE_HEADER), types_txt, F.lit(fixed.CLASS_CAUSE_HEADER + "\n    "), causes_txt)


def lexicon_answer(text: str | Column, lexicon: list[str] | None = None) -> Column:
    """M2: answer text naming the first lexicon term found (case-insensitive)."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(F.lower(F.coalesce(t, F.lit(""))), lexicon_pattern(lexicon), 1)
    return _answer(found)


class LexiconScorer:
    """Picklable pandas scorer equal to :func:`lexicon_answer` (used through M1)."""

    def __init__(self, lexicon: list[str] | None = None):
        self.lexicon = list(lexicon or DEFAULT_LEXICON)
        self._rx = None

    def __call__(self, texts: pd.Series) -> pd.Series:
        if self._rx is None:  # compiled once per task
            self._rx = re.compile(lexicon_pattern(self.lexicon))
        low = texts.fillna("").str.lower()
        found = low.str.extract(self._rx, expand=False).fillna("")
        head = f"{fixed.FILTER_IS_PERF_HEADER}\n    "
        out = pd.Series(
            [f"{head}Yes\n\n\n{fixed.FILTER_TYPE_HEADER}\n    {f}" if f else
             f"{head}No\n\n\n{fixed.FILTER_TYPE_HEADER}\n    {fixed.NA_MARKER}" for f in found],
            index=texts.index, dtype=object)
        return out


class ClassLexiconScorer:
    """Picklable pandas scorer equal to :func:`lexicon_class_answer`; of a chat
    prompt it reads the last user message."""

    def __init__(self, lexicon: list[tuple[str, list[str]]] | None = None):
        self.lexicon = lexicon or CLASS_LEXICON

    def __call__(self, texts: pd.Series) -> pd.Series:
        rules = [(label, re.compile(lexicon_pattern(terms))) for label, terms in self.lexicon]
        na = f"[{fixed.NA_MARKER}]"

        def one(text: str | None) -> str:
            low = (text or "").rsplit("user: ", 1)[-1].lower()
            hits = [(label, m.group(1)) for label, rx in rules if (m := rx.search(low))]
            types, causes = (", ".join(h[i] for h in hits) for i in (0, 1))
            return (f"{fixed.CLASS_TYPE_HEADER}{'[' + types + ']' if hits else na}{fixed.CLASS_CAUSE_HEADER}\n"
                    f"    {'[' + causes + ']' if hits else na}")

        return texts.map(one).astype(object)


class Refusing:
    """A scorer that raises on batches with a text that holds ``word`` (stands for a failing model)."""

    def __init__(self, scorer: Callable[[pd.Series], pd.Series], word: str):
        self.scorer, self.word = scorer, word

    def __call__(self, texts: pd.Series) -> pd.Series:
        if texts.fillna("").str.contains(self.word, regex=False).any():
            raise ValueError(f"cannot read a text with {self.word!r}")
        return self.scorer(texts)


def _ship_package_by_value() -> None:
    """Workers need not have this package installed: its functions and classes
    (the batch runner, the scorers) are pickled by value into the task."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def score_with(df: DataFrame, text: str, scorer: Callable[[pd.Series], pd.Series],
               out: str = "answer") -> DataFrame:
    """M1: append ``out`` = scorer(text) computed batch-wise in Python workers."""
    _ship_package_by_value()
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType(), True)])

    def run(batches):
        for pdf in batches:
            pdf[out] = scorer(pdf[text])
            yield pdf

    return df.mapInPandas(run, schema=schema)


def answer_or_null(scorer: Callable[[pd.Series], pd.Series], texts: pd.Series) -> pd.Series:
    """Answers of a scorer that may raise: a failing batch is halved until only
    the rows that fail on their own are left, and those get NULL."""
    if not len(texts):
        return pd.Series([], index=texts.index, dtype=object)
    try:
        return scorer(texts).astype(object)
    except Exception:  # any model error is a miss, as in the source pipeline
        if len(texts) == 1:
            return pd.Series([None], index=texts.index, dtype=object)
        half = len(texts) // 2
        return pd.concat([answer_or_null(scorer, texts.iloc[:half]), answer_or_null(scorer, texts.iloc[half:])])


def score_with_fallback(df: DataFrame, text: str, first: Callable[[pd.Series], pd.Series],
                        second: Callable[[pd.Series], pd.Series] | None = None,
                        out: str = "answer", by: str = "answered_by", native: Column | None = None,
                        keep: bool = False) -> DataFrame:
    """M3: the first scorer for all rows, the second for those where the first
    raised or gave NULL; ``by`` says which one answered ('first', 'second' or NULL).

    With ``second=None`` a native answer is the fallback (JVM side; the lexicon
    answer unless ``native`` is given).  With ``keep`` rows that have an answer
    keep it ('done').  The first model is called once per row unless its batch fails.
    """
    _ship_package_by_value()
    kept = [f for f in df.schema.fields if f.name not in (out, by)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType(), True), T.StructField(by, T.StringType(), True)])
    names = [f.name for f in kept]

    def run(batches):
        for pdf in batches:
            texts = pdf[text]
            todo = pdf[out].isna() if keep else pd.Series(True, index=pdf.index)
            got = pdf[out].astype(object) if keep else pd.Series(None, index=pdf.index, dtype=object)
            who = pd.Series("done", index=pdf.index, dtype=object)
            got[todo] = answer_or_null(first, texts[todo])
            who[todo] = got[todo].notna().map({True: "first", False: None}).astype(object)
            miss = got.isna()
            if second is not None and miss.any():
                more = answer_or_null(second, texts[miss])
                got[miss] = more
                who[miss] = more.notna().map({True: "second", False: None}).astype(object)
            yield pdf[names].assign(**{out: got, by: who})

    scored = df.mapInPandas(run, schema=schema)
    if second is None:
        scored = scored.withColumn(by, F.coalesce(F.col(by), F.lit("second"))) \
            .withColumn(out, F.coalesce(F.col(out), lexicon_answer(text) if native is None else native))
    return scored


def score_missing(df: DataFrame, text: str, out: str,
                  scorer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """M4: score only rows whose ``out`` is NULL and keep existing verdicts, in one pass over ``df``."""
    if scorer is None:
        return df.withColumn(out, F.coalesce(F.col(out), lexicon_answer(text)))
    _ship_package_by_value()

    def run(batches):
        for pdf in batches:
            todo = pdf[out].isna()
            if todo.any():
                pdf[out] = pdf[out].astype(object)
                pdf.loc[todo, out] = scorer(pdf.loc[todo, text]).values
            yield pdf

    return df.mapInPandas(run, schema=df.schema)
