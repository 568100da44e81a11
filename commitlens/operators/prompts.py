"""Prompt construction as column arithmetic (T1, T2) and few-shot pairs.

The template is split once on the driver at its slots; per row we only
``concat`` the parts with indented fields, so a field that itself contains the
slot marker cannot leak into the next slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.fixed import DIFF_FILE_FORMAT, DIFF_INPUT_TEMPLATE, FILTER_INPUT_TEMPLATE
from commitlens.functions.text import indent_lines

def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fill_template(template: str, *values: Column) -> Column:
    """Replace the first ``len(values)`` slots, left to right, with ``values``."""
    parts = template.split(fixed.TEMPLATE_SLOT, len(values))
    if len(parts) != len(values) + 1:
        raise ValueError("template has fewer slots than values")
    pieces: list[Column] = [F.lit(parts[0])]
    for v, p in zip(values, parts[1:]):
        pieces += [v, F.lit(p)]
    return F.concat(*pieces)


def chat_prompt(title: str, description: str, system_text: str,
                examples: list[tuple[str, str]] | None = None,
                template: str = FILTER_INPUT_TEMPLATE) -> Column:
    """array<struct<role, content>> = system + few-shot pairs + filled user input."""
    msgs = [_message("system", F.lit(system_text))]
    for inp, out in examples or []:
        msgs += [_message("user", F.lit(inp)), _message("assistant", F.lit(out))]
    user = fill_template(template, indent_lines(F.col(title), 1), indent_lines(F.col(description), 1))
    msgs.append(_message("user", user))
    return F.array(*msgs)


def render_messages(messages: str | Column) -> Column:
    """Flat text of a message array (for length budgets and exports)."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n\n")


def render_diffs(files: str | Column) -> Column:
    """Numbered rendering of array<struct<file_name, patch>>."""
    arr = F.col(files) if isinstance(files, str) else files
    head, rest = DIFF_FILE_FORMAT.split("{name}")
    pre_n, post_n = head.split("{n}")
    mid, tail = rest.split("{patch}")
    return F.array_join(F.transform(arr, lambda f, i: F.concat(
        F.lit(pre_n), (i + 1).cast("string"), F.lit(post_n.replace("{{", "{")), f["file_name"],
        F.lit(mid), indent_lines(f["patch"], 2), F.lit(tail.replace("}}", "}")))), "")


def diff_prompt(message: str, files: str) -> Column:
    """User message with the commit message and the numbered diffs."""
    user = fill_template(DIFF_INPUT_TEMPLATE, indent_lines(F.col(message), 1),
                         indent_lines(render_diffs(files), 1))
    return F.array(_message("user", user))


def example_pairs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """Few-shot (input, output) pairs: each user turn with the assistant turn that
    follows it.  An equi self-join on (conversation, turn + 1); no collect."""
    u = conversations.filter(F.col(role) == "user").select(conv, turn, F.col(text).alias("input"))
    a = conversations.filter(F.col(role) == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col(text).alias("output"))
    return u.join(a, on=[conv, turn])
