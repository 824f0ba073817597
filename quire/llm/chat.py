"""Preference formatting: one prompt and two masked completions from a pair of conversations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role: string, text: string>>"
_OPEN, _CLOSE, _END = "concat('<|', x.role, '|>\\n')", "'<|end|>\\n'", "concat(x.text, '<|end|>\\n')"


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat({_OPEN}, {_END})), '')"


def _mask(turns: str, trained: str) -> str:
    """Spans of characters, end exclusive, of what the trained role says with its end mark."""
    step = f"struct(a.at + length({_OPEN}) + length({_END}) AS at, IF(x.role = '{trained}', array_append(a.spans, struct(a.at + length({_OPEN}) AS start, a.at + length({_OPEN}) + length({_END}) AS end)), a.spans) AS spans)"
    return f"aggregate({turns}, struct(0 AS at, cast(array() AS array<struct<start: int, end: int>>) AS spans), (a, x) -> {step}, a -> a.spans)"


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", key: str = "pair_id", trained: str = "assistant") -> DataFrame:
    """Renders the longest common turn prefix of two conversations once, and what follows in each.

    chosen and rejected are arrays of (role, text) in order. Returns key,
    n_common (turns), prompt, chosen_text, rejected_text, chosen_mask and
    rejected_mask: arrays of (start, end) in characters of the completion, the
    parts that count for the loss. Where one conversation is the start of the
    other its completion is empty; a null role or text counts as empty, a null
    conversation as one without turns; rows and ties are kept as they come, an
    empty table gives none; other columns are not returned.
    """
    clean = "coalesce(transform({0}, x -> struct(coalesce(x.role, '') AS role, coalesce(x.text, '') AS text)), cast(array() AS " + TURNS + "))"
    both = pairs.selectExpr(f"`{key}`", f"{clean.format(f'`{chosen}`')} AS c", f"{clean.format(f'`{rejected}`')} AS r")
    same = "zip_with(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r))), (x, y) -> x = y)"
    first = both.selectExpr("*", f"cast(array_position({same}, false) AS int) AS apart")
    cut = first.selectExpr(f"`{key}`", "c", "r", "IF(apart = 0, least(size(c), size(r)), apart - 1) AS n_common")
    parts = cut.selectExpr(f"`{key}`", "n_common", "slice(c, 1, n_common) AS p", "slice(c, n_common + 1, size(c)) AS c", "slice(r, n_common + 1, size(r)) AS r")
    return parts.selectExpr(
        f"`{key}`", "n_common", f"{_rendered('p')} AS prompt",
        f"{_rendered('c')} AS chosen_text", f"{_rendered('r')} AS rejected_text",
        f"{_mask('c', trained)} AS chosen_mask", f"{_mask('r', trained)} AS rejected_mask",
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order: by turn, then role, then text; repeated rows count once, a null turn comes first, rows without conv_id are left out."""
    clean = turns.where("conv_id IS NOT NULL").selectExpr("conv_id", "struct(coalesce(turn, -1L) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text) AS t")
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t")).selectExpr("conv_id", "transform(t, x -> struct(x.role AS role, x.text AS text)) AS turns")


def paired(turns: DataFrame) -> DataFrame:
    """A pair for each conversation with an assistant turn: itself, chosen, and rejected.

    The table has no rejected answers, so the last assistant turn of the
    neighbour (the conversation whose id differs in the lowest bit) stands for
    one: rejected is the conversation with that turn in place of its own last
    assistant turn. Conversations without such a neighbour have no pair.
    """
    backwards = "filter(transform(turns, (x, i) -> IF(x.role = 'assistant', i, -1)), i -> i >= 0)"
    answered = conversations_of(turns).selectExpr("conv_id", "turns", f"array_max({backwards}) AS last").where("last IS NOT NULL")
    other = answered.selectExpr("conv_id ^ 1L AS conv_id", "turns[last].text AS other")
    swapped = "transform(turns, (x, i) -> IF(i = last, struct(x.role AS role, other AS text), x))"
    return answered.join(other, "conv_id").selectExpr("conv_id AS pair_id", "turns AS chosen", f"{swapped} AS rejected")


def preference_digest(formatted: DataFrame) -> DataFrame:
    """The masks as text, the rest as it is."""
    spans = "array_join(transform({0}, x -> concat(x.start, '-', x.end)), ',') AS {0}"
    return formatted.selectExpr("pair_id", "n_common", "prompt", "chosen_text", "rejected_text", spans.format("chosen_mask"), spans.format("rejected_mask"))


PREFERENCE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t
), l AS (
  SELECT conv_id, max(i) AS i FROM n WHERE role = 'assistant' GROUP BY conv_id
), a AS (
  SELECT n.conv_id, n.i, n.text FROM n JOIN l ON n.conv_id = l.conv_id AND n.i = l.i
), p AS (
  SELECT x.conv_id, x.i AS last, y.text AS other, x.text = y.text AS same FROM a x JOIN a y ON xor(x.conv_id, 1) = y.conv_id
), r AS (
  SELECT n.conv_id, n.i, n.role = 'assistant' AS trained, same OR n.i < last AS common, same, last,
         '<|' || n.role || '|>' || chr(10) AS head,
         n.text || '<|end|>' || chr(10) AS c,
         (CASE WHEN n.i = last THEN other ELSE n.text END) || '<|end|>' || chr(10) AS r
  FROM n JOIN p ON n.conv_id = p.conv_id
), o AS (
  SELECT *, coalesce(sum(CASE WHEN common THEN 0 ELSE length(head) + length(c) END) OVER w, 0) AS at_c,
            coalesce(sum(CASE WHEN common THEN 0 ELSE length(head) + length(r) END) OVER w, 0) AS at_r
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id AS pair_id, CAST(count(*) FILTER (WHERE common) AS INTEGER) AS n_common,
       coalesce(string_agg(head || c, '' ORDER BY i) FILTER (WHERE common), '') AS prompt,
       coalesce(string_agg(head || c, '' ORDER BY i) FILTER (WHERE NOT common), '') AS chosen_text,
       coalesce(string_agg(head || r, '' ORDER BY i) FILTER (WHERE NOT common), '') AS rejected_text,
       coalesce(string_agg(CAST(at_c + length(head) AS BIGINT) || '-' || CAST(at_c + length(head) + length(c) AS BIGINT), ',' ORDER BY i) FILTER (WHERE trained AND NOT common), '') AS chosen_mask,
       coalesce(string_agg(CAST(at_r + length(head) AS BIGINT) || '-' || CAST(at_r + length(head) + length(r) AS BIGINT), ',' ORDER BY i) FILTER (WHERE trained AND NOT common), '') AS rejected_mask
FROM o GROUP BY conv_id
"""
