"""Chat formatting by rotating the perspective of multi-party dialogues.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and
all others as named users; system turns stay system turns. The loss mask covers the speaker's own text and
end mark.

    <|im_start|>system\\n...<|im_end|>\\n<|im_start|>user name=NAME\\n...<|im_end|>\\n<|im_start|>assistant\\n...<|im_end|>\\n

Everything is DataFrame expressions. A rendering comes in parts of 512 turns by position, in rows of their own, so
that a dialogue of any length meets in no task; a speaker's parts in order make up the whole rendering, of the whole
dialogue for everyone who speaks anywhere in it. Masks count from the part's start; who is silent in a part has an
empty mask there.

A text can't forge a turn: in texts and names every "<", backslashes, "|" gets one backslash more, which unescaped()
takes away again, and in names a line end is written as a backslash and n, a backslash as two.

Defined results: a null role speaks as "unknown", a null text is empty, null turns form a part of their own
(-1). Turns with equal numbers are ordered by role, then text; repeated equal rows count once. A null conv_id
is a dialogue like any other. A dialogue of system turns only has no participant and no rows. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import let, starts

START, END = "<|im_start|>", "<|im_end|>"
PART = 512


def escaped(text: Column) -> Column:
    """text in which no mark of the format occurs."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    """What escaped() was given."""
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _header(role: Column, speaker: Column) -> Column:
    one_line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    name = F.when(role == "system", "system").when(role == speaker, "assistant").otherwise(F.concat(F.lit("user name="), escaped(one_line)))
    return F.concat(F.lit(START), name, F.lit("\n"))


def dialogues(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, speaker, n_turns, rendered, mask (start:end in code points, comma-joined), n_masked, n_chars.

    Positions come from counts by range of turn numbers and the order within a range, so that a long dialogue is
    not ordered in one task.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    rows = rows.withColumn("range", F.floor(F.col("turn") / part).cast("long"))
    counts = rows.where("range is not null").groupBy("conv_id", "range").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")) - 1
    placed = rows.withColumn("within", within).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")), "left")
    number = F.floor((F.col("before") + F.col("within")) / part).cast("long")
    grouped = placed.groupBy("conv_id", F.coalesce(number, F.lit(-1).cast("long")).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts")
    )
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    return _rendered(grouped.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))))


def _rendered(seen: DataFrame) -> DataFrame:
    pieces = F.transform(
        "ts",
        lambda t: F.struct(
            _header(t["role"], F.col("speaker")).alias("head"),
            F.concat(escaped(t["text"]), F.lit(END)).alias("body"),
            (t["role"] == F.col("speaker")).alias("own"),
        ),
    )
    made = seen.select("conv_id", "part", "speaker", F.size("ts").cast("long").alias("n_turns"), pieces.alias("p"))
    spans = let(
        starts(F.transform("p", lambda x: F.length(x["head"]) + F.length(x["body"]) + 1)),
        lambda at: F.transform(
            F.filter(
                F.transform(
                    "p",
                    lambda x, i: F.struct(
                        x["own"].alias("own"),
                        (at[i] + F.length(x["head"])).alias("a"),
                        (at[i] + F.length(x["head"]) + F.length(x["body"])).alias("z"),
                    ),
                ),
                lambda s: s["own"],
            ),
            lambda s: F.concat_ws(":", s["a"].cast("string"), s["z"].cast("string")),
        ),
    )
    masked = F.aggregate("p", F.lit(0), lambda n, x: n + F.when(x["own"], F.length(x["body"])).otherwise(0))
    rendered = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        "part",
        "speaker",
        "n_turns",
        rendered.alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
        masked.cast("long").alias("n_masked"),
    ).withColumn("n_chars", F.length("rendered").cast("long"))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_NAME = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

ORACLE = f"""
WITH d AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
t AS (
  SELECT *, CASE WHEN turn IS NULL THEN -1
    ELSE (row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY turn, role, text) - 1) // {PART} END AS part FROM d),
r AS (
  SELECT t.*, s.speaker,
    '{START}' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
      ELSE 'user name=' || {_ESCAPED.format(_NAME)} END || chr(10) AS head,
    {_ESCAPED.format("text")} || '{END}' AS body
  FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM d WHERE role <> 'system') s ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
p AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM r)
SELECT conv_id, part, speaker, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
  coalesce(string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)), ',' ORDER BY pos) FILTER (WHERE role = speaker), '') AS mask,
  coalesce(sum(length(body)) FILTER (WHERE role = speaker), 0)::BIGINT AS n_masked,
  sum(length(head) + length(body) + 1)::BIGINT AS n_chars
FROM p GROUP BY conv_id, part, speaker"""
