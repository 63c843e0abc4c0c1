"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Base measures of a text: words (runs of anything but space and controls 9 to 13), their code points,
symbols, lines equal to an earlier line, and words in five-word windows that occur twice or more. The
table adds ratios of those, of stop words and of line forms; a text is kept if the base doesn't fail it
and every row of the table holds.

Defined results: a null or empty text has no words, fails the base (n_words < 10) and isn't kept. Each row
is judged by itself: repeated rows give repeated results, an empty table an empty one. Only `doc_id` and
`text` are read; other columns pass through keep_good() untouched. Five-word windows are compared by a
64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import NOT_SPACE, SPACE, let, words_of

SYMBOLS = "#*$%&|<>"
#: Very common words of the languages in scope.
STOP_WORDS = (
    "the of and to in is it that for on with as was be by are this from or an not at "
    "de la le les et des en un une que est pour dans du au par qui "
    "der die das und ist von zu den mit im sich nicht ein eine auf "
    "el los las y por con para una su al lo es se"
).split()


@dataclass(frozen=True)
class Rule:
    """`measure` has to lie within [low, high]; a bound of None is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Only texts that are plainly not prose fall outside.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("dup_line_share", None, 0.5),
    Rule("ellipsis_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("letter_word_share", 0.5, None),
    Rule("stop_words_per_word", 0.01, None),
)


def n_repeat_words(words: Column, n: int = 5) -> Column:
    """Words in n-word windows found twice or more. Windows are sorted by hash only where some repeat."""
    hashes = F.transform(
        F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words) - n + 1, F.lit(0))) for k in range(n)]),
        lambda w: F.xxhash64(*[w[str(k)] for k in range(n)]),
    )

    def covered(h: Column) -> Column:
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
            lambda s: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["x"] == e["x"]))
                            | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["x"] == e["x"])),
                        ),
                        lambda e: e["i"],
                    )
                ),
                F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum")),
                lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(n), i - a["last"])).alias("sum")),
                lambda a: a["sum"],
            ),
        )

    return F.when(
        F.size(words) > n,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)),
    ).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """(row, measures): docs as one struct, with the base measures and those of the threshold table."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    split = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        body.alias("body"),
        words_of(body).alias("words"),
        lines.alias("lines"),
    )
    counts = split.select(
        "row",
        # Not deterministic: a filter on it can't be moved below, where it would compute every measure again.
        F.rand(0).alias("barrier"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•·]"))).alias("n_bullets"),
        F.size(F.filter("words", lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
        F.regexp_count(F.lower("body"), F.lit(rf"(?<![\p{{L}}])({'|'.join(STOP_WORDS)})(?![\p{{L}}])")).alias("n_stop"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.select(
        "row",
        "barrier",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_ellipsis", "n_lines").alias("ellipsis_line_share"),
        per("n_bullets", "n_lines").alias("bullet_line_share"),
        per("n_letter_words", "n_words").alias("letter_word_share"),
        # One is added, so that a short text without any isn't judged by that.
        ((F.col("n_stop") + 1) / F.greatest("n_words", F.lit(1))).alias("stop_words_per_word"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition."""
    bounds = [F.col(r.measure) >= r.low for r in rules if r.low is not None]
    bounds += [F.col(r.measure) <= r.high for r in rules if r.high is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return measured(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        (~F.col("base_failed") & passes(rules)).alias("kept"),
        *[F.round(r.measure, 6).alias(r.measure) for r in rules],
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, columns unchanged."""
    good = measured(docs).where(~F.col("base_failed") & passes(rules) & (F.col("barrier") >= 0))
    return good.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """quality_report() in SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = [f"{r.measure} >= {r.low}" for r in rules if r.low is not None]
    bounds += [f"{r.measure} <= {r.high}" for r in rules if r.high is not None]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
s AS (
  SELECT *, regexp_extract_all(body, '{NOT_SPACE}+') AS words,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS lines
  FROM d),
windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times
  FROM (SELECT rid, i, words[i:i+4] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM s WHERE len(words) > 5))),
covered AS (
  SELECT rid, count(DISTINCT j)::BIGINT AS n
  FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM windows WHERE times > 1) GROUP BY rid),
c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(body, '{SPACE}+', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•·]'))) AS n_bullets,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(list_filter(regexp_extract_all(lower(body), '\p{{L}}+'), lambda x: x IN ({stop}))) AS n_stop
  FROM s LEFT JOIN covered USING (rid)),
m AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_ellipsis / greatest(n_lines, 1) AS ellipsis_line_share,
    n_bullets / greatest(n_lines, 1) AS bullet_line_share, n_letter_words / greatest(n_words, 1) AS letter_word_share,
    (n_stop + 1) / greatest(n_words, 1) AS stop_words_per_word,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(bounds)} AS kept, {", ".join(f"round({r.measure}, 6) AS {r.measure}" for r in rules)}
FROM m"""
