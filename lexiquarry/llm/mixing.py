"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token totals are raked: in turn for each of
the three, cells are scaled so that its marginal meets its target shares, and that over and over until the
weights stay as they are; marginal_error() says how far any marginal still is from its target. A document is then
sampled with a probability in proportion to its cell's scale, at most 1: no document is taken twice. The factor
is such that a share `keep` of all tokens is expected; sampled tokens then meet the raked shares, but for cells
that have too little. The draw is a digest of the doc_id: it is the same in every run and on any partitioning.

Everything is DataFrame expressions over one aggregate; only cells are shuffled repeatedly, documents never.

Defined results: a null source, language or text counts as an empty one. Cells without tokens keep scale 0
and documents without tokens are not sampled. Targets for absent categories are left out and the rest
rescaled; categories without a target get their tempered share of the rest. Rows with equal doc_ids share
their draw; without doc_id the text is drawn by. Empty tables give empty results. Further columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

DIMENSIONS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
LEGAL = r"(?i)\b(license|licence|copyright|warranty)\b"
CONTACT = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+"


def topic_of(text: Column, tokens: Column) -> Column:
    """A document's topic by its form."""
    return (
        F.when(text.rlike("(?=[lcwLCW])" + LEGAL), "legal")  # looked at only from letters that it can begin with
        .when(F.contains(text, F.lit("@")) & text.rlike(CONTACT), "contact")
        .when(tokens < 120, "note")
        .when(tokens > 1500, "longform")
        .otherwise("article")
    )


def with_cells(docs: DataFrame) -> DataFrame:
    """(row, source, lang, topic, tokens, draw)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text "), F.md5(text)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("mix "), name)), 1, 12), 16, 10).cast("double") / 16.0**12
    return counted.select("row", "source", "lang", topic_of(text, F.col("tokens")).alias("topic"), "tokens", draw.alias("draw"))


def _wanted(cells: DataFrame, targets: dict[str, dict[str, float]], temper: float) -> list[Column]:
    """Every dimension's target share, from the column __total_<dimension> of a category's tokens.

    The sums over categories that it takes come to the driver in one row for each dimension.
    """
    sums = {}
    for d in DIMENSIONS:
        given = F.col(d).isin(sorted(targets.get(d, {})))
        tempered = F.pow(F.sum("tokens").cast("double"), F.lit(temper))
        by = cells.groupBy(d).agg(tempered.alias("tempered")).withColumn("wanted", _given(d, targets))
        sums[d] = by.agg(F.sum("wanted"), F.sum(F.when(~given, F.col("tempered")))).first()
    out = []
    for d in DIMENSIONS:
        met, rest = (x or 0.0 for x in sums[d])
        free = max(0.0, 1.0 - sum(targets[d].values())) if targets.get(d) else 1.0
        norm = met + (free if rest else 0.0)
        tempered = F.lit(free) * F.pow(F.col(f"__total_{d}").cast("double"), F.lit(temper)) / F.lit(rest or 1.0)
        out.append((F.coalesce(_given(d, targets), tempered) / F.lit(norm or 1.0)).alias(f"__{d}"))
    return out


def _given(d: str, targets: dict[str, dict[str, float]]) -> Column:
    """The share that `targets` names for the category, else null."""
    shares = [F.when(F.col(d) == k, F.lit(float(v))) for k, v in sorted(targets.get(d, {}).items())]
    return F.coalesce(*shares, F.lit(None).cast("double"))


def _with_sums(cells: DataFrame, d: str, column: str, name: str, few: bool) -> DataFrame:
    """Cells with the sum of a column over their category. Few cells are summed up where they are; of more, each
    task adds up its own before the sums are shuffled, and Spark chooses the join by the size that they have."""
    if few:
        return cells.withColumn(name, F.sum(column).over(Window.partitionBy(d)))
    return cells.join(cells.groupBy(d).agg(F.sum(column).alias(name)), d)


def raked(
    cells: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.8,
    rounds: int = 12,
    error: float = 1e-12,
    few: int = 50_000,
) -> DataFrame:
    """Cells (source, lang, topic, tokens; no nulls in the first three) with `weight`, the raked token share.

    Where `targets` names no share, a category's target is its observed share to the power `temper`, rescaled.
    It ends after `rounds` rounds, or when a round has changed no weight by more than a share `error` of it.
    Up to `few` cells, four rounds are one job; of more cells, each round is written as a table.
    """
    now = materialize(cells.where("tokens > 0"), "cells")
    small = now.limit(few + 1).count() <= few
    shares = _wanted(now, targets or {}, temper)
    for d in DIMENSIONS:
        now = _with_sums(now, d, "tokens", f"__total_{d}", small)
    now = materialize(now.select(*DIMENSIONS, "tokens", F.col("tokens").cast("double").alias("weight"), *shares), "targets")
    kept = now.columns
    for done in range(0, rounds, 4 if small else 1):
        for _ in range(min(4, rounds - done) if small else 1):
            now = now.withColumn("__before", F.col("weight"))
            for d in DIMENSIONS:
                now = _with_sums(now, d, "weight", "__sum", small)
                now = now.withColumn("weight", F.col("weight") * F.col(f"__{d}") / F.col("__sum")).drop("__sum")
        now = materialize(now, "raked")
        moved = now.where("weight > 0").agg(F.max(F.abs(F.col("__before") / F.col("weight") - 1))).first()[0]
        now = now.select(*kept)
        if (moved or 0.0) <= error:
            break
    return now


def marginal_error(cells: DataFrame) -> float:
    """Of raked() cells, the largest difference between a category's share of weight and its target; 0 without cells."""
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    worst = [
        cells.groupBy(d).agg(F.abs(F.sum("weight") / total - F.first(f"__{d}")).alias("off")).agg(F.max("off")).first()[0] for d in DIMENSIONS
    ]
    return max(w or 0.0 for w in worst)


def factor(weights: DataFrame, keep: float) -> float:
    """The f for which the tokens of min(1, f * weight / tokens) sum up to keep times all tokens, for keep from 0
    (f is 0: nothing is sampled) to 1 (everything is)."""
    if not 0 <= keep <= 1:
        raise ValueError(f"keep is a share from 0 to 1, not {keep}")
    if keep in (0, 1):
        return 0.0 if keep == 0 else float("inf")
    goal = weights.agg(F.sum("tokens")).first()[0]
    if goal is None:
        return float("inf")
    goal, f, taken = keep * goal, 0.0, -1
    while True:
        # Cells that f takes whole leave the rest of the goal to the others; f only grows, so it ends.
        whole = F.lit(f) * (F.col("weight") / F.col("tokens")) > 1
        n, full, open_ = weights.agg(
            F.count(F.when(whole, 1)), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))
        ).first()
        if n == taken:
            return f
        if not open_:
            return float("inf")
        f, taken = (goal - (full or 0)) / open_, n


def with_probability(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    temper: float = 0.8,
    rounds: int = 12,
    keep: float = 0.8,
    broadcast_cells: int = 50_000,
    with_rows: bool = True,
) -> DataFrame:
    """with_cells() and `probability`. Up to broadcast_cells cells are raked in one task at a time and go to every
    task; more are raked and joined by shuffle.

    Without rows, only doc_id is kept of them, and texts are read once.
    """
    rows = with_cells(docs)
    if not with_rows:
        rows = materialize(rows.select(F.struct("row.doc_id").alias("row"), *DIMENSIONS, "tokens", "draw"), "placed")
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    weights = raked(cells, targets, temper, rounds, few=broadcast_cells)
    f = factor(weights, keep)
    scale = weights.select(*DIMENSIONS, F.least(F.lit(1.0), F.lit(f) * (F.col("weight") / F.col("tokens"))).alias("probability"))
    if weights.limit(broadcast_cells + 1).count() <= broadcast_cells:
        scale = F.broadcast(scale)
    return rows.join(scale, list(DIMENSIONS), "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))


def sample_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, cell, tokens and probability of the sampled documents."""
    drawn = with_probability(docs, with_rows=False, **parameters).where("draw < probability and tokens > 0")
    return drawn.select(F.col("row.doc_id").alias("doc_id"), *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"))


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The sampled rows of docs, columns unchanged."""
    drawn = with_probability(docs, **parameters).where("draw < probability and tokens > 0")
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle(temper: float = 0.8, rounds: int = 12, keep: float = 0.8) -> str:
    """sample_report() in SQL."""
    steps, last = [], "t0"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"r{k}_{d}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, "
                f"weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM {last})"
            )
            last = name
    shares = ", ".join(
        f"g_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {temper}) / sum(pow(sum(tokens)::DOUBLE, {temper})) OVER () AS t_{d} "
        f"FROM cells GROUP BY {d})"
        for d in DIMENSIONS
    )
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens
  FROM documents),
docs AS (
  SELECT doc_id, source, lang, tokens,
    CASE WHEN regexp_matches(text, '{LEGAL}') THEN 'legal' WHEN regexp_matches(text, '{CONTACT}') THEN 'contact'
      WHEN tokens < 120 THEN 'note' WHEN tokens > 1500 THEN 'longform' ELSE 'article' END AS topic,
    ('0x' || substr(md5('mix ' || doc_id), 1, 12))::BIGINT::DOUBLE / pow(16.0, 12) AS draw
  FROM counted),
cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
{shares},
t0 AS MATERIALIZED (
  SELECT cells.*, t_source, t_lang, t_topic, tokens::DOUBLE AS weight
  FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
{", ".join(steps)},
ranked AS (
  SELECT *, weight / tokens AS s, row_number() OVER w AS k,
    ({keep} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f
  FROM {last} WINDOW w AS (ORDER BY weight / tokens DESC, source, lang, topic)),
scale AS (
  SELECT source, lang, topic, least(1.0::DOUBLE, (SELECT arg_min(f, k) FROM ranked WHERE f * s <= 1) * s) AS probability FROM ranked)
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability
FROM docs JOIN scale USING (source, lang, topic) WHERE draw < probability AND tokens > 0"""
