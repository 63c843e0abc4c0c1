"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers.

Everything runs as DataFrame expressions. A pattern's matches come from regexp_extract_all and the gaps
between them from split by the same pattern, so that a match's start is a running total of lengths in
code points, and long texts need no Python.

The model: one first-order Markov chain over characters is fitted to random strings, one to ordinary
identifiers; a candidate is a secret if the log-likelihood ratio of the two, per transition, reaches a
threshold. Weights are integers (thousandths of a nat), so scores don't depend on the order of addition.
Candidates are whole runs of the alphabet's characters, however long, and of a run that meets base spans the
pieces beside them, each of at least LEAST characters and with a letter.

Defined results: a null text is empty. An empty table gives an empty table. Every row is judged by itself,
so repeated rows and ties give repeated results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exprs import let, starts

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Words of which ordinary identifiers are made.
LEXICON = (
    "account action address admin agent array author batch buffer build cache calendar catalog channel client "
    "column command comment config connection content context controller counter customer data default delete "
    "description directory document download element employee entry error event exchange factory field filter "
    "folder format function gateway generator group handler header history image import index information input "
    "instance integer interface internal international item keyboard language layout library listener location "
    "logger manager memory message method model module monitor network number object operation option order "
    "output package parameter parser password payment pipeline position process product profile project property "
    "protocol provider query queue random reader record region register registration relation report request "
    "resource response result router sample schedule schema search section security selector server service "
    "session setting shipment source statement status storage stream string support system table target template "
    "test thread threshold timeout token transaction transform transport update user validation value vector "
    "version view window worker wrapper"
).split()


@dataclass(frozen=True)
class MarkovRatio:
    """Weights of (n + 1)² transitions in thousandths of a nat; any other character shares the last class."""

    alphabet: str
    weights: tuple[int, ...]
    threshold: int = 800

    def score(self, s: Column) -> Column:
        """Sum of weights over the transitions of s."""
        n = len(self.alphabet) + 1
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")
        cls = lambda c: (F.instr(F.lit(self.alphabet), c) + n - 1) % n
        return F.aggregate(
            F.split(s, ""),
            F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum")),
            lambda a, c: F.struct(
                cls(c).cast("int").alias("last"),
                (a["sum"] + F.when(a["last"] < 0, 0).otherwise(table[(a["last"] * n + cls(c)).cast("int")])).alias("sum"),
            ),
            lambda a: a["sum"],
        )

    def is_random(self, s: Column) -> Column:
        return self.score(s) >= self.threshold * (F.length(s) - 1)


def labelled_strings(spark: SparkSession, size: int = 6000) -> DataFrame:
    """(string, random): `size` random strings of several forms and `size` identifiers. size bounds the sample."""
    ids = spark.range(size)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest("b")))
    upper = F.upper(F.translate(F.base64(F.unhex(digest("u"))), "+/=", "QXZ"))
    random = ids.select(
        F.when(F.col("id") % 3 == 0, digest("h")).when(F.col("id") % 3 == 1, b64).otherwise(upper).alias("string"),
        F.lit(1).alias("random"),
    )
    words = F.array(*map(F.lit, LEXICON))
    word = lambda k: words[
        (F.conv(F.substring(digest(f"w{k}"), 1, 6), 16, 10).cast("long") % len(LEXICON)).cast("int")
    ]
    parts = [word(k) for k in range(4)]
    names = ids.select(
        F.when(F.col("id") % 6 == 0, F.concat_ws("_", *parts))
        .when(F.col("id") % 6 == 1, F.concat(parts[0], *map(F.initcap, parts[1:])))
        .when(F.col("id") % 6 == 2, F.upper(F.concat_ws("_", *parts)))
        .when(F.col("id") % 6 == 3, F.concat_ws("-", *parts))
        .when(F.col("id") % 6 == 4, F.concat_ws("/", *parts[:3], F.concat(F.lit("v"), F.col("id") % 100)))
        .otherwise(F.concat(*parts))
        .alias("string"),
        F.lit(0).alias("random"),
    )
    return random.union(names)


def train(samples: DataFrame, alphabet: str = ALPHABET, smoothing: float = 0.5, threshold: int = 800) -> MarkovRatio:
    """Count transitions by label in Spark. At most 2 (n + 1)² counts come to the driver."""
    n = len(alphabet) + 1
    cls = lambda c: (F.instr(F.lit(alphabet), c) + n - 1) % n
    chars = samples.where(F.length("string") > 1).select("random", F.split("string", "").alias("c"))
    pairs = chars.select(
        "random",
        F.explode(
            F.zip_with(
                F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: cls(a) * n + cls(b)
            )
        ).alias("pair"),
    )
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    totals = {
        (label, a): sum(counts.get((label, a * n + b), 0) for b in range(n)) for label in (0, 1) for a in range(n)
    }

    def log_p(label: int, a: int, b: int) -> float:
        return math.log((counts.get((label, a * n + b), 0) + smoothing) / (totals[label, a] + smoothing * n))

    weights = tuple(round(1000 * (log_p(1, a, b) - log_p(0, a, b))) for a in range(n) for b in range(n))
    return MarkovRatio(alphabet, weights, threshold)


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, matches: Column, pattern: str, kind: int, keep=None) -> Column:
    """Structs (start, kind, end) of the matches, of those only for which keep(index) holds, if given."""
    located = let(
        F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"))),
        lambda parts: let(
            starts(F.transform(parts, lambda p: p["gap"] + F.coalesce(F.length(p["m"]), F.lit(0)))),
            lambda at: F.transform(
                F.filter(parts, lambda p: p["m"].isNotNull()),
                lambda p, i: F.struct(
                    (at[i] + p["gap"]).alias("start"),
                    F.lit(kind).alias("kind"),
                    (at[i] + p["gap"] + F.length(p["m"])).alias("end"),
                ),
            ),
        ),
    )
    if keep:
        whole = located
        located = let(whole, lambda s: F.filter(s, lambda x, i: keep(i)))
    return F.when(F.size(matches) > 0, located).otherwise(F.array().cast(NO_SPANS))


def _beside(run: Column, base: Column) -> Column:
    """The pieces of a span that no base span covers, in order; base spans are in order of their starts."""
    met = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    piece = lambda a, z: F.struct(a.alias("start"), run["kind"].alias("kind"), z.alias("end"))
    walked = F.aggregate(
        met,
        F.struct(F.array().cast(NO_SPANS).alias("out"), run["start"].alias("at")),
        lambda a, b: F.struct(
            F.when(b["start"] > a["at"], F.concat(a["out"], F.array(piece(a["at"], b["start"])))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], b["end"]).alias("at"),
        ),
        lambda a: F.when(a["at"] < run["end"], F.concat(a["out"], F.array(piece(a["at"], run["end"])))).otherwise(a["out"]),
    )
    return F.when(F.size(met) > 0, walked).otherwise(F.array(run))


def find_secrets(docs: DataFrame, model: MarkovRatio, text: str = "text") -> DataFrame:
    """docs with `spans`, structs (start, kind, end) of base and model spans in order, and `base_spans`.

    Model spans overlap no base span. Columns of docs stay as they are.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        body.alias("body"),
        F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)).alias("assign"),
        F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)).alias("value"),
        F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0)).alias("access"),
        F.regexp_extract_all(body, F.lit(HEX), F.lit(0)).alias("hex"),
        F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)).alias("candidate"),
    )
    base = F.array_sort(
        F.concat(
            _spans(F.col("body"), F.col("assign"), ASSIGN, 0, lambda i: F.length(F.col("value")[i]) >= 6),
            _spans(F.col("body"), F.col("access"), ACCESS, 1),
            _spans(F.col("body"), F.col("hex"), HEX, 2),
        )
    )
    runs = _spans(F.col("body"), F.col("candidate"), CANDIDATE, 3)
    located = found.select("row", "body", base.alias("base_spans"), runs.alias("runs"))
    pieces = F.when(F.size("runs") > 0, F.flatten(F.transform("runs", lambda r: _beside(r, F.col("base_spans"))))).otherwise(F.col("runs"))
    spans = located.select("row", "body", "base_spans", pieces.alias("pieces"))
    of = lambda x: F.substring(F.col("body"), x["start"] + 1, x["end"] - x["start"])
    random = lambda m: (F.length(m) >= LEAST) & m.rlike("[A-Za-z]") & model.is_random(m)
    added = F.when(F.size("pieces") > 0, F.filter("pieces", lambda x: let(of(x), random))).otherwise(F.col("pieces"))
    return spans.select("row", "base_spans", F.array_sort(F.concat("base_spans", added)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def secret_report(docs: DataFrame, model: MarkovRatio) -> DataFrame:
    """doc_id, the counts of base spans by kind, their digest, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        of_kind(F.col("base_spans"), "assign").alias("n_assign"),
        of_kind(F.col("base_spans"), "access").alias("n_access"),
        of_kind(F.col("base_spans"), "hex").alias("n_hex"),
        F.sha2(span_list(F.col("base_spans")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
        of_kind(F.col("spans"), "markov").alias("n_markov"),
    )


def redact(docs: DataFrame, model: MarkovRatio, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` replaced by `mark`; columns and their order stay. Null stays null.

    Overlapping base spans are replaced once, as their union.
    """
    found = find_secrets(docs, model, text)
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    # Walk spans in order; `done` is the code point up to which the text has been dealt with.
    pieces = F.aggregate(
        "spans",
        F.struct(F.array().cast("array<struct<from:int,to:int>>").alias("keep"), F.lit(0).alias("done")),
        lambda a, s: F.struct(
            F.when(
                s["start"] >= a["done"],
                F.concat(a["keep"], F.array(F.struct(a["done"].alias("from"), s["start"].alias("to")))),
            )
            .otherwise(a["keep"])
            .alias("keep"),
            F.greatest(a["done"], s["end"]).alias("done"),
        ),
        lambda a: F.concat(a["keep"], F.array(F.struct(a["done"].alias("from"), F.lit(2**31 - 1).alias("to")))),
    )
    clean = F.array_join(F.transform(pieces, lambda p: F.substring(body, p["from"] + 1, p["to"] - p["from"])), mark)
    out = F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[out.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
