"""Build a saved catalogue: python -m lexiquarry SOURCE --out-dir FOLDER."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import index
from .sources import json_documents, sqlite, store


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexiquarry", description="Build the search catalogue of a table (id, json).")
    p.add_argument("source", help="an SQLite file, or a folder of Parquet or JSON lines with the columns id and json")
    p.add_argument("--table", default="comics", help="the table of an SQLite file")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--generated-at", default="", help="ISO 8601 time for the manifest; now by default")
    p.add_argument("--clean", action="store_true", help="remove tables of earlier builds")
    p.add_argument("--meta-shard-docs", type=int, default=4096, help="documents in a file at most; 0: not split")
    p.add_argument("--index-shard-count", type=int, default=8, help="shards of the gram index; 0: one")
    return p.parse_args(given)


def main(given: list[str] | None = None) -> int:
    a = arguments(given)
    spark = SparkSession.builder.appName("lexiquarry").getOrCreate()
    if a.source.endswith((".sqlite", ".sqlite3", ".db")):
        raw = sqlite.read(spark, a.source, a.table)
    else:
        raw = spark.read.json(a.source, "id long, json string") if a.source.rstrip("/").endswith(".json") else spark.read.parquet(a.source)
    entries = json_documents.parse(raw).persist()
    skipped = index.document_grams(entries).agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]
    made = store.save(
        index.build(entries), a.out_dir, a.index_shard_count, a.generated_at.strip(), a.meta_shard_docs, skipped, a.clean,
        lambda name, done, of: print(f"{name}: {done} of {of} tables", file=sys.stderr),
    )
    entries.unpersist()
    print(made["stats"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
