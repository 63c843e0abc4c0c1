"""A catalogue as Parquet tables named by their content, and a manifest that is replaced in one step.

    manifest.json                       canonical JSON: version, generated_at, shards, statistics, tables
    docs.<digest>/ tags.<digest>/ authors.<digest>/ grams.<digest>/shard=k postings.<digest>/shard=k

A table with the content of one that is there already isn't written a second time. Readers keep what they have
open until `clean` removes the tables that the manifest doesn't name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gram_key, gram_shard
from ..operators.index import Catalog, check_grams, check_ids

VERSION = 2
TABLES = ("docs", "tags", "authors", "grams", "postings")


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def digest(df: DataFrame) -> tuple[str, int]:
    """Twelve hex digits that depend on the rows, not on their order or partitions, and the number of rows: one pass,
    one row to the driver."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    total = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), *map(str, total)]).encode()).hexdigest()[:12], total[0]


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write canonical JSON (sorted keys, compact, UTF-8) beside `path` and rename it over it, so that readers find
    the old file or the new one."""
    raw = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    jvm = spark.sparkContext._jvm
    fs, beside = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(raw)
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    mode = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, jvm.org.apache.hadoop.fs.Path(path), mode)


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def _keep(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> dict:
    """Write a table aside and move it to the name that its content gives; {path, rows, bytes}."""
    fs, aside = _hadoop(spark, f"{folder}/_aside-{uuid.uuid4().hex}")
    write(aside.toString())
    mark, rows = digest(spark.read.parquet(aside.toString()))
    path = f"{name}.{mark}"
    _, final = _hadoop(spark, f"{folder}/{path}")
    if fs.exists(final):
        fs.delete(aside, True)
    elif not fs.rename(aside, final):
        raise OSError(f"{aside} can't be moved to {final}")
    return {"path": path, "rows": rows, "bytes": fs.getContentSummary(final).getLength()}


def save(
    catalog: Catalog,
    folder: str,
    shards: int = 8,
    generated_at: str = "",
    shard_docs: int = 4096,
    skipped: int | None = None,
    clean_up: bool = False,
    tell: Callable[[str, int, int], None] | None = None,
) -> dict:
    """Write the catalogue and its manifest, which is returned. shards: of postings and dictionary, by a hash of the
    gram; shard_docs: documents in a file at most, in ranges of ids (0: not split). tell(table, done, of) is called
    after each table. Raises ValueError for ids that aren't positive or come twice.
    """
    spark, folder, shards = catalog.docs.sparkSession, folder.rstrip("/"), max(1, shards)
    shard = gram_shard(gram_key(F.col("gram")), shards).alias("shard")
    docs = catalog.docs.repartitionByRange("id").sortWithinPartitions("id").write.option("compression", "zstd")
    if shard_docs > 0:
        docs = docs.option("maxRecordsPerFile", shard_docs)
    by_gram = lambda df, *keys: df.select("*", shard).repartitionByRange("shard", *keys).sortWithinPartitions("shard", *keys)
    writers = {
        "docs": docs,
        "tags": catalog.tags.orderBy(F.desc("count"), "name", "tag_id").write,
        "authors": catalog.authors.orderBy("author_id").write,
        "grams": by_gram(catalog.grams, "gram").write.partitionBy("shard"),
        "postings": by_gram(catalog.postings, "gram", "id").write.partitionBy("shard"),
    }
    tables = {}
    for k, name in enumerate(TABLES):
        tables[name] = _keep(spark, folder, name, writers[name].option("compression", "zstd").parquet)
        if tell:
            tell(name, k + 1, len(TABLES))
        if name == "docs":  # before anything refers to them
            check_ids(spark.read.parquet(f"{folder}/{tables[name]['path']}").select("id"))
    check_grams(spark.read.parquet(f"{folder}/{tables['grams']['path']}"))
    manifest = {
        "version": VERSION,
        "generated_at": generated_at or datetime.now(timezone.utc).isoformat(),
        "shards": shards,
        "shard_docs": shard_docs,
        "stats": {
            "count": tables["docs"]["rows"],
            "tags": tables["tags"]["rows"],
            "authors": tables["authors"]["rows"],
            "unique_grams": tables["grams"]["rows"],
            "postings": tables["postings"]["rows"],
            "index_bytes": tables["postings"]["bytes"],
            "skipped": skipped,
        },
        "tables": tables,
    }
    put_json(spark, f"{folder}/manifest.json", manifest)
    if clean_up:
        clean(spark, folder)
    return manifest


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Remove the tables and what is left of broken writes that the manifest doesn't name; returns their names."""
    folder = folder.rstrip("/")
    named = {t["path"] for t in get_json(spark, f"{folder}/manifest.json")["tables"].values()}
    fs, at = _hadoop(spark, folder)
    gone = []
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        ours = name.split(".")[0] in TABLES or name.startswith(("_aside-", "manifest.json."))
        if ours and name not in named:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def load(spark: SparkSession, folder: str, tell: Callable[[str, int, int], None] | None = None, verify: bool = True) -> Catalog:
    """What the manifest names. With verify, raises ValueError if row counts, shards or ids aren't as they should be."""
    folder = folder.rstrip("/")
    m = get_json(spark, f"{folder}/manifest.json")
    if m["version"] != VERSION:
        raise ValueError(f"version {m['version']} of the catalogue can't be read")
    found = {}
    for k, name in enumerate(TABLES):
        found[name] = spark.read.parquet(f"{folder}/{m['tables'][name]['path']}")
        if verify and (n := found[name].count()) != m["tables"][name]["rows"]:
            raise ValueError(f"{name} has {n} rows, the manifest {m['tables'][name]['rows']}")
        if tell:
            tell(name, k + 1, len(TABLES))
    if verify:
        check_ids(found["docs"])
        for name in ("grams", "postings"):
            top = found[name].agg(F.max("shard")).first()[0]
            if top is not None and top >= m["shards"]:
                raise ValueError(f"{name} has shard {top}, the manifest {m['shards']} shards")
    return Catalog(found["docs"], found["tags"], found["authors"], found["postings"], found["grams"], m["shards"])
