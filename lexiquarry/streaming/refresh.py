"""Keep a saved catalogue up to date with a stream of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.index import build
from ..sources import json_documents, store


def merged(now: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Typed entries with those of a batch (id, json) in the place of older ones of the same id. Of several rows of an
    id in one batch the one of the least json counts."""
    newest = Window.partitionBy("id").orderBy(F.col("json").asc_nulls_last())
    fresh = json_documents.parse(batch.select("id", "json").withColumn("k", F.row_number().over(newest)).where("k = 1"))
    if now is None:
        return fresh
    return now.join(fresh.select("src_id"), "src_id", "left_anti").unionByName(fresh)


def refresh(stream: DataFrame, state_folder: str, catalog_folder: str, checkpoint: str, **trigger):
    """With each batch of (id, json), replace the changed entries and save the catalogue built from all entries.

    Entries are kept typed, one folder for each batch, of which the last two stay: JSON is read once, whatever the
    history. A batch that is repeated after a failure starts from the one before it and gives the same result.
    Tables of the catalogue that come out equal aren't written again.
    """

    def rebuild(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, root = store._hadoop(spark, state_folder)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = sorted(int(n.removeprefix("entries-")) for n in names if n.startswith("entries-"))
        before = [n for n in done if n < number and fs.exists(store._hadoop(spark, f"{state_folder}/entries-{n}/_SUCCESS")[1])]
        now = spark.read.parquet(f"{state_folder}/entries-{before[-1]}") if before else None
        at = f"{state_folder}/entries-{number}"
        merged(now, batch).write.mode("overwrite").parquet(at)
        store.save(build(spark.read.parquet(at)), catalog_folder, clean_up=True)
        for n in before[:-1]:
            fs.delete(store._hadoop(spark, f"{state_folder}/entries-{n}")[1], True)

    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
