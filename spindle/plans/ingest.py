"""Ingestion that goes on where it stopped: only new and changed files are parsed, in batches that count once they are committed.

A run compares the listing of files (names, sizes, times; no contents) with the manifest of what is committed. What is new makes a batch, whose name follows from its
files: a run that was killed and starts again writes the same folders, and nothing of a batch is read before its commit record is there. Batches are
never changed; of a file in several, the row of the last one counts. Files that vanish from the tree stay as they were ingested.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.plans.runs import _file, exists, required, save, write_text
from spindle.schemas import SAMPLING_RATE_HZ, SIGNAL_LENGTH
from spindle.sources import raw_files

#: Rows of observations that later batches replace, up to which their keys (some 60 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_REPLACED = 100_000
_VERSION = ["source_relative_path", "length", "modified", "copies"]


def commits(spark: SparkSession, out: str) -> list[dict]:
    """The committed batches in their order: number, batch, files. A record is some 100 bytes."""
    if not exists(f"{out}/commits"):
        return []
    return sorted((json.loads(r.value) for r in spark.read.option("pathGlobFilter", "*.json").text(f"{out}/commits", wholetext=True).collect()), key=lambda c: c["number"])


def _all(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """A table over all committed batches, with the batch's number."""
    known = commits(spark, out)
    if not known:
        return None
    numbers = F.create_map(*[x for c in known for x in (F.lit(c["batch"]), F.lit(c["number"]))])
    read = spark.read.option("basePath", f"{out}/{table}").parquet(*[f"{out}/{table}/batch={c['batch']}" for c in known])
    return read.withColumn("number", numbers[F.col("batch")])


def manifest(spark: SparkSession, out: str) -> DataFrame | None:
    """The source manifest of all committed batches: the last row of each file. None before the first commit."""
    rows = _all(spark, out, "source_manifest")
    if rows is None:
        return None
    last = Window.partitionBy("source_relative_path").orderBy(F.desc("number"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def observations(spark: SparkSession, out: str) -> DataFrame | None:
    """The observations of all committed batches, without those of files that later batches hold again."""
    rows, files = _all(spark, out, "observations"), _all(spark, out, "source_manifest")
    if rows is None:
        return None
    key = ["batch", "experiment_id", "bearing_id", "measurement_index"]
    last = Window.partitionBy("source_relative_path")
    old = files.withColumn("_last", F.max("number").over(last)).where("number < _last and parse_status = 'ok'").select(*key)
    n = old.limit(BROADCAST_REPLACED + 1).count()
    if n:
        rows = rows.join(F.broadcast(old) if n <= BROADCAST_REPLACED else old, key, "left_anti")
    return rows.drop("batch", "number")


def _listing(spark: SparkSession, raw_root: str) -> DataFrame:
    """Files with their versions: path, size, time, and how many files have the same measurement index (its change makes them all faulty, or not)."""
    key = ["experiment_id", "bearing_id", "measurement_index"]
    names = raw_files.discover(spark, raw_root).select("path", "source_relative_path", *key, "length", F.unix_micros("modificationTime").alias("modified"))
    copies = names.where("measurement_index is not null").groupBy(*key).agg(F.count("*").alias("copies"))
    return names.join(copies, key, "left").select("path", "source_relative_path", "length", "modified", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def ingest(spark: SparkSession, raw_root: str, out: str, *, rate: float = SAMPLING_RATE_HZ, expected: int = SIGNAL_LENGTH) -> dict:
    """Parses what is new or changed under raw_root and commits it: {"parsed": files, "batch": its name or None}."""
    required(spark, raw_root=raw_root)
    listing, known = _listing(spark, raw_root), manifest(spark, out)
    fresh = listing if known is None else listing.join(known.select(*_VERSION), _VERSION, "left_anti")
    found = fresh.select("path", *_VERSION).collect()  # names of new files, as Spark's own index of files has them
    if not found:
        return {"parsed": 0, "batch": None}
    name = fresh.agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(F.xxhash64(*_VERSION).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *_VERSION))), 256)).first()[0][:24]
    version = spark.createDataFrame([tuple(r)[1:] for r in found], "source_relative_path string, length long, modified long, copies long")
    files = raw_files.discovered(spark, [spark.read.format("binaryFile").load([r.path for r in found])]).join(version.select("source_relative_path", "copies"), "source_relative_path")
    parsed = save(raw_files.parsed(files), f"{out}/parsing/{name}")
    save(raw_files.observations(parsed, rate), f"{out}/observations/batch={name}")
    save(raw_files.source_manifest(parsed, expected).join(version, "source_relative_path"), f"{out}/source_manifest/batch={name}")
    number = max([c["number"] for c in commits(spark, out)], default=0) + 1
    commit(f"{out}/commits/{name}.json", {"number": number, "batch": name, "files": len(found)})
    fs, where = _file(spark, f"{out}/parsing")
    fs.delete(where, True)  # waveforms are kept once
    return {"parsed": len(found), "batch": name}


def commit(path: str, content: dict) -> None:
    """Writes the record aside and moves it to its place, so that it is there whole or not at all."""
    write_text(f"{path}.part", json.dumps(content))
    fs, aside = _file(SparkSession.active(), f"{path}.part")
    _, place = _file(SparkSession.active(), path)
    if not fs.rename(aside, place):
        raise RuntimeError(f"could not commit {path}")
