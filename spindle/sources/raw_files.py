"""Raw CSV trees: <root>/<condition>/<bearing>/<n>.csv as observations and a manifest of every file, errors included.

Files are read by Spark (binaryFile), parsed one by one in tasks, and never stop a run: a file that can't be
parsed is a manifest row with its error.
"""

from __future__ import annotations

import io
import math
import re

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.schemas import CONDITIONS, DATASET, RECORD_INTERVAL_SEC, SAMPLING_RATE_HZ, SIGNAL_COLUMNS, SIGNAL_LENGTH

#: Repeated measurement indices (some 60 bytes each) that are broadcast to the files; more are joined by shuffle.
BROADCAST_COPIES = 100_000
_NUMBER = re.compile(r"[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, content, length, modificationTime, source_relative_path, condition_source_name, experiment_id, bearing_id, stem, measurement_index (null if the name is no number from 1 on).

    Files count where they stand right in <root>/<condition>/<bearing>/; trees at another depth are no bearings. A root that is absent raises.
    """
    names = folders(spark, root)
    known = [c[0] for c in CONDITIONS if c[0] in names]
    files = None
    for name in known:
        try:
            one = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{name}/*/*.[cC][sS][vV]")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue  # a condition without any file
        files = one if files is None else files.union(one)
    return discovered(spark, [] if files is None else [files])


def discovered(spark: SparkSession, found: list[DataFrame]) -> DataFrame:
    """What `discover` gives, of tables of binary files."""
    files = found[0] if found else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    rel = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)
    cond = F.create_map(*[x for c in CONDITIONS for x in (F.lit(c[0]), F.lit(c[1]))])
    stem = F.regexp_extract(rel, r"/([^/]+)\.[cC][sS][vV]$", 1)
    idx = F.when(stem.rlike("^[0-9]{1,18}$"), stem.try_cast("long"))
    out = files.select("path", "content", "length", "modificationTime", rel.alias("source_relative_path"), F.regexp_extract(rel, "^([^/]+)/", 1).alias("condition_source_name"), F.regexp_extract(rel, "/([^/]+)/", 1).alias("bearing_id"), stem.alias("stem"), F.when(idx >= 1, idx).alias("measurement_index"))
    return out.withColumn("experiment_id", cond[F.col("condition_source_name")]).where("experiment_id is not null")


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders right in root, sorted, read by Spark's own file system so that any store will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"raw root does not exist: {root}")
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory())


def ignored_conditions(spark: SparkSession, root: str) -> list[str]:
    """Folders in root that are no condition."""
    return [x for x in folders(spark, root) if x not in {c[0] for c in CONDITIONS}]


def missing_conditions(spark: SparkSession, root: str) -> list[str]:
    """Conditions without a folder in root."""
    have = folders(spark, root)
    return [c[0] for c in CONDITIONS if c[0] not in have]


def _plain(content: bytes) -> np.ndarray | None:
    """The numbers of a file whose lines are all of two plain decimal numbers; None for any other, which is then read cell by cell."""
    body = content.partition(b"\n")[2]
    if not body or body.translate(None, b"0123456789+-.eE,\r\n"):
        return None
    try:
        got = np.loadtxt(io.BytesIO(body), delimiter=",", dtype=np.float64, ndmin=2, comments=None)
    except ValueError:
        return None
    with np.errstate(over="ignore"):
        got = got.astype(np.float32)
    return got if got.shape[0] and got.shape[1] == 2 and np.isfinite(got).all() else None


def parse_signals(content: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(header, horizontal, vertical); anything that isn't two columns of finite numbers raises with its line."""
    head = [x.strip() for x in content.partition(b"\n")[0].decode("utf-8-sig").split(",")]
    if sorted(head) == sorted(SIGNAL_COLUMNS):  # most files: nothing but the header is read as text
        fast = _plain(content)
        if fast is not None:
            return head, fast[:, head.index(SIGNAL_COLUMNS[0])], fast[:, head.index(SIGNAL_COLUMNS[1])]
    rows = [(n, line.split(",")) for n, line in enumerate(content.decode("utf-8-sig").splitlines(), 1)]
    if not rows or not any(x.strip() for x in rows[0][1]):
        raise ValueError("empty file")
    header = [x.strip() for x in rows[0][1]]
    if len(set(header)) != len(header):
        raise ValueError(f"repeated columns: {header}")
    if set(header) != set(SIGNAL_COLUMNS):
        raise ValueError(f"unexpected columns: {header}")
    data = []
    for n, cells in rows[1:]:
        if not any(x.strip() for x in cells):
            continue
        if len(cells) != 2:
            raise ValueError(f"line {n}: {len(cells)} columns")
        pair = []
        for x in cells:
            x = x.strip()
            if not _NUMBER.match(x):
                raise ValueError(f"line {n}: {'empty' if not x else 'not a finite number'}: {x!r}")
            pair.append(float(x))
        data.append(pair)
    if not data:
        raise ValueError("no data rows")
    with np.errstate(over="ignore"):
        got = np.array(data, dtype=np.float64).astype(np.float32)
    if not np.isfinite(got).all():
        raise ValueError("values beyond float32")
    return header, got[:, header.index(SIGNAL_COLUMNS[0])], got[:, header.index(SIGNAL_COLUMNS[1])]


_PARSED = "source_relative_path string, file_sha256 string, file_size_bytes bigint, condition_source_name string, experiment_id string, bearing_id string, measurement_index bigint, copies bigint, source_columns array<string>, error string, horizontal array<float>, vertical array<float>"


def _parse(frames):
    for pdf in frames:
        out = {"source_columns": [], "error": [], "horizontal": [], "vertical": []}
        for content, idx, copies in zip(pdf.content, pdf.measurement_index, pdf.copies, strict=True):
            header, error, h, v = [], None, None, None
            try:
                if idx is None or (isinstance(idx, float) and math.isnan(idx)):
                    raise ValueError("file name is no measurement index")
                if copies > 1:
                    raise ValueError("duplicate measurement index")
                header, h, v = parse_signals(bytes(content))
            except (ValueError, UnicodeDecodeError) as e:
                error = str(e)
            for k, x in zip(out, (header, error, h, v), strict=True):
                out[k].append(x)
        yield pd.concat([pdf.drop(columns="content"), pd.DataFrame(out, index=pdf.index)], axis=1)[[c.split(" ")[0] for c in _PARSED.split(", ")]]


def parsed(files: DataFrame) -> DataFrame:
    """Each file with its hash, size, error or signals. All copies of a measurement index in a bearing (1.csv, 01.csv) are errors.

    Copies are counted among these files, unless they have a column `copies`.
    """
    hashed = files.withColumns({"file_sha256": F.sha2("content", 256), "file_size_bytes": F.length("content").cast("long")})
    wanted = ["source_relative_path", "file_sha256", "file_size_bytes", "condition_source_name", "experiment_id", "bearing_id", "measurement_index", "copies", "content"]
    if "copies" in files.columns:
        return hashed.select(*wanted).mapInPandas(_parse, _PARSED)
    key = ["experiment_id", "bearing_id", "measurement_index"]
    twice = files.where("measurement_index is not null").groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")  # names only, not contents
    if twice.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES:
        twice = F.broadcast(twice)  # so that contents pass no shuffle
    rows = hashed.join(twice, key, "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))).select(*wanted)
    return rows.mapInPandas(_parse, _PARSED)


def observations(files: DataFrame, rate: float = SAMPLING_RATE_HZ) -> DataFrame:
    """Two rows for each file that was parsed. files: from `parsed`."""
    speed = F.create_map(*[x for c in CONDITIONS for x in (F.lit(c[1]), F.lit(c[2]))])
    load = F.create_map(*[x for c in CONDITIONS for x in (F.lit(c[1]), F.lit(c[3]))])
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in ("horizontal", "vertical")]))
    rows = files.where("error is null").select("experiment_id", "bearing_id", "measurement_index", both.alias("s"))
    return rows.select(
        F.lit(DATASET).alias("dataset_name"), "experiment_id", "bearing_id", "measurement_index", ((F.col("measurement_index") - 1) * RECORD_INTERVAL_SEC).alias("elapsed_time_sec"),
        speed[F.col("experiment_id")].alias("rotational_speed_rpm"), load[F.col("experiment_id")].alias("radial_load_kn"), F.col("s.c").alias("channel_id"), F.col("s.c").alias("channel_direction"),
        F.lit(rate).alias("sampling_rate_hz"), F.size("s.x").cast("long").alias("signal_length"), F.col("s.x").alias("vibration_signal"))


def source_manifest(files: DataFrame, expected: int = SIGNAL_LENGTH) -> DataFrame:
    """One row for each file; rows with an error have no parsed values. An unexpected length is a warning only."""
    ok = F.col("error").isNull()
    n = F.size("horizontal").cast("long")
    warn = F.when(ok & (n != expected), F.array(F.format_string(f"signal length %d differs from expected {expected}", n))).otherwise(F.array().cast("array<string>"))
    return files.select(
        "source_relative_path", "file_sha256", "file_size_bytes", "condition_source_name", "experiment_id", "bearing_id", "measurement_index", "source_columns",
        F.when(ok, n).alias("source_row_count"), F.when(ok, n).alias("horizontal_signal_length"), F.when(ok, F.size("vertical").cast("long")).alias("vertical_signal_length"),
        F.when(ok, "ok").otherwise("error").alias("parse_status"), "error", warn.alias("warnings"))


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "ok").alias("ok"), F.count_if(F.col("parse_status") == "error").alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings"), (2 * F.count_if(F.col("parse_status") == "ok")).alias("observations"))
