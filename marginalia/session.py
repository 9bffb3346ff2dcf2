"""A Spark session with the settings that the engine's queries expect."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Runtime settings; all are session-level, so they can be applied to a session that exists.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8, memory: str = "8g", app: str = "marginalia") -> SparkSession:
    """A session on this machine, for tests and benchmarks; on a cluster pass your own to `configured`."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return configured(builder.getOrCreate())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see; without one, and only where all run on this machine, in a temporary folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders staged by this process, deleted when it ends.
_STAGED: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """A result that several parts of a plan read, written once as Parquet in the shared folder and read again."""
    path = shared_path(df.sparkSession, "settled")
    if not _STAGED:
        atexit.register(_unstaged)
    _STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unstaged() -> None:
    for path in _STAGED:
        with contextlib.suppress(OSError):
            system, place = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
            system.delete_dir(place)
    _STAGED.clear()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
