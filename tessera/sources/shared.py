"""The folder that driver and executors share, and what is kept in it."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a folder of its machine, once per application."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _file_system(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held


def state_of(table: DataFrame) -> str | None:
    """A digest of the names, sizes and times of a table's files; None where it has none. Folders are listed, not files one by one."""
    files = set(table.inputFiles())
    if not files:
        return None
    digest = hashlib.sha256()
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        fs, path = _file_system(table.sparkSession, folder)
        rows = [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
        names = {f.rsplit("/", 1)[1] for f in files if f.rsplit("/", 1)[0] == folder}
        for name, size, time in sorted(rows):
            if name.rsplit("/", 1)[1] in names:
                digest.update(f"{name}|{size}|{time}\n".encode())
    return digest.hexdigest()


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads again."""
    fs, held = _file_system(spark, path)
    fs.delete(held, True)


def kept(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path of what ``write`` writes to a folder, written once for a name.

    It is written aside and then renamed, so that a reader sees all of it or
    nothing, and of two writers at once the first one's stays.
    """
    path = f"{shared_dir(spark)}/{name}"
    fs, held = _file_system(spark, path)
    if not fs.exists(held):
        aside = f"{path}-{uuid.uuid4().hex}"
        write(aside)
        if not fs.rename(_file_system(spark, aside)[1], held) and not fs.exists(held):
            raise OSError(f"could not keep {path}")
    return path
