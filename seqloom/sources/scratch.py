"""A folder that driver and executors share, for tables and text files that a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is not set, in a temporary folder, if Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="seqloom-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        found = f"file://{_own['dir']}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder: computed once, lineage cut, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_file(lines: DataFrame, name: str, compression: str = "none") -> str:
    """Path of lines (value, in the order of column n) as text files, whose names are in the order of their lines."""
    path = scratch(lines.sparkSession, name)
    ordered = lines.repartitionByRange("n").sortWithinPartitions("n")
    ordered.select("value").write.option("compression", compression).text(path)
    return path
