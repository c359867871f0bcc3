"""Tables that cut a plan in two: written to the folder that the driver and all executors share, and read back.

On a cluster the folder is what ``spark.checkpoint.dir`` names. A folder of this
machine is only used with a local master and without that setting.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loomtext-tables-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a new table."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, k=id(out): _paths.pop(k, None)), path)
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave and that nothing will read again, not even to make a lost part anew."""
    for df in tables:
        _, path = _paths.pop(id(df))
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
