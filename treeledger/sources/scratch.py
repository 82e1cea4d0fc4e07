"""Where intermediate tables are written."""

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


# The temporary folder of each local session that names none, by application id.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a session inside one process may go without: it gets a temporary folder of its own, kept
    here because Spark does not let a running session change the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.conf.get("spark.app.id")
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="treeledger-")
    return _own_folders[application]


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/treeledger-{uuid.uuid4().hex}"


def materialise(df: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table and read it back: lost executors cost a reread, not a rerun."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
