"""Stage tables: cut the lineage of a long flow by writing a stage to shared storage.

The folder is the one that ``spark.checkpoint.dir`` names, else the warehouse: both are
shared by all executors. A stage that is read back survives the loss of executors, and
its real size feeds the join strategy of the stages that read it (``persist`` does
neither, and nested cached plans grow without bound). An application's stage tables are
deleted when it ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application on shared storage, deleted when its driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/sonde-{spark.sparkContext.applicationId}"
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGES: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The stage table ``name`` of an input folder, written on first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGES:
        _STAGES[key] = written(build(), name)
    return _STAGES[key]


def forget(spark: SparkSession) -> None:
    """Forget the stage tables of this session, so the next query computes its stages anew."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _STAGES if k[0] == app]:
        del _STAGES[key]
