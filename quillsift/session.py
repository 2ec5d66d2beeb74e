"""What Python functions need on a cluster: this package beside the executors' workers."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "quillsift.shipped"


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the executors once a session, so that their Python workers can import it."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.conf.get(_SHIPPED, None):
        return
    here = pathlib.Path(__file__).resolve().parent
    out = pathlib.Path(tempfile.mkdtemp()) / f"{here.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted([*here.rglob("*.py"), *here.rglob("*.yaml")]):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(out))  # Spark's own file server takes it from the driver
    spark.conf.set(_SHIPPED, "true")


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the session names: what two readers must see alike is evaluated once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillsift-"))
    return df.checkpoint()
