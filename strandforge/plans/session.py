"""What a session needs: the package on the workers, the shared folder, cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Gives the workers this package, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_strandforge_shipped", None) != sc.applicationId:
        at = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        sc.addPyFile(str(at))
        sc._strandforge_shipped = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else one for runs on a single machine. A cluster
    without that setting is an error, since its machines don't share their own folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that one operator writes, reads again and drops."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        """df written and read again; its schema is known, so reading needs no job."""
        path = f"{self.at}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
