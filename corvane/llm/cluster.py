"""Where jobs keep what all executors must see, and the one batch setting the text operators need."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts have no length limit, so the row count stays small.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for a context: they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_corvane_shipped", False):
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(archive := Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip", "w") as z:
            for file in [root / "__init__.py", *sorted((root / "llm").glob("*.py"))]:
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._corvane_shipped = True


def session_for_texts(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, by rows and by bytes; ship the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a temporary one is set, in local mode only: on a
    cluster every executor would write to a disk of its own, so there an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corvane-tables/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. sweep() removes what is written there."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. sweep() removes it."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder. Results not yet written elsewhere are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
