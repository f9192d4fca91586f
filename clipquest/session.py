"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", name: str = "clipquest", **settings) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only on a local master."""
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="clipquest-")
    spark.conf.set(CHECKPOINT_SETTING, root)
    return root


def materialize(df: DataFrame, label: str, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table once and go on from the written copy.

    Lineage ends here, so losing an executor later cannot run a model again.
    Without a ``path`` the copy goes to a folder of this application, which can
    be deleted when its results have been stored elsewhere. The columns ``by``
    become folders, so that a filter on them opens no other files.
    """
    spark = df.sparkSession
    home = f"{scratch_dir(spark)}/clipquest/{spark.sparkContext.applicationId}"
    target = path or f"{home}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*by).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def ship_package(spark: SparkSession, package: Path = Path(__file__).parent) -> None:
    """Give the workers a package of this code, once per application."""
    context, package = spark.sparkContext, Path(package).resolve()
    shipped = context.__dict__.setdefault("_clipquest_shipped", set())
    if package in shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="clipquest-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    shipped.add(package)
