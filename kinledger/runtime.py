"""Session-level helpers shared by all operators: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per application: Spark hands the archive from the driver to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="kinledger-")) / "kinledger.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, str(source.relative_to(root.parent)))
        sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; only a local session without one gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinledger-ckpt-"))


def _folder(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder; removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/tables"
    if path not in _registered:
        _registered.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        return  # the session is gone; the folder goes with the application's checkpoint folder


_registered: set[str] = set()


def cut(df: DataFrame, **counts: Column) -> DataFrame | tuple[DataFrame, Row]:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: lineage is cut, sizes are known.

    With ``counts`` (name=aggregate) their values over the written rows come along, without another job.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation(uuid.uuid4().hex) if counts else None
    out = df.observe(seen, *[c.alias(n) for n, c in counts.items()]) if seen else df
    out.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, Row(**seen.get)) if seen else back


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` is proven under the limit, else leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df
