"""Session settings and the one way in which lineage is cut."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster's own session is used as it is."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quireloom")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this package, once a session, by Spark's own file server.

    The archive lies in the shared folder of spark.checkpoint.dir where that is
    a path of a file system mounted here; else the driver keeps it for itself.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quireloom_shipped", False):
        return spark
    package = pathlib.Path(__file__).parent
    shared = sc.getConf().get("spark.checkpoint.dir") or ""
    folder = shared.removeprefix("file://") if shared.startswith(("/", "file:///")) else ""
    try:
        if folder:
            pathlib.Path(folder).mkdir(parents=True, exist_ok=True)
    except OSError:
        folder = ""
    archive = pathlib.Path(tempfile.mkdtemp(prefix="quireloom-", dir=folder or None)) / "quireloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(x for x in package.rglob("*") if x.suffix in (".py", ".npz")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._quireloom_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir of the session.

    Only where that is unset and everything runs on this machine (tests) a
    temporary folder is taken; on a cluster that is an error, as executors can't
    read each other's disks.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_quireloom_folder", None):
        sc._quireloom_folder = "file://" + tempfile.mkdtemp(prefix="quireloom-")
    return sc._quireloom_folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df once as a table in the shared folder and reads that, so that a lost executor loses no result.

    A reader of a cut table reads only its columns. The files are removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quireloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
