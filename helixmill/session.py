"""Session settings, the shared folder for intermediate tables, size-checked broadcasts, and joins on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows of a few numbers each may be broadcast (some 5 MB).
BROADCAST_ROWS = 50_000
#: A key of more rows than this and than a part in HOT_KEYS of all rows is hot; so there are at most HOT_KEYS of them.
HOT_ROWS = 200_000
HOT_KEYS = 5_000

_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a folder of this machine only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="helixmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet to the shared folder and read back: lineage ends there and later reads prune columns.

    The table outlives lost executors. It is removed by release(), or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/helixmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back.written_ = path
    return back


def release() -> None:
    """Remove the intermediate tables written so far. Results not yet read must not be read afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else for a shuffled join. It is written first unless it is a
    table of materialize(), so that it isn't worked out twice; the count then reads the files' footers."""
    t = df if "written_" in vars(df) else materialize(df, "side")
    return F.broadcast(t) if t.count() <= rows else t


def hot_keys(counts: DataFrame, key: str, n_rows: int) -> list:
    """The hot keys of a table of n_rows rows, from its counts (key, n): at most HOT_KEYS. No job runs where there can't be any."""
    if n_rows <= HOT_ROWS:
        return []
    return [r[0] for r in counts.where(F.col("n") > max(HOT_ROWS, n_rows // HOT_KEYS)).select(key).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """left.join(right, key, how), how inner or left, right with one row a key. Rows of hot keys stay where they are and get the
    at most HOT_KEYS rows of right by broadcast; only the others are shuffled. AQE can't do that: right is mostly an aggregate
    by the key, and it splits a partition only where both sides come straight from a shuffle."""
    if not hot:
        return left.join(right, key, how)
    own = F.col(key).isin(hot)
    spread = left.where(own).join(F.broadcast(right.where(own)), key, how)
    return spread.unionByName(left.where(~own | F.col(key).isNull()).join(right.where(~own), key, how))
