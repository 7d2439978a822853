"""Session helpers: table reads and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the test tables, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: (JVM view, Hadoop configuration, path) of what was written and not removed yet.
_written: list[tuple] = []
#: (session, name) of the bucketed tables among them.
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster[...] has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
        note(spark, base)
    return base.rstrip("/")


def note(spark: SparkSession, path: str) -> None:
    """Has release() remove the path."""
    _written.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))


def release() -> None:
    """Removes every stored table; those that still read from one must be done. Also runs when the driver ends."""
    while _tables:
        spark, name = _tables.pop()
        try:
            spark.sql(f"drop table if exists {name}")
        except Exception:  # the session may have ended already
            continue
    while _written:
        jvm, conf, path = _written.pop()
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(release)


#: Bytes of files from which on store_joined() keeps a stored table from being broadcast; unpacked and hashed they come to ten times as much or more.
BROADCAST_BYTES = 256 * 1024


def store_joined(df: DataFrame, label: str = "cut") -> DataFrame:
    """store() for a table that grows with the pages and is joined again and again: unless its files are small, joins merge it.

    Spark's size rule goes by the compressed files of the columns that are read,
    so a table within the rule may be hundreds of MB once it is collected and
    hashed on the driver, where several are built at a time.
    """
    out = store(df, label)
    return out.hint("merge") if _bytes(out) > BROADCAST_BYTES else out


def _bytes(stored: DataFrame) -> int:
    """Of the files that a stored table is read from."""
    jvm, conf = stored.sparkSession.sparkContext._jvm, stored.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in stored.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def store(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage: what is read later doesn't depend on any executor,
    and values that depend on the partition (ids, range bounds) are fixed.
    The files stay until release() or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgrid/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, key: str, label: str = "cut") -> DataFrame:
    """store() for a table that is joined by the key again and again: it lies in buckets, so that none of these joins shuffles it.

    The table is in the session's catalogue, under a name of its own, until
    release(). A catalogue that takes no tables costs those shuffles, no more.
    """
    spark = df.sparkSession
    name = f"quillgrid_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/quillgrid/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    note(spark, path)
    _tables.append((spark, name))
    try:
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
        return spark.table(name)
    except AnalysisException:
        return store(df, label)
