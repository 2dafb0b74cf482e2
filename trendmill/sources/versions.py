"""Datasets replaced as a whole: a version is written beside the last one and counts once it is complete.

``root/v=<number>`` holds one version.  Spark's success file, written last, makes it count, so a reader sees the old
rows or the new ones, and a job that dies leaves the old ones.  Frames read before a switch keep reading their own
files; old versions stay until somebody removes them.  One writer at a time; two at once meet an error on the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _numbers(spark: SparkSession, folder: str, prefix: str, complete: bool) -> list[int]:
    """Numbers of the folders ``<prefix><number>``; a missing folder has none."""
    paths = spark._jvm.org.apache.hadoop.fs
    path = paths.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    return sorted(int(p.getName().removeprefix(prefix)) for p in found
                  if p.getName().removeprefix(prefix).isdigit() and (not complete or files.exists(paths.Path(p, "_SUCCESS"))))


def complete_numbers(spark: SparkSession, folder: str, prefix: str = "v=") -> list[int]:
    """Numbers of the complete folders, ascending."""
    return _numbers(spark, folder, prefix, complete=True)


def current_folder(spark: SparkSession, root: str) -> str | None:
    """The newest complete version's folder, None before the first."""
    done = complete_numbers(spark, root)
    return f"{root}/v={done[-1]}" if done else None


def read_version(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest complete version; no rows before the first."""
    folder = current_folder(spark, root)
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).select(*map(_quoted, schema.names))


def replace_version(df: DataFrame, root: str, keys=(), **options) -> DataFrame:
    """Write ``df`` as the next version, in one folder per key combination, and read it back.

    ``df`` may read the dataset it replaces.  Folders of failed writers are passed over, never reused.
    """
    spark = df.sparkSession
    number = max(_numbers(spark, root, "v=", complete=False), default=0) + 1
    rows = df.hint("rebalance", *keys) if keys else df
    rows.write.options(**options).partitionBy(*keys).mode("error").parquet(f"{root}/v={number}")
    return read_version(spark, root, df.schema)


def append_version(df: DataFrame, root: str) -> DataFrame:
    """Add rows to the newest complete version, or begin the first; a job that dies adds none that count twice."""
    folder = current_folder(df.sparkSession, root)
    if folder is None:
        return replace_version(df, root)
    df.write.mode("append").parquet(folder)
    return read_version(df.sparkSession, root, df.schema)


def point_table(df: DataFrame, folder: str, table: str) -> DataFrame:
    """Let the catalogue name ``table`` show the Parquet in ``folder``, in one step of the catalogue.

    The name is a view with the columns and types of ``df``; folders of keys are found by the reader, which prunes
    them, and keys of text that all look like numbers come back as Spark reads those.  A stored table of that name is an error.
    """
    spark = df.sparkSession
    if spark.read.schema(df.schema).parquet(folder).isEmpty():  # no file may be there to tell the columns
        columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {_quoted(f.name)}" for f in df.schema.fields)
        body = f"SELECT {columns} WHERE false"
    else:
        columns = ", ".join(f"CAST({_quoted(f.name)} AS {f.dataType.simpleString()}) AS {_quoted(f.name)}" for f in df.schema.fields)
        body = f"SELECT {columns} FROM parquet.{_quoted(folder)}"
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS {body}")
    return spark.table(table)


def publish_table(df: DataFrame, root: str, table: str, keys=(), **options) -> DataFrame:
    """The next version of a dataset and the catalogue name switched to it; the name is readable throughout."""
    replace_version(df, root, keys, **options)
    return point_table(df, current_folder(df.sparkSession, root), table)
