"""Tables that are replaced as a whole: a version is written aside, then a pointer moves.

A reader sees the old version or the new one, never a part, and a writer that dies
before the pointer moves leaves the table as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the version in force, None before the first."""
    files, pointer = _file(spark, f"{root}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return f"{root}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Moves the pointer; the rename is the one step that counts."""
    files, made = _file(spark, f"{root}/{version}.pointer")
    stream = files.create(made, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    conf = spark._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(made, _file(spark, f"{root}/{POINTER}")[1], how)


def new_version() -> str:
    return f"v-{uuid.uuid4().hex}"


def replace(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes ``df`` as the table at ``root``, which ``df`` itself may read; returns the new folder."""
    version = new_version()
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{version}")
    publish(df.sparkSession, root, version)
    return f"{root}/{version}"


def read(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The version in force; with ``schema`` an empty table before the first."""
    found = current(spark, root)
    if found is None and schema is None:
        raise FileNotFoundError(f"no version of {root}")
    if found is None:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(found)


def sweep(spark: SparkSession, root: str) -> int:
    """Deletes the versions that are no longer in force; only when nobody reads them."""
    kept = current(spark, root)
    files, folder = _file(spark, root)
    old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("v-") and kept is not None and not kept.endswith(s.getPath().getName())]
    for path in old:
        files.delete(path, True)
    return len(old)
