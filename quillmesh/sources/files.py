"""Small files of the driver by whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """(file system, path)."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def names(spark: SparkSession, path: str) -> list[str]:
    """Names under a folder, in order; none if there is no such folder."""
    fs, root = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, root = at(spark, path)
    fs.delete(root, True)


def read(spark: SparkSession, path: str) -> str:
    fs, root = at(spark, path)
    stream = fs.open(root)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file, which shows only when whole; False if there is one of that name already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    folder, _, name = path.rpartition("/")
    fs, hidden = at(spark, f"{folder}/.{name}.{jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(hidden, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
    try:
        context.rename(hidden, at(spark, path)[1], plain)
    except Exception as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
