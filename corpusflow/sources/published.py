"""Tables in versions: complete folders next to each other, and one small file that names one.

Readers follow the file ``_current``. It is written aside and put in place by one rename that
replaces the old one, so at every moment, and after a crash between any two steps, it names a
version that is complete. Old versions stay until ``drop_old_versions``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def read_state(spark: SparkSession, path: str) -> dict | None:
    """What ``_current`` of the table at ``path`` says; None before the first version."""
    files, pointer = _hadoop(spark, f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Replace ``_current`` by ``state`` in one step."""
    files, pointer = _hadoop(spark, f"{path}/{POINTER}")
    _, aside = _hadoop(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(aside, True)
    try:
        stream.write(json.dumps(state).encode("utf-8"))
    finally:
        stream.close()
    fs_package = spark._jvm.org.apache.hadoop.fs
    context = fs_package.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(fs_package.Options.Rename, 1)
    replace[0] = fs_package.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(aside), context.makeQualified(pointer), replace)


def publish(df: DataFrame, path: str, **facts: object) -> dict:
    """Write ``df`` as the next version of the table at ``path``; returns its state.

    ``facts`` are kept with the version. A job that fails leaves the version before.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    state = {"version": version, **facts}
    write_state(spark, path, state)
    return state


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``; its rows do not change under a reader."""
    state = read_state(spark, path)
    if state is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    return spark.read.parquet(f"{path}/{state['version']}")


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete versions that are not current; only when no reader holds one. Returns how many."""
    state = read_state(spark, path)
    files, folder = _hadoop(spark, path)
    dropped = 0
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name != (state or {}).get("version"):
            files.delete(status.getPath(), True)
            dropped += 1
    return dropped
