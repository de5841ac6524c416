"""Session helpers: shipping the package to executors and choosing the checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker until it is asked for another key.

    Spark reuses its Python workers, so what the stages of a long job keep would add up; only the last is kept.
    """
    if key not in _HELD:
        _HELD.clear()
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def keep_groups(spark: SparkSession) -> None:
    """Have Spark deal the rows of a union by key before they are grouped.

    Spark 4.1 takes a union of tables dealt by the same key for dealt itself, and adaptive execution may then join up
    the partitions of each differently: rows of one key land in different tasks and are grouped apart.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application.

    The zip is staged on the driver and served to executors by Spark itself, so no folder has to be shared.
    """
    keep_groups(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def send(spark: SparkSession, content: bytes, kind: str) -> str:
    """Hand ``content`` to every executor through Spark's file server; its name there, for SparkFiles."""
    name = f"{kind}-{hashlib.sha256(content).hexdigest()[:20]}"
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        target = Path(tempfile.mkdtemp(prefix="tidemark-")) / name
        target.write_bytes(content)
        spark.sparkContext.addFile(str(target))
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one is set only in local mode, where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    chosen = named or tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(chosen)
    return chosen


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, without its lineage.

    It is Parquet, so it is compressed, its size is known to the planner and later reads take only the columns they
    need.  Like checkpoint files, the tables are left for whoever cleans the checkpoint folder.
    """
    keep_groups(df.sparkSession)
    out = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables made by `cut`, once all that is made of them is written itself."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove what a query shuffled as soon as it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    keep_groups(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
