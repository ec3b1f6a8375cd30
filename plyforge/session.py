"""Session construction, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "plyforge", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers of every executor.

    Workers don't inherit the driver's path. The package's sources go through
    Spark's own file distribution once for each application.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    # the driver serves this file to executors that come later too, so it stays until the program ends
    made = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    archive = os.path.join(made, f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables.

    It is what the cluster names in ``spark.checkpoint.dir``; where that is
    unset (local tests) a temporary folder is used, which is refused on any
    master that isn't local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"plyforge-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_written: list[tuple[SparkSession, str]] = []


def _remove_all() -> None:
    while _written:
        spark, path = _written.pop()
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table; best effort, the folder is the cluster's."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drop at the end every table that :func:`cut` made inside, but those passed through the function given.

    What is kept must not read what is dropped: it has been cut itself.
    """
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._plyforge_path)
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for df in made:
            if df._plyforge_path not in kept:
                release(df)
            elif _scopes:
                _scopes[-1].append(df)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read of files and not
    a recomputation, keeps column pruning and real size statistics (which a
    checkpointed RDD lacks), and is removed when the program ends.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._plyforge_path = path
    if _scopes:
        _scopes[-1].append(back)
    return back


def release(df: DataFrame) -> None:
    """Drop a table made by :func:`cut` that no later plan reads."""
    path = getattr(df, "_plyforge_path", None)
    if path:
        drop(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]
