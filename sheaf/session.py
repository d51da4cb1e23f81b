"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "sheaf", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. ``master`` is for local runs; a cluster sets its own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the session's warehouse takes its place, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not have it, once a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="sheaf-code-"), "sheaf.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "sheaf")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Let plans run in here send Python workers at most about ``size`` bytes of rows at a time; one row at least.

    Batches are counted in rows otherwise, so that workers hold more, the longer the texts and the fuller the files.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(size))
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Let ``encode``/``decode`` use any JVM charset and mark bad bytes with U+FFFD.

    Both expressions take these switches over when they are analysed, so they need to be on
    only while a plan is put together; the session is left as it was.
    """
    keys = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
