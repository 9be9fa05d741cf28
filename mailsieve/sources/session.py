"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident

from pyspark.sql import SparkSession

from mailsieve.sources.files import remove


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mailsieve")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode.

    The session's ``spark.checkpoint.dir`` counts first, then a folder already set on the
    context. Anywhere but in local mode one of them is needed: executors share no local disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not configured and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # The setting cannot be changed in a running session; the context remembers the folder.
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="mailsieve-"))
    return configured or context.getCheckpointDir()


# Folders of the jobs that run in each thread, the innermost last; a plain value, as tasks get copies of this module.
_job_roots: dict[int, list[str]] = {}


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """A folder for all work paths taken inside; it is removed at the end, also after a failure."""
    root = f"{checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"
    own = _job_roots.setdefault(get_ident(), [])
    own.append(root)
    try:
        yield root
    finally:
        own.pop()
        remove(spark, root)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, or under that of the running job."""
    roots = _job_roots.get(get_ident())
    return f"{roots[-1] if roots else checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
