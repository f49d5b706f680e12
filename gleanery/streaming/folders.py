"""Folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession

_removed_at_exit: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir.

    Where that is unset, one under the warehouse, which all executors share as well; it is
    removed when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/gleanery-{spark.sparkContext.applicationId}"
        if root not in _removed_at_exit and root.startswith("file:"):
            _removed_at_exit.add(root)
            atexit.register(shutil.rmtree, root.removeprefix("file:"), ignore_errors=True)
    return f"{root.rstrip('/')}/{name}"


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder that nothing has used."""
    return shared_folder(spark, f"{kind}-{uuid.uuid4().hex}")
