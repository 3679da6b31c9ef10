"""Files that Spark derives from the test tables, for the file readers.

Written once under the session's shared checkpoint folder
(``spark.checkpoint.dir``); a complete earlier write (``_SUCCESS``) is
reused.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

from skyledger.session import checkpoint_dir
from skyledger.streaming.state_tables import hadoop_path_exists


def derived_path(spark: SparkSession, sf_dir: str, kind: str) -> str:
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    return os.path.join(checkpoint_dir(spark), "derived", f"{kind}-{tag}")


def ensure_written(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    if not hadoop_path_exists(spark, os.path.join(path, "_SUCCESS")):
        write(path)
    return path
