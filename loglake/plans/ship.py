"""Makes the package importable for Python workers that don't run beside it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import loglake

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package as a zip, once per application, unless workers run on this machine with this path (master local)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(loglake.__file__)))
    known = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    alone = master.startswith("local") and not master.startswith("local-cluster")
    if app in _DONE or (alone and os.path.realpath(root) in known):
        return
    _DONE.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="loglake-"), "loglake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.dirname(os.path.abspath(loglake.__file__))):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
