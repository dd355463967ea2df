"""What a session needs: the package on its executors, and a folder that all of them share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read and write.

    The session's ``spark.checkpoint.dir`` where it is set. Else, on one machine only, a temporary
    folder of the driver, deleted at exit; on a cluster, a folder beside the tables of the warehouse.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        if sc.applicationId not in _LOCAL_DIRS:
            path = tempfile.mkdtemp(prefix="notelake-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _LOCAL_DIRS[sc.applicationId] = f"file://{path}"
        return _LOCAL_DIRS[sc.applicationId]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def delete_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session or the folder may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete_path, spark, path)
    return path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, as a zip of a few hundred KB.

    Not needed where the package is installed on every node.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="notelake-ship-")), "notelake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("notelake", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
