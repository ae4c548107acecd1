"""What a cluster needs: this package on the executors' Python path, and a folder that all machines share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application; every operator that runs Python there calls this."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenframe_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lumenframe-"), "lumenframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._lumenframe_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``, or else the session's checkpoint folder, which driver and executors share.

    Where neither is set, a local session gets a temporary folder; on a cluster that would lie on one machine, so there it raises.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
