"""plumbline: analytics over database code estates, as DataFrame queries."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("plumbline", os.path.relpath(full, root)))
    sc.addPyFile(at)
    sc._plumbline_shipped = True
