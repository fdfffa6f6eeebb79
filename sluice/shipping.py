"""Send this package to the executors, once for each Spark application."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

_sent: set[str] = set()


def ship(spark) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="sluice-ship-"), "sluice.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)


def shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
