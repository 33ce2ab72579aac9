"""Spark session and the helpers that every operator may use."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its measured rows times their width stay below this.
BROADCAST_BYTES = 8 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(app: str = "tesserae", **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; conf overrides, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder of ``spark.checkpoint.dir`` and cut its lineage there.

    Where no folder is named, a local session gets one; a cluster, whose machines
    share no temporary folder, must name it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a materialised side for broadcast if it is measured to be small; otherwise Spark chooses."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def inline(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few rows as a table of the plan itself, so that no task and no Python worker makes them; names: "a string, b long"."""
    if not rows:
        return spark.createDataFrame([], names)
    literal = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = [n.split() for n in names.split(", ")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(n for n, _ in columns)})")
