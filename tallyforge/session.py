"""Sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Errors stay loud (ANSI), times are UTC, plans adapt at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "tallyforge", master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; ``more`` has further settings with ``__`` for dots. Without a master, the deployment's own."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
