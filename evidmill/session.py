"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "evidmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; further settings by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
