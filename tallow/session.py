"""Session settings: UTC, AQE with skew-join handling, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "tallow", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def object_store(endpoint: str, key: str, secret: str, ssl: bool = False) -> dict[str, str]:
    """Settings for build_session to read and write an S3-compatible store by path-style addresses (s3a://bucket/...)."""
    names = {"endpoint": endpoint, "access.key": key, "secret.key": secret, "path.style.access": "true", "connection.ssl.enabled": str(ssl).lower()}
    return {f"spark.hadoop.fs.s3a.{k}": v for k, v in names.items()}
