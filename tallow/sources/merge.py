"""A partitioned Parquet table with merges that rewrite only the partitions they change.

Every merge writes the changed partitions into a folder of its own and then adds a manifest, which names the folder of each
partition. The manifest appears at once or not at all, so a reader sees the table before or after a merge, and a
frame that was read before keeps its files. Of two writers who start from one version the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallow.sources.stages import remove, stage


class Conflict(Exception):
    """Another writer made the version that this one wanted to make."""


class MergeTable:
    """Rows by unique keys, in partitions by columns that are among the keys or follow from them (as a day from a time)."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], partition: tuple[str, ...]) -> None:
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), keys, partition

    # Files, through Hadoop's interface: any store that Spark reads.

    def _at(self, *names: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *names: str) -> list[str]:
        where, fs = self._at(*names)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _folders(self, *names: str, depth: int | None = None) -> list[str]:
        """Partition folders (a=1/b=2) below a folder."""
        depth = len(self.partition) if depth is None else depth
        inner = [x for x in self._names(*names) if "=" in x]
        return inner if depth == 1 else [f"{x}/{y}" for x in inner for y in self._folders(*names, x, depth=depth - 1)]

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest whole manifest, or that of a version: version, schema (JSON) and the folder of each partition."""
        for n in reversed(self.versions() if version is None else [version]):
            where, fs = self._at("manifests", str(n))
            stream = fs.open(where)
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:  # its writer isn't done
                continue
            finally:
                stream.close()
        return {"version": 0, "schema": None, "parts": {}}

    def _commit(self, manifest: dict) -> None:
        where, fs = self._at("manifests", str(manifest["version"]))
        try:
            out = fs.create(where, False)
        except Exception as e:
            if fs.exists(where):
                raise Conflict(f"version {manifest['version']} is there already") from e
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # Rows

    def _rows(self, manifest: dict, only: set[str] | None = None) -> DataFrame | None:
        chosen = [f"{self.path}/data/{folder}/{part}" for part, folder in manifest["parts"].items() if only is None or part in only]
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*chosen).select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the newest or a given version; a table without one is an error."""
        rows = self._rows(self.manifest(version))
        if rows is None:
            raise FileNotFoundError(f"no version at {self.path}")
        return rows

    def merge(self, rows: DataFrame) -> int:
        """Put each of rows in place of the stored row of its keys, or add it; returns the version, which stays if nothing changes.

        Only the partitions that rows lie in are read, and only those in which a row is new or differs are written. Of
        rows with equal keys the largest by its columns counts. Nulls in keys meet nulls.
        """
        before = self.manifest()
        columns = StructType.fromJson(json.loads(before["schema"])).names if before["schema"] else rows.columns
        schema = rows.select(*columns).schema if not before["schema"] else StructType.fromJson(json.loads(before["schema"]))
        mark = uuid.uuid4().hex
        # What arrives is written by partition first: that names the partitions without collecting a value.
        rows.select(*columns).write.partitionBy(*self.partition).parquet(f"{self.path}/arrived/{mark}")
        try:
            touched = set(self._folders("arrived", mark))
            if not touched:
                return before["version"]
            new = self.spark.read.schema(schema).option("basePath", f"{self.path}/arrived/{mark}").parquet(f"{self.path}/arrived/{mark}").select(*columns)
            old = self._rows(before, touched)
            both = new.withColumn("_new", F.lit(1))
            if old is not None:
                both = both.unionByName(old.withColumn("_new", F.lit(0)))
            rest = F.struct(*[c for c in columns if c not in self.keys] or [F.lit(0).alias("_none")])
            merged = both.groupBy(*self.keys).agg(F.max(F.struct("_new", rest.alias("row"))).alias("_last"), F.max(F.when(F.col("_new") == 0, rest)).alias("_old"))
            merged = merged.withColumn("_changed", (F.col("_last._new") == 1) & ~F.col("_old").eqNullSafe(F.col("_last.row")))
            merged = stage(merged.select(*[F.col(c) if c in self.keys else F.col(f"_last.row.`{c}`").alias(c) for c in columns], "_changed"), "merged")
            changed = merged.where("_changed").select(*self.partition).distinct().withColumnsRenamed({c: f"_of_{c}" for c in self.partition})
            on = F.lit(True)
            for c in self.partition:
                on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
            # At most the touched partitions, a row each: as many as the folders just listed.
            kept = merged.drop("_changed").join(F.broadcast(changed), on, "left_semi")
            folder = f"commit={mark}"
            kept.write.partitionBy(*self.partition).parquet(f"{self.path}/data/{folder}")
            written = self._folders("data", folder)
            if not written:
                return before["version"]
            after = {"version": before["version"] + 1, "schema": schema.json(), "parts": before["parts"] | dict.fromkeys(written, folder)}
            self._commit(after)
            return after["version"]
        finally:
            remove(self.spark, f"{self.path}/arrived/{mark}")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest `keep` versions don't name, and manifests that their writer left half done; returns the number of partition folders deleted. Not while a merge runs."""
        versions = self.versions()
        for v in [v for v in versions if self.manifest(v)["version"] != v]:
            remove(self.spark, f"{self.path}/manifests/{v}")
            versions.remove(v)
        alive = {f"{folder}/{part}" for v in versions[-keep:] for part, folder in self.manifest(v)["parts"].items()}
        gone = 0
        for folder in self._names("data"):
            parts = self._folders("data", folder)
            dead = [p for p in parts if f"{folder}/{p}" not in alive]
            for p in dead:
                remove(self.spark, f"{self.path}/data/{folder}/{p}")
            if len(dead) == len(parts):
                remove(self.spark, f"{self.path}/data/{folder}")
            gone += len(dead)
        for v in versions[:-keep]:
            remove(self.spark, f"{self.path}/manifests/{v}")
        return gone
