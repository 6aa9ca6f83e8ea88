"""A chain of loads that can be resumed: what a step made, from which versions of its inputs, is kept in a manifest."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """A table of the chain: build(spark, tables of `after` by name) gives its rows. A failed build is tried `retries` times more."""

    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    retries: int = 0
    wait_seconds: float = 0.0


class StepFailed(Exception):
    """A step failed as often as it was tried; those done before it stay done."""


def input_version(spark: SparkSession, path: str) -> str:
    """A name for what lies at a path now: changes with any file's name, size or time."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files, seen = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


class Run:
    """Steps over a folder: tables lie in its folders, the manifest in run-<n>.json, the newest of which counts."""

    def __init__(self, spark: SparkSession, path: str, steps: list[Step]) -> None:
        known: set[str] = set()
        for s in steps:
            if missing := set(s.after) - known:
                raise ValueError(f"{s.name} comes before {sorted(missing)}")
            known.add(s.name)
        self.spark, self.path, self.steps = spark, path.rstrip("/"), steps

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        where, fs = self._fs()
        if not fs.exists(where):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(where)]
        return sorted(int(n[4:-5]) for n in names if n.startswith("run-") and n.endswith(".json"))

    def manifest(self) -> dict[str, dict]:
        """By step: version of its inputs, outcome (done or failed), table, attempts, seconds, error."""
        for n in reversed(self._manifests()):
            stream = self._fs()[1].open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-{n}.json"))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                continue
            finally:
                stream.close()
        return {}

    def _save(self, state: dict[str, dict]) -> None:
        n = (self._manifests() or [0])[-1] + 1
        out = self._fs()[1].create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-{n}.json"), False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def run(self, inputs: dict[str, str] | None = None, force: bool = False) -> list[str]:
        """Run what isn't done from these versions of the inputs, in order; returns the names of the steps that ran.

        A step runs again if an input or a table before it has another version, or if `force` is set. The manifest is saved after every step.
        """
        state, ran, versions = ({} if force else self.manifest()), [], {}
        for s in self.steps:
            told = json.dumps([s.name, sorted((inputs or {}).items()), [versions[a] for a in s.after]])
            want = hashlib.sha256(told.encode()).hexdigest()[:16]
            old = state.get(s.name, {})
            if old.get("outcome") != "done" or old.get("inputs") != want:
                state[s.name] = self._attempt(s, want, state)
                self._save(state)
                ran.append(s.name)
                if state[s.name]["outcome"] == "failed":
                    raise StepFailed(f"{s.name}: {state[s.name]['error']}")
            versions[s.name] = state[s.name]["table"]
        return ran

    def _attempt(self, s: Step, inputs: str, state: dict[str, dict]) -> dict:
        began, error = time.time(), ""
        for attempt in range(1, s.retries + 2):
            table = f"{self.path}/{s.name}-{uuid.uuid4().hex}"
            try:
                s.build(self.spark, {a: self.spark.read.parquet(state[a]["table"]) for a in s.after}).write.parquet(table)
                return {"inputs": inputs, "outcome": "done", "table": table, "attempts": attempt, "seconds": round(time.time() - began, 3)}
            except Exception as e:  # any fault of a step is its outcome
                error = f"{type(e).__name__}: {e}"[:500]
                if attempt <= s.retries:
                    time.sleep(s.wait_seconds)
        return {"inputs": inputs, "outcome": "failed", "attempts": s.retries + 1, "seconds": round(time.time() - began, 3), "error": error}

    def table(self, name: str) -> DataFrame:
        """A finished step's table."""
        return self.spark.read.parquet(self.manifest()[name]["table"])
