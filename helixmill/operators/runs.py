"""Restartable stages: a table keyed by the fingerprint of inputs and settings, written as an immutable generation behind a pointer."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


def fingerprint(*parts: object) -> str:
    """A hash of settings and input digests, keys sorted."""
    return sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class StaleError(RuntimeError):
    """A document changed since it was read."""


class Registry:
    """Stages under a folder that all executors share. Each has generations gen=<id> and one pointer.json; readers follow the pointer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _read(self, *parts: str) -> dict | None:
        p = self._path(*parts)
        fs = p.getFileSystem(self._conf)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _write(self, document: dict, *parts: str) -> None:
        """The document under a new name, then renamed over the old one in one step: readers see the old or the new one."""
        p = self._path(*parts)
        tmp = self._path(*parts[:-1], f".{uuid.uuid4().hex}")
        fs = p.getFileSystem(self._conf)
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(tmp, p, options)

    def replace(self, document: dict, expected: dict | None, *parts: str) -> None:
        """The document written if the present one is still `expected` (None: there is none); else StaleError. Writers of one
        document must hold its lock file, which only one of them can create."""
        lock = self._path(*parts[:-1], f".{parts[-1]}.lock")
        fs = lock.getFileSystem(self._conf)
        try:
            fs.create(lock, False).close()
        except Exception as e:  # noqa: BLE001 - someone else holds it
            raise StaleError(f"{parts[-1]} is being written") from e
        try:
            if self._read(*parts) != expected:
                raise StaleError(f"{parts[-1]} has changed")
            self._write(document, *parts)
        finally:
            fs.delete(lock, False)

    def current(self, stage: str) -> dict | None:
        return self._read(stage, "pointer.json")

    def is_valid(self, stage: str, key: str) -> bool:
        """Whether the stage's table is of this fingerprint and was written whole."""
        now = self.current(stage)
        if not now or now["fingerprint"] != key:
            return False
        done = self._path(stage, now["generation"], "_SUCCESS")
        return bool(done.getFileSystem(self._conf).exists(done))

    def run(self, stage: str, key: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """The stage's table: read if valid, else built and written as a new generation, to which the pointer moves if nobody else moved
        it meanwhile. The generation before stays for its readers; the one before that is removed."""
        if not force and self.is_valid(stage, key):
            return self.spark.read.parquet(f"{self.root}/{stage}/{self.current(stage)['generation']}")
        old = self.current(stage)
        generation = f"gen={uuid.uuid4().hex}"
        build().write.parquet(f"{self.root}/{stage}/{generation}")
        document = {"stage": stage, "fingerprint": key, "generation": generation, "before": old and old["generation"], "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        self.replace(document, old, stage, "pointer.json")
        if old and old.get("before"):
            p = self._path(stage, old["before"])
            p.getFileSystem(self._conf).delete(p, True)
        return self.spark.read.parquet(f"{self.root}/{stage}/{generation}")
