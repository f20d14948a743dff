"""Runs the jobs of a matrix: each once, a few at a time, whoever else runs them too.

A ledger folder holds a marker for each job: claimed, done or failed. A claim is the creation of a file that mustn't exist, which the file system grants to one runner only. Jobs are Spark
work; each runs in a scheduler pool of its own, so that a long one doesn't hold up the others.
"""

from __future__ import annotations

import hashlib
import json
import time
import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

_STATES = "job string, state string, seconds double, error string"


class Ledger:
    """Markers of jobs in a folder that all runners see."""

    def __init__(self, spark: SparkSession, folder: str):
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.folder = folder.rstrip("/")
        root = self._fs_path(self.folder)
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(root)
        self.spark = spark

    def _path(self, job: str, state: str):
        return self._fs_path(f"{self.folder}/{hashlib.sha256(job.encode()).hexdigest()[:32]}.{state}")

    def has(self, job: str, state: str) -> bool:
        return self.fs.exists(self._path(job, state))

    def _write(self, job: str, state: str, **what) -> None:
        out = self.fs.create(self._path(job, state), True)
        out.write(bytearray(json.dumps({"job": job, "state": state} | what).encode()))
        out.close()

    def claim(self, job: str, force: bool = False, stale: float | None = None) -> bool:
        """Whether the job is this runner's now. Done jobs aren't, but for ``force``; a claim older than ``stale`` seconds is one of a runner that died."""
        if self.has(job, "done") and not force:
            return False
        path = self._path(job, "claimed")
        if stale is not None and self.fs.exists(path):
            age = time.time() - self.fs.getFileStatus(path).getModificationTime() / 1000
            if age > stale:
                self.fs.delete(path, False)
        if not self._created(path):
            return False
        if self.has(job, "done") and not force:  # done between the two looks
            self.release(job)
            return False
        return True

    def _created(self, path) -> bool:
        from py4j.protocol import Py4JJavaError

        local = path.toUri().getScheme() in (None, "file") and self.fs.getUri().getScheme() == "file"
        if local:  # the local file system's own exclusive creation: Hadoop's looks first and creates then
            import os

            try:
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self.fs.create(path, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def release(self, job: str) -> None:
        self.fs.delete(self._path(job, "claimed"), False)

    def finish(self, job: str, seconds: float, error: str | None = None) -> None:
        if error is None:
            self._write(job, "done", seconds=seconds)
            self.fs.delete(self._path(job, "failed"), False)
        else:
            self._write(job, "failed", seconds=seconds, error=error)
        self.release(job)

    def states(self) -> DataFrame:
        """job, state (done or failed), seconds, error of all jobs that have ended."""
        done = [s.getPath().toString() for s in self.fs.listStatus(self._fs_path(self.folder)) if s.getPath().getName().endswith((".done", ".failed"))]  # a marker for each job
        return self.spark.read.schema(_STATES).json(done) if done else self.spark.createDataFrame([], _STATES)


def run_jobs(spark: SparkSession, jobs: list[str], run: Callable[[str], object], folder: str, at_once: int = 4, force: bool = False, stale: float | None = None, attempts: int = 1) -> dict[str, str]:
    """What became of each job: done, failed, or skipped (done before, or another runner's).

    ``run(job)`` does a job; what it raises is kept in the ledger, and the job is taken up again by the next call (or up to ``attempts`` times by this one). ``jobs`` are names, a matrix's rows.
    """
    ledger = Ledger(spark, folder)

    def one(job: str) -> str:
        for k in range(attempts):
            if not ledger.claim(job, force, stale):
                return "skipped"
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", hashlib.sha256(job.encode()).hexdigest()[:16])
            began = time.time()
            try:
                run(job)
            except Exception:  # whatever a job raises is its own failure, not the others'
                ledger.finish(job, time.time() - began, traceback.format_exc(limit=3)[-2000:])
                continue
            ledger.finish(job, time.time() - began)
            return "done"
        return "failed"

    out: dict[str, str] = {}
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        def started(job):
            def go():
                out[job] = one(job)

            t = InheritableThread(target=go)  # its own local properties in the engine
            t.start()
            t.join()

        list(pool.map(started, dict.fromkeys(jobs)))
    return out
