"""Jobs of a driver: one at a time, with events, pause and cancel."""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from corpusloom.streaming.events import RING

Work = Callable[[Callable[[str, dict], None], Callable[[], bool]], Any]


class EventLog:
    """Numbered events of which the last RING are held; a reader's cursor tells whether it missed some."""

    def __init__(self, ring: int = RING):
        self._held: deque[tuple[int, str, str, dict]] = deque(maxlen=ring)
        self._last = 0
        self._lock = threading.Lock()

    def emit(self, job: str, kind: str, payload: dict) -> None:
        with self._lock:
            self._last += 1
            self._held.append((self._last, job, kind, payload))

    def since(self, cursor: int) -> tuple[list[tuple[int, str, str, dict]], int, bool]:
        """(events after the cursor, new cursor, whether events between were lost)."""
        with self._lock:
            found = [e for e in self._held if e[0] > cursor]
            lost = bool(self._held) and self._held[0][0] > cursor + 1 and cursor < self._last
            return found, self._last if found else cursor, lost


@dataclass
class Job:
    id: str
    pausable: bool
    status: str = "queued"
    result: Any = None
    error: str | None = None
    asked: threading.Event = field(default_factory=threading.Event)
    ended: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """Runs one job at a time in a thread of the driver; Spark jobs of a running one can be interrupted by its tag.

    A job is given emit(kind, payload) and stop(), which it asks at safe places. Whether a pausable job stopped early is for
    the job to say (a result dict with cancelled: True); others count as cancelled if they were asked to stop.
    """

    def __init__(self, spark: SparkSession | None = None, log: EventLog | None = None):
        self.spark, self.log = spark, log or EventLog()
        self._pool = ThreadPoolExecutor(max_workers=1, thread_name_prefix="corpusloom-job")
        self._jobs: dict[str, Job] = {}

    def submit(self, work: Work, pausable: bool = False) -> str:
        job = Job(uuid.uuid4().hex[:12], pausable)
        self._jobs[job.id] = job
        self._pool.submit(self._run, job, work)
        return job.id

    def _run(self, job: Job, work: Work) -> None:
        emit = lambda kind, payload: self.log.emit(job.id, kind, payload)
        if job.asked.is_set():
            job.status = "cancelled"
            emit("cancelled", {})
            job.ended.set()
            return
        job.status = "running"
        emit("started", {})
        if self.spark is not None:
            self.spark.addTag(f"job-{job.id}")
        try:
            result = work(emit, job.asked.is_set)
            early = result.get("cancelled") is True if isinstance(result, dict) else False
            job.result = {k: v for k, v in result.items() if k != "cancelled"} if early else result
            if job.pausable:
                job.status = "paused" if early else "done"
            else:
                job.status = "cancelled" if job.asked.is_set() else "done"
            emit(job.status, {"result": str(job.result)})
        except Exception as e:  # a job's failure is its own; the next one runs
            job.status, job.error = ("cancelled", None) if job.asked.is_set() and not job.pausable else ("failed", str(e))
            emit(job.status, {"error": str(e)})
        finally:
            if self.spark is not None:
                self.spark.removeTag(f"job-{job.id}")
            job.ended.set()

    def stop(self, job_id: str, interrupt: bool = False) -> None:
        """Ask a job to stop at its next safe place; interrupt ends its Spark jobs too."""
        self._jobs[job_id].asked.set()
        if interrupt and self.spark is not None:
            self.spark.interruptTag(f"job-{job_id}")

    def get(self, job_id: str) -> Job:
        return self._jobs[job_id]

    def wait(self, job_id: str, seconds: float | None = None) -> Job:
        self._jobs[job_id].ended.wait(seconds)
        return self._jobs[job_id]

    def close(self) -> None:
        for job in self._jobs.values():
            job.asked.set()
        self._pool.shutdown(wait=True)
