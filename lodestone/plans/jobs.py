"""Named jobs in JSON files, and a queue that runs them by priority."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession

#: Smaller runs first.
PRIORITIES = {"high": 0, "medium": 1, "low": 2}


class JobStore:
    """One JSON file for each job."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, name: str) -> str:
        if not name or os.sep in name or name.startswith("."):
            raise ValueError(f"not a job name: {name!r}")
        return os.path.join(self.folder, f"{name}.json")

    def save(self, name: str, config: Mapping[str, Any], description: str = "") -> dict:
        job = {"name": name, "description": description, "config": dict(config), "modified": time.time()}
        part = self._path(name) + ".part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(job, f, indent=2)
        os.replace(part, self._path(name))
        return job

    def get(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        with open(self._path(name), encoding="utf-8") as f:
            return json.load(f)

    def exists(self, name: str) -> bool:
        return os.path.exists(self._path(name))

    def delete(self, name: str) -> bool:
        found = self.exists(name)
        if found:
            os.remove(self._path(name))
        return found

    def list(self) -> list[dict]:
        """All jobs, the last modified first."""
        names = [f[:-5] for f in os.listdir(self.folder) if f.endswith(".json")]
        return sorted((self.get(n) for n in names), key=lambda j: -j["modified"])


class JobQueue:
    """Jobs by priority, then by time; workers are threads that submit Spark jobs.

    With ``state`` the queue outlives the process: what waited waits again, what
    ran is marked as failed.  With ``spark`` the Spark jobs of a running job form
    the group of its id, by which ``cancel`` interrupts them and those to come.
    """

    def __init__(self, run: Callable[[dict], Any], workers: int = 2, state: str | None = None, spark: SparkSession | None = None):
        self.run, self.state, self.spark = run, state, spark
        self.jobs: dict[str, dict] = {}
        self.lock = threading.Condition()
        self.open = True
        if state and os.path.exists(state):
            with open(state, encoding="utf-8") as f:
                self.jobs = json.load(f)
            for j in self.jobs.values():
                if j["status"] == "running":
                    j.update(status="failed", error="the process ended while the job ran")
        self.threads = [threading.Thread(target=self._work, daemon=True) for _ in range(workers)]
        for t in self.threads:
            t.start()

    def _keep(self) -> None:
        if self.state:
            with open(self.state + ".part", "w", encoding="utf-8") as f:
                json.dump(self.jobs, f)
            os.replace(self.state + ".part", self.state)

    def enqueue(self, name: str, config: Mapping, priority: str = "medium") -> str:
        if priority not in PRIORITIES:
            raise ValueError(f"priority must be one of {', '.join(PRIORITIES)}")
        with self.lock:
            key = uuid.uuid4().hex
            self.jobs[key] = {"id": key, "name": name, "config": dict(config), "priority": priority, "at": time.time(), "number": len(self.jobs), "status": "queued", "error": None}
            self._keep()
            self.lock.notify()
        return key

    def waiting(self) -> list[dict]:
        """Queued jobs in the order in which they will run."""
        with self.lock:
            return sorted((j for j in self.jobs.values() if j["status"] == "queued"), key=lambda j: (PRIORITIES[j["priority"]], j["at"], j["number"]))

    def position(self, key: str) -> int | None:
        return next((i for i, j in enumerate(self.waiting(), 1) if j["id"] == key), None)

    def active(self) -> list[dict]:
        with self.lock:
            return [j for j in self.jobs.values() if j["status"] == "running"]

    def status(self, key: str) -> dict | None:
        with self.lock:
            return dict(self.jobs[key]) if key in self.jobs else None

    def cancel(self, key: str) -> bool:
        """Cancel a queued job, or stop a running one: its Spark jobs are interrupted if the queue knows the session."""
        with self.lock:
            job = self.jobs.get(key)
            if not job or job["status"] not in ("queued", "running"):
                return False
            waits = job["status"] == "queued"
            job["status"] = "cancelled" if waits else "stopping"
            self._keep()
        if self.spark and not waits:
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(key)
        return True

    def is_cancelled(self, key: str) -> bool:
        return (self.status(key) or {}).get("status") in ("cancelled", "stopping")

    def clear_history(self, seconds: float) -> int:
        """Forget jobs that ended and are older than that; how many they were."""
        with self.lock:
            old = [k for k, j in self.jobs.items() if j["status"] not in ("queued", "running", "stopping") and j["at"] < time.time() - seconds]
            for k in old:
                del self.jobs[k]
            self._keep()
            return len(old)

    def _work(self) -> None:
        while True:
            with self.lock:
                while self.open and not self.waiting():
                    self.lock.wait(0.5)
                if not self.open:
                    return
                job = self.jobs[self.waiting()[0]["id"]]
                job["status"] = "running"
                self._keep()
            try:
                if self.spark:
                    self.spark.sparkContext.setJobGroup(job["id"], job["name"], interruptOnCancel=True)
                self.run(job)
                end = {"status": "completed", "error": None}
            except Exception as e:  # noqa: BLE001  a job's failure is its own
                end = {"status": "failed", "error": str(e)}
            if job["status"] == "stopping":
                end = {"status": "cancelled", "error": None}
            with self.lock:
                job.update(end)
                self._keep()

    def stop(self) -> None:
        with self.lock:
            self.open = False
            self.lock.notify_all()
        for t in self.threads:
            t.join(timeout=5)
