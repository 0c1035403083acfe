"""The state of a job, kept in a JSON file."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class State:
    job_id: str = ""
    status: str = "idle"
    phase: str = ""
    project: str = ""
    total_files: int = 0
    done_files: int = 0
    total_chunks: int = 0
    done_chunks: int = 0
    started_at: float = 0.0
    updated_at: float = 0.0
    error: str = ""

    def eta(self, now: float) -> int:
        """Whole seconds left at the rate so far; 0 unless running with something, but not all, done."""
        if self.status != "running" or not 0 < self.done_chunks < self.total_chunks or now <= self.started_at:
            return 0
        return int((self.total_chunks - self.done_chunks) / (self.done_chunks / (now - self.started_at)))


class Progress:
    """Changes a job's state and saves each change; a state that is not there yet is idle."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> State:
        try:
            with open(self.path, encoding="utf-8") as f:
                return State(**json.load(f))
        except FileNotFoundError:
            return State()

    def _save(self, state: State) -> State:
        state = replace(state, updated_at=time.time())
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(asdict(state), f)
        os.replace(self.path + ".tmp", self.path)
        return state

    def start(self, prefix: str, project: str = "", total_files: int = 0) -> State:
        return self._save(State(f"{prefix}-{time.time_ns()}", "running", project=project, total_files=total_files, started_at=time.time()))

    def update(self, **changes) -> State:
        return self._save(replace(self.load(), **changes))

    def done(self, **changes) -> State:
        return self.update(status="done", phase="", **changes)

    def fail(self, error: Exception) -> State:
        return self.update(status="error", error=str(error)[:1000])
