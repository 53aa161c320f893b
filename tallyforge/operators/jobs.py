"""A batch job at a remote service, driven from the driver through a client that the caller brings."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol


class Client(Protocol):
    """What a service must offer: each call takes and gives its own ids."""

    def upload(self, path: str) -> str: ...
    def create(self, file_id: str) -> str: ...
    def status(self, job_id: str) -> str: ...
    def files(self, job_id: str) -> tuple[str | None, str | None]: ...
    def download(self, file_id: str, path: str) -> None: ...


@dataclass(frozen=True)
class Outcome:
    status: str
    output: str | None
    errors: str | None


#: States in which a job has ended.
ENDED = ("completed", "failed", "expired", "cancelled")


def run(client: Client, requests: str, output: str, errors: str, every: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Upload requests, create the job, wait for its end, download results and errors as far as there are any."""
    job = client.create(client.upload(requests))
    while (status := client.status(job)) not in ENDED:
        sleep(every)
    found, failed = client.files(job) if status == "completed" else (None, None)
    for file_id, path in ((found, output), (failed, errors)):
        if file_id:
            client.download(file_id, path)
    return Outcome(status, output if found else None, errors if failed else None)


class Registry:
    """Named builders; an unknown name raises ValueError."""

    def __init__(self, **builders: Callable):
        self.builders = builders

    def build(self, names: list[str], **parameters: object) -> list[object]:
        if unknown := [n for n in names if n not in self.builders]:
            raise ValueError(f"unknown names {unknown}; known are {sorted(self.builders)}")
        return [self.builders[n](**parameters) for n in names]
