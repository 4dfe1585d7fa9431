"""Calls to outside services from a pipeline: batched, retried, with a circuit breaker and a fallback."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Retries with doubling, jittered pauses; the breaker opens after so many failed batches in a row and lets a trial through after a pause."""

    retries: int = 3
    base_seconds: float = 0.1
    most_seconds: float = 30.0
    jitter: float = 0.1
    failures_to_open: int = 5
    open_seconds: float = 30.0


class Breaker:
    """closed, open or half open; one for each Python worker, since a worker is what makes calls."""

    def __init__(self, policy: Policy, clock: Callable[[], float] = time.monotonic):
        self.policy, self.clock, self.failed, self.opened = policy, clock, 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half open" if self.clock() - self.opened >= self.policy.open_seconds else "open"

    def record(self, ok: bool) -> None:
        if ok:
            self.failed, self.opened = 0, None
            return
        self.failed += 1
        if self.state == "half open" or self.failed >= self.policy.failures_to_open:
            self.opened = self.clock()


def guarded(call: Callable[[pd.Series], pd.Series], policy: Policy, breaker: Breaker, pause: Callable[[float], None] = time.sleep) -> Callable[[pd.Series], pd.Series | None]:
    """The call with retries behind the breaker; None if it could not be made."""

    def run(batch: pd.Series) -> pd.Series | None:
        if breaker.state == "open":
            return None
        wait = policy.base_seconds
        for attempt in range(policy.retries + 1):
            try:
                got = call(batch)
                breaker.record(True)
                return got
            except Exception:  # any failure of a service is a reason to retry
                if attempt < policy.retries:
                    pause(min(wait, policy.most_seconds) * (1 + random.uniform(-policy.jitter, policy.jitter)))
                    wait *= 2
        breaker.record(False)
        return None

    return run


def service(call: Callable[[pd.Series], pd.Series], result: str, policy: Policy = Policy(), fallback: object = None) -> Callable[[Column], Column]:
    """A column function that calls the service batch by batch; a batch that fails for good has the fallback."""
    made: dict[str, Breaker] = {}

    @F.pandas_udf(result)
    def batch(values: pd.Series) -> pd.Series:
        breaker = made.setdefault("breaker", Breaker(policy))
        got = guarded(call, policy, breaker)(values)
        return got if got is not None else pd.Series([fallback] * len(values))

    return batch
