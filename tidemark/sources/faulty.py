"""A source that fails on purpose, to test what runs above it."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class Faulty:
    """Wraps a reader or writer: calls fail at a rate (from a seed), or on stated calls (from 1), after a delay."""

    def __init__(self, call: Callable[..., DataFrame], rate: float = 0.0, on: tuple[int, ...] = (), delay: float = 0.0, seed: int = 0):
        self.call, self.rate, self.on, self.delay = call, rate, frozenset(on), delay
        self.random, self.calls = random.Random(seed), 0

    def __call__(self, *args, **kwargs) -> DataFrame:
        self.calls += 1
        if self.delay:
            time.sleep(self.delay)
        if self.random.random() < self.rate or self.calls in self.on:
            raise OSError(f"injected fault on call {self.calls}")
        return self.call(*args, **kwargs)
