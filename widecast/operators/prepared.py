"""Tables that several fits of a search share: made once, counted, and given up after their last use."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Lock, RLock
from typing import Any

from pyspark.sql import DataFrame

from widecast.operators.learner import Learner, Model


@dataclass
class Entry:
    lock: Any = field(default_factory=RLock)
    value: Any = None
    made: bool = False
    release: Callable[[Any], None] | None = None


class Preparations:
    """Prepared inputs by (part of the rows, what the learner prepares).

    Learners that differ only in settings that come after preparation have one key. ``expect`` announces
    uses; an input is released after the last one announced. Fits on other threads wait for an input that
    is being made. ``made`` counts how often each was made.
    """

    def __init__(self) -> None:
        self.lock = Lock()
        self.entries: dict[Hashable, Entry] = {}
        self.users: Counter = Counter()
        self.made: Counter = Counter()

    def expect(self, learner: Learner, part: Hashable) -> None:
        if learner.preparation() is not None:
            self.users[part, learner.preparation()] += 1

    @contextmanager
    def using(self, key: Hashable, make: Callable[[], Any], release: Callable[[Any], None]) -> Iterator[Any]:
        with self.lock:
            entry = self.entries.setdefault(key, Entry())
        try:
            with entry.lock:
                if not entry.made:
                    entry.value, entry.made, entry.release = make(), True, release
                    self.made[key] += 1
            yield entry.value
        finally:
            with self.lock:
                self.users[key] -= 1
                last = self.users[key] <= 0 and self.entries.pop(key, None)
            if last and last.made:
                release(last.value)

    def fit(self, learner: Learner, df: DataFrame, part: Hashable) -> Model:
        """``learner.fit(df)``, where ``part`` says which rows ``df`` has."""
        what = learner.preparation()
        if what is None:
            return learner.fit(df)
        with self.using((part, what), lambda: learner.prepare(df), learner.release) as prepared:
            return learner.fit_prepared(prepared)

    def close(self) -> None:
        """Give up what is left, for uses that were announced and never came."""
        with self.lock:
            left, self.entries = list(self.entries.values()), {}
        for entry in left:
            if entry.made:
                entry.release(entry.value)
