"""Answers kept on the driver for a while."""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

#: Seconds that answers live, by what they hold.
LIFE = {"query": 30.0, "filter": 60.0, "highlight": 30.0, "tags": 120.0}
#: Most requests of one prewarming.
PREWARM = 50


@dataclass
class AnswerCache:
    """A bounded map with times to live; when full, the answer that would end first goes.

    Keys hold the generation and the digest of the settings, and a generation's snapshot never changes, so writes need no
    fence: after a switch old keys are simply not asked for again.
    """

    most: int = 1000
    clock: Callable[[], float] = time.monotonic
    hits: int = 0
    misses: int = 0
    _answers: dict = field(default_factory=dict)
    _ends: list = field(default_factory=list)

    def get(self, kind: str, generation: object, settings: str, query: str, make: Callable[[], object]) -> object:
        """The kept answer, or the one that ``make`` gives; errors are not kept."""
        key, now = (kind, generation, settings, query), self.clock()
        kept = self._answers.get(key)
        if kept and kept[0] > now:
            self.hits += 1
            return kept[1]
        self.misses += 1
        answer, end = make(), now + LIFE.get(kind, LIFE["query"])
        self._answers[key] = (end, answer)
        heapq.heappush(self._ends, (end, len(self._ends), key))
        while len(self._answers) > self.most:
            end, _, old = heapq.heappop(self._ends)
            if self._answers.get(old, (None,))[0] == end:
                del self._answers[old]
        return answer

    def ratio(self) -> float:
        """Share of answers that were kept ones, 0 before the first."""
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


def prewarm(requests: Iterable, answer: Callable[[object], object]) -> int:
    """Answers the first PREWARM requests; those that fail are passed over. How many succeeded."""
    done = 0
    for r in list(requests)[:PREWARM]:
        try:
            answer(r)
            done += 1
        except Exception:  # noqa: BLE001 (a bad request must not stop the others)
            continue
    return done
