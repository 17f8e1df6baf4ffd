"""A bounded cache of results that evicts what was used least, and of those the oldest."""

from __future__ import annotations

from threading import Lock
from typing import Any


class Cache:
    """A get raises an entry's use by one, and so does putting a key again; a full cache drops the entry of least use, ties to the oldest put."""

    def __init__(self, capacity: int = 1000):
        self.capacity = capacity
        self.hits = self.misses = 0
        self._entries: dict[Any, list] = {}  # key -> [value, uses, turn]
        self._turn = 0
        self._lock = Lock()

    def __len__(self) -> int:
        return len(self._entries)

    def __contains__(self, key: Any) -> bool:
        return key in self._entries

    def get(self, key: Any, default: Any = None) -> Any:
        with self._lock:
            entry = self._entries.get(key)
            if entry is None:
                self.misses += 1
                return default
            self.hits += 1
            entry[1] += 1
            return entry[0]

    def put(self, key: Any, value: Any) -> None:
        with self._lock:
            if self.capacity <= 0:
                return
            entry = self._entries.get(key)
            if entry is not None:
                entry[0] = value
                entry[1] += 1
                return
            if len(self._entries) >= self.capacity:
                del self._entries[min(self._entries, key=lambda k: self._entries[k][1:])]
            self._turn += 1
            self._entries[key] = [value, 1, self._turn]

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()
