"""Stored versions of a table under a recipe: undo, redo and a changed last step start from what is there.

A version is the table after a prefix of the steps, written to the shared folder under a hash of that prefix and
of the original. To get a version, the longest stored prefix is read and only the steps after it are
carried out. Versions in use are counted; of the others, those least recently used are removed once
there are more than `keep`.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.rowid import ROW_ID
from ..session import new_path, remove
from .recipe import Step, apply_recipe


@dataclass
class _Version:
    path: str
    schema: object
    used: int = 0


def prefix_key(steps: list[Step]) -> str:
    """The same for steps that do the same, whatever they are called and counted."""
    said = []
    for s in steps:
        if any(isinstance(v, DataFrame) for v in s.config.values()):
            raise ValueError("a step that holds a table has no stored version; give its row ids as a list")
        said.append([s.type, s.column, s.config])
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


class VersionStore:
    """The versions of one original. Not shared between applications."""

    def __init__(self, original: DataFrame, row_id: str = ROW_ID, keep: int = 8):
        self.original, self.row_id, self.keep = original, row_id, keep
        self._stored: OrderedDict[str, _Version] = OrderedDict()  # least recently used first
        self.steps_run = 0

    def __enter__(self) -> VersionStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def acquire(self, steps: list[Step]) -> DataFrame:
        """The table after `steps`, which stays stored until it is released as often."""
        if not steps:
            return self.original
        key = prefix_key(steps)
        if key not in self._stored:
            done = next((n for n in range(len(steps) - 1, 0, -1) if prefix_key(steps[:n]) in self._stored), 0)
            start = self._read(prefix_key(steps[:done])) if done else self.original
            after = apply_recipe(start, steps[done:], self.row_id)
            path = new_path(self.original.sparkSession, "stored-version")
            after.write.parquet(path)
            self.steps_run += len(steps) - done
            self._stored[key] = _Version(path, after.schema)
        self._stored[key].used += 1
        df = self._read(key)
        self._evict()
        return df

    def release(self, steps: list[Step]) -> None:
        version = self._stored.get(prefix_key(steps)) if steps else None
        if version is not None and version.used:
            version.used -= 1
        self._evict()

    def close(self) -> None:
        """Remove every version, used or not: for the end of a session."""
        for key in list(self._stored):
            self._drop(key)

    def paths(self) -> list[str]:
        return [v.path for v in self._stored.values()]

    def _read(self, key: str) -> DataFrame:
        self._stored.move_to_end(key)
        version = self._stored[key]
        return self.original.sparkSession.read.schema(version.schema).parquet(version.path)

    def _evict(self) -> None:
        for key in [k for k, v in self._stored.items() if not v.used][: max(0, len(self._stored) - self.keep)]:
            self._drop(key)

    def _drop(self, key: str) -> None:
        remove(self.original.sparkSession, self._stored.pop(key).path)
