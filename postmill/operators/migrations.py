"""Numbered, reversible changes of a store's layout: each is done wholly or not at all, in order, and a newer store is refused.

The version stands in a manifest of the store's folder. A step gets the session and the store's path and writes new tables beside the
old ones; the manifest's next number makes it count, so a step that fails leaves the store at the version before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from postmill.session import list_files, read_text, write_new

Step = Callable[[SparkSession, str], None]


@dataclass(frozen=True)
class Migration:
    """One version's way up from the one before, and down again."""

    version: int
    up: Step
    down: Step


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of the last manifest and the version it names; 0 and 0 for a new store."""
    numbers = [int(m.group(1)) for f in list_files(spark, f"{path}/version") if (m := re.search(r"/v(\d+)\.json$", f))]
    last = max(numbers, default=0)
    return last, json.loads(read_text(spark, f"{path}/version/v{last}.json"))["version"] if last else 0


def version(spark: SparkSession, path: str) -> int:
    return _state(spark, path.rstrip("/"))[1]


def migrate(spark: SparkSession, path: str, migrations: Sequence[Migration], target: int | None = None) -> int:
    """Take the store up, or down, to ``target`` (the newest known if none); returns its version."""
    path, known = path.rstrip("/"), sorted(migrations, key=lambda m: m.version)
    if [m.version for m in known] != list(range(1, len(known) + 1)):
        raise ValueError("migrations must be numbered from 1 without gaps")
    number, now = _state(spark, path)
    if now > len(known):
        raise RuntimeError(f"the store has version {now}, newer than {len(known)}")
    goal = len(known) if target is None else target
    if not 0 <= goal <= len(known):
        raise ValueError(f"no version {goal}")
    while now != goal:
        (known[now].up if goal > now else known[now - 1].down)(spark, path)
        now += 1 if goal > now else -1
        number += 1
        write_new(spark, f"{path}/version/v{number}.json", json.dumps({"version": now}))
    return now
