"""Tables that micro-batches append to: a commit log of batches, files merged as they pile up.

The manifest (:mod:`basketlake.sinks.versions`) is the log: a part is named
``<prefix>level=L/batches=FIRST-LAST``. A batch that runs again replaces its own part.
When ``FANOUT`` finished parts of one level and prefix have come together they are
rewritten as one part of the next level, so a row is rewritten once per level, and a
prefix holds fewer than ``FANOUT`` parts of each level plus the newest batch, which is
never merged as it may still run again.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlake.sinks import versions

FANOUT = 64
_PART = re.compile(r"(?P<prefix>.*?)level=(?P<level>\d+)/batches=(?P<first>\d+)-(?P<last>\d+)$")


def _named(prefix: str, level: int, first: int, last: int) -> str:
    return f"{prefix}level={level}/batches={first:012d}-{last:012d}"


def _parts(live: dict[str, str]) -> list[tuple[str, int, int, int, str]]:
    """(prefix, level, first batch, last batch, part), oldest first."""
    found = [(m["prefix"], int(m["level"]), int(m["first"]), int(m["last"]), part) for part in live for m in [_PART.match(part)] if m]
    return sorted(found, key=lambda p: (p[0], p[2], p[3]))


def append_batch(
    rows: DataFrame, batch_id: int, path: str, keys: tuple[str, ...] = (), fanout: int = FANOUT,
) -> None:
    """Make the rows the batch's share of the table, by the partition columns ``keys``."""
    spark = rows.sparkSession
    staged = versions.stage(rows, path, keys=keys)
    own = {part: None for _, level, first, _, part in _parts(versions.live_parts(spark, path)) if level == 0 and first == batch_id}
    fresh = {_named(f"{part}/" if part else "", 0, batch_id, batch_id): folder for part, folder in staged.items()}
    versions.publish(spark, path, {**own, **fresh})
    compact(spark, path, fanout)


def compact(spark: SparkSession, path: str, fanout: int = FANOUT) -> int:
    """Merge parts where ``fanout`` of a level have come together; gives the number of merges."""
    merges = 0
    while True:
        live = versions.live_parts(spark, path)
        parts = _parts(live)
        newest = max((p[3] for p in parts), default=-1)
        groups = defaultdict(list)
        for part in parts:
            if part[3] < newest:
                groups[part[:2]].append(part)
        full = {k: g for k, g in groups.items() if len(g) >= fanout}
        if not full:
            return merges
        if not merges:  # what earlier merges replaced has no reader any more
            versions.vacuum(spark, path)
        changes: dict[str, str | None] = {}
        for (prefix, level), group in full.items():
            rows = versions.read_parts(spark, path, [live[p[4]] for p in group])
            rows = rows.drop(*[k.split("=")[0] for k in prefix.split("/") if k])
            merged = versions.stage(rows.hint("rebalance"), path, prefix.rstrip("/"))[""]
            changes |= {p[4]: None for p in group}
            changes[_named(prefix, level + 1, group[0][2], group[-1][3])] = merged
            merges += 1
        versions.publish(spark, path, changes)


def batch_folders(spark: SparkSession, path: str, before: int | None = None, keep: Callable[[str], bool] | None = None) -> list[str]:
    """Live folders of the batches before one, of the prefixes to keep."""
    live = versions.live_parts(spark, path)
    return [live[p[4]] for p in _parts(live) if (before is None or p[3] < before) and (keep is None or keep(p[0]))]


def own_folders(spark: SparkSession, path: str, batch_id: int) -> list[str]:
    """Live folders of one batch, as long as it is the newest."""
    live = versions.live_parts(spark, path)
    return [live[p[4]] for p in _parts(live) if p[1:4] == (0, batch_id, batch_id)]
