"""Plans of pairs: which records of which files a task reads side by side, from the records of each split."""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from ..sources.fastq import sized
from ..sources.pairs import PairSource
from .reads import judged


def anchors(summary: DataFrame, files: list[str]) -> list[tuple[list[tuple[int, int | None, int]], int | None, bool]]:
    """For each file its splits that have records as (number of the first record, its offset, decoded bytes before what offsets count from), its records, None if it is one split, and whether the
    last of them is malformed.

    A row a split comes to the driver, which holds the splits themselves as well. Splits after the first that ends in an error are left out.
    """
    out: list = [([(1, None, 0)], None, False) for _ in files]
    rows = summary.select("file_no", "split_id", "records", "bytes", "failed", "start").orderBy("file_no", "split_id").collect()
    now, number, before, failed = None, 1, 0, False
    for r in rows:
        if r.file_no != now:
            now, number, before, failed = r.file_no, 1, 0, False
            out[now] = ([], 0, False)
        if failed:
            continue
        if r.start is not None or r.split_id == 0:
            out[now][0].append((number, r.start if r.split_id else None, before if r.split_id else 0))
        number, before, failed = number + r.records, before + r.bytes, r.failed
        out[now] = (out[now][0], number - 1, failed)
    return out


def zipped_plan(first: list, second: list, files: tuple[list[str], list[str]], every: int = 1) -> list:
    """Ranges of records by the splits of the first mate, and by those of the second beyond its end, so many splits a range."""
    plan = []
    for no in range(max(len(first), len(second))):
        sides = [s[no] if no < len(s) else None for s in (first, second)]
        names = [f[no] if no < len(f) else None for f in files]
        if None in sides or any(total is None for _, total, _ in sides):
            plan.append((no, 1, None, (names[0],), (names[1],)))  # a file that is one split is read from its start
            continue
        total, last = sides[0][1], min((n for _, n, failed in sides if failed), default=None)
        starts = sorted({*[a for a, *_ in sides[0][0]][::every], *[a for a, *_ in sides[1][0] if a > total][::every]})
        for k, start in enumerate(starts):
            if last is not None and start > last:
                break  # a malformed read is the last of its pair of files
            count = starts[k + 1] - start if k + 1 < len(starts) else None
            both = []
            for (marks, n, _), name in zip(sides, names, strict=True):
                at = bisect_right([a for a, *_ in marks], start) - 1
                both.append((name, *marks[at]) if start <= n else (None,))
            plan.append((no, start, count, *both))
    return plan


def folded_plan(marks: list, files: list[str], every: int = 1) -> list:
    """Ranges of one file that start at odd records, so many splits a range."""
    plan = []
    for no, (found, *_) in enumerate(marks):
        starts = sorted({a + (a % 2 == 0) for a, *_ in found[::every]})
        for k, start in enumerate(starts):
            at = bisect_right([a for a, *_ in found], start) - 1
            plan.append((no, start, starts[k + 1] - start if k + 1 < len(starts) else None, (files[no], *found[at]), None))
    return plan


def loaded(spark: SparkSession, plan: list, options: dict, check_ids: bool) -> DataFrame:
    spark.dataSource.register(PairSource)
    return judged(spark.read.format("fastq_pairs").options(**options, plan=json.dumps(plan)).load(), check_ids)


def files_of(path: str) -> list[str]:
    return [f for f, _ in sized(path)]
