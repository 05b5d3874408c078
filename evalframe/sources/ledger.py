"""Attempts and versions: which of several persisted rows counts.

Records, grades and criterion verdicts are append-only: a later pass never rewrites an
earlier one, it adds rows under a higher pass number. A grade belongs to one version of a
record, so a record that changes (a failed call answered by a later run) is graded again,
and only it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fingerprint of what a grade depends on; kept with every grade and verdict
VERSION = "record_version"
#: number of the grading pass that wrote a row
GRADE_PASS = "grade_pass"
#: number of the generation pass that wrote a row
RUN_PASS = "run_pass"

_GRADED_FIELDS = ("prediction", "reference", "evaluation_sample")


def record_version(records: DataFrame) -> Column:
    """Fingerprint of the fields that grading reads; a failed record (null prediction) differs from every answered one."""
    return F.md5(F.to_json(F.struct(*[c for c in _GRADED_FIELDS if c in records.columns])).cast("binary"))


def next_pass(rows: DataFrame | None, column: str) -> int:
    """One more than the highest pass number stored; 1 for a table that is missing, empty or older than pass numbers."""
    if rows is None or column not in rows.columns:
        return 1
    return (rows.agg(F.max(column).alias("n")).first()["n"] or 0) + 1


def newest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the one of greatest ``order``, kept by partial aggregates."""
    kept = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in kept])
