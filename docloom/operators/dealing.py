"""Rows dealt to tasks by a key, in numbers that grow with the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task, about: what it sorts stays some hundred megabytes, however many rows there are.
ROWS = 500_000


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` in partitions by ``key``, so that windows and groups over the key, or over more than it, shuffle no more.

    The session's number of partitions is fixed; where each would get more than ``ROWS`` rows, there are more of them.
    """
    wanted = -(-rows.count() // ROWS)
    few = wanted <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(*key) if few else rows.repartition(wanted, *key)
