"""Batch sizes of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Shares of a device's memory in use above which a batch has so many rows, those of an idle device, and those without a device.
STEPS = ((0.85, 2), (0.7, 4), (0.5, 8))
IDLE, NO_DEVICE = 12, 4


def batch_rows(requested: Column, used: Column) -> Column:
    """Rows of a batch by the share of a device's memory that is in use; null where there is no device."""
    most = F.when(used.isNull(), NO_DEVICE)
    for share, rows in STEPS:
        most = most.when(used > share, rows)
    return F.least(requested, most.otherwise(IDLE))


def batch_size(requested: int, used: float | None) -> int:
    """`batch_rows` of one device, as a worker asks it; one row at least."""
    most = NO_DEVICE if used is None else next((rows for share, rows in STEPS if used > share), IDLE)
    return max(1, min(requested, most))
