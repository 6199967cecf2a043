"""Batches that Python hands on, bounded by their bytes: rows of an Arrow batch are counted by Spark, their sizes aren't."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Bytes of a batch that is handed on, beside the last value.
BATCH_BYTES = 8 << 20


def by_bytes(values: Iterable[bytes | None], most: int = BATCH_BYTES) -> Iterator[pd.Series]:
    """``values`` in their order, one series after another, each ended by the value that brings it to ``most`` bytes."""
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value or b"")
        if size >= most:
            yield pd.Series(held, dtype=object)
            held, size = [], 0
    if held:
        yield pd.Series(held, dtype=object)
