"""Reading texts out of Arrow batches without holding a second copy of the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_ROWS = 128


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each row, a few rows at a time."""
    column = column.cast(pa.binary())
    for at in range(0, len(column), _ROWS):
        yield from column.slice(at, _ROWS).to_pylist()


def tidy() -> None:
    """Give memory that Arrow keeps for later back to the system; workers live on."""
    pa.default_memory_pool().release_unused()
