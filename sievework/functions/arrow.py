"""Arrow batches for helpers inside tasks."""

from __future__ import annotations

from collections.abc import Iterator


def cut(it: Iterator, most: int = 8 << 20) -> Iterator:
    """Batches cut by their bytes, so that a batch of very long texts stays small as Python objects."""
    for b in it:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
