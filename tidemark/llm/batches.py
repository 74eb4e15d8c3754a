"""Cutting batches so that long texts do not pile up in a task's memory."""

from __future__ import annotations

from collections.abc import Iterator

CHUNK = 1 << 20  # characters that are worked on together; a longer text is a chunk of its own


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[slice]:
    """Consecutive slices of the texts, of at most ``limit`` characters or one text each."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
