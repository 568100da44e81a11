"""Alphanumeric words of whole texts as bytes, and text batches in bounded slices (inside tasks).

A word is a maximal run of ASCII letters and digits and of all characters beyond ASCII; A-Z become a-z.
In UTF-8 these are exactly the runs of letter, digit and high bytes, so one byte table does it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20   # text bytes that become Python objects at once (one longer text makes a slice of its own)

_keep = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
TABLE = bytes(ord(chr(b).lower()) if b < 0x80 and b in _keep else b if b in _keep else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text in order; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def slices(batches: Iterator[pa.RecordBatch], text: str = "_x_text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_BYTES`` of text each."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(size):
            if held + n > SLICE_BYTES and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)
