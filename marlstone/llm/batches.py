"""Arrow batches of texts, cut so that a Python worker never holds much text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time in a Python worker.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch again in runs of rows with about ``limit`` bytes in ``column``; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased; none for null.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just that.
    """
    return text.encode().lower().split() if text else []
