"""Helpers to write Arrow-batched operators without pandas in between."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


#: Bytes of input a worker takes at once, if they are more than one row.
SLICE_BYTES = 16 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches into pieces of at most ``rows`` rows and about ``most`` bytes: bounds what a worker holds at once."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * most / max(1, b.nbytes))))
        for k in range(0, b.num_rows, step):
            piece = b.slice(k, step)
            if piece.num_rows > 1 and piece.nbytes > 2 * most:  # long rows side by side
                yield from slices([piece], max(1, step // 2), most)
            else:
                yield piece


def arrow_map(df, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 500):
    """``df.mapInArrow`` where ``fn`` turns a small batch into a dict of columns.

    Lists are typed by ``schema``; empty batches are skipped.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            out = fn(b)
            if out is None:
                continue
            cols = [
                (x.cast(f.type) if isinstance(x, pa.Array) and x.type != f.type else x) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type)
                for f, x in ((f, out[f.name]) for f in target)
            ]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, schema)
