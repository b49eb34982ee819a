"""What a task keeps for a later task: blocks of arrays in the shared folder, and rows dealt back to them.

A task writes a block as one compressed file named by a random number, hands narrow rows with that
number to Spark, and a later task opens the block beside the rows that came back for it. Texts are
then never shuffled.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import ipc

from voxloom.llm.files import opened, written


def new_block() -> int:
    return secrets.randbits(62)


def _uri(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}.block"


def save_block(folder: str, block: int, **arrays: np.ndarray) -> None:
    """Write one-dimensional arrays of any lengths; the file gets its name when it is complete."""
    rows = [pa.array([a.tobytes()], pa.large_binary()) for a in map(np.ascontiguousarray, arrays.values())]
    kinds = {name: a.dtype.str for name, a in arrays.items()}
    table = pa.Table.from_arrays(rows, names=list(arrays)).replace_schema_metadata(kinds)
    with written(_uri(folder, block)) as out:
        with ipc.new_file(out, table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as file:
            file.write_table(table)


def load_block(folder: str, block: int, *names: str) -> list[np.ndarray]:
    """The named arrays of a block; the others are not decoded."""
    with opened(_uri(folder, block)) as source:
        schema = ipc.open_file(source).schema
        picked = [schema.get_field_index(n) for n in names]
        file = ipc.open_file(source, options=ipc.IpcReadOptions(included_fields=sorted(picked)))
        batch = file.get_batch(0)
        kinds = {k.decode(): v.decode() for k, v in schema.metadata.items()}
        return [np.frombuffer(batch.column(n)[0].as_buffer(), dtype=kinds[n]) for n in names]


def by_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that follow each other with the same keys, as one table each."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            values = batch.column(k)
            same = np.array(pc.equal(values[1:], values[:-1]).fill_null(False), dtype=bool)
            new[1:] |= ~same
        edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            own = tuple(batch.column(k)[a].as_py() for k in keys)
            if own != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = own
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
