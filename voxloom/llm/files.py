"""Files of own formats in the folder that all machines share, opened inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator:
    """An output stream; the file gets its name only when all of it is there, so a lost task leaves no half file."""
    store, path = _at(uri)
    folder = path.rsplit("/", 1)[0]
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)


def opened(uri: str):
    """A random access file."""
    store, path = _at(uri)
    return store.open_input_file(path)
