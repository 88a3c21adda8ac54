"""Files in the shared folder, written and read by tasks as streams."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame


def local_path(uri: str) -> str | None:
    """The path of a folder that every worker has mounted; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri and not re.match(r"\w+:", uri) else None


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str, name: str) -> Iterator:
    """A stream into ``uri``/``name``, renamed once it is whole: a retried task leaves the same file, a failed one none by that name."""
    store, root = store_of(uri)
    store.create_dir(root)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, f"{root}/{name}")


def opened(uri: str):
    store, path = store_of(uri)
    return store.open_input_file(path)


def one_task_each(files: DataFrame, key: str = "path") -> DataFrame:
    """``files`` (one row for each file) dealt so that every task gets one file or so."""
    return files.repartitionByRange(max(files.count(), 1), key)
