"""Files that tasks write to the shared folder and other tasks read."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


@contextmanager
def new_file(folder: str, suffix: str):
    """Opens a file with a name of its own in ``folder`` (uri, stream). A task that is run again writes another
    file; only the manifest row of the attempt that Spark commits leads to one."""
    fs, path = at(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield f"{folder}/{name}", out


def open_file(uri: str):
    """A random-access binary file."""
    fs, path = at(uri)
    return fs.open_input_file(path)
