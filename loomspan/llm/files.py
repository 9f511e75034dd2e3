"""Binary files in the cluster's shared folder, written and read inside tasks by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, stem: str, suffix: str) -> tuple[str, object]:
    """(URI, output stream) of a new file; its name is new for every attempt, so a retried task never meets an older one."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str):
    """A seekable file."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
