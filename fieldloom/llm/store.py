"""Files of a shared folder as Python tasks see them: whole files, written under another name and moved."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def write(uri: str, name: str, data: bytes) -> None:
    """Readers see all of ``data`` or none; a task that runs again writes the same file again."""
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")


def read(uri: str, name: str) -> bytes | None:
    system, path = opened(uri)
    if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{path}/{name}") as f:
        return f.read()
