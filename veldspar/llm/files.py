"""Files that tasks write to and read from the shared folder, whatever file system it is on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Pending:
    """A file under a temporary name that gets its own name when it is complete. Another attempt writes the same bytes."""

    def __init__(self, folder: str, name: str):
        self.fs, root = store(folder)
        self.name, self.final, self.temporary = name, f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temporary)


def chunks(folder: str, name: str, size: int = 1 << 20) -> Iterator[bytes]:
    own, root = store(folder)
    with own.open_input_stream(f"{root}/{name}", compression=None) as file:
        while data := file.read(size):
            yield data


def whole(folder: str, name: str) -> bytes:
    return b"".join(chunks(folder, name, 1 << 24))
