"""Files below the shared folder, written and read by workers through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file that appears under its name only when complete, so that a task that is run again leaves one file."""

    def __init__(self, uri: str) -> None:
        self.system, self.path = opened(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)  # of an earlier run of the task; some systems refuse to move onto it
        self.system.move(self.temporary, self.path)
