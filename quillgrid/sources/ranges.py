"""Ranged reads and writes of stored files from inside tasks, for formats Spark has no reader for."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs

#: Bytes of one read when a longer range is streamed.
BLOCK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path inside it.

    Local and mounted folders, HDFS, S3 (also as s3a or s3n) and GCS are known.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")
    if scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    return fs.FileSystem.from_uri(path)


class RangedFile:
    """A stored file of which only the asked ranges are read."""

    def __init__(self, path: str):
        system, inner = located(path)
        self._file = system.open_input_file(inner)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        """At most `length` bytes from `offset`; fewer at the end of the file."""
        if offset < 0 or length < 0:
            raise ValueError("A range starts and ends at or after the start of the file.")
        return self._file.read_at(min(length, max(0, self.size - offset)), offset)

    def stream(self, offset: int, length: int, block: int = BLOCK) -> Iterator[bytes]:
        """The bytes of a range, one block after another."""
        end = min(self.size, offset + length)
        while offset < end:
            data = self.read(offset, min(block, end - offset))
            yield data
            offset += len(data)

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def open_for_writing(path: str):
    """A binary stream that writes a new file, with its folder."""
    system, inner = located(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)
