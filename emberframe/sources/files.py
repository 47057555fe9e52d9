"""Files that Python tasks read by ranges and write themselves: local and shared folders, and the stores that pyarrow knows."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.session import portable

portable(__name__)


def local_path(path: str) -> str | None:
    """The path on this machine (or on a mounted share) of a plain path or a file: URI, else None."""
    uri = urlparse(path)
    return path if not uri.scheme else unquote(uri.path) if uri.scheme == "file" else None


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder, or of those a pattern matches, in the order of their names; names with _ or . in front are left out."""
    plain = local_path(path)
    if plain is None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        info = system.get_file_info(inner)
        infos = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
        found = [(f"{path.rstrip('/')}/{i.base_name}" if info.type == fs.FileType.Directory else path, i.size) for i in infos if i.type == fs.FileType.File]
    else:
        names = [os.path.join(plain, n) for n in os.listdir(plain)] if os.path.isdir(plain) else glob.glob(plain)
        found = [(n, os.path.getsize(n)) for n in names if os.path.isfile(n)]
    found = sorted(f for f in found if not os.path.basename(f[0]).startswith(("_", ".")))
    if not found and plain is not None and not os.path.isdir(plain):
        raise FileNotFoundError(path)
    return found


class Ranges:
    """Reads byte ranges of one file."""

    def __init__(self, path: str):
        plain = local_path(path)
        if plain is None:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            self.file = system.open_input_file(inner)
        else:
            self.file = open(plain, "rb")  # noqa: SIM115

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def close(self) -> None:
        self.file.close()


def write_files(files: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files of a shared folder, each from the task that holds it; returns how many.

    A file is written under a name of its own and then renamed, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        plain = local_path(folder)
        system, base = (fs.LocalFileSystem(), plain) if plain is not None else fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{base}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{base}/{name}")
            yield batch.select([0])

    return files.select("name", "content").mapInArrow(run, "name string").count()
