"""File access from inside tasks for plain paths and URIs (file://, hdfs://,
s3://, ...) through ``pyarrow.fs``, so the Python-side readers and writers
work on the shared storage a cluster uses, not only on a local disk."""

from __future__ import annotations

import pyarrow.fs as pafs


def resolve(path: str):
    """(filesystem, path inside it) for a plain path or a URI."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def exists(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def is_file(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type == pafs.FileType.File


def size(path: str) -> int:
    fs, p = resolve(path)
    return fs.get_file_info(p).size


def list_sizes(path: str) -> list[tuple[str, int]]:
    """(full path, bytes) of the files directly under a folder, URI scheme kept, in name order; a file is itself."""
    fs, p = resolve(path)
    if is_file(path):
        return [(path, size(path))]
    infos = fs.get_file_info(pafs.FileSelector(p, recursive=False))
    prefix = path[: len(path) - len(p)] if "://" in path and path.endswith(p) else ""
    return sorted((prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File)


def list_files(path: str) -> list[str]:
    """Files directly under a folder, full paths (URI scheme kept), name order."""
    return [f for f, _ in list_sizes(path)]


def move(source: str, target: str) -> None:
    fs, p = resolve(source)
    fs.move(p, resolve(target)[1])


def makedirs(path: str) -> None:
    fs, p = resolve(path)
    fs.create_dir(p, recursive=True)


def open_input(path: str):
    fs, p = resolve(path)
    return fs.open_input_file(p)


def open_output(path: str):
    fs, p = resolve(path)
    return fs.open_output_stream(p)
