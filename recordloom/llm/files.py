"""Files in the shared folder, read and written from tasks through its file system's URI."""

from __future__ import annotations

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts) -> None:
    """A file appears under its name only when whole."""
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path + ".part") as f:
        for p in parts:
            f.write(p)
    store.move(path + ".part", path)


def read_bytes(uri: str) -> bytes:
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        return f.read()


def open_input(uri: str):
    store, path = _at(uri)
    return store.open_input_file(path)


def open_output(uri: str):
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def listed(uri: str) -> list[str]:
    store, path = _at(uri)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    scheme = uri.split("://", 1)[0] + "://" if "://" in uri else ""
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File)


def remove(uri: str) -> None:
    """Delete a folder that nothing will read again."""
    store, path = _at(uri)
    store.delete_dir(path)
