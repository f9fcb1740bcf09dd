"""Files in a folder that all executors share, as tasks open them."""

from __future__ import annotations


def filesystem(uri: str):
    """(file system, path) of an address: a local path, or any address that Arrow's file systems know."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """A whole file, under another name until it is complete, so a task that runs again leaves one file."""
    import uuid

    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def read_file(uri: str) -> bytes:
    """A whole file."""
    system, path = filesystem(uri)
    with system.open_input_file(path) as source:
        return source.read()


def list_files(uri: str, ending: str = "") -> list[str]:
    """The files below a folder, by name; none if there is no such folder."""
    from pyarrow import fs

    system, path = filesystem(uri)
    infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(i.path for i in infos if i.type == fs.FileType.File and i.path.endswith(ending))
