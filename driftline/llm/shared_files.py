"""Binary files in the shared folder, written whole by tasks and mapped into memory by workers."""

from __future__ import annotations

import functools
import mmap
import os
import uuid

import numpy as np

_MAGIC = b"DRIFTARR"


def qualified(spark, path: str) -> str:
    """The path with its file system's scheme, as Spark on the driver understands it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def _local(uri: str) -> str | None:
    return uri.removeprefix("file:").replace("///", "/") if uri.startswith("file:") else None


def write_arrays(uri: str, arrays: list[np.ndarray]) -> int:
    """Write arrays under ``uri``; the name appears only once the file is whole, so a repeated task does no harm. Returns bytes."""
    head = [_MAGIC, np.array([len(arrays)], dtype=np.int64).tobytes()]
    for a in arrays:
        head.append(a.dtype.str.encode().ljust(8))
        head.append(np.array([len(a)], dtype=np.int64).tobytes())
    blob = [*head]
    size = sum(map(len, head))
    for a in arrays:
        pad = -size % 64
        data = np.ascontiguousarray(a).tobytes()
        blob += [b"\0" * pad, data]
        size += pad + len(data)
    part = f"{uri}.{uuid.uuid4().hex}"
    local = _local(uri)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(_local(part), "wb") as f:
            f.writelines(blob)
        os.replace(_local(part), local)
    else:
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(part)
        there.create_dir(path.rpartition("/")[0], recursive=True)
        with there.open_output_stream(path) as f:
            for x in blob:
                f.write(x)
        there.move(path, fs.FileSystem.from_uri(uri)[1])
    return size


#: Files of a store that cannot be mapped which a worker holds in memory at once.
HELD_FILES = 32


def _arrays(uri: str, data) -> list[np.ndarray]:
    if data[:8] != _MAGIC:
        raise ValueError(f"{uri} is no array file")
    n = int(np.frombuffer(data, np.int64, 1, 8)[0])
    kinds = [(data[16 + 16 * i : 24 + 16 * i].decode().strip(), int(np.frombuffer(data, np.int64, 1, 24 + 16 * i)[0])) for i in range(n)]
    at, out = 16 + 16 * n, []
    for kind, length in kinds:
        at += -at % 64
        out.append(np.frombuffer(data, kind, length, at))
        at += length * np.dtype(kind).itemsize
    return out


@functools.lru_cache(maxsize=4096)
def _mapped(path: str) -> list[np.ndarray]:
    with open(path, "rb") as f:
        return _arrays(path, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


@functools.lru_cache(maxsize=HELD_FILES)
def _stored(uri: str) -> list[np.ndarray]:
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(uri)
    with there.open_input_file(path) as f:
        return _arrays(uri, f.read())


def map_arrays(uri: str) -> list[np.ndarray]:
    """The arrays under ``uri``: mapped and not read from a shared path; from a store that cannot be mapped read whole, the last few files held."""
    local = _local(uri)
    return _mapped(local) if local else _stored(uri)
