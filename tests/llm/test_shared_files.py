"""Array files on a shared path and in a store that cannot be mapped."""

import numpy as np
import pytest

from driftline.llm import shared_files


def test_arrays_by_path_and_by_store(tmp_path, monkeypatch):
    arrays = [np.arange(5), np.zeros(0, np.uint16), np.array([1.5, 2.5]), np.frombuffer(b"abc", np.uint8)]
    uri = f"file://{tmp_path}/x"
    shared_files.write_arrays(uri, arrays)
    for reader in ("mapped", "store"):
        if reader == "store":
            monkeypatch.setattr(shared_files, "_local", lambda uri: None)
        got = shared_files.map_arrays(uri)
        assert [a.dtype for a in got] == [a.dtype for a in arrays]
        assert all((a == b).all() for a, b in zip(got, arrays, strict=True))
    shared_files.write_arrays(f"file://{tmp_path}/y", arrays[:1])
    assert (shared_files.map_arrays(f"file://{tmp_path}/y")[0] == arrays[0]).all()
    (tmp_path / "bad").write_bytes(b"no array file here")
    with pytest.raises(ValueError):
        shared_files.map_arrays(f"file://{tmp_path}/bad")
