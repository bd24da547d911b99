"""Sources and sinks."""

import io
import struct
import zipfile

import numpy as np

from driftline.sinks import tables
from driftline.sources import results, tiff


def test_run_round_trip(spark, tmp_path):
    folder = str(tmp_path / "run")
    rows = spark.createDataFrame([(1, 0, 1.5, float("nan"), "a;b"), (1, 1, 0.1234567894999, float("inf"), None)], "track_id int, frame int, x_px double, speed double, track_flags string")
    assert not results.is_complete(spark, folder)
    tables.save_run(spark, folder, {"tracks": rows}, {"input": "movie", "bad": float("nan")})
    assert results.is_complete(spark, folder)
    run = results.load_run(spark, folder)
    assert run.manifest == {"schema_version": 2, "input": "movie", "bad": None}
    got = run.table("tracks").orderBy("frame").collect()
    assert [(r.track_id, r.frame, r.x_px, r.speed, r.track_flags) for r in got] == [(1, 0, 1.5, None, "a;b"), (1, 1, 0.123456789, None, None)]
    assert [r.frame for r in run.frame(1).collect()] == [1]
    assert run.table("track_msd").columns == []


def test_wrong_cells_are_kept_as_text(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("frame,x_px,source\n1,2.5,primary\n1.5,?,window\n")
    rows = results.read_table(spark, str(p)).collect()
    assert [(r.frame, r.frame_text, r.x_px, r.x_px_text) for r in rows] == [(1, None, 2.5, None), (None, "1.5", None, "?")]


def test_broken_manifest(spark, tmp_path):
    (tmp_path / "run.json").write_text("{")
    assert results.read_manifest(spark, str(tmp_path / "run.json")) == {}
    (tmp_path / "run.json").write_text("[1]")
    assert results.read_manifest(spark, str(tmp_path / "run.json")) == {}


def test_workbook():
    data = tables.workbook([("A/B", ["x", "y"], [(1, "<a>"), (None, True)]), ("A_B", ["z"], [])])
    z = zipfile.ZipFile(io.BytesIO(data))
    assert 'name="A_B"' in z.read("xl/workbook.xml").decode() and 'name="A_B_2"' in z.read("xl/workbook.xml").decode()
    assert "&lt;a&gt;" in z.read("xl/worksheets/sheet1.xml").decode()


def make_tiff(images):
    body, offsets = b"", []
    at = 8
    for im in images:
        offsets.append(at)
        body += im.tobytes()
        at += im.nbytes
    out, pages = b"", []
    for k, im in enumerate(images):
        h, w = im.shape
        tags = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, 1), (273, 4, offsets[k]), (277, 3, 1), (278, 4, h), (279, 4, im.nbytes)]
        pages.append(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in tags))
    first = at
    for k, p in enumerate(pages):
        at += len(p) + 4
        out += p + struct.pack("<I", at if k + 1 < len(pages) else 0)
    return struct.pack("<2sHI", b"II", 42, first) + body + out


def test_tiff_stack(spark, tmp_path):
    images = [np.arange(12, dtype="<u2").reshape(3, 4) + k for k in range(3)]
    (tmp_path / "a.tif").write_bytes(make_tiff(images))
    rows = tiff.read_stacks(spark, str(tmp_path / "a.tif")).orderBy("frame").collect()
    assert [r.frame for r in rows] == [0, 1, 2]
    assert (np.frombuffer(rows[2].pixels, np.float32).reshape(3, 4) == images[2]).all()
