import struct
import zlib

import numpy as np
import pytest

from quern.sources import images as im


def png(picture):
    """A PNG file of an array (rows, columns) or (rows, columns, 3 or 4) in the order red, green, blue, alpha."""
    shown = picture.reshape(*picture.shape[:2], -1)
    kind = {1: 0, 3: 2, 4: 6}[shown.shape[2]]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + row.tobytes() for row in shown)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", shown.shape[1], shown.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    g = np.random.default_rng(1)
    pictures = {"a/0.png": g.integers(0, 256, (40, 50, 3), np.uint8), "a/1.png": g.integers(0, 256, (33, 32), np.uint8), "b c+d/2.PNG": g.integers(0, 256, (64, 32, 4), np.uint8)}
    for name, picture in pictures.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(png(picture))
    (tmp_path / "b c+d/3.png").write_bytes(b"no picture")
    (tmp_path / "b c+d/4.png").write_bytes(png(np.zeros((31, 40), np.uint8)))
    (tmp_path / "b c+d/.5.png").write_bytes(png(np.zeros((40, 40), np.uint8)))
    return tmp_path, pictures


def test_decoded(spark, folder):
    root, pictures = folder
    rows = im.decoded(spark, str(root)).orderBy("index").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in rows] == ["0.png", "1.png", "2.PNG", "3.png", "4.png"]
    for r, picture in zip(rows[:3], pictures.values(), strict=True):
        shown = np.stack([picture] * 3, axis=2) if picture.ndim == 2 else picture[:, :, :3]
        assert (r["height"], r["width"], r["problem"]) == (*shown.shape[:2], None)
        assert np.allclose(np.array(r["pixels"]).reshape(3, *shown.shape[:2]), shown[:, :, ::-1].transpose(2, 0, 1) / 255, atol=1e-6)
    assert [(r["pixels"], r["problem"]) for r in rows[3:]] == [(None, "not decoded"), (None, "too small: 31 x 40")]
    small = im.decoded(spark, str(root), "0.png", (25, 10), keep_bytes=True).first()
    assert (small["height"], small["width"]) == (10, 25)
    assert (np.frombuffer(small["pixels"], np.uint8).reshape(3, 10, 25) == pictures["a/0.png"][::4, ::2, ::-1].transpose(2, 0, 1)).all()


def test_masks(spark, folder):
    root, pictures = folder
    red, green, blue = (int(v) for v in pictures["a/0.png"][3, 7])
    found = im.decoded(spark, str(root), "a/")
    by_colour = im.colour_masks(found, [(blue, green, red), (0, 0, 256)])
    want = (pictures["a/0.png"] == (red, green, blue)).all(2)
    row = by_colour.where("index = 0").first()
    assert (np.array(row["mask"]).reshape(40, 50) == want).all() and want[3, 7]
    grey = int(pictures["a/1.png"][0, 0])
    by_class = im.class_masks(found, grey)
    assert (np.array(by_class.where("index = 1").first()["mask"]).reshape(33, 32) == (pictures["a/1.png"] == grey)).all()
    assert im.frames(found, by_class).count() == 2
    assert im.class_masks(im.decoded(spark, str(root), "3.png"), 1).first()["mask"] is None
