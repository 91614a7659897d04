import random

import numpy as np
import pytest

from matrixlake.functions.tables import ALPHANUMERIC
from matrixlake.operators import encode, scan, vision
from matrixlake.operators.scenes import SCENES


@pytest.mark.parametrize("scene", SCENES)
def test_detection_rates(scene):
    change, floor = SCENES[scene]
    rng, pick, hits = np.random.default_rng(9), random.Random(9), 0
    for _ in range(25):
        text = "".join(pick.choice(ALPHANUMERIC) for _ in range(20))
        frame = change(encode.render(encode.encode(text, "M", 2)), rng)
        hits += any(r["text"] == text for r in vision.scan(frame, try_harder=True)[0])
    assert hits / 25 >= floor


@pytest.mark.parametrize(("version", "level", "scale"), [(1, "M", 4), (2, "L", 3), (3, "Q", 5), (5, "H", 4), (7, "M", 4), (10, "Q", 3), (15, "M", 3), (25, "L", 3), (40, "M", 3)])
def test_versions(version, level, scale):
    results, _ = vision.scan(encode.render(encode.encode("version", level, version), scale))
    assert [(r["text"], r["version"]) for r in results] == [("version", version)]


def test_geometry():
    src, dst = [(0, 0), (1, 0), (1, 1), (0, 1)], [(3, 2), (9, 3), (8, 9), (1, 7)]
    h = vision.homography(src, dst)
    assert np.allclose([vision.apply(h, *p) for p in src], dst)
    assert vision.homography(src, [(0, 0), (1, 1), (2, 2), (3, 3)]) is None
    with pytest.raises(scan.DecodeError):
        vision.gray_of(b"\0" * 10, 2, 2)


def test_frames_in_spark(spark):
    a, b = (encode.render(encode.encode(t, "M", 2)) for t in ("tel:12", "second"))
    both = np.hstack([a, np.full((a.shape[0], 24), 255, np.uint8), 255 - b])
    blank = np.full((60, 60), 200, np.uint8)
    frames = [(i, encode.rgba(g), g.shape[1], g.shape[0]) for i, g in enumerate([a, both, blank])] + [(3, None, 5, 5), (4, b"\0" * 9, 5, 5)]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d), w, h) for i, d, w, h in frames], "frame_id int, data binary, width int, height int")
    first = {r.frame_id: r for r in scan.decode_frames(df).collect()}
    assert first[0].text == "tel:12"
    assert first[0].content.type == "tel"
    assert set(first) <= {0, 1}
    every = sorted((r.frame_id, r.text) for r in scan.decode_all_frames(df).collect())
    assert every == [(0, "tel:12"), (1, "second"), (1, "tel:12")]
    assert [r.error_code for r in scan.scan_frames(df).orderBy("frame_id").collect()] == [None, None, None, "frame", "frame"]
    assert {r.frame_id for r in scan.detect_frames(df).collect()} == {0, 1}
