"""Frames as cameras spoil them: the nine scenes by which detection is measured. Gray frames in, gray frames out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import encode, vision


def warped(gray: np.ndarray, source: Callable, shape: tuple[int, int] | None = None) -> np.ndarray:
    """Each pixel from where source(x, y) says; white beyond the frame."""
    h, w = shape or gray.shape
    y, x = np.mgrid[:h, :w] + 0.5
    value, inside = vision.sample(gray, *source(x, y))
    return np.where(inside, value, 255).astype(np.uint8)


def rotated(gray: np.ndarray, degrees: float) -> np.ndarray:
    a, (h, w) = np.deg2rad(degrees), gray.shape
    n = int(abs(w * np.cos(a)) + abs(h * np.sin(a))) + 2
    c, s = np.cos(a), np.sin(a)
    return warped(gray, lambda x, y: ((x - n / 2) * c + (y - n / 2) * s + w / 2, -(x - n / 2) * s + (y - n / 2) * c + h / 2), (n, n))


def tilted(gray: np.ndarray, rng: np.random.Generator, pull: float = 0.09) -> np.ndarray:
    n = gray.shape[0]
    e = rng.uniform(0, pull * n, 8)
    quad = [(e[0], e[1]), (n - e[2], e[3]), (n - e[4], n - e[5]), (e[6], n - e[7])]
    h = vision.homography(quad, [(0, 0), (n, 0), (n, n), (0, n)])
    return warped(gray, lambda x, y: vision.apply(h, x, y))


def blurred(gray: np.ndarray, r: int) -> np.ndarray:
    p, n = np.pad(gray.astype(float), r, mode="edge"), 2 * r + 1
    return (sum(p[i : i + gray.shape[0], j : j + gray.shape[1]] for i in range(n) for j in range(n)) / n**2).round().astype(np.uint8)


def noisy(gray: np.ndarray, rng: np.random.Generator, share: float = 0.02) -> np.ndarray:
    out = gray.copy()
    hit = rng.random(gray.shape) < share
    out[hit] = rng.choice([0, 255], hit.sum())
    return out


#: The scenes, and the share of frames that has to be read with a harder try.
SCENES: dict[str, tuple[Callable, float]] = {
    "clean": (lambda g, r: g, 1.0),
    "rotated": (lambda g, r: rotated(g, 30), 0.9),
    "perspective": (tilted, 0.9),
    "noise": (noisy, 0.9),
    "gradient": (lambda g, r: (g * np.linspace(0.35, 1, g.shape[1])).astype(np.uint8), 0.9),
    "low contrast": (lambda g, r: (110 + g / 255 * 55).astype(np.uint8), 0.9),
    "blur 1": (lambda g, r: blurred(g, 1), 0.9),
    "blur 2": (lambda g, r: blurred(g, 2), 0.5),
    "inverted": (lambda g, r: 255 - g, 1.0),
}


def frames(df: DataFrame, text: str, scene: str, seed: str, scale: int = 6, level: str = "M") -> DataFrame:
    """df with an RGBA frame (data, width, height) of the symbol of a text column in the named scene; seed makes it the same again."""
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("data binary, width int, height int").fields])
    arrow = encode._schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                made = [SCENES[s][0](encode.render(encode.encode(t, level), scale), np.random.default_rng(n)) for t, s, n in zip(*(part.column(c).to_pylist() for c in (text, scene, seed)), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([encode.rgba(g) for g in made], pa.binary()), *(pa.array([g.shape[k] for g in made], pa.int32()) for k in (1, 0))], schema=arrow)

    return encode.spread(df).mapInArrow(work, schema)
