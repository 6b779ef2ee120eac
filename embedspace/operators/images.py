"""Pixels to tensors to vectors, in Arrow batches on the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means and deviations of the RGB channels, side of the input, names of the nodes.
MEANS, DEVIATIONS, SIDE = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 224
EMBEDDING_NODE, LOGIT_NODE, INPUT_NODE = "resnetv24_pool1_fwd", "resnetv24_dense0_fwd", "data"


class Vectorizer(Protocol):
    """Made once in each Python worker."""

    def __call__(self, tensor: np.ndarray) -> np.ndarray:
        """[n, 3, side, side] to [n, d]."""


def resize(pixels: np.ndarray, side: int = SIDE, crop: bool = True) -> np.ndarray:
    """Bilinear. crop: the middle square, keeping the aspect; else stretched."""
    h, w, _ = pixels.shape
    if crop:
        s = min(h, w)
        pixels = pixels[(h - s) // 2 : (h - s) // 2 + s, (w - s) // 2 : (w - s) // 2 + s]
        h = w = s
    at = lambda n: np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    y, x = at(h), at(w)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(np.float64)
    rows = lambda r: p[r][:, x0] * (1 - fx) + p[r][:, x1] * fx
    return rows(y0) * (1 - fy) + rows(y1) * fy


def tensor(bgr: bytes, height: int, width: int, channels: int, side: int = SIDE, crop: bool = True) -> np.ndarray:
    """[3, side, side]: RGB, normalised by channel."""
    p = np.frombuffer(bgr, np.uint8).reshape(height, width, channels)
    rgb = np.repeat(p, 3, axis=2) if channels == 1 else p[:, :, 2::-1]
    return ((resize(rgb, side, crop) / 255 - MEANS) / DEVIATIONS).transpose(2, 0, 1).astype(np.float32)


def normalize_channel(value: Column, channel: int) -> Column:
    return (value / 255.0 - MEANS[channel]) / DEVIATIONS[channel]


def output_node(names: list[str], vector_type: str) -> str:
    """The node of this kind if the model has it; else the first one for embeddings and the last one for logits."""
    wanted = EMBEDDING_NODE if vector_type == "embedding" else LOGIT_NODE
    return wanted if wanted in names else names[0 if vector_type == "embedding" else -1]


def onnx_vectorizer(model: str, vector_type: str = "embedding") -> Callable[[], Vectorizer]:
    """A maker for vectorize(): one single-threaded session in each worker. The model file must be where the workers can read it."""

    def make() -> Vectorizer:
        import os

        import onnxruntime as ort

        if not os.path.exists(model):
            raise FileNotFoundError(f"no model at {model}")
        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = ort.InferenceSession(model, options)
        node, source = output_node([o.name for o in session.get_outputs()], vector_type), session.get_inputs()[0].name
        return lambda x: session.run([node], {source: x})[0].reshape(len(x), -1)

    return make


def pooled_vectorizer(side: int = 4) -> Callable[[], Vectorizer]:
    """A maker of a deterministic stand-in without a model: means over a grid of side x side."""

    def make() -> Vectorizer:
        def run(x: np.ndarray) -> np.ndarray:
            n, c, h, w = x.shape
            return x.reshape(n, c, side, h // side, side, w // side).mean(axis=(3, 5)).reshape(n, -1)

        return run

    return make


VECTORIZED = "file_path string, vector array<float>, error string"


def vectorize(images: DataFrame, make: Callable[[], Vectorizer], crop: bool = True, batch: int = 16) -> DataFrame:
    """images(file_path, height, width, channels, bgr) to (file_path, vector, error); an image that fails has an error and no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectorizer = make()
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                rows, good, found = whole.slice(i, batch).to_pylist(), [], {}
                errors: dict[int, str] = {}
                for k, r in enumerate(rows):
                    if r["height"] is None or r["height"] <= 0 or not r["bgr"]:
                        errors[k] = "the image can't be decoded"
                    else:
                        good.append((k, tensor(r["bgr"], r["height"], r["width"], r["channels"], crop=crop)))
                if good:
                    try:
                        found = dict(zip((k for k, _ in good), np.asarray(vectorizer(np.stack([t for _, t in good])), np.float32).tolist(), strict=True))
                    except Exception as e:  # noqa: BLE001  one bad model call is an error of these rows, not of the job
                        errors |= {k: str(e) for k, _ in good}
                yield pa.record_batch([pa.array([r["file_path"] for r in rows], pa.string()), pa.array([found.get(k) for k in range(len(rows))], pa.list_(pa.float32())), pa.array([errors.get(k) for k in range(len(rows))], pa.string())], ["file_path", "vector", "error"])

    return images.select("file_path", "height", "width", "channels", "bgr").mapInArrow(run, VECTORIZED)


def png(pixels: np.ndarray) -> bytes:
    """RGB pixels as a PNG file, for thumbnails where no JPEG encoder is at hand."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in np.clip(np.rint(pixels), 0, 255).astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def thumbnails(images: DataFrame, existing: DataFrame | None = None, encode: Callable[[np.ndarray], bytes] = png) -> DataFrame:
    """(file_path, key, content) of thumbnails that existing(key) lacks; where they are written is the caller's choice."""
    from embedspace.functions.paths import path_key

    named = images.withColumn("key", path_key(F.col("file_path")))
    named = named if existing is None else named.join(existing.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                p = np.frombuffer(r["bgr"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                out.append((r["file_path"], r["key"], encode(resize(np.repeat(p, 3, axis=2) if r["channels"] == 1 else p[:, :, 2::-1]))))
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["file_path", "key", "content"])

    return named.filter("height > 0").select("file_path", "key", "height", "width", "channels", "bgr").mapInArrow(run, "file_path string, key string, content binary")
