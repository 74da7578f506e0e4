"""Image inspection: decode with Spark's image source, hash and profile in Arrow batches.

Rows carry whole images, so set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to what fits
a Python worker (a few hundred for photographs).
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence.functions.signatures import signature_from_coefficients, signature_hex
from evidence.operators.gates import file_validity
from evidence.sources.trees import EXTENSIONS, list_files, plain_path

# Weights of red, green and blue in the brightness of a profile.
LUMA = np.array([0.2126, 0.7152, 0.0722])
# The same for the gray image of the signature, in 1/65536.
GRAY = np.array([19595, 38470, 7471])
PROFILE_SIDE, HASH_SIDE, LOW = 64, 32, 8

_PIXELS = """path string, pixel_rgb_sha256 string, brightness_mean double, contrast_std double,
  rgb_mean array<double>, coefficients array<double>"""


def _box(x: np.ndarray) -> np.ndarray:
    return ((x > -0.5) & (x <= 0.5)).astype(float)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _weights(size: int, target: int, kernel, support: float) -> np.ndarray:
    """(target, size) matrix of a separable resampling filter, each row summing to 1."""
    scale = size / target
    stretch = max(scale, 1.0)
    centres = (np.arange(target) + 0.5) * scale
    w = kernel((np.arange(size)[None, :] + 0.5 - centres[:, None]) / stretch)
    w[np.abs(np.arange(size)[None, :] + 0.5 - centres[:, None]) > support * stretch] = 0.0
    return w / w.sum(axis=1, keepdims=True)


def resize(channel: np.ndarray, side: int, kernel, support: float) -> np.ndarray:
    """A channel scaled to side × side, rounded to whole levels after each direction."""
    level = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    across = level(channel @ _weights(channel.shape[1], side, kernel, support).T)
    return level(_weights(channel.shape[0], side, kernel, support) @ across)


def _cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    basis = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * np.arange(n)[None, :] + 1) / (2 * n))
    basis[0] /= np.sqrt(2)
    return basis


def describe_pixels(rgb: np.ndarray) -> dict:
    """Pixel digest, brightness profile and low frequencies of one (height, width, 3) image."""
    height, width, _ = rgb.shape
    digest = hashlib.sha256(struct.pack(">II", width, height) + np.ascontiguousarray(rgb).tobytes()).hexdigest()
    small = np.stack([resize(rgb[:, :, c].astype(float), PROFILE_SIDE, _box, 0.5) for c in range(3)], axis=2) / 255
    luma = small @ LUMA
    gray = (rgb.astype(np.int64) @ GRAY + 0x8000) >> 16
    basis = _cosine_basis(HASH_SIDE)[:LOW]
    low = basis @ resize(gray.astype(float), HASH_SIDE, _lanczos, 3.0) @ basis.T
    return {
        "pixel_rgb_sha256": digest, "brightness_mean": luma.mean(), "contrast_std": luma.std(),
        "rgb_mean": small.mean(axis=(0, 1)), "coefficients": low.ravel(),
    }


def _to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]  # stored blue first


def _describe(batches):
    for pdf in batches:
        rows = [
            {"path": row.path, **describe_pixels(_to_rgb(row.data, row.height, row.width, row.nChannels))}
            for row in pdf.itertuples(index=False)
        ]
        if rows:
            yield pd.DataFrame(rows)


def file_format(content) -> F.Column:
    """Format from the first bytes of a file."""
    # Leading bytes of the formats.
    magic = {"FFD8FF": "JPEG", "89504E47": "PNG", "424D": "BMP", "49492A00": "TIFF", "4D4D002A": "TIFF"}
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(None).cast("string")
    for prefix, name in magic.items():
        out = F.when(head.startswith(prefix), name).otherwise(out)
    return out


def inspect_images(spark: SparkSession, root: str, folders: list[str] = []) -> DataFrame:
    """One record per file below root: listing, digests, size, profile, signature, validity.

    A file that cannot be decoded is recorded, not raised. Empty files are found in ``folders``.
    """
    files = list_files(spark, root, folders)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(
        plain_path("path").alias("path"), F.sha2("content", 256).alias("file_sha256"), file_format("content").alias("format")
    )
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*").select(
        plain_path("origin").alias("path"), "width", "height", "nChannels", "data"
    )
    good = decoded.where(F.col("width") > 0)
    pixels = good.mapInPandas(_describe, _PIXELS).withColumn("h", signature_from_coefficients(F.col("coefficients")))
    modes = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 4, "RGBA").otherwise("RGB")
    sizes = good.select("path", "width", "height", modes.alias("source_mode"))
    joined = files.join(raw, "path", "left").join(sizes, "path", "left").join(pixels, "path", "left")
    return joined.select(
        "path", "identifier", "split", "class", "extension", "size_bytes", "file_sha256", "pixel_rgb_sha256", "h",
        signature_hex(F.col("h")).alias("phash_63bit_hex"), "width", "height",
        F.try_divide(F.col("width").cast("double"), F.col("height").cast("double")).alias("aspect_ratio"),
        "source_mode", F.when(F.col("width").isNotNull(), "RGB").alias("decoded_mode"), "format",
        F.struct("brightness_mean", "contrast_std", "rgb_mean").alias("profile"),
        file_validity(F.col("size_bytes"), F.col("extension"), F.col("width").isNotNull(), EXTENSIONS).alias("validity"),
    )


def compact(records: DataFrame) -> DataFrame:
    """The columns kept for one side of a duplicate pair."""
    return records.select("identifier", "class", "width", "height", "file_sha256", "pixel_rgb_sha256", "phash_63bit_hex", "h")
