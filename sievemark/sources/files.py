"""File trees as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import limit_text
from sievemark.functions.raster import gray_features

# First bytes (hex) of each supported format.
MAGIC_PREFIXES = {
    "PNG": "89504E470D0A1A0A",
    "JPEG": "FFD8FF",
    "BMP": "424D",
}
TIFF_PREFIXES = ("49492A00", "4D4D002A")


def scan_file_tree(spark: SparkSession, directory: str) -> DataFrame:
    """Every file below ``directory``, whatever its extension.

    ``content`` is read only by queries that use it.  Symbolic links are
    followed by the Hadoop file system and cannot be told apart here.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
        .withColumns({
            "filename": F.element_at(F.split("path", "/"), -1),
            "file_key": F.col("_metadata.file_path"),  # spelled the same by every file source
        })
    )


def scan_bounded(spark: SparkSession, directory: str, limit: int | None = S.MAX_FILE_BYTES) -> DataFrame:
    """Files up to ``limit`` bytes with content; larger ones as failed rows without it; no limit, all of them.

    The size test is pushed into the file scan, so this reader never reads the
    bytes of a large file; decoding images does, in its own scan.
    """
    files = scan_file_tree(spark, directory)
    if limit is None:
        return files.select("path", "filename", "file_key", "length", "content", F.lit(None).cast("string").alias("read_error"))
    small = files.where(F.col("length") <= limit).select(
        "path", "filename", "file_key", "length", "content", F.lit(None).cast("string").alias("read_error")
    )
    large = files.where(F.col("length") > limit).select(
        "path", "filename", "file_key", "length", F.lit(None).cast("binary").alias("content"),
        F.lit(f"File exceeds {limit_text(limit)}").alias("read_error"),
    )
    return small.unionByName(large)


def sniffed_format(content: Column) -> Column:
    """Format by leading bytes; NULL when none is recognised."""
    head = F.hex(F.substring(content, 1, 12))
    expr = F.when(F.substring(head, 1, 8).isin(*TIFF_PREFIXES), "TIFF").when(
        head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP"
    )
    for name, prefix in MAGIC_PREFIXES.items():
        expr = expr.when(head.startswith(prefix), name)
    return expr


def scan_decoded_images(spark: SparkSession, directory: str) -> DataFrame:
    """Decoded size, channels and pixels per file; undecodable files stay as failed rows."""
    decoded = (
        spark.read.format("image").option("dropInvalid", "false")
        .option("recursiveFileLookup", "true").load(directory)
    )
    ok = F.col("image.width") > 0
    channels = F.col("image.nChannels")
    return decoded.select(
        F.col("image.origin").alias("path"), F.col("_metadata.file_path").alias("file_key"),
        F.when(ok, F.col("image.width").cast("long")).alias("width"),
        F.when(ok, F.col("image.height").cast("long")).alias("height"),
        F.when(ok, F.when(channels == 1, "L").when(channels == 3, "RGB").otherwise("RGBA")).alias("color_mode"),
        F.when(ok, channels).alias("channels"), F.when(ok, F.col("image.data")).alias("pixels"),
        F.when(~ok, F.lit("cannot identify image file")).alias("decode_error"),
    )


def file_batch(
    spark: SparkSession, directory: str, feature_count: int = 784, *, max_bytes: int | None = None, max_pixels: int | None = None
) -> DataFrame:
    """An ingest batch of a directory: digests, formats and what decoding gave.

    Pictures of any size, gray or in colour, get the features of a square of
    ``feature_count`` gray values. Files above ``max_bytes`` and images above ``max_pixels`` are kept as rows
    with an error; without these limits everything is read.
    """
    side = math.isqrt(feature_count)
    if side * side != feature_count:
        raise ValueError("feature_count must be a square")
    # Digest, format and features are taken in the scans: the join moves neither bytes nor pixels.
    files = scan_bounded(spark, directory, max_bytes).select(
        "path", "filename", "file_key", "length", "read_error", F.sha2("content", 256).alias("content_id"),
        sniffed_format(F.col("content")).alias("sniffed"),
    )
    images = scan_decoded_images(spark, directory).select(
        "file_key", "width", "height", "color_mode", "decode_error",
        gray_features(F.col("width"), F.col("height"), F.col("channels"), F.col("pixels"), side, side).alias("features"),
    )
    readable = F.col("read_error").isNull()
    fmt = F.col("sniffed")
    too_large = F.lit(False) if max_pixels is None else F.col("width") * F.col("height") > max_pixels
    problem = (
        F.when(F.col("decode_error").isNotNull() | F.col("width").isNull(),
               F.coalesce("decode_error", F.lit("cannot identify image file")))
        .when(too_large, f"Image exceeds {max_pixels} pixels")
        .when(fmt.isNull(), "Unsupported decoded format")
        .when(F.col("features").isNull(), "Image data are incomplete")
    )
    joined = files.join(images, "file_key", "left")
    good = readable & problem.isNull()
    return joined.select(
        "path", "filename",
        F.when(readable, F.col("content_id")).alias("content_id"),
        F.col("length").alias("file_size"),
        F.when(good, fmt).alias("format"),
        F.when(good, F.col("width")).alias("width"),
        F.when(good, F.col("height")).alias("height"),
        F.when(good, F.col("color_mode")).alias("color_mode"),
        F.when(good, F.lit("{}")).alias("exif"),
        F.when(good, F.col("features")).alias("features"),
        F.when(readable, problem).alias("decode_error"),
        F.lit(None).cast("string").alias("split"), F.lit(None).cast("long").alias("label"),
        F.current_timestamp().alias("seen_at"), "read_error",
    )
