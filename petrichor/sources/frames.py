"""Scans of frames and raw payloads, file pairing and key audits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.values import NULL_CODES
from ..operators.slots import order_violations
from ..session import small_side
from .ranges import RANGE_BYTES, in_ranges, resumable, sha256_by_ranges

# fixed values of the raw layout
HEADER_BYTES, RAW_HEIGHT, RAW_WIDTH = 1024, 2881, 2305
PIXELS = "path string, y int, x int, raw smallint, valid boolean, problem string"


def scan_frames(spark: SparkSession, path: str, schema: str, keys: DataFrame | None = None, on=("source", "slot")) -> tuple[DataFrame, DataFrame]:
    """SC01: (frames of the requested keys, requested keys without a frame). Missing frames are never zeros.

    The semi-join on the key columns lets partition and row-group pruning reach the scan.
    """
    frames = spark.read.schema(schema).parquet(path)
    if keys is None:
        return frames, frames.select(*on).limit(0)
    want = keys.select(*on).distinct()
    return frames.join(want, list(on), "left_semi"), want.join(frames.select(*on).distinct(), list(on), "left_anti")


def _strips_to_pixels(width: int) -> Callable:
    """Grid rows as byte strips to pixels; an Arrow batch holds strips of a few kilobytes, never whole files."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = np.frombuffer(b"".join(pdf["strip"]), dtype="<i2")
            yield pd.DataFrame({"path": np.repeat(pdf["path"].to_numpy(), width), "y": np.repeat(pdf["y"].to_numpy(), width),
                                "x": np.tile(np.arange(width, dtype="int32"), len(pdf)), "raw": raw, "valid": ~np.isin(raw, NULL_CODES), "problem": None})
    return decode


def _inflate(most: int) -> Callable:
    """(path, content) of gzip files to (path, content, problem): at most ``most`` bytes come out of any file, and a file
    that is no gzip stream, or is cut short, is named as such."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                body, problem = None, None
                try:
                    z = zlib.decompressobj(31)
                    body = z.decompress(content.as_py() or b"", most)
                    if not z.eof and len(body) < most:
                        body, problem = None, "gzip stream cut short"
                except zlib.error:
                    problem = "no gzip stream"
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([body], pa.binary()), pa.array([problem], pa.string())], names=["path", "content", "problem"])
    return run


def decode_raw(payloads: DataFrame, height: int = RAW_HEIGHT, width: int = RAW_WIDTH) -> DataFrame:
    """SC02: (path, content) to long pixel rows; a wrong length is one problem row, and so is a given ``problem``.

    The JVM cuts a payload into grid rows before anything goes to Python.
    """
    said = F.col("problem") if "problem" in payloads.columns else F.lit(None).cast("string")
    size = HEADER_BYTES + height * width * 2
    good = F.coalesce(F.length("content") == size, F.lit(False))
    strips = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.substring("content", y * (2 * width) + (HEADER_BYTES + 1), F.lit(2 * width)))
    whole = payloads.filter(good).select("path", F.posexplode(strips).alias("y", "strip"))
    null = F.lit(None)
    broken = payloads.filter(~good).select("path", null.cast("int").alias("y"), null.cast("int").alias("x"), null.cast("smallint").alias("raw"),
                                           null.cast("boolean").alias("valid"), F.coalesce(said, F.concat(F.lit("length "), F.coalesce(F.length("content"), F.lit(0)))).alias("problem"))
    return whole.mapInPandas(_strips_to_pixels(width), PIXELS).unionByName(broken)


def ingest_raw_scans(spark: SparkSession, folder: str, pattern: str = "*", height: int = RAW_HEIGHT, width: int = RAW_WIDTH,
                     compressed: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")
    size = HEADER_BYTES + height * width * 2
    unpacked = files.mapInArrow(_inflate(size + 1), "path string, content binary, problem string") if compressed else files
    return decode_raw(unpacked, height, width)


def decode_with(payloads: DataFrame, decoder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """UD01: any decoder over Arrow batches, chosen by the caller."""
    return payloads.mapInPandas(decoder, schema)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes only; the content column is never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
            .select("path", "length"))


def pair_files(files: DataFrame, left_suffix: str, right_suffix: str, path: str = "path") -> DataFrame:
    """SC03: pairs by stem; ``state`` = paired, unmatched_left or orphan_right."""
    def side(suffix, name):
        return files.filter(F.col(path).endswith(suffix)).select(
            F.expr(f"substring({path}, 1, length({path}) - {len(suffix)})").alias("stem"), F.col(path).alias(name))
    j = side(left_suffix, "left_path").join(side(right_suffix, "right_path"), "stem", "full_outer")
    state = F.when(F.col("right_path").isNull(), "unmatched_left").when(F.col("left_path").isNull(), "orphan_right").otherwise("paired")
    return j.select("stem", "left_path", "right_path", state.alias("state"))


def audit_file_keys(keys: DataFrame, files: DataFrame | None = None, chunk: int = 1 << 20) -> DataFrame:
    """SC04: keys (file, ordinal, key, shape) to counts per file: keys, repeats, order breaks, shapes."""
    per_key = keys.groupBy("file", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.groupBy("file").agg(F.sum("n").alias("keys"), F.sum(F.col("n") - 1).alias("repeated"))
    shapes = keys.select("file", "shape").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("shapes"))
    breaks = order_violations(keys.select("file", "ordinal", "key"), "ordinal", ["key"], chunk, ["file"]).groupBy("file").agg(
        F.count(F.lit(1)).alias("order_breaks"))
    out = counts.join(shapes, "file").join(breaks, "file", "left")
    if files is not None:
        out = files.select("file").join(out, "file", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("keys", "repeated", "shapes", "order_breaks")}
    return out.select("file", *[v.alias(k) for k, v in zero.items()], (zero["keys"] == 0).alias("empty"))


def common_timestamps(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC05: keys in both (file, key) tables, and keys that several files of one side claim."""
    def twice(d, side):
        return d.groupBy("key").agg(F.count_distinct("file").alias("files")).filter("files > 1").select("key", "files", F.lit(side).alias("side"))
    return a.select("key").intersect(b.select("key")), twice(a, "a").unionByName(twice(b, "b"))


def unequal_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """SC05: (pair, key, rows_a, rows_b) of the keys that the two files of a pair don't hold equally often; both tables have (pair, key).

    Each side folds to one digest a pair, which doesn't depend on order: the number of keys and two sums of hashes of them. Only
    pairs whose digests differ are looked at key by key. A pair without its other file differs in all keys.
    """
    def digest(d: DataFrame, side: str) -> DataFrame:
        hashes = [F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
        return d.groupBy("pair").agg(F.struct(F.count(F.lit(1)), *hashes).alias(side))
    both = digest(a, "_a").join(digest(b, "_b"), "pair", "full")
    differ = small_side(both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("pair"))

    def counted(d: DataFrame, side: str) -> DataFrame:
        return d.join(differ, "pair", "left_semi").groupBy("pair", "key").agg(F.count(F.lit(1)).alias(side))
    keys = counted(a, "rows_a").join(counted(b, "rows_b"), ["pair", "key"], "full")
    one, two = F.coalesce("rows_a", F.lit(0)), F.coalesce("rows_b", F.lit(0))
    return keys.select("pair", "key", one.alias("rows_a"), two.alias("rows_b")).filter(F.col("rows_a") != F.col("rows_b"))


def estimate_bytes(frames: DataFrame, by, cells: Column, bytes_per_cell: int = 4, mask_bytes: int = 0) -> DataFrame:
    """SC06: payload size per source or year."""
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("frames"), F.sum(cells * bytes_per_cell + mask_bytes).alias("bytes"))


def fingerprint_files(spark: SparkSession, folder: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SC14: size and SHA-256 per artifact file.

    A file above ``range_bytes`` is read by blocks and digested range by range (``ranges``). Smaller files, and those with the
    suffix of a compression codec, are read in one row each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    large = files.filter(in_ranges(range_bytes)).select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("named"), F.col("length").alias("size"))
    if not resumable() or large.isEmpty():
        return fingerprint_content(files)
    digests = sha256_by_ranges(spark, large.select("path", "size"), folder, pattern, range_bytes)
    return fingerprint_content(files.filter(~in_ranges(range_bytes))).unionByName(
        large.join(digests, "path").select(file_name("named").alias("file"), F.col("size").alias("bytes"), "sha256"))


def file_name(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fingerprint_content(files: DataFrame) -> DataFrame:
    """Name, size and SHA-256 of every (path, content)."""
    return files.select(file_name("path").alias("file"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def row_digest(cols) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def fingerprint_table(df: DataFrame, cols) -> DataFrame:
    """SC15: identity of a table's content in any order: count, sum and xor of row digests."""
    d = df.select(row_digest(list(cols)).alias("_h"))
    return d.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")).alias("xor60"),
                 F.sum(F.conv(F.substring("_h", 16, 8), 16, 10).cast("long")).alias("sum32"))
