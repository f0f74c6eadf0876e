"""Archives as tables: members of ZIP files against a manifest, arrays of NPZ files.

Files come as (path, content), as ``spark.read.format("binaryFile")`` gives them from any store that Spark reads. They are
opened where they are; a member is read up to a limit, whatever its header says, so a bomb costs no more than that.
"""

from __future__ import annotations

import hashlib
import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, member string, size long, sha256 string, content binary, error string"
ARRAYS = "path string, name string, row long, values array<double>, error string"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith("/") and "\\" not in name and ".." not in name.split("/") and ":" not in name


def zip_members(archives: DataFrame, most: int = 1 << 28) -> DataFrame:
    """(path, member, size, sha256, content, error) of all files in archives (path, content).

    error: not_an_archive (one row without a member), unsafe_name, encrypted, too_large (over ``most`` bytes), damaged;
    such members have no content, size and digest. Null contents are no archives.
    """

    def one(path, content):
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            yield path, None, None, None, None, "not_an_archive"
            return
        for info in archive.infolist():
            if info.is_dir():
                continue
            error = "unsafe_name" if not _safe(info.filename) else "encrypted" if info.flag_bits & 1 else None
            data = None
            if error is None:
                try:
                    with archive.open(info) as f:
                        data = f.read(most + 1)
                    if len(data) > most:
                        data, error = None, "too_large"
                except (zipfile.BadZipFile, EOFError, NotImplementedError, OSError, ValueError):
                    data, error = None, "damaged"
            yield path, info.filename, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), data, error

    def run(batches):
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in one(path, content.as_py()):  # a member is a batch of its own
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["path", "member", "size", "sha256", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, MEMBERS)


def listed_members(archives: DataFrame, manifest: DataFrame, most: int = 1 << 28) -> DataFrame:
    """Members against a manifest (member, size, sha256), which is an allow-list: what it doesn't name is never handed on.

    Returns (path, member, content, reason): content only where reason is null. Beside the errors of ``zip_members``:
    not_listed, wrong_size, wrong_sha256; a listed member that no archive has comes without a path, as missing.
    """
    wanted = manifest.select("member", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_listed"))
    rows = zip_members(archives, most).join(wanted, "member", "full")
    reason = (
        F.when(F.col("path").isNull(), "missing")
        .when(F.col("error") == "not_an_archive", F.col("error"))
        .when(F.col("_listed").isNull(), "not_listed")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("size") != F.col("_size"), "wrong_size")
        .when(F.col("sha256") != F.col("_sha256"), "wrong_sha256")
    )
    return rows.withColumn("reason", reason).select("path", "member", F.when(F.col("reason").isNull(), F.col("content")).alias("content"), "reason")


def npz_arrays(archives: DataFrame) -> DataFrame:
    """(path, name, row, values, error): the rows of all arrays of one or two dimensions in NPZ files (path, content).

    A vector is one row for each number. Pickled objects are never loaded: they, other shapes and what isn't numeric give a
    row with an error.
    """

    def arrays(path, content):
        try:
            held = np.load(io.BytesIO(content or b""), allow_pickle=False)
            names = held.files
        except (OSError, ValueError, EOFError, zipfile.BadZipFile, AttributeError):
            yield path, None, None, "not_an_archive"
            return
        for name in names:
            try:
                x = held[name]
                if x.ndim not in (1, 2) or x.dtype.kind not in "biuf":
                    raise ValueError
                yield path, name, (x if x.ndim == 2 else x[:, None]).astype(np.float64), None
            except (ValueError, OSError, zipfile.BadZipFile):
                yield path, name, None, "not_numeric"

    def run(batches):
        names = ["path", "name", "row", "values", "error"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for p, name, x, error in arrays(path, content.as_py()):
                    if x is None:
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([name], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.float64())), pa.array([error])], names)
                    for lo in range(0, 0 if x is None else len(x), 4096):
                        part = x[lo : lo + 4096]
                        ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array([p] * n), pa.array([name] * n), pa.array(np.arange(lo, lo + n)), values, pa.nulls(n, pa.string())], names)

    return archives.select("path", "content").mapInArrow(run, ARRAYS)
