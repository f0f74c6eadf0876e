"""Archives and numbered lines from real files."""

import hashlib
import io
import zipfile

import numpy as np

from textquarry.sources import archives, readers


def test_zip(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("good.txt", "text é")
        z.writestr("dir/", "")
        z.writestr("dir/empty", b"")
        z.writestr("../out.txt", "x")
        z.writestr("bomb", b"0" * 100_000)
        z.writestr("hurt", "0123456789" * 20)
    body = bytearray(path.read_bytes())
    at = body.index(b"hurt") + 6
    body[at] ^= 0xFF
    (tmp_path / "b.zip").write_bytes(bytes(body))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = {(r.path[-5:], r.member): r for r in archives.zip_members(archives.files(spark, f"file://{tmp_path}/*.zip"), 1000).collect()}
    good = got["a.zip", "good.txt"]
    assert (good.size, good.sha256, bytes(good.content), good.error) == (7, hashlib.sha256("text é".encode()).hexdigest(), "text é".encode(), None)
    assert {k[1]: r.error for k, r in got.items() if k[0] == "a.zip"} == {"good.txt": None, "dir/empty": None, "../out.txt": "unsafe_name", "bomb": "too_large", "hurt": None}
    assert got["b.zip", "hurt"].error == "damaged" and got["c.zip", None].error == "not_an_archive"
    manifest = spark.createDataFrame([("good.txt", 7, good.sha256), ("bomb", 100_000, "x"), ("none", 1, "x")], "member string, size long, sha256 string")
    one = archives.files(spark, f"file://{tmp_path}/a.zip")
    assert {r.member: r.reason for r in archives.listed_members(one, manifest, 1000).collect()} == {"good.txt": None, "bomb": "too_large", "none": "missing", "dir/empty": "not_listed", "../out.txt": "not_listed", "hurt": "not_listed"}


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(3, 2), y=np.array([1, 2]), z=np.array([{}], object), w=np.zeros((2, 2, 2)), e=np.zeros((0, 3)), n=np.array([np.nan]))
    buffer = io.BytesIO()
    np.save(buffer, np.arange(3))
    (tmp_path / "b.npz").write_bytes(buffer.getvalue())
    rows = archives.npz_arrays(archives.files(spark, f"file://{tmp_path}/*.npz")).collect()
    held = [(r.name, r.row, r["values"]) for r in rows if r.error is None and r.name != "n"]
    assert sorted(held) == [("x", 0, [0.0, 1.0]), ("x", 1, [2.0, 3.0]), ("x", 2, [4.0, 5.0]), ("y", 0, [1.0]), ("y", 1, [2.0])]
    assert sorted((r.name or "", r.error) for r in rows if r.error) == [("", "not_an_archive"), ("w", "not_numeric"), ("z", "not_numeric")]


def test_lines_of_many_blocks(spark, tmp_path):
    """A file is read in many blocks, another in one; both are numbered from 1 without a job before the query."""
    for name, n in (("a", 3000), ("b", 7)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i}\n" for i in range(1, n + 1)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = spark.read.text(f"file://{tmp_path}/*.txt")
        assert lines.rdd.getNumPartitions() > 10
        got = readers.with_line_number(lines, "line").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 3007 and all(r.value.split()[1] == str(r.line) for r in got)
