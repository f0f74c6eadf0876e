"""Tables in the shared folder, and how they go."""

import os

from textquarry.llm import _shared


def test_written_and_cleared(tmp_path, monkeypatch, spark):
    monkeypatch.setattr(_shared, "shared_dir", lambda _: f"file://{tmp_path}")
    df = _shared.written(spark.range(5), "numbers")
    assert df.count() == 5 and os.path.isdir(f"{tmp_path}/textquarry/{spark.sparkContext.applicationId}")
    os.makedirs(f"{tmp_path}/textquarry/another")
    _shared.clear(spark)
    assert os.listdir(f"{tmp_path}/textquarry") == ["another"]
