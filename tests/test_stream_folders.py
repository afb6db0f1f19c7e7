"""Streams over tables that are folders of files."""

import pytest
from pyspark.sql import functions as F

from colloquy.plans import stream_queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["stream_phrase_matches", "stream_cascade"])
def test_a_folder_of_files_gives_what_one_file_gives(spark, tmp_path, name):
    for t in ("conversations", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3, F.rand(1)).write.parquet(str(tmp_path / f"{t}.parquet"))
    run = stream_queries.Q[name]
    got, want = (sorted(map(tuple, run(spark, d).collect())) for d in (str(tmp_path), SF))
    assert got == want and got
