"""Tables of one file and tables of many files are streams alike."""

import pytest

from riskloom.streaming import jobs


@pytest.mark.parametrize("folder", [True, False])
def test_stream_of_a_table_in_one_file_or_in_a_folder(spark, tmp_path, folder):
    made = tmp_path / "made"
    spark.range(10).repartition(3 if folder else 1).write.parquet(str(made))
    if folder:
        made.rename(tmp_path / "t.parquet")
    else:
        next(made.glob("*.parquet")).rename(tmp_path / "t.parquet")
    stream = jobs.stream_table(spark, str(tmp_path), "t.parquet")
    assert sorted(r["id"] for r in jobs.run_to_table(stream, folder=str(tmp_path / "out")).collect()) == list(range(10))
