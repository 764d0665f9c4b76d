"""What passes between Spark and Python is bounded by rows and characters, not by the Arrow batch."""

from riskloom.functions import pieces
from riskloom.operators import chunk


def test_rows_leave_in_pieces(spark):
    df = spark.createDataFrame([(k, "x" * 10) for k in range(50)], "k long, t string").coalesce(1)
    sizes = pieces.map_rows(df, lambda: lambda k, t: ((k, t) for _ in range(100)), "k long, t string").mapInArrow(
        lambda batches: (b for b in batches), "k long, t string")
    assert sizes.groupBy("k").count().where("count = 100").count() == 50


def test_made_rows_are_bounded(monkeypatch):
    import pyarrow as pa

    caught = {}

    class Frame:
        def mapInArrow(self, run, schema):
            caught["run"] = run

    pieces.map_rows(Frame(), lambda: lambda k, t: ((k, t) for _ in range(3_000)), "k long, t string")
    batch = pa.RecordBatch.from_pydict({"k": [1, 2], "t": ["a", "b" * 10_000]})
    sizes = [b.num_rows for b in caught["run"](iter([batch]))]
    assert sum(sizes) == 6_000 and sizes[:3] == [pieces.OUT_ROWS] * 3 and max(sizes[3:]) <= pieces.OUT_CHARS // 10_000 + 1


def test_sized_chunks_of_one_long_text(spark):
    text = "\n".join(f"line {k}" for k in range(20_000))
    files = spark.createDataFrame([("p", "a.txt", text)], "project string, path string, content string")
    rows = chunk.chunk_lines_sized(files).collect()
    assert [r["chunk_no"] for r in rows] == list(range(1, len(rows) + 1)) and rows[-1]["line_end"] == 20_000
