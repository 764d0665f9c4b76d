"""Texts behind findings and indexes are read once, however many parts of a result read them."""

from pyspark.sql import functions as F

from riskloom.functions.pieces import map_groups
from riskloom.operators import chunk, context, dedup, merge, reach, symbols
from riskloom.sources import exports

FINDINGS = "project string, source string, rule_id string, file string, line int, location string, vuln_type string, severity string, confidence double, title string, match string, evidence string"
ROWS = [("p", s, f"R{i % 3}", f"d{i % 2}/f{i % 5}.txt", i, f"d{i % 2}/f{i % 5}.txt:{i}", "XSS", "high", 0.5, "t", "m", "e") for i in range(40) for s in ("quick_scan", "llm")]


def counted(spark, df):
    """`df` through a Python step that counts the rows it sees."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_findings_are_worked_out_once(spark):
    steps = {
        "ids": lambda f: dedup.assign_ids(f), "results": lambda f: exports.sarif_results(f), "documents": lambda f: exports.export_sarif(f, 4),
        "merge": lambda f: merge.cross_source_merge(f)[0],
        "guards": lambda f: context.guard_context(f, spark.createDataFrame([("p", "d0/f0.txt", "a\nb")], "project string, path string, content string")),
    }
    for name, step in steps.items():
        df, seen = counted(spark, spark.createDataFrame(ROWS, FINDINGS))
        assert step(df).collect()
        assert seen.value == len(ROWS), name


def test_functions_are_read_once_for_a_call_tree(spark):
    rows = [("p", "a.js", "f", 1, "", ["g"]), ("p", "a.js", "g", 5, "", ["h"]), ("p", "b.js", "h", 2, "", [])]
    index, seen = counted(spark, spark.createDataFrame(rows, "project string, path string, name string, line int, definition string, calls array<string>"))
    got = symbols.call_tree(index, spark.createDataFrame([("p", "a.js", "f")], "project string, path string, name string"))
    assert sorted((r["name"], r["depth"]) for r in got.collect()) == [("f", 1), ("g", 2), ("h", 3)]
    assert seen.value == len(rows)


def test_edges_without_hot_nodes_are_kept_once(spark):
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(20)], "project string, src int, dst int")
    parted, hot = reach.parted_edges(edges)
    assert hot.count() == 0 and parted.where("part = 0").count() == 20
    assert "Join" not in parted._jdf.queryExecution().optimizedPlan().toString()
    parted, hot = reach.parted_edges(edges.unionByName(spark.createDataFrame([("p", 0, i) for i in range(2, 12)], edges.schema)), fan=5)
    assert {r["parts"] for r in hot.collect()} == {3} and parted.count() == 30


def test_groups_pass_python_in_common_batches(spark):
    df = spark.range(30_000).select((F.col("id") % 7_000).alias("k"), "id")
    calls = spark.sparkContext.accumulator(0)

    def each(table, ends):
        import pyarrow as pa

        calls.add(1)
        k, v, out, a = table["k"].to_pylist(), table["id"].to_pylist(), [], 0
        for z in ends:
            assert len(set(k[a:z])) == 1 and v[a:z] == sorted(v[a:z])
            out.append((k[a], z - a))
            a = z
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["k", "n"])

    got = {r["k"]: r["n"] for r in map_groups(df, ["k"], ["id"], each, "k long, n long").collect()}
    assert got == {k: len(range(k, 30_000, 7_000)) for k in range(7_000)} and calls.value < 50


def test_only_blocks_of_large_projects_are_summarised(spark):
    rows = [(p, f"s{i:03}.java", "w " * (i % 9)) for p in ("one", "two") for i in range(3 if p == "one" else 90)]
    got = chunk.pack_batches(spark.createDataFrame(rows, "project string, path string, content string"), chunk.BatchLimits(4, 10_000), block=20).collect()
    assert len(got) == 93 and max(r["batch"] for r in got if r["project"] == "two") == 23 and {r["batch"] for r in got if r["project"] == "one"} == {1}
