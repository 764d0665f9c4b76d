"""Rule scans called from SQL give what the DataFrame call gives."""

from pyspark.sql import functions as F

from riskloom.functions import paths
from riskloom.operators import scan
from riskloom.operators.scan_sql import language_of, register_scan
from riskloom.sources.rules import Rule

RULES = [Rule("EXEC", r"Runtime\.exec\s?\(", language="java", severity="high"), Rule("EVAL", r"eval\(", language="python", kind="source"),
         Rule("DIGITS", r"[0-9]{3,}"), Rule("KEY", r"key\s*=\s*\w+", pattern_ord=1, kind="source")]
FILES = [("p", "a/A.java", "x\nRuntime.exec(1234)\nRUNTIME.EXEC (KEY = b)\n", 1), ("p", "a/A.java", "x\nRuntime.exec(1234)\nRUNTIME.EXEC (KEY = b)\n", 2),
         ("p", "b.py", "eval(key=a)\n\neval(999)", 3), ("q", "noext", "é key = 𝄞 key = é1 777", 4), ("q", "c.PY", "", 5), (None, "d.js", None, 6),
         ("q", "long.java", "Runtime.exec(1) " * 30_000, 7)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_same_rows_as_the_call(spark):
    files = spark.createDataFrame(FILES, "project string, path string, content string, severity int").repartition(3)
    files.createOrReplaceTempView("sql_files")
    for kind in (None, "source", "sink"):
        assert register_scan(spark, RULES, "scan_here", kind) == []
        got = spark.sql("SELECT * FROM scan_here(TABLE(sql_files))")
        want = scan.scan_rules(files, RULES, kind)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert rows(got) == rows(want) and got.count() >= 5
    spark.createDataFrame(FILES, files.schema).createOrReplaceTempView("sql_files")
    assert "Exchange" not in spark.sql("SELECT * FROM scan_here(TABLE(sql_files))")._jdf.queryExecution().executedPlan().toString()


def test_given_language_joins_and_filters(spark):
    register_scan(spark, RULES, "scan_here")
    spark.createDataFrame(FILES[:3], "project string, path string, content string, n int").withColumn("language", F.lit("python")).createOrReplaceTempView("sql_files")
    got = spark.sql("SELECT rule_id, count(*) AS n FROM scan_here(TABLE(SELECT * FROM sql_files WHERE n < 3)) WHERE line > 1 GROUP BY rule_id")
    assert {tuple(r) for r in got.collect()} == {("DIGITS", 2), ("KEY", 2)}  # nothing of java


def test_nothing_to_scan_and_refused_patterns(spark):
    spark.createDataFrame([], "project string, path string, content string").createOrReplaceTempView("sql_none")
    refused = register_scan(spark, [Rule("BAD", "("), Rule("EMPTY", "a*"), *RULES], "scan_here")
    assert [r[0] for r in refused] == ["BAD", "EMPTY"]
    assert spark.sql("SELECT * FROM scan_here(TABLE(sql_none))").count() == 0
    register_scan(spark, [], "scan_here")
    spark.createDataFrame(FILES[:2], "project string, path string, content string, n int").createOrReplaceTempView("sql_files")
    assert spark.sql("SELECT * FROM scan_here(TABLE(sql_files))").count() == 0


def test_languages_as_the_jvm_sees_them(spark):
    names = ["a.java", "b/c.PY", "noext", ".env", "x.tar.gz", "a.b/c", "", "d/e.", "f.JS", "g.tsx", "h.unknownext", ".py"]
    got = spark.createDataFrame([(n,) for n in names], "path string").select(paths.detect_language(F.col("path")).alias("l"))
    assert [r.l for r in got.collect()] == [language_of(n) for n in names]
