"""Joins of sides that all grow with the corpus are shuffled."""

from riskloom.operators import context, filters, scan, taint, validate
from riskloom.sources.rules import Rule

RULES = [Rule("S", r"request\.args", kind="source", language="python", category="user_input"),
         Rule("K", r"os\.system\(", kind="sink", language="python", category="command_exec", vuln_type="COMMAND_INJECTION", severity="critical"),
         Rule("C", r"quote\(", kind="sanitizer", language="python", category="general")]


def _files(spark):
    text = "name = request.args['n']\nname = quote(name)\nos.system(name)\n"
    return spark.createDataFrame([("p", f"a{k}.py", text, len(text)) for k in range(20)], "project string, path string, content string, size long")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_and_windows_are_never_broadcast(spark):
    files = _files(spark)
    found = scan.make_findings(scan.scan_lines(files, [RULES[1]]), "quick_scan")
    for df in (context.guard_context(found, files), context.context_flags(found, files), validate.verify_path(found, files, strict=True)):
        assert "Broadcast" not in _plan(df) and df.count() == 20


def test_taint_sides_are_never_broadcast(spark):
    files = _files(spark)
    paths = taint.taint_paths(files, RULES)
    between = taint.sanitizer_between(paths, files, RULES)
    for df in (taint.taint_summary(paths, taint.taint_findings(paths)), between):
        assert "Broadcast" not in _plan(df)
    assert {(r["file"], tuple(r["sanitizer_lines"])) for r in between.collect()} == {(f"a{k}.py", (2,)) for k in range(20)}


def test_versions_snippets_and_chains_are_never_broadcast(spark):
    files = _files(spark)
    found = scan.make_findings(scan.scan_lines(files, [RULES[1]]), "quick_scan")
    nodes = found.select("project", "file", "line", "match").withColumnRenamed("match", "method")
    for df in (filters.incremental_skip(files, filters.changed_lines(files, files)), validate.validate_snippet(found, files), validate.verify_chain(nodes, files)):
        assert "Broadcast" not in _plan(df) and df.count() == 20
