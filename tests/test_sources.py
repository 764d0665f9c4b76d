from pyspark.sql import functions as F

from riskloom.sources import corpus, exports, history, manifests, rules


def test_read_corpus(spark, tmp_path):
    for name, text in {"p1/src/a.py": "x = 1\n", "p1/node_modules/b.js": "y", "p1/.hidden/c.py": "z", "p2/big.py": "q" * 400, "p2/pic.png": "n", "p2/ok.java": "class A {}"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = {(r.project, r.path) for r in corpus.read_corpus(spark, str(tmp_path), max_bytes=300).collect()}
    assert got == {("p1", "src/a.py"), ("p2", "ok.java")}
    assert corpus.oversized(spark, str(tmp_path), 300).count() == 1


def test_rule_files(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "vuln-profiles").mkdir()
    (tmp_path / "rules/py.yaml").write_text("language: python\ntaintTracking:\n  sinks:\n    - id: P1\n      category: command_exec\n      severity: HIGH\n"
                                            "      guidelines: {cwe: ['78']}\n      patterns: ['os\\.system', 'exec(']\n")
    (tmp_path / "vuln-profiles/s.yaml").write_text("sqli:\n  cwe: CWE-89\n  languages:\n    java:\n      riskPatterns: [{pattern: 'executeQuery'}]\n      safePatterns: ['Prepared']\n")
    good, bad = rules.load_rules(spark, str(tmp_path))
    assert {(r.rule_id, r.vuln_type, r.cwe, r.severity) for r in good} == {("P1", "COMMAND_INJECTION", "CWE-78", "high"), ("sqli", "SQLI", "CWE-89", "medium")}
    assert bad.count() == 1


def test_manifests(spark):
    files = [("p", "go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n", 0), ("p", "requirements.txt", "# c\nflask==2.0\nrequests>=1,<3\nplain\n", 0)]
    out = {(r.artifact, r.version) for r in manifests.parse_manifests(spark.createDataFrame(files, "project string, path string, content string, size long")).collect()}
    assert out == {("github.com/a/b", "v1.2.3"), ("flask", "2.0"), ("requests", "1"), ("plain", "any")}


def test_export_and_resume(spark, tmp_path):
    f = spark.createDataFrame([("a", "x.py", 1, "confirmed"), ("b", "y.py", 2, "false_positive")], "project string, file string, line int, verdict string")
    exports.export_findings(f, str(tmp_path / "out"))
    assert [r.project for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
    left = history.remaining_projects(f.select("project"), f.where("project = 'a'"))
    assert [r.project for r in left.collect()] == ["b"]


def test_second_run_scans_only_changes(spark):
    cols = "project string, path string, content string"
    old = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2")], cols)
    new = spark.createDataFrame([("p", "a", "1"), ("p", "b", "3"), ("p", "c", "4")], cols)
    assert sorted(r.path for r in history.changed_files(new, history.snapshot(old)).collect()) == ["b", "c"]
    assert history.project_hash(new).select(F.length("hash")).first()[0] == 32


def test_read_corpus_keeps_large_files_by_default(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "large.py").write_text("x = 1\n" * 100_000)
    assert [(r.path, r.size, len(r.content)) for r in corpus.read_corpus(spark, str(tmp_path)).collect()] == [("large.py", 600_000, 600_000)]
