from riskloom.operators import context

FINDING = "project string, severity string, location string, line int, vuln_type string, confidence double"
FILE = "project string, path string, content string, size long"

GUARDED = """import java.sql.*;
public class UserService {
  public User findUser(String name) {
    PreparedStatement stmt = conn.prepareStatement("SELECT * FROM users WHERE name = ?");
    stmt.setString(1, name);
    return stmt.executeQuery();
  }
}"""
UNGUARDED = """public class Unsafe {
  public void run(String input) {
    Runtime.getRuntime().exec(input);
  }
}"""
LITERAL = """public class Safe {
  public void run() {
    "SELECT * FROM users"
  }
}"""


def check(spark, location, line, vuln_type, confidence=None, content=None):
    f = spark.createDataFrame([("p", "high", location, line, vuln_type, confidence)], FINDING)
    files = spark.createDataFrame([("p", location, content, 0)] if content else [], FILE)
    rows = context.guard_context(f, files).collect()
    assert len(rows) == 1
    return rows[0]


def test_no_path_or_line_is_left_alone(spark):
    assert check(spark, None, None, "SQL_INJECTION").severity == "high"
    assert check(spark, "foo.js", 0, "SQL_INJECTION").guard is None


def test_test_paths(spark):
    r = check(spark, "src/test/foo.java", 10, "SQL_INJECTION")
    assert r.confidence < 0.5 and r.guard.is_test_file
    assert check(spark, "src/mock/auth.js", 5, "XSS").confidence < 0.5
    assert check(spark, "user.spec.ts", 5, "XSS").confidence < 0.5


def test_guard(spark):
    r = check(spark, "UserService.java", 4, "SQL_INJECTION", 0.9, GUARDED)
    assert r.confidence < 0.9 and r.guard.has_guard_pattern


def test_unguarded(spark):
    r = check(spark, "Unsafe.java", 3, "COMMAND_INJECTION", 0.9, UNGUARDED)
    assert r.confidence == 0.9 and not r.guard.has_guard_pattern


def test_literal(spark):
    r = check(spark, "Safe.java", 3, "SQL_INJECTION", 0.9, LITERAL)
    assert r.confidence < 0.9 and r.guard.has_string_literal_arg


def test_location_with_line(spark):
    f = spark.createDataFrame([("p", "high", "UserService.java:4", 4, "SQL_INJECTION", 0.9)], FINDING)
    files = spark.createDataFrame([("p", "UserService.java", GUARDED, 0)], FILE)
    assert context.guard_context(f, files).first().confidence == 0.3


def test_windows_hold_the_lines_around_and_no_text(spark):
    text = "\n".join(f"l{i}" for i in range(1, 41))
    files = spark.createDataFrame([("p", "a.java", text, 0), ("p", "empty.java", "", 0)], FILE)
    asked = [("a.java", 1), ("a.java", 20), ("a.java", 20), ("a.java", 40), ("a.java", 42), ("a.java", 60), ("a.java", 0), ("empty.java", 1), ("gone.java", 3)]
    found = spark.createDataFrame([("p", "high", f, n, "XSS", 0.5) for f, n in asked], FINDING)
    rows = context.with_windows(found, files, 3).collect()
    assert len(rows) == len(asked) and "_lines" not in rows[0].asDict()
    got = {(r._file, r._line): r._around for r in rows}
    whole = text.split("\n")
    for n in (1, 20, 40, 42, 60):
        assert got["a.java", n] == whole[max(n - 4, 0):n + 3]
    assert got["a.java", 0] == whole[:4] and got["empty.java", 1] == [""] and got["gone.java", 3] is None


def test_the_scan_carries_lines_characters_and_measures(spark):
    from pyspark.sql import functions as F

    from riskloom.operators.scan import scan_lines, scan_rules
    from riskloom.sources.rules import Rule

    text = "\n".join(["x"] * 5 + ["eval(a); eval(b)"] + ["y"] * 2)
    files = spark.createDataFrame([("p", "a.js", text, 0), ("p", "b.js", "nothing", 0)], FILE)
    rules = [Rule("R1", r"eval\s*\(")]
    a, b = scan_rules(files, rules, around=2, span=4, carry={"chars": F.length("content")}).orderBy("offset").collect()
    assert a._around == b._around == ["x", "x", "eval(a); eval(b)", "y", "y"] and a._from == 4 and a.chars == len(text)
    assert a._near == "x\nx\neval(a); " and b._near == "a); eval(b)\ny"
    assert scan_rules(files, [], around=2, span=4, carry={"chars": F.length("content")}).columns == scan_rules(files, rules, around=2, span=4, carry={"chars": F.length("content")}).columns
    row = scan_lines(files, rules, around=2).first()
    assert (row._around, row._from, row.line) == (a._around, 4, 6)
