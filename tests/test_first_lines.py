"""Methods looked up in files by one automaton a file, against a plain search of every line for every node."""

import random

from riskloom.operators.validate import verify_chain

WORDS = ["Alpha", "alphabet", "bet", "É", "x.y", "", None, "a\nb", "missing", "ab"]


def plain(node, files):
    project, file, line, method, tag = node
    texts = [t for p, f, t in files if p == project and f == file and t is not None and project is not None]
    out = []
    for text in texts:
        lines = text.split("\n")
        if line is not None and 1 <= line <= len(lines):
            at = line
        else:
            at = next((i + 1 for i, x in enumerate(lines) if method is not None and method.lower() in x.lower()), None)
        out.append((*node, at, at is not None))
    return out or [(*node, None, False)]


def test_equals_a_plain_search(spark):
    rnd = random.Random(5)
    files = [(p, f"f{i}", "\n".join(" ".join(rnd.choices(["ALPHAbet", "bet", "é", "X.Y", "a", "b", "zz"], k=rnd.randint(0, 4))) for _ in range(rnd.randint(1, 9))))
             for i in range(12) for p in ("p", "q")]
    files += [("p", "empty", ""), ("p", "none", None), (None, "f1", "alpha"), files[0], ("p", "long", "x\n" * 200_000 + "alpha")]
    nodes = [(rnd.choice(["p", "q", None]), rnd.choice([f"f{i}" for i in range(13)] + ["empty", "none", "long", None]), rnd.choice([None, -1, 0, 3, 7, 50, 10**6]), rnd.choice(WORDS), rnd.randint(0, 3))
             for _ in range(600)]
    nodes += [("p", "f1", 99, "bet", 0)] * 300  # one file, one method asked of again and again
    got = verify_chain(spark.createDataFrame(nodes, "project string, file string, line int, method string, word int"),
                       spark.createDataFrame(files, "project string, path string, content string"))
    assert got.columns == ["project", "file", "line", "method", "word", "verified_line", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for n in nodes for r in plain(n, files)), key=key)


def test_empty_tables(spark):
    nodes = spark.createDataFrame([], "project string, file string, line int, method string")
    files = spark.createDataFrame([], "project string, path string, content string")
    assert verify_chain(nodes, files).count() == 0
    one = spark.createDataFrame([("p", "f", 1, "m")], nodes.schema)
    assert [tuple(r) for r in verify_chain(one, files).collect()] == [("p", "f", 1, "m", None, False)]
