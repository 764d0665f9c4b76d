"""Uses of input names: whole names only, equal to a plain sweep over lines."""

import random
import re

from riskloom.operators import taint
from riskloom.sources.rules import Rule

RULES = [Rule("S", r"input\(", kind="source", category="user_input"), Rule("K", r"exec\(", kind="sink", category="command_exec"), Rule("C", r"clean\(", kind="sanitizer", category="x")]


def plain(files):
    out = set()
    for project, path, content in files:
        lines = content.split("\n")
        names = [re.findall(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b", x, re.A) for x in lines]
        for s, x in enumerate(lines):
            if not re.search(r"input\(", x):
                continue
            uses = [(n, u) for n in names[s] for u in range(s + 1, len(lines)) if n in names[u]]
            for k in range(s + 1, len(lines)):
                steps = [(n, u) for n, u in uses if u <= k]
                if re.search(r"exec\(", lines[k]) and steps:
                    gain = lambda t: (0.15 if "+" in t or "${" in t else 0) + (0.1 if "(" in t and ")" in t else 0) - (0.3 if "clean(" in t else 0)
                    sure = min(1, max(0, 0.7 + sum(gain(lines[u]) for _, u in steps)))
                    out.add((project, path, s + 1, k + 1, len(steps), any("clean(" in lines[u] for _, u in steps), round(sure, 6), ",".join(sorted({n for n, _ in steps}))))
    return out


def found(spark, files):
    df = spark.createDataFrame(files, "project string, path string, content string")
    return {(r["project"], r["file"], r["source_line"], r["sink_line"], r["steps"], r["is_sanitized"], round(r["confidence"], 6), ",".join(sorted(r["variables"])))
            for r in taint.taint_paths(df, RULES).collect()}


def test_whole_names_only(spark):
    files = [("p", "a.py", "id = input()\nwidth = 3\nexec(width)"), ("p", "b.py", "id = input()\nx = id\nexec(x)")]
    assert {x[1] for x in found(spark, files)} == {"b.py"}


def test_equals_a_plain_sweep(spark):
    rnd = random.Random(12)
    names = ["id", "width", "a", "ab", "a_b", "x1", "é"]
    make = lambda: rnd.choice(["{0} = input({1})", "{0} = {1} + {0}", "exec({0})", "clean({1})", "{0} {0} {1}", "", "call({0}, '${{{1}}}')"]).format(rnd.choice(names), rnd.choice(names))
    files = [("p" if i % 2 else "q", f"f{i}.py", "\n".join(make() for _ in range(rnd.randint(0, 25)))) for i in range(200)]
    want = plain(files)
    assert found(spark, files) == want and len(want) > 200


def test_odd_files(spark):
    assert found(spark, [("p", "a.py", None), ("p", "b.py", ""), ("p", "c.py", "input()")]) == set()
