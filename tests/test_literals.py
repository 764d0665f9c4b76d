"""Required strings of patterns, and scans that rest on them, against plain searches of every rule in every text."""

import random
import re
import time

from hypothesis import given, settings, strategies as st

from riskloom.functions import literals
from riskloom.operators import scan
from riskloom.sources.rules import Rule

FLAGS = re.IGNORECASE | re.ASCII
PIECES = ["abc", "Key", r"\s*", r"\b", "(?:pass|passwd|secret)", r"\d{2,4}", "x?", ".", r"[^\n]{0,5}", "(foo|bar)", "(?:ab)+", "(?:q|)", "=", "é", r"(?=z)", "(?:(?:to|tok)en){1,2}", "$", "^"]
BITS = ["abc", "ABC", "key", "pass", "PASSWD", "secret", " ", "\n", "12", "345", "x", "foo", "BAR", "ab", "q", "=", "é", "z", "token", "TOTOKEN", "İ", "K", "𝄞"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=6), st.lists(st.sampled_from(BITS), max_size=40))
def test_same_matches_as_a_search_of_the_whole_text(parts, bits):
    pattern, text = "".join(parts), "".join(bits)
    need, compiled, folded = literals.needs(pattern), re.compile(pattern, FLAGS), literals.fold(text)
    want = [m.span() for m in compiled.finditer(text) if m.group()]
    assert len(folded) == len(text) and [m.span() for m in literals.matches(compiled, need, text, folded) if m.group()] == want
    if need.strings and want:
        assert literals.RuleFinder([(3, need)]).rules_in(folded) == [3]


def test_needs():
    assert literals.needs(r"Runtime\.exec\s?\(") == literals.Needs(("runtime.exec",), 14)
    assert literals.needs(r"(?:password|passwd|secret)\s*=").strings == ("passwd", "password", "secret")
    assert literals.needs(r"(?<!x)hello").width is None and literals.needs(r"^import os").width is None
    for nothing in (r"\d+", r"a|b", r"x?yz", r"(?:abc)?\w", "é" * 5):
        assert literals.needs(nothing).strings == ()


def made_rules(count, rnd):
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(count)]
    tails = [r"\s*\(", r"\b", r"[a-c]{0,3}", r"\s*=\s*\w+", r".*;"]
    rules = [Rule(f"R{i}", w + rnd.choice(tails), language=rnd.choice(["*", "java", "python"])) for i, w in enumerate(words)]
    return rules + [Rule("N1", r"\d{3,}"), Rule("N2", r"[x-z]\(", language="java")], words


def test_scan_equals_every_rule_on_every_text(spark):
    rnd = random.Random(8)
    rules, words = made_rules(120, rnd)
    ends = ["py", "java", "txt"]
    files = [("p", f"d/f{i}.{ends[i % 3]}", "".join(rnd.choice([rnd.choice(words), rnd.choice(words).upper(), "(", " = ", "\n", "12345", "x(", ";", "é"]) for _ in range(60))) for i in range(90)]
    df = scan.with_language(spark.createDataFrame(files, "project string, path string, content string"))
    got = sorted((r["path"], r["rule_id"], r["offset"], r["match"], r["line"]) for r in scan.scan_rules(df, rules).collect())
    want = []
    for r in df.collect():
        for rule in rules:
            if rule.language in ("*", r["language"]):
                want += [(r["path"], rule.rule_id, m.start(), m.group(), r["content"].count("\n", 0, m.start()) + 1) for m in re.finditer(rule.pattern, r["content"], FLAGS)]
    assert got == sorted(want) and len(want) > 1000


def test_time_hardly_grows_with_rules(spark):
    rnd = random.Random(9)
    rules, words = made_rules(400, rnd)
    text = " ".join("".join(rnd.choice("klmnopqrst") for _ in range(6)) for _ in range(20_000))
    folded = literals.fold(text)

    def took(some):
        finder = literals.RuleFinder([(i, literals.needs(r.pattern)) for i, r in enumerate(some)])
        t = time.perf_counter()
        for _ in range(20):
            finder.rules_in(folded)
        return time.perf_counter() - t

    took(rules[:40])
    assert took(rules[:400]) < 3 * took(rules[:40])
