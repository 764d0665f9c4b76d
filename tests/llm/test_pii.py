"""Personal data: base spans against a plain reading of the rules, learned spans, and odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def card(rnd, size):
    head = "".join(rnd.choice("0123456789") for _ in range(size - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def messy(rnd):
    bits = [lambda: "".join(rnd.choice("ab9._%+-@é𝄞 \n(") for _ in range(rnd.randint(0, 6))), lambda: card(rnd, rnd.randint(13, 20)), lambda: " ", lambda: "-", lambda: ".", lambda: "+",
            lambda: ".".join(str(rnd.randint(0, 300)) for _ in range(rnd.randint(2, 6))), lambda: f"+{rnd.randint(1, 99)} ({rnd.randint(0, 999):03}) {rnd.randint(0, 999):03}-{rnd.randint(0, 9999):04}",
            lambda: f"x{rnd.randint(0, 9)}@b.c{rnd.choice(['', '.d', '_e', '%', '-'])}", lambda: "0" * rnd.randint(1, 5), lambda: " ".join(re.findall("....", card(rnd, 16)))]
    return "".join(rnd.choice(bits)() for _ in range(rnd.randint(0, 14)))


def spans_of(rows):
    return {r["doc_id"]: [(s["start"], s["ord"], s["end"], s["base"]) for s in r["spans"]] for r in rows}


def test_base_spans_equal_the_rules(spark):
    rnd = random.Random(11)
    texts = [messy(rnd) for _ in range(1500)]
    got = spans_of(pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    for i, t in enumerate(texts):
        assert [(a, k, e) for a, k, e, b in got[i] if b] == plain(t), t
        taken = [(a, e) for a, _, e, b in got[i] if b]
        free = [(a, e) for a, _, e, b in got[i] if not b]
        assert all(e <= a2 or e2 <= a for a, e in free for a2, e2 in taken + [x for x in free if x != (a, e)])


def test_learned_spans_and_redaction(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        good = card(rnd, 16)
        bad = good[:-1] + str((int(good[-1]) + 1) % 10)
        phone = f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}"
        rows.append((i, f"text {good} and {bad} or {phone} end {rnd.randint(10**19, 10**20)} x"))
    rows += [(1000, f"call +1 (826) 555-4081 190.137.223.204 now"), (1001, f"{card(rnd, 16)} {card(rnd, 16)}"), (1002, "nothing here 1234567890123456 at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans_of(pii.find_spans(docs).collect())
    assert got[1000] == [(5, 3, 22, False), (23, 1, 38, True)]
    assert got[1001] == [(0, 2, 16, False), (17, 2, 33, False)] and got[1002] == []
    assert all([x[1] for x in got[i]] == [2, 3] for i in range(600))
    red = pii.find_spans(docs).join(docs, "doc_id").select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    by = {r["doc_id"]: r["t"] for r in red}
    assert by[1000] == "call [phone] [ip] now" and by[1002] == "nothing here 1234567890123456 at all" and "[card] and" in by[0]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "é𝄞 a@b.c"), (3, "é𝄞 a@b.c"), (4, "a." * 30_000 + "@"), (5, "a@" + "b." * 20_000 + "c"), (6, "9" * 60_000), (7, "+" + "1 " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("found", F.lit(2))
    got = pii.find_spans(docs)
    assert got.columns == ["doc_id", "spans"]
    by = sorted(((r["doc_id"], [(s["start"], s["ord"], s["end"]) for s in r["spans"]]) for r in got.collect()), key=str)
    assert by == sorted([(1, []), (2, []), (None, [(0, 0, 5)]), (3, [(3, 0, 8)]), (3, [(3, 0, 8)]), (4, []), (5, [(0, 0, 40_003)]), (6, []), (7, [])], key=str)
    assert pii.find_spans(docs.where("false")).count() == 0
    flat = pii.fit(pii.candidates(pii.find_matches(docs, "doc_id", "text")), F.lit(False))
    assert flat.threshold == {}


def test_query_equals_the_rules(spark):
    import os

    from riskloom.llm.queries import QUERIES

    folder = os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no tables")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op13_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in own) for n in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in own} <= set(r["spans"].split(","))
