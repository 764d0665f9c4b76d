"""Version order and affected ranges at their boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import versions
from riskloom.operators import advisories

ORDER = ["1.0-alpha1", "1.0-alpha-2", "1.0-beta", "1.0-M1", "1.0-rc1", "1.0-rc2", "1.0-SNAPSHOT", "1.0", "1.0-sp1", "1.0-xyz", "1.0.1-rc1", "1.0.1", "1.2", "1.10-beta", "1.10", "1.10.1", "2.9", "2.10.0-b1",
         "2.10", "2.10.0.1", "10.0", "20240101123000"]
SAME = [("2", "2.0.0"), ("2.0", "v2.0"), ("1.0.Final", "1"), ("^4.17.0", "4.17"), ("29.0-jre", "29"), ("1.2.3+build.7", "1.2.3"), ("1.0.0-RC1", "1-cr1"), ("01.02", "1.2")]


def keys_of(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "v string").select("v", versions.version_key(F.col("v")).alias("k")).collect()
    return {r["v"]: r["k"] for r in rows}


def test_order(spark):
    keys = keys_of(spark, ORDER + [v for p in SAME for v in p])
    assert sorted(ORDER, key=lambda v: keys[v]) == ORDER and len({keys[v] for v in ORDER}) == len(ORDER)
    assert all(keys[a] == keys[b] for a, b in SAME)
    assert set(keys_of(spark, ["any", "", "${log.version}", "latest"]).values()) == {None}


def test_numbers_sort_as_numbers(spark):
    rnd = random.Random(4)
    made = [[rnd.choice([0, 1, 2, 9, 10, 11, 99, 100, 10**12]) for _ in range(rnd.randint(1, 4))] for _ in range(300)]
    keys = keys_of(spark, list({".".join(map(str, m)) for m in made}))
    trim = lambda m: tuple(m[: max((i + 1 for i, x in enumerate(m) if x), default=0)])
    want = sorted(made, key=trim)
    assert [keys[".".join(map(str, m))] for m in want] == sorted(keys[".".join(map(str, m))] for m in made)


@pytest.mark.parametrize("version,affected,hit", [
    ("2.9.9", "[2.10,2.12]", False), ("2.10", "[2.10,2.12]", True), ("2.11.3", "[2.10,2.12]", True), ("2.12.0", "[2.10,2.12]", True), ("2.12.1", "[2.10,2.12]", False), ("2.10-rc1", "[2.10,2.12]", False),
    ("1.2.80", "(,1.2.80]", True), ("0.1", "(,1.2.80]", True), ("1.2.80", "(,1.2.80)", False), ("2.0-rc9", "[1.0,2.0)", True), ("2.0", "[1.0,2.0)", False), ("9", "[3.0,)", True), ("3.0", "(3.0,)", False),
    ("5.2.19", "[5.2.0, 5.2.19] , [5.3.0,5.3.17]", True), ("5.2.20", "[5.2.0,5.2.19],[5.3.0,5.3.17]", False), ("5.3.17", "[5.2.0,5.2.19],[5.3.0,5.3.17]", True), ("2.15.0", "[2.15.0]", True), ("2.15.1", "[2.15]", False),
    ("any", "(,9]", False)])
def test_boundaries(spark, version, affected, hit):
    deps = spark.createDataFrame([("p", "pom.xml", "g", "Lib", version), ("p", "a/pom.xml", "g", "Lib", version), ("q", "pom.xml", "g", "lib-core", version)],
                                 "project string, path string, group_id string, artifact string, version string")
    rules = spark.createDataFrame([("r", "CVE-1", "other lib", affected, "high", "99")], advisories.SCHEMA)
    got = [(r["project"], r["file"], r["component"]) for r in advisories.match_advisories(deps, rules).collect()]
    assert got == ([("p", "a/pom.xml", "g:Lib")] if hit else [])


def test_many_advisories_equal_a_plain_comparison(spark, tmp_path):
    rnd = random.Random(6)
    ver = lambda: [rnd.randint(0, 12) for _ in range(3)]
    text = lambda v: ".".join(map(str, v))
    rules = [(f"r{i}", f"CVE-{i}", f"lib{rnd.randrange(40)}", *sorted((ver(), ver()))) for i in range(3000)]
    table = spark.createDataFrame([(n, c, lib, f"[{text(a)},{text(b)})", "low", "x") for n, c, lib, a, b in rules], advisories.SCHEMA)
    table.write.parquet(str(tmp_path / "adv.parquet"))
    table.write.json(str(tmp_path / "adv"))
    uses = [(f"p{rnd.randrange(30)}", f"f{i}", "", f"lib{min(rnd.randrange(60), 39)}", ver()) for i in range(400)]
    deps = spark.createDataFrame([(*u[:4], text(u[4])) for u in uses], "project string, path string, group_id string, artifact string, version string")
    want = {(p, lib, c) for p, _, _, lib, v in uses for _, c, of, a, b in rules if of == lib and a <= v < b}
    for at in ("adv.parquet", "adv"):
        got = advisories.match_advisories(deps, advisories.read_advisories(spark, str(tmp_path / at))).collect()
        assert {(r["project"], r["component"], r["cve"]) for r in got} == want and len(got) == len(want)


def test_refused_and_built_in(spark):
    odd = spark.createDataFrame([("a", "C1", "x", "whenever", "low", ""), ("b", "C2", "", "[1,2]", "low", ""), ("c", "C3", "y", "[1,2]", "low", ""), ("d", "C4", "z", None, "low", "")], advisories.SCHEMA)
    assert sorted(r["cve"] for r in advisories.refused(odd).collect()) == ["C1", "C2", "C4"]
    assert advisories.refused(advisories.built_in(spark)).count() == 0 and len(advisories.ADVISORIES) > 50
