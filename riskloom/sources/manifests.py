"""Dependencies from build files, all as column expressions over whole files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import paths

DEP_COLUMNS = ["project", "path", "ecosystem", "group_id", "artifact", "version", "scope", "dev"]


def _resolve(version: Column, keys: Column, values: Column, opening: str, closing: str, reference: str) -> Column:
    """Placeholders replaced by the last definition of their key; unknown ones stay."""
    names = F.regexp_extract_all(version, F.lit(reference), F.lit(1))
    # definitions reversed, so the first hit is the last one written
    back_k, back_v = F.reverse(keys), F.reverse(values)

    def one(acc, name):
        at = F.array_position(back_k, name).cast("int")
        return F.when(at > 0, F.replace(acc, F.concat(F.lit(opening), name, F.lit(closing)), F.element_at(back_v, at))).otherwise(acc)

    return F.aggregate(names, version, one)


def _tag(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, f"<{name}>([^<]+)</{name}>", 1))


def parse_pom(files: DataFrame) -> DataFrame:
    """pom.xml: properties resolved, test and provided scopes left out."""
    section = F.regexp_extract("content", r"(?s)<properties>(.*?)</properties>", 1)
    pair = r"<([^>]+)>([^<]+)</\1>"
    df = files.where(paths.basename(F.col("path")) == "pom.xml").select(
        "project", "path", F.transform(F.regexp_extract_all(section, F.lit(pair), F.lit(1)), lambda x: F.trim(x)).alias("k"),
        F.transform(F.regexp_extract_all(section, F.lit(pair), F.lit(2)), lambda x: F.trim(x)).alias("v"),
        F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    version = _resolve(_tag(F.col("d"), "version"), F.col("k"), F.col("v"), "${", "}", r"\$\{([^}]+)\}")
    scope = F.coalesce(F.nullif(_tag(F.col("d"), "scope"), F.lit("")), F.lit("compile"))
    out = df.select("project", "path", F.lit("maven").alias("ecosystem"), _tag(F.col("d"), "groupId").alias("group_id"),
                    _tag(F.col("d"), "artifactId").alias("artifact"), F.trim(version).alias("version"), scope.alias("scope"),
                    F.lit(False).alias("dev"))
    return out.where(~F.col("scope").isin("test", "provided") & (F.col("group_id") != "") & (F.col("artifact") != "")).distinct()


def parse_gradle(files: DataFrame) -> DataFrame:
    """build.gradle: three-part coordinates of the run-time configurations, ext variables resolved."""
    section = F.regexp_extract("content", r"ext\s*\{([^}]+)\}", 1)
    pair = r"""(\w+)\s*=\s*["'](.+?)["']"""
    call = r"""(?:implementation|api|compile|runtimeOnly|annotationProcessor)\s*\(?\s*["']([^"']+)["']"""
    df = files.where(paths.basename(F.col("path")).isin("build.gradle", "build.gradle.kts")).select(
        "project", "path", F.regexp_extract_all(section, F.lit(pair), F.lit(1)).alias("k"),
        F.regexp_extract_all(section, F.lit(pair), F.lit(2)).alias("v"),
        F.explode(F.regexp_extract_all("content", F.lit(call), F.lit(1))).alias("d"))
    parts = F.split(_resolve(F.col("d"), F.col("k"), F.col("v"), "$", "", r"\$(\w+)"), ":")
    return df.select("project", "path", F.lit("gradle").alias("ecosystem"), parts.alias("p")).where(F.size("p") >= 3).select(
        "project", "path", "ecosystem", *[F.trim(F.element_at("p", i)).alias(n) for i, n in ((1, "group_id"), (2, "artifact"), (3, "version"))],
        F.lit("compile").alias("scope"), F.lit(False).alias("dev"))


def _named(df: DataFrame, ecosystem: str, name: Column, version: Column, dev: Column | None = None) -> DataFrame:
    return df.select("project", "path", F.lit(ecosystem).alias("ecosystem"), F.lit("").alias("group_id"), name.alias("artifact"),
                     version.alias("version"), F.lit("compile").alias("scope"), (dev if dev is not None else F.lit(False)).alias("dev"))


def parse_manifests(files: DataFrame) -> DataFrame:
    """package.json, go.mod and requirements.txt."""
    name = paths.basename(F.col("path"))
    pkg = files.where(name == "package.json").select("project", "path", F.from_json(
        "content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    node = [_named(pkg.select("project", "path", F.explode(f"j.{field}").alias("n", "v")), "npm", F.col("n"), F.col("v"), F.lit(dev))
            for field, dev in (("dependencies", False), ("devDependencies", True))]
    line = r"(?m)^\s+(\S+)\s+(v\S+)"
    go = files.where((name == "go.mod") & F.col("content").contains("require")).select("project", "path", F.explode(F.arrays_zip(
        F.regexp_extract_all("content", F.lit(line), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(line), F.lit(2)).alias("v"))).alias("d"))
    req = files.where(name.rlike(r"requirements.*\.txt$")).select("project", "path", F.explode(F.split("content", "\n")).alias("l")).where(
        (F.trim("l") != "") & ~F.col("l").startswith("#"))
    version = F.regexp_extract("l", r"[=<>!~]+\s*([^,;\s]+)", 1)
    py = _named(req, "pypi", F.trim(F.regexp_extract("l", r"^\s*([^=<>!~;\s\[]+)", 1)),
                F.coalesce(F.nullif(version, F.lit("")), F.lit("any")))
    return reduce(DataFrame.unionByName, [*node, _named(go, "go", F.col("d.n"), F.col("d.v")), py])


def parse_dependencies(files: DataFrame) -> DataFrame:
    """deps(project, path, ecosystem, group_id, artifact, version, scope, dev, coordinate) from every known build file."""
    both = reduce(DataFrame.unionByName, [parse_pom(files), parse_gradle(files), parse_manifests(files)])
    return both.withColumn("coordinate", F.concat_ws(":", F.nullif("group_id", F.lit("")), "artifact", "version"))
