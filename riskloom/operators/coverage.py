"""What was reviewed, what was not, and where to look next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import paths
from riskloom.functions.ranking import first_per, top_n
from riskloom.functions.severity import round_half_up
from riskloom.operators.filters import file_tier

# Code extensions, names worth a look, attack classes, those of an extension, and sink words.
CODE = ["java", "py", "js", "ts", "go", "php", "rb", "cs", "cpp", "c", "rs", "kt", "swift", "scala"]
HIGH_SIGNAL = "controller|service|dao|repository|handler|route|auth|security|admin|api|endpoint|upload|file|config|util"
ATTACK_CLASSES = ["SQL_INJECTION", "COMMAND_INJECTION", "CODE_INJECTION", "DESERIALIZATION", "XSS", "SSRF", "XXE", "PATH_TRAVERSAL",
                  "AUTH_BYPASS", "IDOR", "HARDCODED_CREDENTIALS", "WEAK_CRYPTO", "INFO_LEAK", "FILE_UPLOAD", "SSTI", "SPEL_INJECTION",
                  "JNDI_INJECTION", "SESSION_FIXATION", "CORS_MISCONFIG", "OPEN_REDIRECT", "LOG_INJECTION", "REDOS"]
CLASSES_BY_EXTENSION = {
    "java": ["SQL_INJECTION", "COMMAND_INJECTION", "DESERIALIZATION", "SSRF", "XXE", "AUTH_BYPASS", "SSTI", "SPEL_INJECTION", "JNDI_INJECTION", "IDOR"],
    "py": ["SQL_INJECTION", "COMMAND_INJECTION", "DESERIALIZATION", "PATH_TRAVERSAL", "SSRF", "SSTI", "CODE_INJECTION"],
    "js": ["SQL_INJECTION", "COMMAND_INJECTION", "XSS", "PATH_TRAVERSAL", "SSRF", "CODE_INJECTION", "PROTOTYPE_POLLUTION"],
    "ts": ["SQL_INJECTION", "COMMAND_INJECTION", "XSS", "PATH_TRAVERSAL", "SSRF", "CODE_INJECTION"],
    "go": ["SQL_INJECTION", "COMMAND_INJECTION", "PATH_TRAVERSAL", "SSRF", "CODE_INJECTION"],
    "php": ["SQL_INJECTION", "COMMAND_INJECTION", "XSS", "PATH_TRAVERSAL", "FILE_UPLOAD", "DESERIALIZATION"],
    "cs": ["SQL_INJECTION", "COMMAND_INJECTION", "DESERIALIZATION", "XSS", "AUTH_BYPASS"],
    "cpp": ["COMMAND_INJECTION", "BUFFER_OVERFLOW", "PATH_TRAVERSAL", "CODE_INJECTION"],
}
OTHER_CLASSES = ["COMMAND_INJECTION", "SQL_INJECTION", "PATH_TRAVERSAL"]
SINK_WORDS = {
    "SQL_INJECTION": ["executeQuery", "executeUpdate", "createQuery", "Statement", "PreparedStatement", "JdbcTemplate", "query("],
    "COMMAND_INJECTION": ["Runtime.getRuntime", "ProcessBuilder", "exec(", "ProcessImpl"],
    "DESERIALIZATION": ["readObject", "ObjectInputStream", "Yaml.load", "parseObject", "readValue", "fromJson"],
    "PATH_TRAVERSAL": ["FileInputStream", "FileOutputStream", "File(", "Files.read", "Paths.get"],
    "SSRF": ["HttpClient", "RestTemplate", "URL.openConnection", "fetch(", "WebClient"],
    "SSTI": ["Thymeleaf", "templateEngine", "process(", "FreeMarker", "Velocity"],
    "JNDI_INJECTION": ["InitialContext", "lookup(", "JNDI"],
}


def is_code(path: Column) -> Column:
    return paths.extension(path).isin(CODE)


def is_high_signal(path: Column) -> Column:
    return F.lower(path).rlike(HIGH_SIGNAL)


def _reviewed(findings: DataFrame) -> DataFrame:
    return findings.select("project", F.col("file").alias("path"), "vuln_type")


def with_review(files: DataFrame, findings: DataFrame) -> DataFrame:
    """files(project, path, reviewed, classes): the reviewed set is limited to known files."""
    seen = _reviewed(findings).groupBy("project", "path").agg(F.count_distinct("vuln_type").alias("classes"))
    return files.select("project", "path").join(seen, ["project", "path"], "left").withColumn(
        "reviewed", F.col("classes").isNotNull()).withColumn("classes", F.coalesce("classes", F.lit(0)))


def coverage_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: files, reviewed files, unreviewed code files, percent, attack classes seen."""
    df = with_review(files, findings)
    per = df.groupBy("project").agg(F.count("*").alias("total_files"), F.count(F.when(F.col("reviewed"), 1)).alias("reviewed_files"),
                                    F.count(F.when(~F.col("reviewed") & is_code(F.col("path")), 1)).alias("unreviewed_files"))
    classes = _reviewed(findings).groupBy("project").agg(F.count_distinct("vuln_type").alias("attack_classes"))
    return per.join(classes, "project", "left").withColumn("attack_classes", F.coalesce("attack_classes", F.lit(0))).withColumn(
        "coverage_percent", round_half_up(F.col("reviewed_files") * 100.0 / F.col("total_files")))


def subsystem_coverage(files: DataFrame, findings: DataFrame) -> DataFrame:
    return with_review(files, findings).groupBy("project", paths.subsystem(F.col("path")).alias("subsystem")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("reviewed"), 1)).alias("reviewed"))


def unreviewed(files: DataFrame, findings: DataFrame, high_signal: bool = True, n: int | None = None) -> DataFrame:
    """Unreviewed code files per project (the first n, if asked), high-signal ones only by default."""
    df = with_review(files, findings).where(~F.col("reviewed") & is_code(F.col("path")))
    df = df.where(is_high_signal(F.col("path"))) if high_signal else df
    return (df if n is None else top_n(df, n, [F.col("path")], by=["project"])).select("project", "path")


def gap_targets(files: DataFrame, findings: DataFrame, urgent_t2: int | None = None) -> DataFrame:
    """Unreviewed code files with their tier, and whether they are urgent.

    Urgent are all T1 files; in a project without any, its T2 files (the first urgent_t2, if asked).
    """
    gaps = unreviewed(files, findings, False, None).withColumn("tier", file_tier(F.col("path")))
    t1 = gaps.where("tier = 'T1'").select("project").distinct()
    second = top_n(gaps.where("tier = 'T2'").join(t1, "project", "left_anti"), urgent_t2, [F.col("path")], by=["project"])
    urgent = gaps.where("tier = 'T1'").select("project", "path").unionByName(second.select("project", "path")).withColumn("urgent", F.lit(True))
    return gaps.join(urgent, ["project", "path"], "left").withColumn("urgent", F.coalesce("urgent", F.lit(False)))


def gap_summary(targets: DataFrame) -> DataFrame:
    per = targets.groupBy("project").agg(*[F.count(F.when(F.col("tier") == t, 1)).alias(f"missed_{t.lower()}") for t in ("T1", "T2", "T3")])
    text = (F.when(F.col("missed_t1") > 0, F.concat(F.col("missed_t1"), F.lit(" entry files not covered")))
            .when(F.col("missed_t2") > 0, F.concat(F.col("missed_t2"), F.lit(" service files not covered"))).otherwise("all priority files covered"))
    return per.withColumn("needs_gapfill", (F.col("missed_t1") > 0) | (F.col("missed_t2") > 0)).withColumn("summary", text)


def blind_spots(files: DataFrame, findings: DataFrame, classes: list[str] = ATTACK_CLASSES, n: int | None = None,
                targets: int | None = None) -> DataFrame:
    """(subsystem, attack class) never checked, plus classes that fit unreviewed files (of the first `targets` files,
    and the first n per project, if asked).

    The class list is a literal that is exploded, so there is no cross join.
    """
    sub = paths.subsystem(F.col("path"))
    subs = files.select("project", sub.alias("subsystem")).distinct()
    listed = F.array(*[F.lit(c) for c in classes])
    all_pairs = subs.select("project", "subsystem", F.posexplode(listed).alias("ord", "attack_class"))
    checked = _reviewed(findings).select("project", sub.alias("subsystem"), F.col("vuln_type").alias("attack_class")).distinct()
    never = all_pairs.join(checked, ["project", "subsystem", "attack_class"], "left_anti").select(
        "*", F.lit("never_checked").alias("reason"), F.lit(None).cast("string").alias("target_file"), F.lit(0).alias("pass"))
    few = unreviewed(files, findings, True, targets)
    ext, chain = paths.extension(F.col("path")), None
    for e, cs in CLASSES_BY_EXTENSION.items():
        arr = F.array(*[F.lit(c) for c in cs])
        chain = F.when(ext == e, arr) if chain is None else chain.when(ext == e, arr)
    fit = few.select("project", sub.alias("subsystem"), F.posexplode(chain.otherwise(F.array(*[F.lit(c) for c in OTHER_CLASSES]))).alias("ord", "attack_class"),
                     F.lit("unreviewed_file").alias("reason"), F.col("path").alias("target_file"), F.lit(1).alias("pass"))
    one = first_per(never.unionByName(fit), ["project", "subsystem", "attack_class"], ["pass", "target_file", "ord"])
    order = [F.col("pass"), F.col("subsystem"), F.col("ord"), F.col("attack_class")]
    out = one if n is None else top_n(one, n, order, by=["project"])
    return out.select("project", "subsystem", "attack_class", "reason", "target_file")


def gap_tasks(spots: DataFrame, files: DataFrame, findings: DataFrame, words: dict = SINK_WORDS, n: int | None = None,
              targets: int | None = None) -> DataFrame:
    """For each blind spot, target files that hold a sink word of its class, with the first line that does."""
    few = unreviewed(files, findings, True, targets)
    texts_ = files.join(few, ["project", "path"], "left_semi").select("project", "path", "content")
    # which classes a file speaks of is found in one pass over each text
    tests = []
    for c, ws in words.items():
        word = F.coalesce(*[F.when(F.col("content").contains(w), F.lit(w)) for w in ws])
        tests.append(F.when(word.isNotNull(), F.struct(F.lit(c).alias("attack_class"), word.alias("keyword"))))
    hits = texts_.select("project", "path", "content", F.explode(F.array_compact(F.array(*tests))).alias("h"))
    before = F.left("content", F.position(F.col("h.keyword"), F.col("content")) - 1)
    found = hits.select("project", "path", F.col("h.attack_class").alias("attack_class"), F.col("h.keyword").alias("keyword"),
                        (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).alias("line"))
    tasks = spots.join(found, ["project", "attack_class"]).where(F.col("target_file").isNull() | (F.col("target_file") == F.col("path")))
    out = tasks.select("project", "subsystem", "attack_class", F.col("path").alias("target"), "keyword", "line")
    return out if n is None else top_n(out, n, [F.col("subsystem"), F.col("attack_class"), F.col("target")], by=["project"])
