"""De-duplication and numbering of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import dims
from riskloom.functions import paths, severity
from riskloom.functions.ranking import first_per, numbered

TIES = ["file", "offset", "rule_id"]


def line_of(df: DataFrame) -> Column:
    """The line column, or the one in `location`, or 0."""
    parsed = paths.split_location(F.col("location"))["line"] if "location" in df.columns else F.lit(0)
    if "line" not in df.columns:
        return parsed
    return F.coalesce(F.nullif(F.col("line"), F.lit(0)), parsed, F.lit(0))


def file_of(df: DataFrame) -> Column:
    source = F.col("location") if "location" in df.columns else F.col("file")
    if "file" in df.columns:
        source = severity.or_default(source, F.col("file"))
    return F.trim(F.element_at(F.split(F.coalesce(source, F.lit("")), ":"), 1))


def dedup_findings(df: DataFrame, key: str = "type-location-line", keep_sources: bool = False,
                   by_path: bool = False) -> DataFrame:
    """One finding per (type, file name, 5-line bucket[, source]).

    Within a key, rows go by line, then by falling confidence; the first stays until a row with a
    deeper path or a higher confidence replaces it. Rows of one line share one outcome: a line
    takes over when its best confidence or its deepest path beats the current row, and what it
    leaves is its first row of greatest depth. So each (key, line) shrinks to one row with
    map-side combined aggregates, and only the at most five lines of a bucket are folded.
    Keys with a location hold one line.
    """
    project = [c for c in ("project",) if c in df.columns]
    ties = [c for c in TIES if c in df.columns]
    base = (df.withColumn("_line", line_of(df)).withColumn("_file", file_of(df))
            .withColumn("_conf", F.coalesce(F.col("confidence"), F.lit(0.0)))
            .withColumn("_depth", paths.depth(F.col("_file"))))
    if key == "title-location":
        keys = [F.col("title"), F.col("location")]
    elif key == "type-location":
        keys = [F.col("vuln_type"), F.col("location")]
    else:
        name = F.lower(F.col("_file") if by_path else paths.basename(F.col("_file")))
        keys = [F.col("vuln_type"), name, F.floor(F.col("_line") / 5) * 5]
        if keep_sources:
            keys.append(F.coalesce(F.col("source"), F.lit("unknown")))
    names = []
    for i, k in enumerate(keys):
        names.append(f"_k{i}")
        base = base.withColumn(f"_k{i}", F.coalesce(k.cast("string"), F.lit("")))
    row = F.struct(*df.columns)
    order = F.struct(-F.col("_depth"), -F.col("_conf"), *[F.col(t) for t in ties])
    per_line = base.groupBy(*project, *names, "_line").agg(
        F.min_by(row, order).alias("row"), F.max("_conf").alias("top"), F.max("_depth").alias("depth"),
        F.min_by("_conf", order).alias("conf"))
    steps = F.sort_array(F.collect_list(F.struct("_line", "top", "depth", "conf", "row")))
    grouped = per_line.groupBy(*project, *names).agg(steps.alias("steps"))
    # fold with 1-based positions so that the accumulator is a plain number
    last = F.aggregate(
        F.sequence(F.lit(2), F.size("steps") + 1), F.lit(1),
        lambda at, i: F.when(i > F.size("steps"), at)
        .when((F.element_at("steps", F.least(i, F.size("steps")))["top"] > F.element_at("steps", at)["conf"])
              | (F.element_at("steps", F.least(i, F.size("steps")))["depth"] > F.element_at("steps", at)["depth"]), i)
        .otherwise(at))
    kept = grouped.select(F.element_at("steps", last)["row"].alias("r"))
    return kept.select("r.*")


def dedup_best_confidence(df: DataFrame) -> DataFrame:
    """Same key; the highest confidence wins, the earliest row among equals."""
    name = F.lower(paths.basename(file_of(df)))
    bucket = F.floor(line_of(df) / 5) * 5
    keyed = df.withColumn("_key", F.md5(F.concat_ws("|", name, F.coalesce("vuln_type", F.lit("")), bucket)))
    keys = [c for c in ("project",) if c in df.columns] + ["_key"]
    order = [-F.coalesce(F.col("confidence"), F.lit(0.0)), "line", *[t for t in TIES if t in df.columns]]
    return first_per(keyed, keys, order).drop("_key")


def dedup_best_severity(df: DataFrame) -> DataFrame:
    """Key (type, line, evidence): strictly higher severity wins."""
    keyed = df.withColumn("_evidence", F.coalesce("evidence", F.lit("")))
    keys = [c for c in ("project",) if c in df.columns] + ["vuln_type", "line", "_evidence"]
    order = [-severity.severity_rank(F.col("severity")), *[t for t in TIES if t in df.columns]]
    return first_per(keyed, keys, order).drop("_evidence")


def exact_distinct(df: DataFrame, model_sources: tuple = ("llm", "gapfill")) -> DataFrame:
    """One row per (file, line, type); a model finding is preferred, then the earliest row."""
    keyed = df.withColumn("_file", file_of(df)).withColumn("_line", line_of(df))
    keys = [c for c in ("project",) if c in df.columns] + ["_file", "_line", "vuln_type"]
    order = [F.when(F.col("source").isin(*model_sources), 0).otherwise(1),
             -severity.severity_rank(F.col("severity")), -F.coalesce(F.col("confidence"), F.lit(0.0)),
             "source", *[t for t in TIES if t in df.columns]]
    return first_per(keyed, keys, order).drop("_file", "_line")


# Id codes matched by substring, first entry first.
SUBSTRING_CODES = [
    ("SQL_INJECTION", "SQL"), ("SQLI", "SQL"), ("SQL", "SQL"), ("COMMAND_INJECTION", "CMD"), ("CMD_INJECTION", "CMD"),
    ("CMD", "CMD"), ("CODE_INJECTION", "CODE"), ("CODE", "CODE"), ("PATH_TRAVERSAL", "FILE"), ("PATH_TRAV", "FILE"),
    ("FILE", "FILE"), ("FILE_READ", "READ"), ("FILE_WRITE", "WRITE"), ("UPLOAD", "UPLOAD"), ("XSS", "XSS"),
    ("STORED_XSS", "XSS"), ("REFLECTED_XSS", "XSS"), ("SSRF", "SSRF"), ("CSRF", "CSRF"), ("XXE", "XXE"),
    ("DESERIALIZATION", "DESER"), ("DESER", "DESER"), ("AUTH_BYPASS", "AUTH"), ("IDOR", "IDOR"), ("AUTH", "AUTH"),
    ("OPEN_REDIRECT", "REDIR"), ("REDIR", "REDIR"), ("CRLF_INJECTION", "CRLF"), ("CRLF", "CRLF"),
    ("WEAK_CRYPTO", "CRYPTO"), ("WEAK_HASH", "CRYPTO"), ("SESSION_FIXATION", "SESS"), ("SESS", "SESS"),
    ("HARD_CODE_PASSWORD", "SECRET"), ("SECRET", "SECRET"), ("LOGIC_FLAW", "LOGIC"), ("LOGIC", "LOGIC"),
    ("NOSQL_INJECTION", "NOSQL"), ("NOSQL", "NOSQL"),
]


def substring_code(vuln_type: Column) -> Column:
    upper = F.upper(F.coalesce(vuln_type, F.lit("")))
    return F.coalesce(*[F.when(upper.contains(k), F.lit(v)) for k, v in SUBSTRING_CODES], F.lit("LOGIC"))


def assign_ids(df: DataFrame, scheme: str = "table") -> DataFrame:
    """vuln_id `{C/H/M/L}-{CODE}-{NNN}`, numbered per project in file, line, offset, rule order.

    `table` looks the code up per type (else VULN); `substring` takes the first code whose name
    occurs in the type (else LOGIC). Numbers past 999 just get wider.
    """
    if scheme == "table":
        codes = dims.type_dim(df.sparkSession).select("vuln_type", "id_code")
        coded = df.join(F.broadcast(codes), "vuln_type", "left").withColumn(
            "_code", F.coalesce("id_code", F.lit("VULN"))).drop("id_code")
    else:
        coded = df.withColumn("_code", substring_code(F.col("vuln_type")))
    coded = (coded.withColumn("_prefix", severity.severity_prefix(F.col("severity")))
             .withColumn("_dir", paths.directory(F.col("file"))).withColumn("_name", paths.basename(F.col("file"))))
    project = [c for c in ("project",) if c in df.columns]
    order = ["line", *[c for c in ("offset", "rule_id", "match") if c in df.columns]]
    ranked = numbered(coded, project + ["_prefix", "_code"], ["_dir", "_name"], order, "_nr")
    width = F.greatest(F.lit(3), F.length(F.col("_nr").cast("string")))
    return ranked.withColumn("vuln_id", F.concat_ws("-", "_prefix", "_code", F.lpad(F.col("_nr").cast("string"), width, F.lit("0")))
                             ).select(*df.columns, "vuln_id")


def sort_by_severity(df: DataFrame) -> DataFrame:
    return df.orderBy(severity.severity_rank(F.col("severity")).desc(),
                      F.coalesce("confidence", F.lit(0.0)).desc(), "file", "line")


def rank_findings(df: DataFrame, cvss: str = "cvss") -> DataFrame:
    """Severity (critical first), confidence, CVSS."""
    return df.orderBy(severity.severity_rank(F.col("severity")).desc(), F.coalesce("confidence", F.lit(0.0)).desc(),
                      F.coalesce(cvss, F.lit(0.0)).desc(), "file", "line")


def new_only(new: DataFrame, old: DataFrame, title_chars: int = 40) -> DataFrame:
    """New findings whose (location, start of title) is not known yet."""
    def keyed(df):
        return [F.coalesce("location", F.lit("")).alias("_l"), F.left(F.coalesce("title", F.lit("")), F.lit(title_chars)).alias("_t")]

    return (new.select("*", *keyed(new)).join(old.select(*keyed(old)).distinct(), ["_l", "_t"], "left_anti").drop("_l", "_t"))


def existing_keys(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def update_status(findings: DataFrame, validated: DataFrame) -> DataFrame:
    """Findings overwritten, as whole rows, by the validated row of the same (file, line, type or title)."""
    def key(df):
        return F.concat_ws(":", severity.or_default(file_of(df), "unknown"), line_of(df),
                           severity.or_default(F.col("vuln_type"), severity.or_default(F.col("title"), "unknown")))

    cols = findings.columns
    new = validated.withColumn("_key", key(validated))
    extra = [c for c in validated.columns if c not in cols]
    new = first_per(new, ["_key"], [c for c in ("file", "rule_id", "offset") if c in validated.columns] or ["title"])
    new = new.select("_key", F.struct(*validated.columns).alias("_new"))
    joined = findings.withColumn("_key", key(findings)).join(new, "_key", "left")
    out = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
           if c in validated.columns else F.col(c) for c in cols]
    return joined.select(*out, *[F.col(f"_new.{c}").alias(c) for c in extra])


def severity_floor_cap(df: DataFrame, floor: str = "low", per_file: int | None = None) -> DataFrame:
    """At least this severe; the report lists at most `per_file` findings of one file, the worst first."""
    from riskloom.functions.ranking import top_n

    rank = severity.severity_rank(F.col("severity"))
    kept = df.where(rank >= severity.RANKS.get(floor, 0))
    return top_n(kept, per_file, [rank.desc(), F.coalesce("confidence", F.lit(0.0)).desc(), "line", "rule_id"],
                 by=[c for c in ("project", "file") if c in df.columns])
