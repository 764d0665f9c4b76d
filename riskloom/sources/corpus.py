"""Reading text: directories, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions import paths

# What a code corpus takes in and leaves out by default.
CODE_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "json", "yml", "yaml", "env", "php", "py", "go", "java",
                   "rb", "cs", "rs", "cpp", "cc", "c", "h", "hpp"]
IGNORED_DIRECTORIES = [".git", "node_modules", "dist", "build", ".next", ".nuxt", "coverage", "vendor", "target",
                       "bin", "obj", "__pycache__"]
MAX_BYTES = 250_000


def read_corpus(spark: SparkSession, root: str, max_bytes: int | None = None, extensions: list[str] | None = None,
                ignore: list[str] | None = None, project_depth: int = 1) -> DataFrame:
    """files(project, path, content, size, modified) below a directory or object-store prefix.

    Files of any size, or of at most `max_bytes`; that limit is pushed to the file listing, so larger files are never opened. The first
    `project_depth` segments below the root name the project.
    """
    exts = extensions or CODE_EXTENSIONS
    skipped = IGNORED_DIRECTORIES if ignore is None else ignore
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    base = root.rstrip("/")
    base = base.split("://", 1)[1] if "://" in base else base
    relative = F.ltrim(F.substring_index(F.col("path"), base, -1), F.lit("/"))
    parts = F.split(relative, "/")
    return (raw.withColumn("_rel", relative)
            .where(F.lower(paths.extension(F.col("_rel"))).isin(exts) | F.col("_rel").rlike(r"(^|/)\.env(\.|$)"))
            .where(~F.exists(parts, lambda p: p.isin(skipped)))
            .where(~F.col("_rel").rlike(r"(^|/)\.(?!env(\.|$))[^/]*"))
            .select(F.array_join(F.slice(parts, 1, project_depth), "/").alias("project"),
                    F.array_join(F.slice(parts, project_depth + 1, F.greatest(F.size(parts) - project_depth, F.lit(1))),
                                 "/").alias("path"),
                    F.decode(F.col("content"), "UTF-8").alias("content"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("modified")))


def oversized(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What `read_corpus` leaves out under that size limit; only the listing is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .where(F.col("length") > max_bytes).select("path", F.col("length").alias("size")))


def read_corpus_table(df: DataFrame, mapping: dict) -> DataFrame:
    """files(project, path, content, size) from any table.

    `mapping` gives a column name or expression for project, path and content.
    """
    def col(value):
        return F.expr(value) if isinstance(value, str) else value

    content = col(mapping["content"])
    return df.select(col(mapping["project"]).alias("project"), col(mapping["path"]).alias("path"),
                     content.alias("content"),
                     (col(mapping["size"]) if "size" in mapping else F.octet_length(content)).cast("long").alias("size"))


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Small inputs in few pieces dealt out to all cores before heavy per-text work; large inputs stay as they are."""
    wanted = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def explode_lines(files: DataFrame) -> DataFrame:
    """lines(project, path, line_no, line); every file has at least one line."""
    return files.select("project", "path", F.posexplode(F.split("content", "\n", -1)).alias("_p", "line")).select(
        "project", "path", (F.col("_p") + 1).alias("line_no"), "line")
