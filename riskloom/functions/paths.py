"""Path and location parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom.dims import LANGUAGE_BY_EXTENSION, lookup

# Path segments that say nothing about the part of the system a file belongs to.
PLUMBING = ["src", "main", "java", "com", "python", "lib", "app", "api", "controller", "controllers",
            "routes", "services", "service"]


def clean(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def split_location(location: Column) -> Column:
    """struct(file, line, end_line, col) from `file`, `file:line`, `file:line:col` or `file:from-to`."""
    parts = F.split(F.coalesce(location, F.lit("")), ":")
    second = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    third = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))

    def number(text, pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")

    return F.struct(
        F.trim(F.element_at(parts, 1)).alias("file"),
        F.coalesce(number(second, r"^\s*(\d+)"), F.lit(0)).alias("line"),
        number(second, r"^\s*\d+\s*-\s*(\d+)").alias("end_line"),
        number(third, r"^\s*(\d+)").alias("col"),
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash, `` when there is none."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def depth(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", 0).otherwise(F.size(F.split(path, "/")))


def last_segments(path: Column, n: int = 3) -> Column:
    return F.lower(F.substring_index(path, "/", -n))


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; dotfiles and extension-less names give ``."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def detect_language(path: Column) -> Column:
    return lookup(LANGUAGE_BY_EXTENSION, extension(path), "unknown")


def subsystem(path: Column) -> Column:
    """First two telling path segments (no plumbing names, no segment holding a dot)."""
    parts = F.split(clean(path), "/")
    telling = F.filter(parts, lambda p: (p != "") & ~p.contains(".") & ~F.lower(p).isin(PLUMBING))
    return F.when(F.size(telling) > 0, F.array_join(F.slice(telling, 1, 2), "/")).otherwise(
        F.coalesce(F.nullif(F.element_at(parts, 1), F.lit("")), F.lit("unknown")))


def path_parts(path: Column) -> Column:
    return F.struct(basename(path).alias("basename"), directory(path).alias("directory"),
                    stem(path).alias("stem"), extension(path).alias("extension"),
                    depth(path).alias("depth"), last_segments(path).alias("tail"),
                    subsystem(path).alias("subsystem"), detect_language(path).alias("language"))


def glob_to_regex(glob: str) -> str:
    """Case-insensitive pattern of a file glob: `**` crosses directories, `*` and `?` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        ch = glob[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(ch) or (ch if ch.isalnum() or ch in "/_-" else "\\" + ch)
        i += 1
    return "(?i)^" + out + "$"
