"""Line-by-line work on one file at a time, inside Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from riskloom.functions.pieces import map_rows


def map_files(files: DataFrame, read, schema: str, where: Column | None = None) -> DataFrame:
    """Rows of `read(path, language, content)` for each file, led by its project and path.

    `where` is a JVM test that keeps files without anything to read out of Python.
    """
    from riskloom.operators.scan import with_language

    df = with_language(files)
    df = df if where is None else df.where(where)

    def each():
        return lambda project, path, language, content: ((project, path, *row) for row in read(path, language, content))

    return map_rows(df.select("project", "path", "language", "content"), each, f"project string, path string, {schema}")
