"""Classes, methods, fields and functions, and the graphs between them."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.durable import durable
from riskloom.functions.perfile import map_files
from riskloom.functions.ranking import top_n
from riskloom.functions.source_text import PARENS, Lines, blanked, closing_brace, indented_end, split_list
from riskloom.operators.reach import reach

SYMBOLS = ("kind string, name string, owner string, package string, type string, supers array<string>, "
           "params array<struct<type:string,name:string>>, line int, end_line int, modifiers array<string>")

MODIFIERS = ["public", "private", "protected", "static", "abstract", "final", "export"]
# What the first words of a class, method and field look like, per language. Groups: words, type, name, supers.
JAVA_WORDS = r"(?P<words>(?:(?:public|private|protected|static|abstract|final)\s+)*+)"
JAVA_TYPE = r"(?P<type>[a-zA-Z<>\[\]0-9.]++)\s+"
JAVA = {"class": JAVA_WORDS + r"(?P<type>class|interface|enum)\s+(?P<name>\w+)(?P<supers>[^{\n]*)",
        "method": JAVA_WORDS + r"(?!(?:return|new|throw|else)\b)" + JAVA_TYPE + r"(?P<name>\w+)\s*\(",
        "field": JAVA_WORDS + r"(?!(?:return|throw|package|import)\b)" + JAVA_TYPE + r"(?P<name>\w+)\s*(?:=[^;]*)?;"}
JS_WORDS = r"(?P<words>(?:static\s+)?+)"
JS = {"class": r"(?P<words>(?:(?:export|default)\s+)*+)(?P<type>class)\s+(?P<name>\w+)(?P<supers>[^{\n]*)",
      "method": r"(?![^\n]*(?:=|function))" + JS_WORDS + r"(?P<name>\w+)\s*\(",
      "field": r"(?![^\n]*(?:\(|function))" + JS_WORDS + r"(?P<name>\w+)\s*[?:][^\n]*\S"}
PYTHON = {"class": r"(?P<type>class)\s+(?P<name>\w+)(?:\s*\((?P<supers>[^)]*)\))?",
          "method": r"(?P<words>(?:async\s+)?+)def\s+(?P<name>\w+)\s*\(",
          "field": r"(?P<name>[^\s=:@#()\[\]{},]++)\s*(?::[^=\n]*)?=(?!=)"}
MEMBERS = {language: {kind: re.compile(r"^[ \t]*+" + pattern, re.A | re.M) for kind, pattern in table.items()}
           for language, table in (("java", JAVA), ("javascript", JS), ("typescript", JS), ("python", PYTHON))}
SUPERS = re.compile(r"\b(?:extends|implements)\s+((?:(?!\b(?:extends|implements)\b)[\w.,<>\s])+)", re.A)
PACKAGE = re.compile(r"^\s*package\s+([a-zA-Z0-9.]+)\s*;", re.M)
PARAM = {"java": re.compile(r"(?:@\w+(?:\([^)]*\))?\s+|final\s+)*(?P<type>[\w.]+(?:<.*>)?(?:\[\]|\.\.\.)*)\s+(?P<name>\w+)$", re.A),
         "other": re.compile(r"[*.]*(?P<name>\w+)\??(?:\s*:\s*(?P<type>\w+))?", re.A)}


def _params(inside: str, language: str) -> list[dict]:
    out = []
    for part in split_list(inside):
        m = PARAM.get(language, PARAM["other"]).match(part)
        if m and not (language == "python" and part in ("self", "cls")):
            out.append({"type": m.group("type") or "any", "name": m.group("name")})
        elif not m:
            out.append({"type": "any", "name": part.split("=")[0].strip()})
    return out


def _supers(text: str | None, language: str) -> list[str]:
    if language == "python":
        return [p for p in split_list(text or "") if "=" not in p]
    return [re.sub(r"<.*", "", p, flags=re.S) for group in SUPERS.findall(text or "") for p in split_list(group)]


def _read(path, language, content):
    """Every pattern over the whole file; a member goes to the last class that starts above it."""
    text, bare = blanked(content, language), blanked(content, language, strings=True)
    lines, found = Lines(content), {k: list(p.finditer(text)) for k, p in MEMBERS[language].items()}
    starts = [m.start("name") for m in found["class"]]
    package = PACKAGE.search(text) if language == "java" else None
    for kind, hits in found.items():
        for m in hits:
            got, line = m.groupdict(), lines.at(m.start("name"))
            above = bisect_right(starts, m.start("name")) - 1
            if above < 0:
                continue
            inside = PARENS.match(text, m.end() - 1) if kind == "method" else None
            end = None
            if kind == "class" and language == "python":
                end = indented_end(lines, line)
            elif kind == "class":
                brace = closing_brace(bare, m.end("name"))
                end = lines.at(brace) if brace >= 0 else None
            words = (got.get("words") or "").split()
            yield (kind, got["name"], found["class"][above].group("name"), package.group(1) if package else "", got.get("type") or "any",
                   _supers(got.get("supers"), language), _params(inside.group(1), language) if inside else [], line, end,
                   [w for w in MODIFIERS if w in words])


def symbols(files: DataFrame) -> DataFrame:
    """symbols(project, path, kind, name, owner, package, type, supers, params, line, end_line, modifiers)
    of Java, JavaScript, TypeScript and Python, by patterns over lines without comments. owner is the last class that
    starts above a member; end_line is the line of a class's closing brace, or the last line indented under it."""
    return map_files(files, _read, SYMBOLS, F.col("language").isin("java", "javascript", "typescript", "python"))


def symbol_stats(symbols_: DataFrame) -> DataFrame:
    return symbols_.groupBy("project").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in
                                             (("class", "classes"), ("method", "methods"), ("field", "fields"))])


def symbol_search(symbols_: DataFrame, cls: str | None = None, method: str | None = None, field: str | None = None,
                  pattern: str | None = None) -> DataFrame:
    """A class, a member (also inherited when a class is given), or every class whose name matches."""
    if pattern:
        full = F.concat_ws(".", F.nullif("package", F.lit("")), "name")
        return symbols_.where((F.col("kind") == "class") & (F.col("name").rlike("(?i)" + pattern) | full.rlike("(?i)" + pattern)))
    name, kind = (method, "method") if method else (field, "field")
    if name is None:
        return symbols_.where((F.col("kind") == "class") & (F.col("name") == cls))
    found = symbols_.where((F.col("kind") == kind) & (F.col("name") == name))
    if not cls:
        return found.withColumn("inherited", F.lit(False))
    own = symbols_.where((F.col("kind") == "class") & (F.col("name") == cls)).select("project", F.col("name").alias("owner"))
    up = class_hierarchy(symbols_, "super", classes=own.select("project", F.col("owner").alias("class"))).select("project", F.col("related").alias("owner"))
    return found.join(own.unionByName(up).distinct(), ["project", "owner"], "left_semi").withColumn("inherited", F.col("owner") != cls)


def class_edges(symbols_: DataFrame) -> DataFrame:
    """(project, child, parent) by simple name."""
    return symbols_.where("kind = 'class'").select("project", F.col("name").alias("child"), F.explode("supers").alias("parent")).select(
        "project", "child", F.substring_index("parent", ".", -1).alias("parent")).distinct()


def class_hierarchy(symbols_: DataFrame, direction: str = "super", max_depth: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(project, class, related, depth): all super or all sub classes, of every class or of classes(project, class) only."""
    src, dst = ("child", "parent") if direction == "super" else ("parent", "child")
    edges = class_edges(symbols_).select("project", F.col(src).alias("src"), F.col(dst).alias("dst"))
    of = edges.select("project", F.col("src").alias("class")) if classes is None else classes.select("project", "class")
    found = reach(edges, of.select("project", F.col("class").alias("seed"), F.col("class").alias("node")), max_depth)
    return found.where("depth > 0").select("project", F.col("seed").alias("class"), F.col("node").alias("related"), "depth")


# ------------------------------------------------------------------ functions and calls

# How a function begins, per extension, and words that look like calls.
JS_FUNCTION = (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)|^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*"
               r"(?:async\s+)?(?:\([^)]*\)|[^=])*\s*=>")
FUNCTION = {"js": JS_FUNCTION, "ts": JS_FUNCTION, "py": r"^def\s+(\w+)\s*\(", "go": r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(",
            "java": r"^\s*(?:public|private|protected)?\s*(?:static)?\s*(?:final)?\s*\w+\s+(\w+)\s*\(", "rb": r"^def\s+(\w+)", "rs": r"^fn\s+(\w+)",
            "cs": r"^(?:public|private|protected|internal)?\s*static?\s*(?:async)?\s*\w+\s+(\w+)\s*\(",
            "cpp": r"^(?:virtual\s+)?(?:void|int|string|\w+)\s+(?:\w+::)?(\w+)\s*\(", "c": r"^(?:void|int|char|\w+)\s+(\w+)\s*\(",
            "php": r"^(?:public|private|protected)?\s*function\s+(\w+)\s*\("}
NOT_CALLS = {"if", "else", "while", "for", "return", "throw", "new", "console"}
CALL = re.compile(r"(\w+)\s*\(", re.A)


def _body_end(lines, bare, ext, line, head_end, next_head):
    """Offset behind a function: its closing brace, or its indented block; without either, its statement or the next function."""
    if ext in ("py", "rb"):
        last = indented_end(lines, line)
        return lines.breaks[last - 1] if last <= len(lines.breaks) else len(bare)
    parens = PARENS.match(bare, head_end - 1) or PARENS.match(bare, head_end)
    after = parens.end() if parens else head_end
    opened, stop = bare.find("{", after), bare.find(";", after)
    if opened >= 0 and opened < next_head and not 0 <= stop < opened:
        closed = closing_brace(bare, opened)
        return closed + 1 if closed >= 0 else len(bare)
    return min(next_head, stop + 1 if stop >= 0 else len(bare))


def _functions(path, language, content):
    ext = path.rsplit(".", 1)[-1].lower()
    pattern, lines, bare = re.compile(FUNCTION[ext], re.A), Lines(content), blanked(content, language, strings=True)
    heads = []
    for i, text in enumerate(content.split("\n"), 1):
        m = pattern.match(text)
        name = next((g for g in m.groups() if g), None) if m else None
        if name and not text.strip().startswith(("return", "new ", "throw", "else")):
            heads.append((name, i, text.strip(), lines.start(i) + m.end()))
    for (name, line, text, head_end), stop in zip(heads, [lines.start(h[1]) for h in heads[1:]] + [len(content)]):
        body = bare[lines.start(line):_body_end(lines, bare, ext, line, head_end, stop)]
        yield name, line, text, [c for c in CALL.findall(body) if c != name and c not in NOT_CALLS]


def function_index(files: DataFrame) -> DataFrame:
    """functions(project, path, name, line, definition, calls): every call in the body of a function, in order."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return map_files(files, _functions, "name string, line int, definition string, calls array<string>", ext.isin(list(FUNCTION)))


def call_edges(index: DataFrame) -> DataFrame:
    """(project, path, name, to_path, to_name): a call goes to its own file, else to the only file of the project
    that defines the name, so a common name never fans out."""
    calls = index.select("project", "path", "name", F.explode("calls").alias("to_name")).distinct()
    defs = index.select("project", F.col("path").alias("to_path"), F.col("name").alias("to_name")).distinct()
    same = calls.join(defs.withColumnRenamed("to_path", "path"), ["project", "path", "to_name"], "left_semi").withColumn("to_path", F.col("path"))
    only = defs.groupBy("project", "to_name").agg(F.count("*").alias("n"), F.min("to_path").alias("to_path")).where("n = 1").drop("n")
    other = calls.join(defs.withColumnRenamed("to_path", "path"), ["project", "path", "to_name"], "left_anti").join(only, ["project", "to_name"])
    return same.unionByName(other).select("project", "path", "name", "to_path", "to_name")


def call_tree(index: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(project, root_path, root, depth, path, name, line) from roots(project, path, name), each function once per root, roots at depth 1;
    all that is called from there, or `depth` levels of it."""
    at = lambda path, name: F.struct(F.col(path).alias("path"), F.col(name).alias("name"))
    index = durable(index.select("project", "path", "name", "line", "calls"))  # edges and lines read it several times
    edges = call_edges(index).select("project", at("path", "name").alias("src"), at("to_path", "to_name").alias("dst"))
    lines = index.groupBy("project", "path", "name").agg(F.min("line").alias("line"))
    real = durable(roots.select("project", "path", "name").distinct()).join(lines, ["project", "path", "name"], "left_semi")
    found = reach(edges, real.select("project", at("path", "name").alias("seed"), at("path", "name").alias("node")), None if depth is None else depth - 1)
    rows = found.select("project", F.col("seed.path").alias("root_path"), F.col("seed.name").alias("root"), (F.col("depth") + 1).alias("depth"), "node.path", "node.name")
    return rows.join(lines, ["project", "path", "name"]).select("project", "root_path", "root", "depth", "path", "name", "line")


def dependency_context(findings: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """findings(project, node) with what lies up- and downstream: counts, signal flags, combined risk.

    edges(project, src, dst); nodes(project, node, code, extension). All nodes that can be reached count (within `depth` steps, if given),
    or per finding node and direction the nearest max_nodes.
    """
    from riskloom.operators.hints import hint_profile

    start = findings.select("project", "node").distinct()
    near = None
    for direction, (a, b) in (("up", ("dst", "src")), ("down", ("src", "dst"))):
        seen = reach(edges.select("project", F.col(a).alias("src"), F.col(b).alias("dst")), start.withColumn("seed", F.col("node")), depth).select(
            "project", F.col("seed").alias("node"), F.col("node").alias("at"), "depth")
        few = top_n(seen.where("depth > 0"), max_nodes, [F.col("depth"), F.col("at")], by=["project", "node"]).withColumn("direction", F.lit(direction))
        near = few if near is None else near.unionByName(few)
    described = near.join(nodes.select("project", F.col("node").alias("at"), hint_profile(F.coalesce("code", F.lit("")), F.col("extension")).alias("h")),
                          ["project", "at"], "left")
    n_in, n_sink = F.coalesce(F.col("h.input_count"), F.lit(0)) > 0, F.coalesce(F.col("h.sink_count"), F.lit(0)) > 0
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    out = described.groupBy("project", "node").agg(
        F.count(F.when(up, 1)).alias("upstream"), F.count(F.when(down, 1)).alias("downstream"), F.count(F.when(n_in, 1)).alias("input_sources"),
        F.count(F.when(n_sink, 1)).alias("dangerous_sinks"), F.bool_or(up & n_in).alias("has_input_path"), F.bool_or(down & n_sink).alias("has_sink_path"))
    risky = (F.col("has_input_path") & F.col("has_sink_path")) | ((F.col("input_sources") > 0) & (F.col("dangerous_sinks") > 0))
    return findings.join(out.withColumn("combined_risk", risky), ["project", "node"], "left")
