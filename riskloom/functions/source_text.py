"""Small helpers on the text of one source file: comments, lines, balanced brackets."""

from __future__ import annotations

import re
from bisect import bisect_right

_STRINGS = r"\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`"
_SKIP = {"python": re.compile(r"(?P<string>\"\"\".*?\"\"\"|'''.*?'''|" + _STRINGS + r")|(?P<comment>#[^\n]*)", re.S),
         "xml": re.compile(r"(?P<string>\"[^\"<]*\")|(?P<comment><!--.*?-->)", re.S)}
_BRACE_SKIP = re.compile(r"(?P<string>" + _STRINGS + r")|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)", re.S)
_NOT_NEWLINE = re.compile(r"[^\n]")
#: The inside of a pair of parentheses, with pairs nested once or twice.
INSIDE = r"[^()]*+(?:\((?:[^()]|\([^()]*+\))*+\)[^()]*+)*+"
PARENS = re.compile(r"\((" + INSIDE + r")\)")


def blanked(text: str, language: str, strings: bool = False) -> str:
    """The text with comments (and the insides of strings, if asked) overwritten by spaces; offsets and lines stay."""
    def cover(m):
        if m.lastgroup == "string" and not strings:
            return m.group()
        if m.lastgroup == "string":
            return m.group()[0] + _NOT_NEWLINE.sub(" ", m.group()[1:-1]) + m.group()[-1]
        return _NOT_NEWLINE.sub(" ", m.group())

    return _SKIP.get(language, _BRACE_SKIP).sub(cover, text)


class Lines:
    """Line numbers of offsets, by bisection over the newlines."""

    def __init__(self, text: str):
        self.text, self.breaks = text, [m.start() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def start(self, line: int) -> int:
        return self.breaks[line - 2] + 1 if line > 1 else 0


def closing_brace(code: str, start: int) -> int:
    """Offset of the brace that closes the first one opened from `start` on; -1 if there is none."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m.group() == "{" else -1
        if depth <= 0:
            return m.start() if depth == 0 else -1
    return -1


def indented_end(lines: Lines, line: int) -> int:
    """The last line of the block that hangs under `line` by deeper indentation."""
    rows = lines.text.split("\n")
    own = len(rows[line - 1]) - len(rows[line - 1].lstrip())
    last = line
    for i in range(line, len(rows)):
        if rows[i].strip():
            if len(rows[i]) - len(rows[i].lstrip()) <= own and not rows[i].lstrip().startswith((")", "]", "}")):
                break
            last = i + 1
    return last


def split_list(text: str) -> list[str]:
    """Comma-separated parts; commas inside brackets do not separate."""
    parts = re.findall(r"(?:[^,<(\[{]|<[^<>]*(?:<[^<>]*>[^<>]*)*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|[<(\[{])+", text)
    return [p.strip() for p in parts if p.strip()]
