"""Ignore files as column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule(line: str, base: str = "") -> tuple[bool, str] | None:
    """(keeps, regex on the relative path) of one line of an ignore file in folder ``base``."""
    line = line.rstrip("\n\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    body = line.lstrip("/")
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
            continue
        if c == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out += re.escape(body[i])
        else:
            out += re.escape(c)
        i += 1
    lead = re.escape(base) + ("/" if base else "")
    return keeps, f"^{lead}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path: Column, files: list[tuple[str, str]]) -> Column:
    """Whether ignore files (folder, text), outer folders first, exclude a relative path: the
    last line that matches decides."""
    out = F.lit(False)
    for base, text in files:
        for line in text.splitlines():
            if found := rule(line, base):
                out = F.when(path.rlike(found[1]), F.lit(not found[0])).otherwise(out)
    return out
