"""Globs on whole relative paths as anchored regular expressions. ``*`` and ``?`` cross ``/``."""

from __future__ import annotations

import re


def to_regex(glob: str) -> str:
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", "\\[").replace("&&", "&\\&") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob}")
    return f"(?s)^{out}$"
