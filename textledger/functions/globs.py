"""Globs and ignore rules as Java regular expressions, made on the driver from the patterns' text."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: * and ? stop at /, ** spans, [...] is a class."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif c == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out.append("[^/]*")
            i += run
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", glob[i:])):
            body = m[2].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"(?!/)[{'^' if m[1] else ''}{body}]")
            i += m.end()
        elif c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def path_regex(glob: str) -> str:
    """Selects a path if it or a parent matches; a glob without a slash matches a name at any depth."""
    g = glob.strip("/")
    return f"^{'' if '/' in g else '(?:.*/)?'}{glob_regex(g)}(?:/.*)?$"


def ignore_rule(line: str) -> dict | None:
    """A rule of an ignore file: what it matches relative to its base, and its flags. None for blanks and comments."""
    text = line.rstrip() if not line.rstrip().endswith("\\") else line
    if not text or text.startswith("#"):
        return None
    negate = text.startswith("!")
    text = text[1:] if negate else text
    dir_only = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    return {"negate": negate, "dir_only": dir_only, "regex": f"^{'' if anchored else '(?:.*/)?'}{glob_regex(text)}$"}
