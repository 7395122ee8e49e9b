"""Selection globs as regular expressions that Java and Python read alike."""

from __future__ import annotations

import re

SPECIAL = set("\\.+()|^$@%&~#<>=\" '")


def regex(glob: str) -> str:
    """For use with re.S: * and ? stay inside a path segment, ** doesn't; {a,b} and [..] as usual; raises ValueError for an unclosed group."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            end = i + 2 == len(glob)
            out.append(".*" if end else "(?:.*/)?")
            i += 2 if end else 3
            continue
        if c == "*":
            while glob[i + 1:i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            stop = glob.find("]", i + 2 if glob[i + 1:i + 2] not in ("!", "^") else i + 3)
            if stop < 0:
                raise ValueError("unclosed character class")
            body, negated = glob[i + 1:stop], glob[i + 1:i + 2] in ("!", "^")
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[1:] if negated else body)
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            i = stop
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if c in SPECIAL or c in "{}]" else c)
        i += 1
    if depth:
        raise ValueError("unclosed alternatives")
    return "".join(out)


#: Folders never opened, and folders skipped unless a glob names them. Fixed values.
PROTECTED = (".git", "node_modules")
GENERATED = ("vendor", "dist", "build", "target")


def special_folder(name: str) -> bool:
    return name in GENERATED or name.startswith(".")


def any_of(globs: list[str]) -> re.Pattern:
    """One pattern for the paths that any of the globs selects; an odd number of leading exclamation marks turns a glob round."""
    plain, turned = [], []
    for g in globs:
        bare = g.lstrip("!")
        (turned if (len(g) - len(bare)) % 2 else plain).append(regex(bare))
    return re.compile("|".join([*(f"(?:{x})" for x in plain), *(rf"(?!(?:{x})(?![\s\S])).*" for x in turned)]) or "(?!)", re.S)


def named_folders(globs: list[str]) -> re.Pattern:
    """One pattern for the paths of hidden or generated folders that a segment of a glob, not turned round, names outright."""
    found = []
    for g in globs:
        bare = g.lstrip("!")
        if (len(g) - len(bare)) % 2 == 0:
            at = 0
            for name in bare.split("/"):
                if special_folder(name):
                    found.append(regex(bare[:at]) + re.escape(name))
                at += len(name) + 1
    return re.compile("|".join(found) or "(?!)", re.S)
