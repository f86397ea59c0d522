"""Glob patterns over repository paths, compiled to look-around-free regexes.

A pattern is matched byte by byte: `*` is any run without a slash, `?` one byte
that isn't a slash, `[...]` a class that never holds a slash, `**` any run, and
`{a,b}` alternatives.  The same regex text works in Java (`rlike`), Python and
RE2, so a query and its oracle can share it.

Two dialects differ in `**/` only: `flat` (the default) lets it match any run,
so `**/foo` also matches `xfoo`; `git` requires whole directories.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ALTERNATIVES = 256
DIALECTS = ("flat", "git")

#: Error kinds and their messages; fixed values.
ERRORS = {
    "Empty": "pattern is empty",
    "DanglingEscape": "escape has no following byte",
    "UnclosedCharacterClass": "character class is not closed",
    "InvalidCharacterRange": "character range is descending",
    "EmptyBraceAlternative": "brace alternative is empty",
    "UnclosedBrace": "brace alternative is not closed",
    "UnexpectedClosingBrace": "closing brace has no opening brace",
    "ExpansionLimitExceeded": "brace alternatives exceed the limit of 256",
}


class PatternError(ValueError):
    def __init__(self, kind: str, position: int):
        super().__init__(f"invalid path pattern at byte {position}: {ERRORS[kind]}")
        self.kind, self.position = kind, position


def _scan_braces(pattern: str) -> tuple[int, int, list[str]] | None:
    """Place of the first closed brace group, and its alternatives."""
    escaped = in_class = False
    depth, start, parts, at = 0, -1, [], 0
    for i, c in enumerate(pattern):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "[]":
            in_class = c == "["
        elif in_class:
            continue
        elif c == "{":
            if depth == 0:
                start, at = i, i + 1
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                return start, i, [*parts, pattern[at:i]]
        elif c == "," and depth == 1:
            parts.append(pattern[at:i])
            at = i + 1
    return None


def alternatives(pattern: str) -> list[str]:
    """The brace-free patterns that a pattern stands for."""
    group = _scan_braces(pattern)
    if group is None:
        return [pattern]
    start, end, parts = group
    return [x for part in parts for x in alternatives(pattern[:start] + part + pattern[end + 1 :])]


def _byte(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{ord(c):02x}"


def _class(pattern: str, at: int) -> tuple[str, int] | None:
    """Regex of the class that opens at `at` and the place after it."""
    i = at + 1
    negated = pattern[i : i + 1] in ("!", "^")
    i += negated
    members: set[int] = set()
    first = True
    while i < len(pattern):
        if pattern[i] == "]" and not first:
            allowed = [b for b in range(256) if (b in members) != negated and b != 0x2F]
            return _ranges(allowed), i + 1
        first = False
        low, i = _member(pattern, i)
        if low is None:
            return None
        high = low
        if pattern[i : i + 1] == "-" and pattern[i + 1 : i + 2] not in ("]", ""):
            high, i = _member(pattern, i + 1)
            if high is None:
                return None
        members.update(range(ord(low), ord(high) + 1))
    return None


def _member(pattern: str, i: int) -> tuple[str | None, int]:
    if pattern[i] != "\\":
        return pattern[i], i + 1
    return (pattern[i + 1], i + 2) if i + 1 < len(pattern) else (None, i + 1)


def _ranges(allowed: list[int]) -> str:
    if not allowed:
        return "[^\\x00-\\xff]"
    runs: list[list[int]] = []
    for b in allowed:
        if runs and runs[-1][1] == b - 1:
            runs[-1][1] = b
        else:
            runs.append([b, b])
    return "[" + "".join(f"\\x{a:02x}" if a == b else f"\\x{a:02x}-\\x{b:02x}" for a, b in runs) + "]"


def _plain(pattern: str, dialect: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            run = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            i += run
            if run == 1:
                out.append("[^/]*")
            elif dialect == "git" and pattern[i : i + 1] == "/" and (not out or out[-1] == "\\x2f"):
                out.append("(?:.*\\x2f)?")
                i += 1
            else:
                out.append(".*")
                i += pattern[i : i + 1] == "/" and dialect == "flat"
            continue
        if c == "[" and (found := _class(pattern, i)):
            out.append(found[0])
            i = found[1]
            continue
        if c == "?":
            out.append("[^/]")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(_byte(pattern[i]))
        else:
            out.append(_byte(c))
        i += 1
    return "".join(out)


@lru_cache(maxsize=4096)
def regex(pattern: str, dialect: str = "flat") -> str:
    """Regex that matches a whole path, read as one character a byte."""
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    wide = pattern.encode().decode("latin-1")
    return "(?s)^(?:" + "|".join(_plain(p, dialect) for p in alternatives(wide)) + ")\\z"


def matches(pattern: str, path: str, dialect: str = "flat") -> bool:
    return re.search(regex(pattern, dialect).removesuffix("\\z") + "\\Z", path.encode().decode("latin-1")) is not None


def as_bytes(path: Column) -> Column:
    """One character for each byte of the path."""
    return F.decode(F.encode(path, "UTF-8"), "ISO-8859-1")


def ascii_lower(path: Column) -> Column:
    return F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def glob_column(path: Column, pattern: str, dialect: str = "flat", case_insensitive: bool = False) -> Column:
    """Predicate for a pattern; a literal start is tested before the regex."""
    if case_insensitive:
        path, pattern = ascii_lower(path), ascii_fold(pattern)
    head = re.match(r"[^*?\[{\\]*", pattern)[0]
    rest = pattern[len(head) :]
    if not rest:
        return path == pattern
    subject = as_bytes(path) if ("?" in rest or "[" in rest or not pattern.isascii()) else path
    test = subject.rlike(regex(pattern, dialect))
    return path.startswith(head) & test if head else test


def ascii_fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@dataclass(frozen=True)
class PathPattern:
    """A validated glob."""

    source: str

    def __post_init__(self):
        _validate(self.source.encode())

    def is_match(self, path: str) -> bool:
        return matches(self.source, path)

    def column(self, path: Column) -> Column:
        return glob_column(path, self.source)


def _validate(p: bytes) -> None:
    """Raises PatternError with the byte position of the first fault."""
    if not p:
        raise PatternError("Empty", 0)
    # A frame for the pattern and each open brace: [start, sum of finished alternatives, product of the current, filled].
    frames, i = [[0, 0, 1, True]], 0

    def bounded(n: int, at: int) -> int:
        if n > MAX_ALTERNATIVES:
            raise PatternError("ExpansionLimitExceeded", at)
        return n

    def close(frame: list, at: int) -> None:
        if not frame[3]:
            raise PatternError("EmptyBraceAlternative", at)
        frame[1:] = [bounded(frame[1] + frame[2], at), 1, False]

    while i < len(p):
        c = p[i : i + 1]
        if c == b"\\":
            if i + 1 == len(p):
                raise PatternError("DanglingEscape", i)
            frames[-1][3] = True
            i += 2
            continue
        if c == b"[":
            i = _valid_class(p, i)
            frames[-1][3] = True
            continue
        if c == b"{":
            frames.append([i, 0, 1, False])
        elif c == b"," and len(frames) > 1:
            close(frames[-1], i)
        elif c == b"}":
            if len(frames) == 1:
                raise PatternError("UnexpectedClosingBrace", i)
            frame = frames.pop()
            close(frame, i)
            frames[-1][2] = bounded(frames[-1][2] * frame[1], frame[0])
            frames[-1][3] = True
        elif c != b",":
            frames[-1][3] = True
        i += 1
    if len(frames) > 1:
        raise PatternError("UnclosedBrace", frames[-1][0])


def _valid_class(p: bytes, start: int) -> int:
    i = start + 1 + (p[start + 1 : start + 2] in (b"!", b"^"))
    filled = False

    def member(at: int) -> tuple[int, int]:
        if at >= len(p):
            raise PatternError("UnclosedCharacterClass", at - 1)
        if p[at] != 0x5C:
            return p[at], at + 1
        if at + 1 >= len(p):
            raise PatternError("DanglingEscape", at)
        return p[at + 1], at + 2

    while i < len(p):
        if p[i] == 0x5D and filled:
            return i + 1
        low, i = member(i)
        filled = True
        if p[i : i + 1] == b"-" and p[i + 1 : i + 2] != b"]":
            dash = i
            high, i = member(i + 1)
            if low > high:
                raise PatternError("InvalidCharacterRange", dash)
    raise PatternError("UnclosedCharacterClass", start)
