"""Path helpers: identity of rows, ancestors, prefixes.

Paths are relative, `/`-separated; `%` and undecodable bytes are written as %XX.
`src` covers `src/a` but not `src2`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: bytes | str) -> str:
    """Relative path of an operating-system path: `.`, root and empty parts go."""
    raw = path if isinstance(path, bytes) else path.encode("utf-8", "surrogateescape")
    parts = [p for p in raw.split(b"/") if p not in (b"", b".")]
    return "/".join(_escaped(p) for p in parts)


def _escaped(part: bytes) -> str:
    out = part.replace(b"%", b"%25").decode("utf-8", "surrogateescape")
    return "".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in out)


def is_same_or_descendant(path: str, prefix: str) -> bool:
    return not prefix or path == prefix or path.startswith(prefix + "/")


def collapse_prefixes(prefixes: Iterable[str]) -> list[str]:
    """The prefixes that no other one covers, in order."""
    out: list[str] = []
    for p in sorted(set(prefixes), key=lambda x: x.split("/")):
        if not out or not is_same_or_descendant(p, out[-1]):
            out.append(p)
    return sorted(out)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """Proper ancestors from the shallowest to the parent; empty at the top."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def extension(name: Column) -> Column:
    """Last extension in ASCII lower case, or null; a dotfile has none."""
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    has = name.rlike(r"^.+\.[^.]*$")
    return F.when(has, F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def covered_by(path: Column, prefixes: Iterable[str]) -> Column:
    """Whether one of a few known prefixes covers the path."""
    out = F.lit(False)
    for p in collapse_prefixes(prefixes):
        out = out | (F.lit(True) if not p else (path == p) | path.startswith(p + "/"))
    return out
