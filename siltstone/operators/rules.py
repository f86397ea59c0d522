"""Hierarchical ignore rules: parsing, and lookup as expressions or as a join.

Rule text is gitignore-like.  Parsed rules become one `coalesce(when ...)` chain
in falling precedence (no shuffle, first hit wins).  `decide_by_join` is the same
lookup for rule sets too large for an expression, as a join with a table of rules.

A rule file applies strictly below its own directory.  Within a file the last
match wins; among files the source kind decides, then the deeper directory, then
the later file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.globs import as_bytes, ascii_fold, ascii_lower, glob_column, regex

#: Source kinds from the lowest precedence to the highest; fixed values.
SOURCES = ("GitGlobal", "GitExclude", "GitIgnore", "DotIgnore", "Custom", "Explicit", "Override")
_META = set("*?[{\\")


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str  # Ignore or Include
    dir_only: bool
    scope: str  # Anywhere, Path or Anchored
    source: str = "GitIgnore"
    base: str = ""
    layer: int = 0
    index: int = 0
    case_insensitive: bool = False

    @property
    def precedence(self) -> tuple[int, int, int, int]:
        return SOURCES.index(self.source), len(self.base.split("/")) if self.base else 0, self.layer, self.index


@dataclass(frozen=True)
class SourceEvidence:
    kind: str
    location: str
    content_hash: str


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    evidence: list[SourceEvidence] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    #: Where the paths to be matched lie below the folder that bases count from.
    prefix: str = ""

    def located(self, path: Column) -> Column:
        """A path as the rules' bases see it."""
        return F.concat(F.lit(self.prefix + "/"), path) if self.prefix else path

    def add(self, content: bytes | str, source: str, location: str, base: str = "", layer: int = 0, case_insensitive: bool = False) -> RuleSet:
        raw = content.encode() if isinstance(content, str) else content
        self.evidence.append(SourceEvidence(source, location, "sha256:" + hashlib.sha256(raw).hexdigest()))
        for number, line in enumerate(rule_lines(raw), 1):
            try:
                rule = parse_rule(line, case_insensitive)
            except ValueError as e:
                self.errors.append((location, f"line {number}: {e}"))
                continue
            if rule:
                self.rules.append(Rule(**{**rule.__dict__, "source": source, "base": base, "layer": layer, "index": len(self.rules)}))
        return self

    def sources(self) -> list[SourceEvidence]:
        """Evidence in order, without repeats."""
        return sorted(set(self.evidence), key=lambda e: (SOURCES.index(e.kind), e.location, e.content_hash))


def source_for_name(name: str) -> str:
    return {".gitignore": "GitIgnore", ".ignore": "DotIgnore"}.get(name, "Custom")


def rule_lines(raw: bytes) -> list[str]:
    """Lines of a rule file, with `%` and undecodable bytes written as %XX."""
    text = raw.replace(b"%", b"%25").decode("utf-8", "surrogateescape").lstrip("﻿")
    text = "".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in text)
    return text.removesuffix("\n").split("\n") if text else []


def _trimmed(line: str) -> str:
    """Without trailing blanks, except one that a backslash guards."""
    line = line.rstrip("\r")
    while line.endswith(" "):
        slashes = len(line[:-1]) - len(line[:-1].rstrip("\\"))
        if slashes % 2:
            break
        line = line[:-1]
    return line


def parse_rule(raw: str, case_insensitive: bool = False) -> Rule | None:
    """The rule of a line; None for blank lines and comments."""
    line = _trimmed(raw)
    literal = line[:2] in ("\\#", "\\!")
    if literal:
        line = line[1:]
    elif line.startswith("#"):
        return None
    negated = not literal and line.startswith("!")
    line = line[negated:]
    dir_only = line.endswith("/")
    if dir_only:
        line = line[: -2 if line.endswith("\\/") else -1]
    anchored = line.startswith("/")
    line = line[anchored:]
    if not line:
        return None
    _check_braces(line)
    if case_insensitive:
        line = ascii_fold(line)
    scope = "Anchored" if anchored else "Path" if "/" in line else "Anywhere"
    return Rule(line, "Include" if negated else "Ignore", dir_only, scope, case_insensitive=case_insensitive)


def _check_braces(pattern: str) -> None:
    depth, in_class, escaped = 0, False, False
    for c in pattern:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth < 0:
                raise ValueError("unmatched closing brace")
    if depth:
        raise ValueError("unmatched opening brace")


def _kind(pattern: str, scope: str, dialect: str) -> tuple[str, str]:
    """How a pattern is tested: literal, prefix, suffix or glob, and its text.
    In the git dialect a star never crosses a slash."""
    if "{" in pattern or "**" in pattern:
        return "glob", pattern
    if not _META & set(pattern):
        return "literal", pattern
    whole = dialect == "flat" or scope == "Anywhere"
    if whole and pattern[0] == "*" and not _META & set(pattern[1:]):
        return "suffix", pattern[1:]
    if whole and pattern[-1] == "*" and not _META & set(pattern[:-1]):
        return "prefix", pattern[:-1]
    return "glob", pattern


def rule_condition(rule: Rule, path: Column, name: Column, is_dir: Column, dialect: str = "flat") -> Column:
    """Whether a rule matches a path itself."""
    inside = F.lit(True)
    if rule.base:
        inside = path.startswith(rule.base + "/")
        path = F.substring(path, len(rule.base) + 2, 1_000_000)
    subject = name if rule.scope == "Anywhere" else path
    kind, text = _kind(rule.pattern, rule.scope, dialect)
    if rule.case_insensitive:
        subject = ascii_lower(subject)
    test = {
        "literal": lambda: subject == text,
        "prefix": lambda: subject.startswith(text),
        "suffix": lambda: subject.endswith(text),
        "glob": lambda: glob_column(subject, text, dialect),
    }[kind]()
    return inside & test & is_dir if rule.dir_only else inside & test


def decide(rules: Iterable[Rule], path: Column, name: Column, is_dir: Column, dialect: str = "flat") -> Column:
    """Ignore, Include or null: the action of the winning rule."""
    cases = [F.when(rule_condition(r, path, name, is_dir, dialect), F.lit(r.action)) for r in sorted(rules, key=lambda r: r.precedence, reverse=True)]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def decide_override(rules: Iterable[Rule], path: Column, name: Column, is_dir: Column, dialect: str = "flat") -> Column:
    """OverrideInclude, OverrideIgnore or null.  Actions are inverted: a plain
    pattern includes; where any does, files that no rule matches are left out."""
    rules = list(rules)
    hit = decide(rules, path, name, is_dir, dialect)
    out = F.when(hit == "Ignore", "OverrideInclude").when(hit == "Include", "OverrideIgnore")
    if any(r.action == "Ignore" for r in rules):
        out = out.when(~is_dir, "OverrideIgnore")
    return out


def repository_match(rules: RuleSet, overrides: RuleSet, skip_hidden: bool, path: Column, name: Column, is_dir: Column, dialect: str = "flat") -> Column:
    """None, Ignore, Include, OverrideIgnore, OverrideInclude or Hidden."""
    override = decide_override(overrides.rules, path, name, is_dir, dialect)
    hidden = F.when(name.startswith("."), "Hidden") if skip_hidden else F.lit(None).cast("string")
    return F.coalesce(override, decide(rules.rules, rules.located(path), name, is_dir, dialect), hidden, F.lit("None"))


def ancestor_match(rules: Iterable[Rule], path: Column, ancestors: Column, name: Column, is_dir: Column, dialect: str = "flat") -> Column:
    """Decision for a path on its own.  Layers (the rules of one source kind in one
    folder) are asked in falling precedence.  The first that has a rule for the path
    itself decides; so does the first whose nearest ruled ancestor is ignored, unless
    a layer before it has included an ancestor, which is what is left in the end."""
    layers: dict[tuple[str, str], list[Rule]] = {}
    for r in sorted(rules, key=lambda r: r.precedence, reverse=True):
        layers.setdefault((r.source, r.base), []).append(r)
    named = lambda d: F.element_at(F.split(d, "/"), -1)

    def nearest(own: list[Rule]) -> Column:
        ruled = F.transform(F.reverse(ancestors), lambda d: decide(own, d, named(d), F.lit(True), dialect))
        return F.get(F.filter(ruled, lambda a: a.isNotNull()), 0)

    steps, included = [], F.lit(False)
    for own in layers.values():
        exact, above = decide(own, path, name, is_dir, dialect), nearest(own)
        steps += [exact, F.when(~included & (above == "Ignore"), F.lit("Ignore"))]
        included = included | F.coalesce(exact.isNull() & (above == "Include"), F.lit(False))
    return F.coalesce(*steps, F.when(included, F.lit("Include"))) if steps else F.lit(None).cast("string")


def relation(spark: SparkSession, rules: Iterable[Rule], dialect: str = "flat") -> DataFrame:
    """The rules as rows, with a regex for each; a star-only pattern of the flat
    dialect crosses slashes, as its plain test does."""

    def text(r: Rule) -> str:
        kind, part = _kind(r.pattern, r.scope, dialect)
        quoted = regex("".join("\\" + c if c in "*?[]{}\\," else c for c in part)).removeprefix("(?s)^(?:").removesuffix(")\\z")
        return {"literal": f"(?s)^{quoted}\\z", "prefix": f"(?s)^{quoted}", "suffix": f"(?s){quoted}\\z"}.get(kind) or regex(r.pattern, dialect)

    ordered = sorted(rules, key=lambda r: r.precedence)
    rows = [(i, r.source, r.base, r.pattern, r.action, r.dir_only, r.scope, r.case_insensitive, text(r), r.pattern[-1] if r.pattern[-1] not in "*?]}\\" else "") for i, r in enumerate(ordered)]
    return spark.createDataFrame(rows, "rank int, source_kind string, base string, pattern string, action string, dir_only boolean, scope string, case_insensitive boolean, regex string, last string")


def decide_by_join(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `action` to (relative, name, is_dir, ...) rows by a join with the
    rules, for rule sets too large for an expression.  Rules that end in a literal
    meet only paths that end in it.  A rule set is configuration; it is broadcast
    below Spark's own size limit and shuffled beyond it."""
    below = F.when(F.col("base") == "", F.col("relative")).when(F.col("relative").startswith(F.concat("base", F.lit("/"))), F.expr("substring(relative, length(base) + 2)"))
    rel = F.when(F.col("scope") == "Anywhere", F.when(below.isNotNull(), F.col("name"))).otherwise(below)
    subject = as_bytes(F.when(F.col("case_insensitive"), ascii_lower(rel)).otherwise(rel))
    fits = (~F.col("dir_only") | F.col("is_dir")) & F.regexp_like(subject, F.col("regex"))
    keyed = paths.withColumn("__id", F.xxhash64("relative")).withColumn("__key", F.explode(F.array(F.lit(""), ascii_lower(F.substring("relative", -1, 1)))))
    rows = rules.withColumn("__last", ascii_lower(F.col("last")))
    best = keyed.join(rows, (F.col("__key") == F.col("__last")) & fits).groupBy("relative", "is_dir").agg(F.max_by("action", "rank").alias("action"))
    return paths.join(best, ["relative", "is_dir"], "left")
