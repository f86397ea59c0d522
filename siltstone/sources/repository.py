"""Rule files of a repository on disk: which apply, in which order."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

from siltstone.operators.rules import RuleSet, source_for_name
from siltstone.options import ScanOptions


def enclosing_repository(start: str) -> str | None:
    here = Path(start).resolve()
    return next((str(p) for p in (here, *here.parents) if (p / ".git").exists()), None)


def git_directory(root: str) -> str | None:
    """The repository's git directory; a work tree's `.git` file names it."""
    at = os.path.join(root, ".git")
    if os.path.isfile(at):
        text = Path(at).read_text(errors="replace")
        if text.startswith("gitdir:"):
            return os.path.normpath(os.path.join(root, text[7:].strip()))
    return at if os.path.isdir(at) else None


def config_value(path: str, section: str, key: str, git_dir: str | None = None, depth: int = 0) -> str | None:
    """Last value of section.key in a git configuration file, includes followed."""
    if depth >= 8 or not os.path.isfile(path):
        return None
    found, here, condition = None, "", ""
    for raw in Path(path).read_text(errors="replace").splitlines():
        line = raw.strip()
        if m := re.match(r'\[\s*([\w.-]+)(?:\s+"(.*)")?\s*\]', line):
            here, condition = m[1].lower(), m[2] or ""
            continue
        if line[:1] in ("#", ";", "") or "=" not in line:
            continue
        name, _, value = (x.strip() for x in line.partition("="))
        value = value.strip('"')
        if here == section and name.lower() == key.lower():
            found = value
        elif name.lower() == "path" and (here == "include" or here == "includeif" and _applies(condition, git_dir, path)):
            inner = os.path.join(os.path.dirname(path), os.path.expanduser(value))
            found = config_value(inner, section, key, git_dir, depth + 1) or found
    return found


def _applies(condition: str, git_dir: str | None, config: str) -> bool:
    from siltstone.functions.globs import matches

    kind, _, want = condition.partition(":")
    if git_dir is None:
        return False
    if kind in ("gitdir", "gitdir/i"):
        want = os.path.expanduser(want)
        want = os.path.join(os.path.dirname(config), want[2:]) if want.startswith("./") else want
        want = want if want.startswith("/") else "**/" + want
        want = want + "**" if want.endswith("/") else want
        there = git_dir
        if kind == "gitdir/i":
            want, there = want.lower(), there.lower()
        return matches(want, there) or matches(want, there + "/")
    if kind == "onbranch":
        head = os.path.join(git_dir, "HEAD")
        text = Path(head).read_text(errors="replace").strip() if os.path.isfile(head) else ""
        branch = text.removeprefix("ref: refs/heads/") if text.startswith("ref: refs/heads/") else None
        want = want + "**" if want.endswith("/") else want
        return branch is not None and matches(want, branch, "git")
    return False


def global_excludes(environ: dict[str, str] | None = None, git_dir: str | None = None) -> str | None:
    """The file that core.excludesFile names, or git's default place."""
    env = dict(os.environ) if environ is None else environ
    home = env.get("HOME", "")
    xdg = env.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    files = [env["GIT_CONFIG_GLOBAL"]] if env.get("GIT_CONFIG_GLOBAL") else [os.path.join(home, ".gitconfig"), os.path.join(xdg, "git/config")]
    for f in [*files, "/etc/gitconfig"]:
        if value := config_value(f, "core", "excludesFile", git_dir):
            return value.replace("~", home, 1) if value.startswith("~") else value
    default = os.path.join(xdg, "git/ignore")
    return default if os.path.isfile(default) else None


def load_rules(root: str, options: ScanOptions, rule_files: Iterable[str]) -> tuple[RuleSet, bool, bool]:
    """Rules for a scan root, whether the outcome is portable, and whether all
    could be read.  `rule_files`: paths below the root of the rule files that
    listing has found in directories that are entered."""
    policy, ci = options.ignore_policy, options.ignore_case_insensitive
    rules, portable, complete = RuleSet(), True, True
    repo = enclosing_repository(root)
    git_ok = not policy.require_git or repo is not None
    git_dir = git_directory(repo) if repo else None
    # Bases count from the repository's root where the rules above the scan apply.
    home = repo if policy.parent_rules and repo else os.path.realpath(root)
    steps = [x for x in os.path.relpath(os.path.realpath(root), home).split("/") if x != "."]
    rules.prefix = "/".join(steps)

    def read(path: str, kind: str, location: str, base: str, layer: int) -> None:
        nonlocal complete
        try:
            if os.path.islink(path):
                raise OSError("rule files that are symbolic links aren't read")
            rules.add(Path(path).read_bytes(), kind, location, base, layer, ci)
        except OSError as e:
            rules.errors.append((location, str(e)))
            complete = False
        if rules.errors and options.walk.error_policy == "Abort":
            raise OSError(f"{rules.errors[0][0]}: {rules.errors[0][1]}")

    if policy.git_global and git_ok and (path := global_excludes(git_dir=git_dir)) and os.path.isfile(path):
        read(path, "GitGlobal", "<git-global>", "", 0)
        portable = False
    if policy.git_exclude and git_ok and git_dir and os.path.isfile(exclude := os.path.join(git_dir, "info/exclude")):
        read(exclude, "GitExclude", ".git/info/exclude", "", 0)
        portable = False
    layer = 0
    for k in range(len(steps)):
        # Rules of the folders between the repository's root and the scan's.
        for name in options.ignore_files:
            at = "/".join([*steps[:k], name])
            if os.path.isfile(os.path.join(home, at)) and (kind := source_for_name(name)) and policy.allows(kind) and (kind != "GitIgnore" or git_ok):
                layer += 1
                read(os.path.join(home, at), kind, at, "/".join(steps[:k]), layer)
    order = {n: i for i, n in enumerate(options.ignore_files)}
    for path in sorted(rule_files, key=lambda p: (p.count("/"), p.rpartition("/")[0], order.get(p.rpartition("/")[2], 99))):
        base, _, name = path.rpartition("/")
        kind = source_for_name(name)
        if name in order and policy.allows(kind) and (kind != "GitIgnore" or git_ok):
            layer += 1
            read(os.path.join(root, path), kind, "/".join([*steps, path]), "/".join([*steps, *([base] if base else [])]), layer)
    for k, path in enumerate(policy.explicit_files):
        full = os.path.realpath(os.path.join(root, path))
        inside = full.startswith(home.rstrip("/") + "/")
        portable &= inside
        read(full, "Explicit", os.path.relpath(full, home) if inside else full, "", k)
    return rules, portable, complete and not rules.errors


def known_rule_files(root: str, options: ScanOptions, sources: Iterable) -> list[str]:
    """Paths below the root of the rule files that a report's evidence names."""
    repo = enclosing_repository(root)
    home = repo if options.ignore_policy.parent_rules and repo else os.path.realpath(root)
    out = []
    for s in sources:
        at = os.path.relpath(os.path.join(home, s.location), os.path.realpath(root))
        if s.kind in ("GitIgnore", "DotIgnore", "Custom") and not at.startswith("../"):
            out.append(at)
    return out
