"""Options of a scan, and the descriptor that says which of them shape results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace

from siltstone.operators.filetypes import NamedFileTypes

#: Directories that are left out by name at any depth; fixed values.
STANDARD_DIRECTORIES = (".git", ".hg", ".svn", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor")
MAX_FILE_BYTES = 1_500_000
#: The last name is this engine's own rule file.
IGNORE_FILES = (".gitignore", ".ignore", ".scanignore")
DESCRIPTOR_VERSION = 3


@dataclass(frozen=True)
class IgnorePolicy:
    parent_rules: bool = True
    git_ignore: bool = True
    dot_ignore: bool = True
    custom_ignore: bool = True
    git_exclude: bool = True
    git_global: bool = False
    require_git: bool = False
    explicit_files: tuple[str, ...] = ()

    @classmethod
    def none(cls) -> IgnorePolicy:
        return cls(False, False, False, False, False, False, False)

    @classmethod
    def git_compatible(cls) -> IgnorePolicy:
        return cls(git_global=True, require_git=True)

    def allows(self, kind: str) -> bool:
        return {"GitIgnore": self.git_ignore, "DotIgnore": self.dot_ignore, "Custom": self.custom_ignore, "GitExclude": self.git_exclude, "GitGlobal": self.git_global}.get(kind, True)


@dataclass(frozen=True)
class WalkOptions:
    min_depth: int = 0
    max_depth: int | None = None
    max_open: int = 10
    same_file_system: bool = False
    follow_links: bool = False
    metadata: bool = True
    error_policy: str = "Continue"  # or Abort
    root_symlink_policy: str = "Follow"  # or Reject

    @property
    def effective_min_depth(self) -> int:
        return self.min_depth if self.max_depth is None else min(self.min_depth, self.max_depth)


@dataclass(frozen=True)
class ScanOptions:
    max_file_bytes: int = MAX_FILE_BYTES
    extensions: tuple[str, ...] = ()
    file_types: NamedFileTypes = field(default_factory=NamedFileTypes)
    ignore_files: tuple[str, ...] = IGNORE_FILES
    override_rules: tuple[str, ...] = ()
    ignore_policy: IgnorePolicy = field(default_factory=IgnorePolicy)
    ignore_case_insensitive: bool = False
    skip_hidden: bool = False
    standard_skips: bool = True
    hash_file_contents: bool = True
    detect_binary_files: bool = True
    selected_files_only: bool = False
    parallelism: int = 0
    traversal_parallelism: int | None = None
    content_parallelism: int | None = None
    max_entries: int | None = None
    max_total_bytes: int | None = None
    timeout_seconds: float | None = None
    cancellation: object | None = None
    cache_validation: str = "Fast"  # or Strict
    content_validation: str = "Strict"  # or Fast
    content_discovery: str = "Streaming"  # or BufferedParallel; the planner's business
    dialect: str = "flat"
    walk: WalkOptions = field(default_factory=WalkOptions)

    def __post_init__(self):
        object.__setattr__(self, "extensions", tuple(sorted({e.lstrip(".").lower() for e in self.extensions})))
        for name, allowed in (("cache_validation", ("Fast", "Strict")), ("content_validation", ("Fast", "Strict")), ("content_discovery", ("Streaming", "BufferedParallel")), ("dialect", ("flat", "git"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")

    @classmethod
    def decode(cls, options: dict) -> ScanOptions:
        """From plain names and values; unknown names are rejected.  Without
        hashes nothing of the content is read, so binary files go unnoticed too."""
        known = {f.name for f in fields(cls)} | {"metadata_only"}
        if unknown := sorted(set(options) - known):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in options.items() if k != "metadata_only"}
        out = cls(**given)
        return out.metadata_only() if options.get("metadata_only") or options.get("hash_file_contents") is False else out

    def metadata_only(self) -> ScanOptions:
        return replace(self, hash_file_contents=False, detect_binary_files=False)

    def with_(self, **changes) -> ScanOptions:
        return replace(self, **changes)

    @property
    def reads_content(self) -> bool:
        return self.hash_file_contents or self.detect_binary_files

    def descriptor(self) -> ScanDescriptor:
        return ScanDescriptor(DESCRIPTOR_VERSION, _policy(self))


@dataclass(frozen=True)
class ScanDescriptor:
    version: int
    policy: str

    def matches(self, options: ScanOptions) -> bool:
        return self == options.descriptor()


#: Options that say how a scan runs, and not what it gives.
MANNER = ("parallelism", "traversal_parallelism", "content_parallelism", "timeout_seconds", "cancellation", "cache_validation", "content_validation", "content_discovery")


def _policy(options: ScanOptions) -> str:
    """SHA-256 of all options that shape a selection, as canonical JSON."""

    def plain(value):
        if is_dataclass(value):
            return {f.name: plain(getattr(value, f.name)) for f in fields(value) if f.name not in MANNER}
        if isinstance(value, Mapping):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, (frozenset, set)):
            return sorted(plain(v) for v in value)
        return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value

    walk = replace(options.walk, max_open=0, metadata=True)
    text = json.dumps(plain(replace(options, walk=walk)), sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()
