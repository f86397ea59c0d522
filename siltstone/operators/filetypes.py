"""Named file types: name -> extensions and globs, chosen and excluded in order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.globs import ascii_fold, glob_column
from siltstone.functions.paths import extension

#: Common types and their globs: fixed values.  A larger catalogue is a parameter
#: of `NamedFileTypes.with_catalogue`.
COMMON = """
ada *.adb *.ads|asm *.asm *.s *.S|avro *.avdl *.avpr *.avsc|awk *.awk|bazel *.bazel *.bzl BUILD WORKSPACE|c *.c *.h *.H *.cats
clojure *.clj *.cljc *.cljs *.cljx|cmake *.cmake CMakeLists.txt|cpp *.cc *.cpp *.cxx *.hh *.hpp *.hxx *.inl|cs *.cs|css *.css *.scss
csv *.csv|cython *.pyx *.pxi *.pxd|d *.d|dart *.dart|docker *Dockerfile*|elixir *.ex *.exs *.eex|elm *.elm|erlang *.erl *.hrl
fortran *.f *.f77 *.f90 *.f95|fsharp *.fs *.fsi *.fsx|go *.go|graphql *.graphql *.graphqls|groovy *.groovy *.gradle|haskell *.hs *.lhs
hcl *.hcl *.tf|html *.htm *.html *.ejs|ini *.ini|java *.java *.jsp *.jspx *.properties|js *.js *.jsx *.cjs *.mjs *.vue|json *.json *.sarif
julia *.jl|jupyter *.ipynb *.jpynb|kotlin *.kt *.kts|less *.less|lisp *.el *.lisp *.lsp *.sc *.scm|log *.log|lua *.lua|make *.mk *.mak Makefile makefile GNUmakefile
markdown *.markdown *.md *.mdown *.mdwn *.mkd *.mkdn *.mdx|nim *.nim *.nimble|nix *.nix|objc *.h *.m|ocaml *.ml *.mli *.mll *.mly|org *.org
pascal *.pas *.pp *.lpr|perl *.perl *.pl *.PL *.plh *.plx *.pm *.t|php *.php *.php3 *.php4 *.php5 *.phtml|proto *.proto|ps *.cdxml *.ps1 *.psd1 *.psm1
py *.py *.pyi|r *.R *.r *.Rmd *.Rnw|rst *.rst|ruby *.gemspec *.rb *.rbw Gemfile Rakefile|rust *.rs|sass *.sass *.scss|scala *.scala *.sbt
sh *.bash *.sh *.zsh *.ksh .bashrc .profile|sql *.psql *.sql|svelte *.svelte|svg *.svg|swift *.swift|tcl *.tcl|tex *.tex *.ltx *.cls *.sty *.bib
thrift *.thrift|toml *.toml Cargo.lock|ts *.ts *.tsx *.cts *.mts|txt *.txt|vb *.vb|verilog *.v *.vh *.sv *.svh|vhdl *.vhd *.vhdl|vim *.vim
xml *.xml *.xsl *.xslt *.xsd *.dtd *.rng|yaml *.yaml *.yml|zig *.zig
"""


def _parsed(pattern: str) -> tuple[str, str]:
    pattern = pattern.replace("\\", "/")
    rest = pattern[2:] if pattern.startswith("*.") else ""
    plain = rest and not set(rest) & set("*?[]{}/.")
    return ("extension", ascii_fold(rest)) if plain else ("glob", pattern)


@dataclass(frozen=True)
class NamedFileTypes:
    definitions: Mapping[str, frozenset[tuple[str, str]]] = field(default_factory=dict)
    selections: tuple[tuple[str, str], ...] = ()

    def _with(self, name: str, patterns: Iterable[tuple[str, str]]) -> NamedFileTypes:
        return NamedFileTypes({**self.definitions, name: frozenset(patterns)}, self.selections)

    def with_type(self, name: str, extensions: Iterable[str]) -> NamedFileTypes:
        return self._with(name, (("extension", ascii_fold(e.lstrip("."))) for e in extensions))

    def with_globs(self, name: str, patterns: Iterable[str]) -> NamedFileTypes:
        return self._with(name, map(_parsed, patterns))

    def with_composed_type(self, name: str, components: Iterable[str]) -> NamedFileTypes:
        return self._with(name, (p for c in components for p in self.definitions.get(c, ())))

    def with_catalogue(self, catalogue: Mapping[str, Iterable[str]]) -> NamedFileTypes:
        """Adds definitions for names not defined yet."""
        out = self
        for name, patterns in catalogue.items():
            if name not in out.definitions:
                out = out.with_globs(name, patterns)
        return out

    def with_defaults(self) -> NamedFileTypes:
        entries = [e.split() for line in COMMON.strip().splitlines() for e in line.split("|")]
        return self.with_catalogue({name: patterns for name, *patterns in entries})

    def select(self, names: Iterable[str]) -> NamedFileTypes:
        return NamedFileTypes(self.definitions, tuple(("Include", n) for n in names))

    def negate(self, names: Iterable[str]) -> NamedFileTypes:
        return NamedFileTypes(self.definitions, self.selections + tuple(("Exclude", n) for n in names))

    @property
    def is_active(self) -> bool:
        return bool(self.selections)

    @property
    def has_includes(self) -> bool:
        return any(kind == "Include" for kind, _ in self.selections)

    def names(self) -> list[str]:
        return sorted(self.definitions)

    def matched(self, path: Column, name: Column) -> Column:
        """Include, Exclude or null; the later selection wins."""
        cases = []
        for kind, wanted in reversed(self.selections):
            hit = F.lit(False)
            patterns = self.definitions.get(wanted, frozenset())
            if ends := sorted(p for k, p in patterns if k == "extension"):
                hit = hit | F.coalesce(extension(name).isin(ends), F.lit(False))
            for p in sorted(p for k, p in patterns if k == "glob"):
                hit = hit | glob_column(path if "/" in p else name, p)
            cases.append(F.when(hit, kind))
        return F.coalesce(*cases) if cases else F.lit(None).cast("string")
