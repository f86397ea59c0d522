import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from siltstone.functions import globs, paths


def slow_match(pattern: str, value: str) -> bool:
    """Independent matcher: byte by byte, alternatives spelled out."""
    p, v = pattern.encode(), value.encode()

    @cache
    def at(i, j):
        if i == len(p):
            return j == len(v)
        c = p[i : i + 1]
        if c == b"*":
            k = i
            while p[k : k + 1] == b"*":
                k += 1
            if k - i > 1:
                after = k + (p[k : k + 1] == b"/")
                return any(at(after, m) for m in range(j, len(v) + 1))
            return any(at(k, m) for m in range(j, len(v) + 1) if b"/" not in v[j:m])
        if j == len(v):
            return False
        if c == b"?":
            return v[j] != 0x2F and at(i + 1, j + 1)
        if c == b"[":
            k, members, first = i + 1, set(), True
            negated = p[k : k + 1] in (b"!", b"^")
            k += negated
            while k < len(p) and (first or p[k] != 0x5D):
                first = False
                if p[k] == 0x5C and k + 1 < len(p):
                    k += 1
                low = p[k]
                if p[k + 1 : k + 2] == b"-" and p[k + 2 : k + 3] not in (b"]", b""):
                    k += 2
                    if p[k] == 0x5C and k + 1 < len(p):
                        k += 1
                members |= set(range(low, p[k] + 1))
                k += 1
            if k < len(p):
                return v[j] != 0x2F and ((v[j] in members) != negated) and at(k + 1, j + 1)
        if c == b"\\" and i + 1 < len(p):
            return p[i + 1] == v[j] and at(i + 2, j + 1)
        return p[i] == v[j] and at(i + 1, j + 1)

    return any(at_all(x, value) for x in globs.alternatives(pattern)) if "{" in pattern else at(0, 0)


def at_all(pattern: str, value: str) -> bool:
    return slow_match(pattern.replace("{", "\\{"), value)


CASES = [
    ("src/*.rs", "src/a.rs", True),
    ("src/*.rs", "src/x/a.rs", False),
    ("**/foo", "xfoo", True),
    ("**/foo", "a/b/foo", True),
    ("a/**/b", "a/x/y/b", True),
    ("a?c", "a/c", False),
    ("a[!b]c", "a/c", False),
    ("[]a]", "]", True),
    ("[a", "[a", True),
    ("{a,b{c,d}}.x", "bd.x", True),
    ("{a", "{a", True),
    (r"\*", "*", True),
    ("é?", "éé", False),
    ("[z-a]", "m", False),
]


@pytest.mark.parametrize("pattern,path,want", CASES)
def test_table(pattern, path, want):
    assert globs.matches(pattern, path) is want


def test_dialects():
    assert globs.matches("**/foo", "foo", "git") and not globs.matches("**/foo", "xfoo", "git")
    assert globs.matches("a/**/b", "a/b", "git") and globs.matches("a/**", "a/b/c", "git")


def test_random_against_slow_matcher(spark):
    r = random.Random(11)
    letters, seen = "ab/.é", []
    paths_ = ["".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(60)]
    for _ in range(150):
        pattern = "".join(r.choice(["a", "b", "/", ".", "*", "**", "?", "[ab]", "[!a]", "{a,b/}", "\\a", "é", "**/"]) for _ in range(r.randrange(1, 6)))
        seen.append((pattern, [p for p in paths_ if globs.matches(pattern, p)]))
        assert seen[-1][1] == [p for p in paths_ if slow_match(pattern, p)], pattern
    df = spark.createDataFrame([(p,) for p in paths_], "p string")
    row = df.agg(*(F.collect_list(F.when(globs.glob_column(F.col("p"), g), F.col("p"))).alias(f"c{i}") for i, (g, _) in enumerate(seen[:60]))).first()
    for i, (g, want) in enumerate(seen[:60]):
        assert sorted(row[f"c{i}"]) == sorted(want), g


@pytest.mark.parametrize(
    "pattern,kind,position",
    [("", "Empty", 0), ("a\\", "DanglingEscape", 1), ("a[b", "UnclosedCharacterClass", 1), ("[b-a]", "InvalidCharacterRange", 2), ("{a,}", "EmptyBraceAlternative", 3), ("x{a", "UnclosedBrace", 1), ("a}", "UnexpectedClosingBrace", 1), ("{a,b}" * 9, "ExpansionLimitExceeded", 40)],
)
def test_errors(pattern, kind, position):
    with pytest.raises(globs.PatternError) as e:
        globs.PathPattern(pattern)
    assert (e.value.kind, e.value.position) == (kind, position)
    assert globs.PathPattern("{a,b}" * 8).is_match("abababab")


def test_paths(spark):
    assert paths.normalise(b"./a//b%/\xff") == "a/b%25/%FF"
    assert paths.is_same_or_descendant("src/a", "src") and not paths.is_same_or_descendant("src2", "src")
    assert paths.collapse_prefixes(["src/nested", "src", "src2"]) == ["src", "src2"]
    assert paths.collapse_prefixes(["a.b", "a", "a/b"]) == ["a", "a.b"]
    df = spark.createDataFrame([("a/b/c.RS",), (".bashrc",), ("x.tar.gz",), ("a/.h.",)], "p string")
    got = df.select(paths.ancestors(F.col("p")).alias("a"), paths.extension(paths.base_name(F.col("p"))).alias("e")).collect()
    assert [tuple(r) for r in got] == [(["a", "a/b"], "rs"), ([], None), ([], "gz"), (["a"], "")]
