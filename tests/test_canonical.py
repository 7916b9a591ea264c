"""Canonical JSON: order, escapes, and the place of what is no whole number; repositories above paths."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmeter.functions import canonical
from quillmeter.operators import repositories


@pytest.mark.parametrize("text, want", [
    ('{"b":1, "a":[true,null,"x"]}', ('{"a":[true,null,"x"],"b":1}', None)), ("1.0", (None, "/")), ("1e2", (None, "/")), ('{"a/b":{"c~":[0,-0.5]}}', (None, "/a~1b/c~0/1")), ('{"b":1.5,"a":2.5}', (None, "/a")),
    ("18446744073709551615", ("18446744073709551615", None)), ("18446744073709551616", (None, "/")), ("-9223372036854775809", (None, "/")), ("1" * 5000, (None, "/")), ("NaN", (None, "malformed")), ("{", (None, "malformed")), ("", (None, "malformed")),
    ('"\\ud800"', (None, "malformed")), ('{"k":1,"k":2}', ('{"k":2}', None)), ('"\\u0001\\t\\/é"', ('"\\u0001\\t/é"', None)), ("[]", ("[]", None)), ("{}", ("{}", None)), ("[" * 100_000, (None, "malformed")), (None, (None, None)),
    ('{"\ue000":1,"\U00010000":2,"z":3}', ('{"z":3,"\U00010000":2,"\ue000":1}', None)),
])
def test_canonical_texts(text, want):
    assert canonical.canonicalised(text) == want


def test_column(spark):
    rows = spark.createDataFrame([('{"b":2,"a":1}',), ("[0.1]",), (None,)], "t string").select(canonical.strict(F.col("t")).alias("c")).select("c.*").collect()
    assert {tuple(r) for r in rows} == {('{"a":1,"b":2}', None), (None, "/0"), (None, None)}


def test_nearest_checkout(spark):
    roots = [("/w/app", "/w/app/.git", "/w/app/.git"), ("/w/app/inner", "/w/app/inner/.git", "/w/app/inner/.git"), ("/tmp/tree-1", "/w/app/.git/worktrees/tree-1", "/w/app/.git"), ("/lost", "/lost/.git", None), ("/b/tree", "/b/data/worktrees/t", "/b/data"), ("/home/me", "/home/me/.git", "/home/me/.git")]
    paths = {"root": "/w/app/", "sub": "/w/app/src/x", "near": "/w/app/inner", "name": "/w/application", "tree": "/tmp/tree-1/src", "lost": "/lost/a", "bare": "/b/tree", "none": "/else", "top": "/", "odd": None}
    got = repositories.identities(spark.createDataFrame(list(paths.items()), "k string, p string"), "k", "p", spark.createDataFrame(roots, "root string, git_dir string, common_dir string"))
    ended = lambda p: hashlib.sha256(p.encode() + b"\0").hexdigest()
    app, inner = ended("/w/app/.git"), ended("/w/app/inner/.git")
    assert {r.k: tuple(r)[1:] for r in got.collect()} == {
        "root": ("repository_root", app, "app", "git_common_dir"), "sub": ("repository_subdir", app, "app", "git_common_dir"), "near": ("repository_root", inner, "inner", "git_common_dir"), "name": ("non_git", None, None, None), "tree": ("linked_worktree", app, "app", "git_worktree"),
        "lost": ("unknown", None, "lost", None), "bare": ("linked_worktree", ended("/b/data"), "tree", "git_worktree"), "none": ("non_git", None, None, None), "top": ("non_git", None, None, None), "odd": ("non_git", None, None, None),
    }
