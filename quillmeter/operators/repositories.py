"""Which repository a workspace belongs to, and what a workspace reports: its identity, its context, its configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import digests, text
from quillmeter.functions.values import bound
from quillmeter.operators import joins

#: Fixed value: characters of a label at most.
MOST_LABEL = 255


def prefixes(path: Column) -> Column:
    """A path and all folders above it, but for the root: ``/a/b`` gives ``/a`` and ``/a/b``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return bound(parts, lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(p, 1, n), "/")))))


def identities(workspaces: DataFrame, key: str, path: str, roots: DataFrame, labels: bool = True) -> DataFrame:
    """(key, kind, hash, label, identity_source) of workspaces by the nearest folder above them that is a checkout.

    roots: (root, git_dir, common_dir), a checkout's folder and those of its own and the shared repository data. A checkout
    whose two differ is a ``linked_worktree``: it has the hash of the shared folder, as all of them have, and the label
    of the main checkout, not of its own passing folder. Others are ``repository_root`` or ``repository_subdir``; without
    a shared folder a workspace's repository is ``unknown``, without a checkout it is ``non_git``. Labels that tell a place
    or a secret are left out. Workspaces meet checkouts on the folders above them, by equality; keys must be unique.
    """
    above = workspaces.select(key, F.explode(prefixes(F.col(path))).alias("root"))
    nearest = joins.last_of(above.join(roots, "root"), [key], [F.length("root")])
    found = workspaces.select(key, F.element_at(prefixes(F.col(path)), -1).alias("_p")).join(nearest, key, "left")
    linked = F.col("git_dir").isNotNull() & (F.col("git_dir") != F.col("common_dir"))
    known = F.col("common_dir").isNotNull()
    kind = F.when(F.col("root").isNull(), "non_git").when(~known, "unknown").when(linked, "linked_worktree").when(F.col("_p") == F.col("root"), "repository_root").otherwise("repository_subdir")
    main = F.nullif(F.regexp_extract("common_dir", r"^(.+)/\.git/*$", 1), F.lit(""))
    basis = F.when(linked, F.coalesce(main, F.col("root"))).otherwise(F.col("root"))
    label = text.safe_text(text.base_name(basis), MOST_LABEL) if labels else F.lit(None).cast("string")
    source = F.when(known, F.when(linked, "git_worktree").otherwise("git_common_dir"))
    return found.select(key, kind.alias("kind"), F.when(known, digests.ended(F.col("common_dir"))).alias("hash"), label.alias("label"), source.alias("identity_source"))


def footprints(found: DataFrame, key: str, report: DataFrame, servers: DataFrame) -> DataFrame:
    """(key, identity, sections, tokens, config_hash): what goes up for each workspace with a report.

    report: (key, section, name, tokens), rows of its context report; servers: (key, name, kind), its configuration, of
    which only a digest of the sorted list goes up; without servers that of an empty list.
    """
    per = report.groupBy(key, "section").agg(F.sum("tokens").alias("tokens"))
    sections = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "tokens"))).alias("sections"), F.sum("tokens").alias("tokens"))
    config = servers.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", "kind"))).alias("_c"))
    both = sections.join(found, key).join(config, key, "left")
    names = [c for c in found.columns if c != key]
    written = F.coalesce(F.to_json("_c"), F.lit("[]"))
    return both.select(key, *names, "sections", "tokens", F.sha2(written, 256).alias("config_hash"))
