"""Queries of repository identities, of workspaces whose paths are those of all ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.operators import repositories
from quillmeter.plans.registry import query
from quillmeter.sources.tables import table

#: A page's workspace: its host and path as folders, some with a slash at the end.
_PATH = "concat('/ws/', regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END)"
_HOST, _PART = "'/ws/' || split_part(split_part(url, '//', 2), '/', 1)", "split_part(split_part(url, '//', 2), '/', 2)"
#: Checkouts: hosts of odd length, below them folders of two letters as linked worktrees or as repositories of their own.
_ROOTS = f"""h AS (SELECT DISTINCT {_HOST} AS h FROM pages), f AS (SELECT DISTINCT {_HOST} AS h, {_PART} AS p FROM pages WHERE {_PART} IN ('en', 'de', 'fr')),
roots AS (SELECT h AS root, h || '/.git' AS git_dir, CASE WHEN length(h) % 7 > 0 THEN h || '/.git' END AS common_dir FROM h WHERE length(h) % 2 = 1
UNION ALL SELECT h || '/' || p, h || '/.git/worktrees/' || p, CASE WHEN p = 'de' THEN h || '/bare' ELSE h || '/.git' END FROM f WHERE p <> 'fr' UNION ALL SELECT h || '/fr', h || '/fr/.git', h || '/fr/.git' FROM f WHERE p = 'fr')"""
_FOUND = f"""{_ROOTS}, w AS (SELECT page_id, rtrim({_PATH.replace("regexp_replace(url, '^https?://', '')", "regexp_replace(url, '^https?://', '')")}, '/') AS p FROM pages),
n AS (SELECT page_id, any_value(p) AS p, arg_max(root, length(root)) AS root FROM w LEFT JOIN roots ON p = root OR starts_with(p, root || '/') GROUP BY 1),
i AS (SELECT page_id, CASE WHEN r.root IS NULL THEN 'non_git' WHEN common_dir IS NULL THEN 'unknown' WHEN git_dir <> common_dir THEN 'linked_worktree' WHEN p = r.root THEN 'repository_root' ELSE 'repository_subdir' END AS kind, CASE WHEN common_dir IS NOT NULL THEN sha256(common_dir || chr(0)) END AS hash,
CASE WHEN git_dir <> common_dir AND suffix(common_dir, '/.git') THEN split_part(common_dir, '/', 3) ELSE string_split(r.root, '/')[-1] END AS label, CASE WHEN git_dir <> common_dir THEN 'git_worktree' WHEN common_dir IS NOT NULL THEN 'git_common_dir' END AS identity_source FROM n LEFT JOIN roots r ON r.root = n.root)"""


def _identities(spark, sf):
    pages = table(spark, sf, "pages")
    rest = F.split_part(F.col("url"), F.lit("//"), F.lit(2))
    cut = pages.select(F.concat(F.lit("/ws/"), F.split_part(rest, F.lit("/"), F.lit(1))).alias("h"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("p"))
    git = lambda c: F.concat(c, F.lit("/.git"))
    h, p = F.col("h"), F.col("p")
    hosts = cut.select("h").distinct().where("length(h) % 2 = 1").select(h.alias("root"), git(h).alias("git_dir"), F.when(F.length("h") % 7 > 0, git(h)).alias("common_dir"))
    below = cut.where("p IN ('en', 'de', 'fr')").distinct()
    own = F.concat(h, F.lit("/"), p)
    linked = below.where("p <> 'fr'").select(own.alias("root"), F.concat(h, F.lit("/.git/worktrees/"), p).alias("git_dir"), F.when(p == "de", F.concat(h, F.lit("/bare"))).otherwise(git(h)).alias("common_dir"))
    whole = below.where("p = 'fr'").select(own.alias("root"), git(own).alias("git_dir"), git(own).alias("common_dir"))
    return repositories.identities(pages.select("page_id", F.expr(_PATH).alias("path")), "page_id", "path", hosts.union(linked).union(whole))


@query(f"WITH {_FOUND} SELECT * FROM i")
def repository_identities(spark, sf):
    return _identities(spark, sf)


@query(f"""WITH {_FOUND}, c AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '[]' ELSE '[' || CASE WHEN page_id % 4 > 1 THEN '{{"name":"a' || (page_id % 9) || '","kind":"http"}},' ELSE '' END || '{{"name":"b","kind":"stdio"}}]' END AS config FROM pages)
SELECT page_id, kind, hash, label, 2::INTEGER AS sections, (length(html) + page_id)::BIGINT AS tokens, sha256(config) AS config_hash FROM i JOIN pages USING (page_id) JOIN c USING (page_id)""")
def context_footprints(spark, sf):
    pages = table(spark, sf, "pages")
    row = lambda section, tokens: pages.select("page_id", F.lit(section).alias("section"), F.lit("x").alias("name"), tokens.cast("long").alias("tokens"))
    report = row("Tools", F.length("html")).union(row("Memory", F.col("page_id"))).union(row("Memory", F.lit(0)))
    server = lambda where, name, kind: pages.where(where).select("page_id", name.alias("name"), F.lit(kind).alias("kind"))
    servers = server("page_id % 4 > 0", F.lit("b"), "stdio").union(server("page_id % 4 > 1", F.expr("concat('a', page_id % 9)"), "http"))
    made = repositories.footprints(_identities(spark, sf), "page_id", report, servers)
    return made.select("page_id", "kind", "hash", "label", F.size("sections").alias("sections"), "tokens", "config_hash")
