"""Stored state and what a new scan changes in it: rescans, uploads, retention, merges and bounded histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_rescan(files: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(workspace) to scan again: a file is new, gone or changed, the destination differs, or the upload is a week old.

    files: (workspace, file, mtime, destination); cache: the same with ``uploaded``. Both sides are reduced to a digest of a
    workspace's sorted files: sums of hashes, so that no list is built.
    """
    mark = lambda rows: rows.groupBy("workspace").agg(F.sum(F.xxhash64("file", "mtime").cast("decimal(38,0)")).alias("_m"), F.count("*").alias("_k"), F.max("destination").alias("_d"))
    old = mark(cache).join(cache.groupBy("workspace").agg(F.max("uploaded").alias("uploaded")), "workspace").withColumnsRenamed({"_m": "_om", "_k": "_ok", "_d": "_od"})
    both = mark(files).join(old, "workspace", "left")
    same = F.col("_m").eqNullSafe(F.col("_om")) & F.col("_k").eqNullSafe(F.col("_ok")) & F.col("_d").eqNullSafe(F.col("_od"))
    return both.where(~same | (F.col("uploaded") <= now - F.expr(f"interval {days} days"))).select("workspace")


def to_upload(payloads: DataFrame, published: DataFrame, key: str, digest: str, at: str, now: Column, days: int = 7) -> DataFrame:
    """Payloads whose digest differs from the published one, or whose publication is ``days`` old."""
    last = published.select(key, F.col(digest).alias("_old"), F.col(at).alias("_at"))
    stale = F.col("_at") <= now - F.expr(f"interval {days} days")
    return payloads.join(last, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old")) | F.coalesce(stale, F.lit(True))).select(payloads.columns)


def replaced(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, but those with a key of ``fresh`` replaced by its rows: late data changes a bucket as a whole."""
    return old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def kept_newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of a whole table in a total order."""
    return rows.orderBy(*order).limit(most)


def history(rows: DataFrame, group: str, at: str, seq: str, most: int) -> DataFrame:
    """At most ``most`` newest rows of a group, one for each second: the last one written."""
    second = F.unix_seconds(F.col(at).cast("timestamp"))
    one = rows.withColumn("_s", second).withColumn("_n", F.row_number().over(Window.partitionBy(group, "_s").orderBy(F.desc(seq)))).where("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_s")))).where(F.col("_n") <= most).drop("_n", "_s")


def within(rows: DataFrame, at: Column, now: Column, days: Column | int) -> DataFrame:
    """Rows that are not older than ``days`` (a number, or a column for each kind of row), to the microsecond; those without a time go."""
    return rows.where(F.unix_micros(now) - F.unix_micros(at) <= F.lit(days).cast("long") * 86_400_000_000)


def committable(index: DataFrame, committed: DataFrame, accepted: DataFrame, key: str, mark: str, empty: Column) -> DataFrame:
    """Index entries that may be stored after an upload broke off: empty, accepted, or unchanged since the last commit."""
    before = committed.select(key, F.col(mark).alias("_old"))
    joined = index.join(before, key, "left").join(accepted.select(key, F.lit(True).alias("_in")).distinct(), key, "left")
    return joined.where(empty | F.coalesce("_in", F.lit(False)) | F.col(mark).eqNullSafe(F.col("_old"))).select(index.columns)


def detected(rows: DataFrame, keys: list[str], bucket: str, tokens: str, first: list[str], seen: str, order: str) -> DataFrame:
    """(keys, buckets, tokens, firsts, last_seen): uses by key, of each column the first value in order that is there.

    ``seen`` is compared as text. Tokens are summed for each bucket first, so ``buckets`` counts those with any row.
    """
    per = rows.groupBy(*keys, bucket).agg(F.sum(tokens).alias("_t"), F.max(seen).alias("_s"), *[F.min(F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"_f_{c}") for c in first])
    some = [F.min(f"_f_{c}")[c].alias(c) for c in first]
    return per.groupBy(*keys).agg(F.count("*").alias("buckets"), F.sum("_t").alias("tokens"), *some, F.max("_s").alias("last_seen"))


def products_match(left: Column, right: Column) -> Column:
    """Whether two product names are one: equal, or one ends with an underscore and the other; case and blanks don't count."""
    a, b = F.lower(F.trim(left)), F.lower(F.trim(right))
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("_"), b)) | F.endswith(b, F.concat(F.lit("_"), a)))


def with_quota(uses: DataFrame, windows: DataFrame, product: str) -> DataFrame:
    """Uses with the most constraining window of the plan that names their product: limited first, then percent, last of equals.

    windows: (plan_keys, limited, percent, pos). A use joins by each plan key, in lower case; without a plan the window is null.
    """
    keyed = windows.select(F.explode(F.transform("plan_keys", lambda k: F.lower(k))).alias("_k"), F.struct("limited", "percent", "pos").alias("_w"))
    best = keyed.groupBy("_k").agg(F.max("_w").alias("_w"))
    return uses.withColumn("_k", F.lower(F.trim(F.col(product)))).join(best, "_k", "left").select(*uses.columns, "_w.limited", "_w.percent")


def health(rules: list[tuple[str, str, Column]]) -> Column:
    """(state, blockers): the worst kind of the rules that hold, and their names in order.

    rules: (name, kind, condition); kinds from worst: protocol, account, blocking, warning, setup; none: healthy.
    """
    held = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))) for name, kind, c in rules]))
    state = reduce(lambda rest, kind: F.when(F.exists(held, lambda h: h["kind"] == kind), kind).otherwise(rest), reversed(("protocol", "account", "blocking", "warning", "setup")), F.lit("healthy"))
    return F.struct(state.alias("state"), F.transform(held, lambda h: h["name"]).alias("blockers"))


def overlaid(scopes: list[DataFrame], name: str, disabled: DataFrame) -> DataFrame:
    """Configured servers by name: a later scope replaces an earlier one; disabled names are flagged, not dropped."""
    cols = [c for c in scopes[0].columns if c != name]
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(scopes)])
    last = ranked.groupBy(name).agg(F.max(F.struct("_rank", *cols)).alias("_l")).select(name, *[F.col("_l")[c].alias(c) for c in cols], F.col("_l")["_rank"].alias("scope"))
    off = disabled.select(name, F.lit(True).alias("_off")).distinct()
    return last.join(off, name, "left").withColumn("disabled", F.coalesce("_off", F.lit(False))).drop("_off")
