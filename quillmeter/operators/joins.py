"""Joins: last call wins, containment, calendars, precedence, merges and multiset comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.values import bound


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """For each key the last row in a total order, by one grouped maximum."""
    cols = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *cols)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}") for c in cols])


def _run_hashes(parts: Column, size: int, first: int, last: Column) -> Column:
    """Hashes of each ``size`` neighbours, from place ``first`` to where the last one starts."""
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), lambda i: F.xxhash64(F.array_join(F.slice(parts, i, size), "\0"))))


def _anchors(signatures: DataFrame, text: str) -> DataFrame:
    """Adds ``size`` and ``key``: words inside a signature (neither its first nor last), one or three; else its first characters.

    A text that contains the signature has the words inside it as whole words, and the characters at some place.
    """
    n = F.size(F.split(F.col(text), " "))
    inner = lambda k: bound(F.split(F.col(text), " "), lambda w: F.array_min(_run_hashes(w, k, 2, F.size(w) - k)))
    size = F.when(n >= 5, 3).when(n >= 3, 1).otherwise(0)
    key = F.when(n >= 5, inner(3)).when(n >= 3, inner(1)).otherwise(F.xxhash64(F.array_join(F.slice(F.split(F.col(text), ""), 1, 8), "\0")))
    return signatures.withColumns({"size": size, "key": key})


def _keys(texts: DataFrame, text: str, sizes: list[int]) -> Column:
    """What a text offers for signatures of these sizes to meet: runs of words, and of eight characters for size 0."""

    def offers(k: int) -> Column:
        hashes = bound(F.split(F.col(text), " " if k else ""), lambda w: _run_hashes(w, k or 8, 1, F.size(w) - (k or 8) + 1))
        return F.transform(F.array_distinct(hashes), lambda h: F.struct(F.lit(k).alias("size"), h.alias("key")))

    return F.flatten(F.array_compact(F.array(*[offers(k) for k in sizes])))


def longest_contained(texts: DataFrame, text: str, id_: str, signatures: DataFrame, signature: str, label: str, least: int = 24) -> DataFrame:
    """(id, label): the longest signature that a text contains; none if two labels share the longest length.

    Texts and signatures meet on a hash of words that lie inside the signature (or of its first characters, where it has
    fewer than three words), by an equi-join of any size: hashes and ids alone. The pairs that met get their texts back,
    and ``contains`` decides. Ids must be unique. Null texts and signatures meet nothing.
    """
    some = _anchors(signatures.where(F.octet_length(signature) >= least).select(F.col(signature).alias("_s"), F.col(label).alias("label")), "_s")
    sizes = [r["size"] for r in some.select("size").distinct().collect()]  # three at most
    if not sizes:
        return texts.select(id_, F.lit(None).cast(signatures.schema[label].dataType).alias("label")).where("false")
    own = texts.where(F.col(text).isNotNull()).select(id_, text)
    offers = own.select(id_, F.inline(_keys(own, text, sizes)))
    pairs = offers.join(some, ["size", "key"]).select(id_, "_s", "label")
    met = own.join(pairs, id_).where(F.col(text).contains(F.col("_s")))
    per = met.groupBy(id_, F.octet_length("_s").alias("_n")).agg(F.count_distinct("label").alias("_k"), F.min("label").alias("label"))
    return last_of(per, [id_], [F.col("_n")]).where("_k = 1").select(id_, "label")


def calendar_matches(events: DataFrame, time: str, rules: DataFrame, zone: str = "UTC") -> DataFrame:
    """Events and rules whose minute, hour, weekday (0 and 7 are Sunday), day and month agree; a null in a rule matches all.

    Fields are those of local time in ``zone``. Rules are joined by equality: an event offers a key for each set of fields
    that some rule fixes, of which there are 32 at most.
    """
    t = F.from_utc_timestamp(F.col(time), zone)
    parts = {"minute": F.minute(t), "hour": F.hour(t), "weekday": F.dayofweek(t) - 1, "day": F.dayofmonth(t), "month": F.month(t)}
    fixed = lambda r: F.array(*[F.col(f"{r}.{c}").isNotNull() for c in parts])
    value = {c: F.col(f"_r.{c}") % 7 if c == "weekday" else F.col(f"_r.{c}") for c in parts}
    keyed = rules.alias("_r").select("rule", fixed("_r").alias("_f"), F.array(*[F.coalesce(v.cast("int"), F.lit(-1)) for v in value.values()]).alias("_key"))
    shapes = [r[0] for r in keyed.select("_f").distinct().collect()]  # 32 at most
    if not shapes:
        return events.select("*", F.lit(None).cast("string").alias("rule")).where("false")
    offer = F.array(*[F.struct(F.array(*map(F.lit, f)).alias("_f"), F.array(*[v if use else F.lit(-1) for v, use in zip(parts.values(), f, strict=True)]).alias("_key")) for f in shapes])
    offers = events.select("*", F.explode(offer).alias("_o"))
    return offers.join(keyed.select("rule", F.struct("_f", "_key").alias("_o")), "_o").select(*events.columns, "rule")


def best_scored(rows: DataFrame, id_: str, candidates: DataFrame, label: str, points: list[tuple[Column, int]], least: int, meet: list[tuple[list[Column], list[Column]]]) -> DataFrame:
    """(id, label, score): the candidate with the most points, ``least`` at least; none if two labels share the top score.

    points: conditions between a row and a candidate, and what each adds. meet: equalities, sides apart, of which one set
    holds for every pair with ``least`` points: pairs are formed by these equi-joins alone.
    """
    score = sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))
    met = None
    for left, right in meet:
        mine = rows.withColumns({f"_l{i}": c for i, c in enumerate(left)})
        other = candidates.withColumns({f"_r{i}": c for i, c in enumerate(right)})
        same = [mine[f"_l{i}"] == other[f"_r{i}"] for i in range(len(left))]
        pairs = mine.join(other, same).where(score >= least).select(id_, F.col(label).alias("label"), score.alias("score"))
        met = pairs if met is None else met.union(pairs)
    per = met.groupBy(id_, "score").agg(F.count_distinct("label").alias("_k"), F.min("label").alias("label"))
    return last_of(per.select(id_, F.col("score").alias("_s"), "score", "_k", "label"), [id_], [F.col("_s")]).where("_k = 1").select(id_, "label", "score")


def _evidence(rows: DataFrame, key: str, value: str, name: str, gaps: bool = False) -> DataFrame:
    """(key, name): the one value and how many there are, two for a conflict; with ``gaps`` a null is a conflict too."""
    gap = F.count_if(F.col(value).isNull()) if gaps else F.lit(0)
    n = F.when(gap > 0, 2).otherwise(F.count_distinct(value))
    return rows.groupBy(key).agg(F.struct(F.min(value).alias("v"), n.alias("n")).alias(name)).where(F.col(name)["n"] > 0)


def account_of(sessions: DataFrame, key: str, value: str, seen: DataFrame, used: DataFrame, parents: DataFrame, login: Column) -> DataFrame:
    """Sessions with ``account`` and its ``origin``; a conflict of one kind of evidence stops, nothing weaker is asked.

    In this order: what was observed of the session itself (``seen``), what its usage rows name (``used``, each row
    must), what was observed of its parents, the current ``login``. Observation and usage must agree where both are.
    """
    joined = sessions.join(_evidence(seen, key, value, "_o"), key, "left").join(_evidence(used, key, value, "_u", gaps=True), key, "left").join(_evidence(parents, key, value, "_p"), key, "left")
    n = lambda c: F.coalesce(F.col(c)["n"], F.lit(0))
    v = lambda c: F.col(c)["v"]
    clash = (n("_o") > 1) | (n("_u") > 1) | ((n("_o") == 1) & (n("_u") == 1) & (v("_o") != v("_u")))
    origin = F.when(clash, "conflict").when(n("_o") == 1, "observation").when(n("_u") == 1, "usage").when(n("_p") > 1, "conflict").when(n("_p") == 1, "lineage").when(login.isNotNull(), "login").otherwise("none")
    named = joined.withColumn("origin", origin)
    account = F.when(F.col("origin") == "observation", v("_o")).when(F.col("origin") == "usage", v("_u")).when(F.col("origin") == "lineage", v("_p")).when(F.col("origin") == "login", login)
    return named.withColumn(value, account).drop("_o", "_u", "_p")


def common_prefix(rows: DataFrame, group: str, order: str, signature: str, parents: DataFrame, parent: str) -> DataFrame:
    """(group, shared, own): how many leading rows of a group equal its parent's, and how many follow.

    Rows of a group are numbered in a total order and meet the parent's row of the same number; the first one that
    differs or has no partner ends the prefix. A group without a parent shares nothing. Null signatures are equal.
    """
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    placed = rows.select(group, F.col(signature).alias("_s"), at.alias("_at"))
    theirs = placed.select(F.col(group).alias("_p"), "_at", F.col("_s").alias("_ps"), F.lit(True).alias("_met"))
    mine = placed.join(parents.select(group, F.col(parent).alias("_p")), group, "left")
    both = mine.join(theirs, ["_p", "_at"], "left")
    same = F.coalesce("_met", F.lit(False)) & F.col("_s").eqNullSafe(F.col("_ps"))
    ends = both.groupBy(group).agg(F.count("*").alias("_n"), F.min(F.when(~same, F.col("_at"))).alias("_end"))
    shared = F.coalesce(F.col("_end") - 1, F.col("_n")).cast("long")
    return ends.select(group, shared.alias("shared"), (F.col("_n") - shared).alias("own"))


def only_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys with just one distinct value; keys with several are left out."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_k")).where("_k = 1").drop("_k")


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], either: list[str] = ()) -> DataFrame:
    """Full outer merge: the new row's columns, and the old row's where the new one has none; flags of ``either`` stay once set."""
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    flag = lambda c: F.coalesce(F.col(f"n.{c}"), F.lit(False)) | F.coalesce(F.col(f"o.{c}"), F.lit(False))
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns], *[flag(c).alias(c) for c in either])


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_left, n_right) where the two sides don't hold a key equally often."""
    both = left.groupBy(*keys).agg(F.count("*").alias("n_left")).join(right.groupBy(*keys).agg(F.count("*").alias("n_right")), keys, "full_outer")
    zero = F.lit(0).cast("long")
    return both.select(*keys, F.coalesce("n_left", zero).alias("n_left"), F.coalesce("n_right", zero).alias("n_right")).where("n_left <> n_right")


def closed_domain(counts: DataFrame, key: str, domain: list[str], value: str) -> DataFrame:
    """A row for each name of the domain, 0 where nothing was counted."""
    names = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return names.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))
