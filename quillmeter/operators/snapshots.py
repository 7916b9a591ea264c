"""Snapshots of sessions: what identifies a scan, what a new one changes, and what goes up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import digests

#: Parts of a snapshot that policies may drop.
POLICY_PARTS = ("titles", "labels", "artifacts", "attribution", "display_labels")


def scan_identity(size: Column, mtime_nanos: Column, derivation: Column, sidecar: Column) -> Column:
    """What makes a file worth another scan; the parser's version is no part of it."""
    return F.sha2(digests.framed([size.cast("string"), mtime_nanos.cast("string"), derivation, F.coalesce(sidecar, F.lit(""))]), 256)


def component_hashes(components: dict[str, Column]) -> dict[str, Column]:
    """A digest of each component's canonical JSON."""
    return {name: F.sha2(F.to_json(F.struct(value.alias("v"))), 256).alias(name) for name, value in components.items()}


def changed(fresh: DataFrame, stored: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, changed): snapshots with a component that differs from the stored one, and the names of these."""
    old = stored.select(key, *[F.col(p).alias(f"_{p}") for p in parts])
    names = F.array_compact(F.array(*[F.when(~F.col(p).eqNullSafe(F.col(f"_{p}")), F.lit(p)) for p in parts]))
    return fresh.join(old, key, "left").select(key, names.alias("changed")).where(F.size("changed") > 0)


def policies() -> list[tuple[bool, ...]]:
    """The 20 combinations of kept parts that can be asked for: display labels need titles and attribution."""
    every = [tuple(bool(i >> b & 1) for b in range(5)) for i in range(32)]
    return [p for p in every if not p[4] or (p[0] and p[3])]


def projected(rows: DataFrame, columns: dict[str, str], kept: dict[str, Column]) -> DataFrame:
    """Rows whose columns are null where the policy drops their part. columns: column by part; kept: flag by part."""
    return rows.withColumns({c: F.when(kept[part], F.col(c)) for part, c in columns.items()})


def policy_digests(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, digests): the distinct digests that a snapshot may have had under any policy, for those whose policy isn't known."""
    names = list(columns.values())

    def digest(row: Column, policy: tuple[bool, ...]) -> Column:
        kept = dict(zip(POLICY_PARTS, policy, strict=True))
        return F.sha2(F.to_json(F.struct(*[F.when(F.lit(kept[part]), row[c]).alias(c) for part, c in columns.items()])), 256)

    # a snapshot's rows, mostly one, come together; its digests are made and counted inside of it
    own = rows.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_r"))
    made = F.flatten(F.transform("_r", lambda r: F.array(*[digest(r, p) for p in policies()])))
    return own.select(key, F.size(F.array_distinct(made)).cast("long").alias("digests"))


def _frame(said: str) -> bytes:
    data = said.encode()
    return len(data).to_bytes(4, "big") + data


def manifest(rows: DataFrame, scope: str, source: str, fingerprint: str, active: str, first: Column, until: Column, contract: str) -> DataFrame:
    """(scope, source, digest, n): a digest of contract, scope, source and the distinct fingerprints active in a window.

    Frames have four bytes of length. Rows without a time of activity are left out. Fingerprints stream sorted through
    their scope's hash: a large scope is one task's work, of which nothing is kept but the hash.
    """
    inside = rows.where((F.col(active) >= first) & (F.col(active) < until)).select(F.col(scope).alias("scope"), F.col(source).alias("source"), F.col(fingerprint).alias("fp")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n = None, None, 0
        row = lambda: pa.RecordBatch.from_pylist([{"scope": key[0], "source": key[1], "digest": digest and digest.hexdigest(), "n": n}], pa.schema([("scope", pa.string()), ("source", pa.string()), ("digest", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for now, said in zip(zip(*(batch.column(c).to_pylist() for c in ("scope", "source")), strict=True), batch.column("fp").to_pylist(), strict=True):
                if now != key:
                    if key is not None:
                        yield row()
                    key, n = now, 0
                    digest = None if None in now else hashlib.sha256(b"".join(map(_frame, (contract, *now))))
                if said is not None:
                    n += 1
                    if digest:
                        digest.update(_frame(said))
        if key is not None:
            yield row()

    sorted_ = inside.repartition("scope", "source").sortWithinPartitions("scope", "source", "fp")
    made = sorted_.mapInArrow(run, "scope string, source string, digest string, n long")
    return made.select(F.col("scope").alias(scope), F.col("source").alias(source), "digest", "n")


def file_status(files: DataFrame, key: str, evidence: Column, snapshots: Column, confirmed_empty: Column) -> DataFrame:
    """(key, status): ``done``, ``empty`` once that is confirmed, or ``retry``: evidence of usage without a snapshot is a loss."""
    status = F.when(snapshots > 0, "done").when(evidence > 0, "retry").when(confirmed_empty, "empty").otherwise("retry")
    return files.select(key, status.alias("status"))


def union_marker(rows: DataFrame, key: str, census: Column, owners: Column, joined: Column) -> DataFrame:
    """Rows with ``usage_union``: only where the census is complete and every owner was met."""
    return rows.withColumn("usage_union", F.coalesce(census & (owners == joined), F.lit(False)))


def sync_counts(rows: DataFrame, status: str) -> DataFrame:
    """One row of counts by status."""
    names = ("done", "empty", "retry")
    return rows.agg(F.count("*").alias("scanned"), *[F.count_if(F.col(status) == n).alias(n) for n in names])


def aligned(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, dropped): columns that a policy removed from a snapshot, by its two forms with the same three keys."""
    pair = before.alias("b").join(after.alias("a"), keys)
    return pair.select(*keys, F.array_compact(F.array(*[F.when(F.col(f"b.{c}").isNotNull() & F.col(f"a.{c}").isNull(), F.lit(c)) for c in columns])).alias("dropped"))
