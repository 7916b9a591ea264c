"""Scans of paged lists over several cycles: pages are followed by their cursors, within bounds, and end with a finding.

A page is (scan, seq, mode, known, cursor, state, next, valid, truncated, digest, entities): ``cursor`` asked for it (null:
the first), ``state`` and ``next`` are those of ``cloud.cursor``, ``entities`` its keys in order. Cycles ask for few pages
each, so pages of one scan come in several batches; what is stored between them is the cursor that is due, the cursors
and keys that were seen, and how many pages there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.streaming import keyed

#: Pages and keys of a scan at most, rows of a chunk.
MOST_PAGES, MOST_KEYS, CHUNK_ROWS = 100, 2_000, 200

OUT = "scan string, page int, place int, entity string, outcome string, reason string, pages int, keys int"
STATE = "due string, pages int, keys array<string>, seen array<string>, done boolean"


def follow(most_pages: int = MOST_PAGES, most_keys: int = MOST_KEYS) -> keyed.Step:
    """The machine of one scan. Rows out: an entity of a page, or the end with its outcome and reason.

    A page that isn't due is left alone: one that another cycle asked for again, or a stranger. An invalid page ends a
    scan: what was found stays, ``degraded``; with nothing found it has ``failed``. Only the official end of a list whose
    pages were whole and whose cursors didn't repeat is ``healthy``. A scan in mode ``head`` reads one page; if its digest
    is known, it is ``unchanged`` and gives no rows.
    """

    def step(state: dict | None, page: dict) -> tuple[dict, list[dict]]:
        s = state or {"due": None, "pages": 0, "keys": [], "seen": [], "done": False}
        if s["done"] or page["cursor"] != s["due"]:
            return s, []
        s = s | {"keys": list(s["keys"]), "seen": list(s["seen"])}

        def end(rows: list[dict], outcome: str, reason: str | None) -> tuple[dict, list[dict]]:
            last = {"scan": page["scan"], "page": None, "place": None, "entity": None, "outcome": outcome, "reason": reason, "pages": s["pages"], "keys": len(s["keys"])}
            return s | {"done": True, "due": None, "seen": [], "keys": []}, [*rows, last]

        if not page["valid"] or page["state"] is None:
            return end([], "degraded" if s["keys"] else "failed", "invalid")
        s["pages"] += 1
        known, rows = set(s["keys"]), []
        for place, entity in enumerate(page["entities"] or []):
            if len(known) >= most_keys and entity not in known:
                break
            if entity not in known:
                known.add(entity)
                s["keys"].append(entity)
            rows.append({"scan": page["scan"], "page": s["pages"], "place": place, "entity": entity, "outcome": None, "reason": None, "pages": None, "keys": None})
        churn = page["next"] is not None and page["next"] in s["seen"]
        if page["next"] is not None:
            s["seen"].append(page["next"])
        s["due"] = page["next"]
        whole = page["state"] == "terminal" and not page["truncated"] and not churn
        if page["state"] == "ambiguous":
            return end(rows, "degraded", "ambiguous")
        if page["mode"] == "head":
            if page["digest"] is not None and page["digest"] == page["known"]:
                return end([], "unchanged", None)
            return end(rows, "healthy", None) if whole else end(rows, "degraded", "head")
        if whole:
            return end(rows, "healthy", None)
        for reached, reason in ((page["truncated"], "truncated"), (churn, "cursor repeated"), (len(known) >= most_keys, "keys"), (s["pages"] >= most_pages, "pages")):
            if reached:
                return end(rows, "degraded", reason)
        return s, rows

    return step


def scanned(pages: DataFrame, **bounds: int) -> DataFrame:
    """Entities and ends of all scans of a table of pages."""
    return keyed.over_batch(pages, "scan", ["seq"], OUT, follow(**bounds))


def scanned_stream(pages: DataFrame, **bounds: int) -> DataFrame:
    """The same for a stream of pages: rows come with the batch that has their page."""
    return keyed.over_stream(pages, "scan", ["seq"], OUT, STATE, follow(**bounds))


def chunks(found: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """(scan, entity, page, place, chunk): the last row of each entity, in chunks of ``size`` in the order of entities.

    A scan has ``MOST_KEYS`` entities at most.
    """
    last = found.where("entity is not null").groupBy("scan", "entity").agg(F.max(F.struct("page", "place")).alias("_l")).select("scan", "entity", "_l.*")
    return last.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("scan").orderBy("entity")) - 1) / size).cast("int"))
