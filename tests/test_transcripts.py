"""Transcript files on disk: reading, oversize and malformed lines, entries by category."""

import json

from pyspark.sql import functions as F

from quillmeter.functions import json as js
from quillmeter.operators import transcripts
from quillmeter.sources import transcripts as source



def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def line(kind, *blocks, **more):
    return {"type": kind, "message": {"content": list(blocks), **more}}


def call(ref, tool, **given):
    return {"type": "tool_use", "id": ref, "name": tool, "input": given}


def answer(ref, content):
    return {"type": "tool_result", "tool_use_id": ref, "content": content}


def test_entries_of_a_file(spark, tmp_path):
    """A morning in a garden: two calls of one turn, a turn in two lines, a boundary, a late second answer, odd lines."""
    forecast, beds, report = "sun until noon, then rain", "bed %d\n" * 9, "all watered"
    picture, note = {"type": "image"}, {"filename": "/garden/MEMORY.md", "moon": 3}
    write(
        tmp_path / "2031" / "garden.jsonl",
        [
            {"type": "user", "sessionId": "allotment", "message": {"content": "water the beds"}},
            line("assistant", call("sky", "WebSearch", query="rain"), call("count", "Bash", command="ls beds"), id="turn-1"),
            "[1, 2",
            line("user", answer("count", beds), answer("sky", [{"type": "text", "text": forecast}])),
            line("assistant", call("map", "NotebookRead", file_path="/garden/Plan.HTM"), id="turn-2"),
            line("assistant", call("help", "Agent"), id="turn-2"),
            line("user", answer("help", report)),
            line("user", answer("map", ["rows", picture, picture])),
            {"type": "system", "subtype": "compact_boundary"},
            "",
            line("user", answer("map", "?")),
            line("assistant", {"type": "text", "text": "done"}, id="turn-3"),
            line("user", picture),
            line("assistant"),
            line("assistant"),
            {"type": "attachment", "attachment": note},
        ],
    )
    write(tmp_path / "2031" / "seeds.csv", ["no transcript"])
    lines = source.json_lines(source.read_files(spark, str(tmp_path)))
    assert [r.ordinal for r in lines.orderBy("ordinal").collect()] == list(range(14))
    got = transcripts.entries(lines, F.lit("2031-04-02").cast("date")).select("session", "category", "tokens", "images", "path", "residency").collect()
    quarter = lambda s: -(-len(s) // 4)
    page = "/garden/Plan.HTM"
    # turns: 1, 2 (two lines), and behind the boundary 3 and two without an id
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted([
        ("shell_output", quarter(beds), 0, None, 1), ("web_fetch_search", quarter(forecast), 0, None, 1), ("agent_results", quarter(report), 0, None, 0),
        ("doc_reads_html", quarter("rows"), 0, page, 0), ("browser_and_images", 2 * transcripts.IMAGE_TOKENS, 2, None, 0), ("doc_reads_html", quarter("?"), 0, page, 3),
        ("browser_and_images", transcripts.IMAGE_TOKENS, 1, None, 2), ("memory_notes", quarter(json.dumps(note)), 0, note["filename"], 0),
    ], key=str)
    assert {r.session for r in got} == {"allotment"}
    assert transcripts.entries(lines.where("false"), F.lit("2031-04-02").cast("date")).count() == 0


def test_oversize_and_old_files_are_left_out(spark, tmp_path, monkeypatch):
    write(tmp_path / "small.jsonl", [{"cwd": "/ws"}])
    write(tmp_path / "large.jsonl", [{"cwd": "/" + "x" * 500}])
    monkeypatch.setattr(source, "MOST_BYTES", 100)
    files = source.read_files(spark, str(tmp_path))
    assert [r.file.rpartition("/")[2] for r in files.select("file").distinct().collect()] == ["small.jsonl"]
    assert source.read_files(spark, str(tmp_path), modified_after="2099-01-01T00:00:00").count() == 0


def test_json_functions(spark):
    cases = ["null", "true", "false", "0", "0.0", "2", '""', '"a"', "[]", "[0]", "{}", '{"a":"x, y: \\"z\\" \\\\","b":[1,{"c":null}]}']
    rows = spark.createDataFrame([(c,) for c in cases], "j string").withColumn("v", F.try_parse_json("j"))
    got = {r.j: r for r in rows.select("j", js.is_truthy(F.col("v")).alias("t"), js.spaced_json(F.col("v")).alias("s"), js.content_text(F.col("v")).alias("c")).collect()}
    for c in cases:
        value = json.loads(c)
        assert got[c].t == bool(value)
        assert got[c].s == json.dumps(value, ensure_ascii=False) or isinstance(value, float)
    assert got["null"].c == "" and got['"a"'].c == "a" and got["[0]"].c == "0"
