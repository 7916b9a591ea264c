"""Definition files on disk: property lists of both encodings, TOML, bad, large and too many files."""

import datetime
import plistlib

from pyspark.sql import functions as F

from quillmeter.sources import definitions


def test_property_lists_of_both_encodings(spark, tmp_path):
    rule = {"Minute": 30, "Hour": 24, "Weekday": 7, "Day": 0}
    whole = {"Label": " nightly ", "Program": "/bin/x", "ProgramArguments": ["a", 3, "b" * 5000], "WorkingDirectory": "/w", "StartCalendarInterval": [rule, "no rule", {"Month": 12, "Minute": "5"}]}
    for i, form in enumerate((plistlib.FMT_XML, plistlib.FMT_BINARY)):
        (tmp_path / f"{i}.plist").write_bytes(plistlib.dumps(whole | {"StartedAt": datetime.datetime(2030, 1, 2), "Data": b"\x00\xff"}, fmt=form))
    (tmp_path / "none.plist").write_bytes(plistlib.dumps({"Label": "plain"}))
    (tmp_path / "blank.plist").write_bytes(plistlib.dumps({"Label": "  "}))
    (tmp_path / "long.plist").write_bytes(plistlib.dumps({"Label": "é" * 129}))
    (tmp_path / "broken.plist").write_text("<plist><dict>")
    (tmp_path / "other.txt").write_text("x")
    got = sorted((r.file.rpartition("/")[2], r.label, len(r.command), r.workspace, r.place, r.minute, r.hour, r.weekday, r.day, r.month) for r in definitions.launchd(definitions.read_files(spark, str(tmp_path), "plist")).collect())
    both = [("nightly", 6 + 1 + 1 + 1 + 4096, "/w", 0, 30, None, 7, None, None), ("nightly", 4105, "/w", 1, None, None, None, None, 12)]
    assert got == [("0.plist", *both[0]), ("0.plist", *both[1]), ("1.plist", *both[0]), ("1.plist", *both[1]), ("none.plist", "plain", 0, None, None, None, None, None, None, None)]


def test_faults_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(definitions, "MOST_FILES", 3)
    monkeypatch.setitem(definitions.MOST_BYTES, "toml", 40)
    for name, body in (("a", "x = 1"), ("b", "x = "), ("c", "y = " + "1" * 40), ("d", "z = 1")):
        (tmp_path / f"{name}.toml").write_text(body)
    rows = definitions.parsed(definitions.read_files(spark, str(tmp_path), "toml"), "toml").select("file", F.to_json("value").alias("v"), "fault").collect()
    assert {r.file[-6]: (r.v, r.fault) for r in rows} == {"a": ('{"x":1}', None), "b": (None, "malformed"), "c": (None, "large"), "d": (None, "beyond")}
    empty = definitions.parsed(spark.createDataFrame([("/f/a.toml", None)], "file string, content binary"), "toml")
    assert [r.fault for r in empty.collect()] == ["malformed"]
    assert definitions.parsed(spark.createDataFrame([], "file string, content binary"), "toml").count() == 0


def test_servers_of_three_formats(spark):
    texts = [("j", "json", '{"mcpServers": {"a": {"command": "c", "disabled": true}, "b": {"url": "u"}, "c": {"args": []}, "d": 3}}', "mcpServers"), ("t", "toml", '[mcp_servers.a]\nurl = "u"\nwhen = 2030-01-02\nenabled = "no"\n[mcp_servers.b]\ncommand = "x"\nenabled = false', "mcp_servers")]
    want = {"j": [("a", "stdio", "c", True), ("b", "http", "u", False)], "t": [("a", "http", "u", False), ("b", "stdio", "x", True)]}
    for file, kind, body, block in texts:
        files = spark.createDataFrame([(file, body.encode())], "file string, content binary")
        got = definitions.servers(definitions.parsed(files, kind, F.lit("f")), ["file"], block).collect()
        assert sorted((r.name, r.kind, r.target, r.disabled) for r in got) == want[file]


def test_queries_read_all_files_of_a_folder(spark, tmp_path):
    """More files in a folder than ``MOST_FILES``: the queries read them all, as their SQL does."""
    from quillmeter.plans import definitions as plans

    n = definitions.MOST_FILES + 44
    spark.range(n).selectExpr("id * 500 AS p_partkey", "'Small  Box' AS p_name", "'Brand#1' AS p_brand", "'STEEL' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).selectExpr("id * 1000 AS c_custkey", "concat('C', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    keys = [i * 500 for i in range(n)]
    assert plans.automation_rows(spark, str(tmp_path)).count() == sum(k % 19 > 0 and k % 23 > 0 for k in keys)
    assert plans.configured_servers(spark, str(tmp_path)).count() == sum((k % 23 > 0) * (1 + (k % 3 > 0)) for k in keys)
    assert {r.label for r in plans.launchd_rules(spark, str(tmp_path)).select("label").collect()} == {f"C{i}" for i in range(n) if i * 1000 % 13 and i * 1000 % 17}
