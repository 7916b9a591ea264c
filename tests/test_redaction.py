"""Redaction against a scan token by token, and the rules of keys at any depth."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmeter.functions import redaction

MARK = redaction.MARKS
KEY = "k7Q2m9Zx4Lw8Rt6Yv3Bn5"


def scan(text):
    """The state machine, one token after the other."""
    out, armed = [], False
    for t in re.split("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text):
        if not t:
            continue
        bare = t.strip("\"',;()[]{}")
        low, key, eq, value = bare.lower(), *bare.partition("=")
        value = value if eq else bare
        label = re.sub(":$", "", low) in redaction.LABELS
        secret = (
            bool(eq and value and any(m in key.lower() for m in redaction.ASSIGNED_KEYS))
            or value.lower().startswith(redaction.VENDOR_STARTS)
            or any(re.search(s, value) for s in redaction.SHAPES)
            or bool(len(value) >= 24 and re.fullmatch("[A-Za-z0-9_+=.-]+", value) and re.search("[0-9]", value) and re.search("[A-Za-z]", value) and re.search("[A-Za-z0-9]{20}", value))
        )
        if armed:
            if label:
                out.append(t)
                continue
            armed = False
            opaque = len(value) >= 12 and re.fullmatch("[A-Za-z0-9_+/=.-]+", value) and (re.search("[0-9_+/=.-]", value) or (value.lower() != value and value.upper() != value))
            out.append(MARK["secret"] if secret or opaque else t)
            continue
        machine = bool(value) and (key.lower() in redaction.MACHINE_KEYS or key.lower().endswith(redaction.MACHINE_ENDS)) if eq else re.search(redaction.UUID, value.lower()) or re.search(redaction.MACHINE_ID, value.lower())
        if value.lower().startswith(redaction.PATH_STARTS):
            out.append(MARK["path"])
        elif machine:
            out.append(MARK["machine"])
        elif re.search(redaction.ACCOUNT_ID, value.lower()):
            out.append(MARK["account"])
        elif low.startswith(("prompt=", "raw_prompt=", "user_prompt=")):
            out.append(MARK["prompt"])
            break
        elif secret:
            out.append(MARK["secret"])
        else:
            out.append(t)
            armed = label
    return " ".join(out)


PARTS = [
    "Bearer", "token", "Authorization:", "(password)", "api-key:", "expired", "s3ss-T0ken-42", "Password123456", "abcdefghijklmnop", KEY, f"sk-{KEY}", "ghp_x", "xoxb-1", "xoxq-1", "AKIA" + "A1" * 8, "AKIA" + "a1" * 8,
    "AIza" + "b" * 35, "eyJhbGciOi.payload12.signature", "eyJx.a.b", "0123456789abcdef0123456789ABCDEF", "1.20.3-rc.4-with-a-long-tail-1", "/Users/me/x", "~/x", "C:\\Users\\me", "path=/home/x", "file:/x", "/usr/lib", "acct_1", "org_", "user_a-b",
    "machine_7", "device_é", "serial=9", "disk_uuid=", "9b1deb4d-3b7d-4bad-9bdd-2b0d7b3dcb6d", "prompt=tell", "Raw_Prompt=x", "my_prompt=x", "=x", "pwd=1", "api_key=", "[REDACTED]", "[prompt]", "ok", "naïve", "\u3000", "\n", "a" * 30, "1" * 30,
]


def test_tokens_follow_the_scan(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(1500)] + PARTS + [f"{a} {b}" for a in PARTS[:5] for b in PARTS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", redaction.redacted(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.r == scan(r.t), r.t
    assert spark.range(1).select(redaction.redacted(F.lit(None).cast("string"))).first()[0] is None


def walk(value):
    if isinstance(value, dict):
        return {k: MARK[c] if (c := key_kind(k)) else walk(v) for k, v in value.items()}
    if isinstance(value, list):
        return [walk(v) for v in value]
    return scan(value) if isinstance(value, str) else value


def key_kind(key):
    low = key.lower()
    if any(m in low for m in redaction.SECRET_KEYS):
        return "secret"
    if "path" in low or low == "file" or low.endswith("_file"):
        return "path"
    if low in redaction.MACHINE_KEYS or low.endswith(redaction.MACHINE_ENDS):
        return "machine"
    if "account_id" in low or "organization_id" in low or low in redaction.ACCOUNT_KEYS:
        return "account"
    if "raw_prompt" in low or "user_prompt" in low or low == "prompt" or low.endswith("_prompt"):
        return "prompt"
    return None


def made(rng, depth):
    kind = rng.randrange(5 if depth else 3)
    if kind == 0:
        return rng.choice([1, -3, True, None, ""])
    if kind < 3:
        return rng.choice(PARTS) + rng.choice(["", ' "q" \\ \n', "{[,:", f" token {KEY}"])
    if kind == 3:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    names = ["detail", "a,b", "Session_Token", "config_path", "machine_id", "user_id", "prompt", "k\"q", "note", "x_file", "organization_id", "{", "é"]
    return {rng.choice(names): made(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_json_at_any_depth(spark):
    rng = random.Random(12)
    values = [made(rng, 5) for _ in range(400)]
    rows = spark.createDataFrame([(json.dumps(v, ensure_ascii=False),) for v in values], "t string").select("t", redaction.redacted_json(F.col("t")).alias("r")).collect()
    changed = 0
    for r in rows:
        value = json.loads(r.t)
        want = walk(value)
        if want == value:
            assert r.r == scan(r.t)
        else:
            changed += 1
            assert json.loads(r.r) == want, r.t
            assert r.r == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert changed > 150


@pytest.mark.parametrize("text", ["{broken token " + KEY, "plain", ""])
def test_no_json_is_a_text(spark, text):
    assert spark.range(1).select(redaction.redacted_json(F.lit(text))).first()[0] == scan(text)


def test_own_prefixes_and_labels(spark):
    row = spark.range(1).select(redaction.redacted(F.lit("mine_1 X-Own: abcdefghij-1 other"), ("mine_",), ("x-own",)).alias("r")).first()
    assert row.r == "[REDACTED] X-Own: [REDACTED] other"
