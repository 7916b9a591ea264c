import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from quillmeter.llm import chat, tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
TEXT = st.lists(st.sampled_from(["\\", "#", " ", "</", "turn>", "</turn>", "### ", "User: ", ":", "a", "\n", "<", "é"]), max_size=12).map("".join)


@given(st.lists(st.tuples(TEXT | st.sampled_from(["user", "User", "assistant", "ß"]), TEXT), max_size=5))
def test_round_trip(turns):
    text = "".join(chat.formatted(*t)[0] for t in turns)
    assert chat.parsed(text) == turns


def brute(data):
    out = {}
    for conv, _, role, text in sorted(data, key=lambda r: (r[0], r[1])):
        n, a, k, b = out.setdefault(conv, (0, "", 0, ""))
        loss = (text or "") if role == "assistant" else ""
        out[conv] = (n + 1, a + f"{role}\n{text or ''}\n", k + len(loss), b + loss)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted((c, n, sha(a), k, sha(b)) for c, (n, a, k, b) in out.items())


def test_windows_and_read_back(spark):
    data = [(c, t, ("system" if t == 0 and c % 2 else "assistant" if t % 2 else "user"), f"turn {t} of {c} " + "word " * ((7 * t * c) % 90)) for c in range(8) for t in range(c * 5 + 1)]
    data += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (50, 0, "assistant", None), (50, 1, "user", "")]
    turns = spark.createDataFrame(data, SCHEMA)
    made = chat.windows(turns, PATH, budget=120, history_budget=40)
    rows = made.collect()
    assert max(r.window for r in rows) > 2 and any(r.n_repeated > 1 for r in rows)
    assert all(r.n_tokens <= 120 or len(chat.parsed(r.text)) - r.n_repeated <= 2 for r in rows)
    got = sorted(tuple(r)[:5] for r in chat.read_back(made).collect())
    assert got == brute(data)


def test_empty(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def test_odd_rows_and_windows_read_from_a_table(spark, tmp_path):
    data = [(None, 0, None, "no id"), (None, 1, "assistant", "told"), (3, 1, "user", "again"), (3, 1, "user", "again"), (3, 1, "assistant", "tie"), (3, None, "system", "first")]
    data += [(5, t, "assistant" if t % 2 else "user", "word " * 30) for t in range(40)] + [(6, 0, "user", "long " * 500), (6, 1, "assistant", "ok")]
    turns = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS window", "2 AS n_tokens", "'x' AS loss")
    chat.windows(turns, PATH, budget=120, history_budget=40).repartition(7).write.parquet(f"{tmp_path}/windows")
    stored = spark.read.parquet(f"{tmp_path}/windows")
    rows = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(stored).collect()}
    sorted_data = sorted(((-1 if c is None else c), (-1 if t is None else t), r or "", x) for c, t, r, x in data)
    assert {(-1 if c is None else c): v for c, v in rows.items()} == {c: v for c, *v in map(lambda x: (x[0], *x[1:]), brute(sorted_data)) for v in [tuple(v)]}
    # the budget holds for the formatted text: only a window with one new turn (and what repeats) may pass it
    encoder = tokenizing.load(PATH)
    for r in stored.collect():
        n = encoder.counts([r.text])[0]
        assert n <= r.n_tokens
        assert n <= 120 or len(chat.parsed(r.text)) - r.n_repeated == 1
