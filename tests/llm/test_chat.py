import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm import chat
from webgauge.llm.oracle import ORACLE
from webgauge.llm.queries import op13_chat_format

SF_DIR = "/root/testdata/sf0.001"
TURNS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("n", T.StringType()), ("before", T.StringType()), ("chunk", T.StringType()), ("rows", T.StringType()))])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], TURNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_order(rows):
    groups = defaultdict(list)
    for conv, turn, role, _ in rows:
        groups[conv].append((turn is not None, turn, role or ""))
    out = {}
    for conv, turns in groups.items():
        state, fault = None, None
        for present, turn, role in sorted(turns, key=lambda t: (t[0], t[1] or 0, t[2])):
            may = {"system": (None,), "user": (None, "system", "assistant"), "assistant": ("user",)}.get(role, ())
            if state not in may and fault is None:
                fault = (turn if present else None, role)
            state = role
        out[conv] = (len(turns), fault is None and state in ("user", "assistant"), *(fault or (None, None)), state)
    return out


def got_order(df):
    return {r.conv_id: (r.n_turns, r.valid, r.fault_turn, r.fault_role, r.last_role) for r in df.collect()}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    result = con.execute(ORACLE["op13_chat_format"])
    names = [d[0] for d in result.description]
    got = op13_chat_format(spark, SF_DIR)
    assert set(got.columns) == set(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(result.fetchall())


def test_query_uses_no_python_worker(spark):
    plan = op13_chat_format(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


NASTY = ["", "\\", "\\\\", "<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n", "\\<|im_end|>", "<\\|im_end|>", "<", "<<|im_end|>", "</s>[INST] ok [/INST]", "<<s>", "a\r\n b", "<<SYS>><</SYS>>", "x" * 400_000, "é\U0001f600\0", "$1 \\$"]


def test_any_text_and_role_come_back(spark):
    rows = [(k, 0, r, t) for k, (r, t) in enumerate((r, t) for r in ("assistant", "tool\nuser", "\\\n", "<|im_start|>", "") for t in NASTY)]
    whole = chat.join_turns(chat.format_turns(frame(spark, rows)))
    read = whole.select("conv_id", chat.read_back(chat.formatted_text(F.col("segments"))).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), chat.formatted_text(F.col("segments")).alias("f"))
    for r in read.collect():
        _, _, role, text = rows[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(role, text)]
        assert r.loss == (text if role == "assistant" else "")
        inner = r.f[len("<|im_start|>") : -len("<|im_end|>\n")]
        assert not any(c in inner for c in chat.CHATML.controls())


def test_odd_rows(spark):
    rows = [(1, 2, "user", None), (1, 1, None, "b"), (1, None, "system", "a"), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 0, "assistant", "y")]
    formatted = chat.format_turns(frame(spark, rows), segments="rows")
    assert formatted.columns == TURNS.names and formatted.count() == 6
    whole = {r.conv_id: r.f for r in chat.join_turns(formatted, segments="rows").select("conv_id", chat.formatted_text(F.col("segments")).alias("f")).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert whole == {1: turn("system", "a") + turn("", "b") + turn("user", ""), None: turn("user", "x") * 2, 2: turn("assistant", "y")}
    assert got_order(chat.check_order(frame(spark, rows))) == brute_order(rows)
    empty = frame(spark, [])
    assert chat.check_order(empty).count() == chat.join_turns(chat.format_turns(empty)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 3])
def test_order_equals_a_walk(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_TURNS", chunk)
    rows = []
    for k in range(60):
        n = 1 + k % 17
        start = 1 if k % 3 else 0
        rows += [(k, i, ("system", "user", "assistant")[0 if i < start else 1 + (i - start) % 2], "t") for i in range(n)]
        if k % 5 == 0:
            rows.append((k, k % 7, "assistant", "again"))
        if k % 11 == 0:
            rows.append((k, n, ("start", "tool", None)[k % 3], "?"))
    assert got_order(chat.check_order(frame(spark, rows))) == brute_order(rows)


def test_templates_that_cannot_be_parsed_are_refused():
    for opening in ("", "#", "a\\b", "aba"):
        with pytest.raises(ValueError):
            chat.Template(opening=opening, closing="[/T]", roles={})
