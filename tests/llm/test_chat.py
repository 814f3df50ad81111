import hashlib

import duckdb
import pytest

from loomstat.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "\\<|", "<\\|", "a\\\\<|im_start|>user\n", "<", "|>", "<\\/", "\n<|im_end|>\n", "\\", "<<||", ""]


def test_escape_round_trip(spark):
    rows = [(k, 0, r, t) for k, (r, t) in enumerate((r, t) for r in NASTY for t in NASTY)]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_chat(df)
    got = formatted.select("conv_id", chat.parse_chat(formatted.formatted).alias("t")).collect()
    want = {k: [(r, t)] for k, _, r, t in rows}
    assert {r["conv_id"]: [tuple(x) for x in r["t"]] for r in got} == want
    assert all("<|im_end|>" not in r["formatted"][:-len("<|im_end|>\n")] for r in formatted.collect())


def test_digests_and_state_machine(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a<|x"),
        (2, 0, "assistant", "first"),
        (3, 1, "user", None), (3, 0, None, "t"),
        (4, 0, "user", "u"), (4, 0, "user", "u"),
        (None, 0, "user", "q"), (None, 1, "assistant", "r"),
    ]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1]["valid"] and got[None]["valid"]
    assert not got[2]["valid"] and not got[3]["valid"] and not got[4]["valid"]
    assert got[4]["n_turns"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\nu\nassistant\na<|x\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"a<|x").hexdigest() and got[1]["loss_chars"] == 4
    assert got[3]["turns_sha256"] == hashlib.sha256(b"\nt\nuser\n\n").hexdigest()
    firsts = {r["conv_id"]: r["first_error"] for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert firsts[2] == 0 and firsts[1] is None and firsts[4] == 1


def test_empty(spark):
    assert chat.digests(chat.format_chat(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql(spark):
    rows = [(k // 3, k % 3, ["system", "user", "assistant"][k % 3], NASTY[k % len(NASTY)] + "é") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    conversations = df.toPandas()  # noqa: F841
    want = duckdb.sql(chat.ORACLE)
    got = chat.digests(chat.format_chat(chat.with_probe(spark, df))).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("text", NASTY)
def test_probe_is_escaped(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text + chat.PROBE)], SCHEMA)
    assert chat.format_chat(df).first()["formatted"].count("<|im_start|>") == 1
