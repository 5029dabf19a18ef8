import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import chat
from evidentia.llm.chat import LAYOUTS, canonical_turns, format_chats, read_chats

NASTY = st.text(st.sampled_from(list("\\#</turn>: a\né\x00|")), max_size=20)


def run(spark, records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "json string").select(F.parse_json("json").alias("record"), F.lit(1).alias("text"))
    return {r.conv_id: r for r in read_chats(format_chats(canonical_turns(df))).collect()}


def test_layouts(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}, {"id": 2, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]},
        {"id": 3, "instruction": "do", "input": "this", "output": "done"}, {"id": 4, "prompt": "p", "completion": "c"}, {"id": 5, "prompt": "p", "response": "r"}, {"id": 6, "system": "s", "prompt": "p", "response": "r"},
        {"conv_id": 7, "turn": 1, "role": "assistant", "text": "second"}, {"conv_id": 7, "turn": 0, "role": None, "text": "first"},
        {"id": "identity_0", "conversations": [{"from": "human", "value": "a"}]}, {"id": "identity_1", "conversations": [{"from": "human", "value": "b"}]}, {"id": 10, "instruction": "do", "output": "done"},
        {"id": 11, "messages": [{"role": "user", "content": "hi", "name": "Ann"}, {"content": {"parts": ["x"]}}], "source": {"url": "u"}}, {"prompt": "p", "response": "r", "source": "web", "more": [1]},
        {"id": 12, "system": "s", "prompt": "p", "response": "r", "score": 0.5},
    ]
    got = {i: [(t.role, t.text) for t in r.turns] for i, r in run(spark, records).items()}
    assert got == {
        "1": [("user", "hi"), ("assistant", "ho")], "2": [("user", "hi"), ("assistant", "")], "3": [("user", "do\n\nthis"), ("assistant", "done")], "4": [("user", "p"), ("assistant", "c")],
        "5": [("user", "p"), ("assistant", "r")], "6": [("system", "s"), ("user", "p"), ("assistant", "r")], "7": [("", "first"), ("assistant", "second")],
        "identity_0": [("user", "a")], "identity_1": [("user", "b")], "10": [("user", "do"), ("assistant", "done")], "11": [("user", "hi"), ("", '{"parts":["x"]}')],
        None: [("user", "p"), ("assistant", "r")], "12": [("system", "s"), ("user", "p"), ("assistant", "r")],
    }


def test_unmatched_records_are_given_back(spark):
    odd = [{"id": 8, "odd": {"shape": 1}}, {"id": 9, "messages": []}, {"id": 9, "messages": ["text"]}, [1, 2], "x", None, {}, {"prompt": "only"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in [*odd, {"prompt": "p", "response": "r"}]] + [(None,)], "json string").select(F.parse_json("json").alias("record"))
    rest = chat.unmatched(df).collect()
    assert len(rest) == len(odd) + 1 and len({r.fingerprint for r in rest}) == 4  # those without a field path share one, and so do the two with messages
    assert canonical_turns(df).count() == 2


def test_long_texts_and_roles(spark):
    text, role = "a\\###</turn>" * 20_000, "r: " * 5_000
    got = run(spark, [{"id": 1, "messages": [{"role": role, "content": text}, {"role": "assistant", "content": text}]}])["1"]
    assert [(t.role, t.text) for t in got.turns] == [(role, text), ("assistant", text)] and list(got.learnt) == [text]


def test_fingerprints_differ_and_match_spark(spark):
    every = [f for x in LAYOUTS for f in x.fingerprints()]
    assert len(set(every)) == len(every)
    df = spark.range(1).select(F.parse_json(F.lit('{"id": 1.5, "prompt": "x", "response": true}')).alias("v")).select(chat.fingerprint(F.col("v")).alias("f"))
    assert df.first().f in next(x for x in LAYOUTS if x.name == "prompt and response").fingerprints()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", "#<"]), NASTY), min_size=1, max_size=4), min_size=1, max_size=12))
def test_round_trip(spark, chats):
    chats = [[(r, t.replace("\x00", "")) for r, t in c] for c in chats]
    got = run(spark, [{"id": i, "messages": [{"role": r, "content": t} for r, t in c]} for i, c in enumerate(chats)])
    for i, c in enumerate(chats):
        assert [(t.role, t.text) for t in got[str(i)].turns] == c
        assert list(got[str(i)].learnt) == [t for r, t in c if r == "assistant"]
        assert got[str(i)].formatted.count("</turn>\n") == len(c)


def test_repeated_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", None), (None, 3, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(F.to_variant_object(F.struct("*")).alias("record"))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_chats(format_chats(canonical_turns(df))).collect()}
    assert got == {"1": [("assistant", ""), ("user", "x"), ("user", "x")], None: [("user", "y")]}
    assert read_chats(format_chats(canonical_turns(df.limit(0)))).count() == 0


def test_plan_is_native(spark):
    from evidentia.llm.queries import op9_chat_format

    plan = op9_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    row = op9_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
