"""Records of every layout, alone as a table and mixed as JSON."""

import json

import pytest

from trendmill.llm import chat

ASK, SAY = {"role": "user", "content": "a?"}, {"role": "assistant", "content": "b"}
TWO = [("user", "a?"), ("assistant", "b")]
RECORDS = {
    "messages": ({"messages": [ASK, SAY], "extra": {"x": 1}}, TWO),
    "message_parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "?"}]},
                                    {"role": "model", "content": [{"type": "text", "text": "b"}]}]}, TWO),
    "wrapped": ({"data": {"messages": [ASK, SAY], "n": 2}}, TWO),
    "sharegpt": ({"conversations": [{"from": "human", "value": "a?"}, {"from": "gpt", "value": "b"}]}, TWO),
    "instruction": ({"instruction": "a?", "input": "", "output": "b"}, TWO),
    "prompt": ({"system": "s", "prompt": "a?", "completion": "b"}, [("system", "s"), *TWO]),
    "chat_prompt": ({"prompt": [ASK], "completion": "b"}, TWO),
    "chat_completion": ({"prompt": [ASK], "completion": [SAY]}, TWO),
    "preference": ({"prompt": "a?", "chosen": "b", "rejected": "c"}, TWO),
    "chat_preference": ({"chosen": [ASK, SAY], "rejected": [ASK, {"role": "assistant", "content": "c"}]}, TWO),
    "question": ({"question": "a?", "answer": "b", "odd <name>: `x`": [{"messages": 1}]}, TWO),
}
UNKNOWN = [{"prompt": {"text": "a"}, "completion": "b"}, {"question": [{"x": 1}], "answer": "b"}, {"text": "a"},
           {"data": {"prompt": "a", "completion": "b"}}, {"messages": [{"role": "user", "content": {"deep": "a"}}]}, [1], "x", {}]


def test_every_layout_has_a_record():
    assert set(RECORDS) == set(chat.LAYOUTS) - {"turn_rows"}
    assert len(chat.FINGERPRINTS) == len(chat.LAYOUTS)


def test_mixed_records(spark):
    rows = [(i, json.dumps(record)) for i, (record, _) in enumerate(RECORDS.values())]
    rows += [(100 + i, json.dumps(record)) for i, record in enumerate(UNKNOWN)]
    rows += [(200, "no json"), (201, None), (202, ""), (None, json.dumps(RECORDS["question"][0])), (0, rows[0][1]),
             (300, json.dumps({"messages": [ASK, {"role": "assistant", "content": [{"type": "text", "text": "b"}]}]})),
             (301, json.dumps({"messages": [{"role": None, "content": None}, {"role": "user", "content": "w " * 200_000}]}))]
    df = spark.createDataFrame(rows, "conv_id long, record string").selectExpr("*", "1 AS layout", "2 AS v", "3 AS turn")
    got = {}
    for r in chat.canonical_from_json(df).collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.turn, r.role, r.text))
    for i, (name, (_, turns)) in enumerate(RECORDS.items()):
        expected = [(name, t, role, text) for t, (role, text) in enumerate(turns)] * (2 if i == 0 else 1)
        assert sorted(got[i]) == sorted(expected)
    assert all(got[100 + i] == [(None, None, None, None)] for i in range(len(UNKNOWN)))
    assert all(got[i] == [(None, None, None, None)] for i in (200, 201, 202))
    assert got[None] == [("question", 0, "user", "a?"), ("question", 1, "assistant", "b")]
    assert [t[2:] for t in sorted(got[300])] == TWO
    assert sorted(got[301]) == [("messages", 0, "", ""), ("messages", 1, "user", "w " * 200_000)]
    assert chat.canonical_from_json(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n in RECORDS if n != "question"])
def test_tables(spark, name):
    record, turns = RECORDS[name]
    df = spark.read.json(spark.createDataFrame([(json.dumps({"conv_id": 5, **record}),)], "value string").rdd.map(lambda r: r[0]))
    assert chat.layout_of(df.schema) == name
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).orderBy("turn").collect()]
    assert got == [(5, i, role, text) for i, (role, text) in enumerate(turns)]
