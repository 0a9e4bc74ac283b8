import json
import random

from plumbline.llm.chat import canonical, format_chats, parse, read_back, records_from_turns, render, unescape


def test_round_trip():
    rng = random.Random(4)
    bits = ["###", "</turn>", "\\", "\n", "### ", "#", "a", " ", "/turn>", "<", "é"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "", "x\ny", "\\n"]), "".join(rng.choices(bits, k=rng.randrange(12)))) for _ in range(rng.randrange(4))]
        text, mask = render(turns)
        assert parse(text) == turns
        assert [unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2])] == [t for r, t in turns if r == "assistant"]


def test_layouts():
    want = [("user", "q"), ("assistant", "a")]
    for x in (
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "z"}], "id": 4},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
        {"prompt": "q", "completion": "a", "meta": {"prompt": 1}}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
    ):
        assert canonical(json.dumps(x))[1] == want, x
    assert canonical('{"instruction": "q", "input": "i", "output": null, "system": "s"}')[1] == [("system", "s"), ("user", "q\n\ni"), ("assistant", "")]
    for x in (None, "", "{", "[1]", '{"foo": 1}', '{"prompt": "q", "messages": []}'):
        assert canonical(x) == (None, [])


def test_tables(spark):
    rows = [(1, 2, "assistant", None, "x"), (1, 1, "user", "hi", "x"), (None, 1, "user", "n", None), (2, None, None, "last", None), (2, 5, "assistant", "### " * 30000, None), (3, 1, "user", "dup", None), (3, 1, "user", "dup", None)]
    schema = "conv_id long, turn long, role string, text string, formatted string"
    got = {r.conv_id: r for r in read_back(format_chats(records_from_turns(spark.createDataFrame(rows, schema))), "conv_id").collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 2}
    assert got[2].loss_chars == 120_000 and got[1].loss_chars == 0
    assert read_back(format_chats(records_from_turns(spark.createDataFrame([], schema))), "conv_id").count() == 0
    odd = format_chats(spark.createDataFrame([(1, None, "old"), (2, '{"question": "q", "answer": "a"}', None)], "id int, record string, layout string"))
    assert {(r.id, r.layout, r.formatted != "") for r in odd.collect()} == {(1, None, False), (2, "question", True)}


def test_broken_unicode_and_deep_nesting(spark):
    from plumbline.llm.chat import canonical, format_chats, read_back

    deep = '{"prompt": ' + "[" * 100_000 + "]" * 100_000 + ', "completion": "x"}'
    rows = [(1, '{"prompt": "a \\\\ud83d b", "completion": "ok \\\\udc00"}'.replace("\\\\", "\\")), (2, deep), (3, '{"turns": [{"role": "\\ud800", "text": null}]}')]
    assert canonical(deep) == (None, [])
    out = {r.id: r for r in format_chats(spark.createDataFrame(rows, "id int, record string")).collect()}
    assert out[1].formatted == "### user\na � b\n</turn>\n### assistant\nok �\n</turn>\n" and out[1].layout == "prompt"
    assert (out[2].layout, out[2].formatted, out[2].loss_mask) == (None, "", [])
    assert out[3].formatted == "### �\n\n</turn>\n"
    assert read_back(format_chats(spark.createDataFrame(rows, "id int, record string")), "id").count() == 3
