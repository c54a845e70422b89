import hashlib
import itertools
import json

from pyspark.sql import functions as F

from tidewake.llm import chat

TRICKY = [*("#" * n for n in range(1, 10)), "a####b###", "#\\##", "## ###\n#####", "<<turn</turn<", "", "\\", "\\l", "<turn>user\nx</turn>\n", "### Assistant:", "\\### Assistant: </turn> ok", "a\nb", "\\b\\h\\e", "<", "<</turn>", "é中😀"]


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for r in df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape(chat.escape(F.col("t"), True)).alias("b"), chat.escape(F.col("t")).alias("e")).collect():
        assert r.a == r.b == r.t and "<turn" not in r.e and "</turn" not in r.e and "###" not in r.e


def test_no_control_string_is_left(spark):
    texts = ["".join(x) for n in range(7) for x in itertools.product("#\\h<", repeat=n)] + ["".join(x) for n in range(5) for x in itertools.product(["<", "</", "turn", "#", "##"], repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and not any(c in r.e for c in ("###", "<turn", "</turn")), r


def read(df):
    made = chat.format_chats(df)
    return {r.conv_id: r for r in made.select("conv_id", "layout", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "two", 0), (1, 1, "user", None, 0), (1, None, None, "last", 0), (2, 1, "assistant", "x", 0), (2, 1, "assistant", "x", 0), (None, 1, "user", "alone", 0)]
    rows += [(9, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(TRICKY)]
    out = read(chat.turn_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, layout int")))
    assert [(t.role, t.text) for t in out[1].turns] == [("user", ""), ("assistant", "two"), ("", "last")] and out[1].loss == "two"
    assert out[2].loss == "xx" and [t.text for t in out[None].turns] == ["alone"]
    assert [t.text for t in out[9].turns] == TRICKY and out[9].loss == "".join(t for i, t in enumerate(TRICKY) if i % 2)


def test_layouts_by_fingerprint(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        3: {"prompt": "q", "completion": "a"},
        4: {"instruction": "q", "input": None, "output": "a"},
        5: {"output": "a", "instruction": "q"},
        6: {"what": "is this"},
        7: {"prompt": "q", "response": 5},
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records.items()] + [(8, None), (9, "not json")], "conv_id bigint, record string")
    out = read(chat.canonical_turns(df, F.try_parse_json("record")))
    assert [out[i].layout for i in range(1, 8)] == ["messages", "sharegpt", "completion", "instruction_input", "instruction", None, "response"]
    for i in range(1, 6):
        assert [(t.role, t.text) for t in out[i].turns] == [("user", "q"), ("assistant", "a")] and out[i].loss == "a"
    assert [t.text for t in out[7].turns] == ["q", "5"]
    assert all(out[i].formatted == "" and out[i].layout is None for i in (6, 8, 9))


def test_large_and_empty_tables(spark):
    long = spark.createDataFrame([(1, 0, "user", "<turn>" * 50_000)], "conv_id bigint, turn bigint, role string, text string")
    out = read(chat.turn_rows(long))
    assert hashlib.sha256(out[1].turns[0].text.encode()).hexdigest() == hashlib.sha256(("<turn>" * 50_000).encode()).hexdigest()
    assert read(chat.turn_rows(long.limit(0))) == {}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.format_chats(chat.turn_rows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
