from __future__ import annotations

import hashlib
import itertools
import random

from eventloom.llm import chat, queries
from oracle import assert_same
from pyspark.sql import functions as F


def test_query(spark, data):
    assert_same(queries.op8_chat_format(spark, f"{data}/sf0.001"), queries.OP8_SQL, f"{data}/sf0.001")
    odd = queries.op8_chat_format(spark, f"{data}/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert (odd.n_turns, odd.loss_chars, odd.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def texts():
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s>", "[", "INST]", "/", "é", "\n", " [/INST]", "<s>[INST] ", "<\\s>", "𝒳"]
    r = random.Random(5)
    return ["", *bits, *(a + b for a, b in itertools.product(bits, bits)), *("".join(r.choices(bits, k=12)) for _ in range(200))]


def test_escapes_are_undone(spark):
    t = chat.Template()
    df = spark.createDataFrame([(x,) for x in texts()], "x string").select("x", chat.escaped(F.col("x"), t).alias("e"), chat.unescaped(chat.escaped(F.col("x"), t), t).alias("back"))
    for r in df.collect():
        assert r.back == r.x
        assert not any(c in r.e for c in t.controls)


def test_turns_come_back(spark):
    all_ = texts()
    r = random.Random(6)
    rows = [(c, n, r.choice(["user", "assistant", "system", None, "</s>", "tool\\"]), r.choice([*all_, None])) for c in range(40) for n in range(r.randint(1, 6))]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (50, 1, "user", "same"), (50, 1, "user", "same"), (51, 0, "user", "long " * 40_000), (51, 1, "assistant", "<s>" * 9_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segments", "2 AS n_turns")
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    assert len(out) == len({c for c, *_ in rows})
    for row in out:
        own = sorted(((n is not None, n or 0, a or "", b or "") for c, n, a, b in rows if c == row.conv_id))
        assert [(x.role, x.text) for x in row.back] == [(a, b) for *_, a, b in own]
        assert row.loss == "".join(b for *_, a, b in own if a == "assistant")
        assert row.formatted == "".join(s.text for s in row.segments)
        assert row.n_turns == len(own)


def test_order_of_roles(spark):
    cases = {"ua": True, "sua": True, "uaua": True, "u": False, "au": False, "sa": False, "uu": False, "uas": False, "": None}
    rows = [(k, n, {"u": "user", "a": "assistant", "s": "system"}[c], "t") for k, w in enumerate(cases) for n, c in enumerate(w)]
    got = {r.conv_id: r.valid_order for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {k: v for k, v in enumerate(cases.values()) if v is not None}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_own_template(spark):
    t = chat.Template(begin="<|im_start|>", after_role="<|sep|>", end="<|im_end|>", controls=("<|im_start|>", "<|im_end|>", "<|sep|>"), loss_roles=("assistant", "tool"))
    df = spark.createDataFrame([(1, 0, "user", "<|im_end|>"), (1, 1, "tool", "<|sep|>x")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df, t).withColumn("back", chat.read_turns(F.col("formatted"), t)).withColumn("loss", chat.loss_text(F.col("segments"), t)).first()
    assert [(x.role, x.text) for x in r.back] == [("user", "<|im_end|>"), ("tool", "<|sep|>x")] and r.loss == "<|sep|>x"
