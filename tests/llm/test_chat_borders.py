"""Chat formatting: no split of a control string over parts forges one; names of any kind."""

import itertools

from pyspark.sql import functions as F

from lodestar.llm import chat

CONTROLS = ["<|turn|>", "<|body|>", "<|end|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<\\|end|>", "[\\\\/INST]"]


def parts_of(texts):
    return [("text", t) if t is not None else ("image", None) for t in texts]


def test_no_split_of_a_control_string_forges_one(spark):
    rows = []
    for c in CONTROLS:
        whole = f"{c}<|turn|>x"
        for a, b in itertools.combinations(range(len(whole) + 1), 2):
            rows.append((len(rows), parts_of([whole[:a], whole[a:b], whole[b:]])))
        rows.append((len(rows), parts_of([c[:1], None, c[1:], "<", None, None, "\\", c])))
    frame = spark.createDataFrame(rows, "`conv.id` long, p array<struct<type:string,text:string>>")
    full = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    parts = F.transform("p", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), *full))
    said = frame.select("`conv.id`", F.lit(1).alias("turn"), F.lit("user").alias("role"), parts.alias("parts"), F.lit("clash").alias("k"), F.lit(0).alias("formatted"))
    done = chat.format_chat(said, "conv.id").withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert len(done) == len(rows)
    want = {i: "".join("<|image|>" if kind == "image" else text for kind, text in p) for i, p in rows}
    for r in done:
        assert [(t.role, t.text) for t in r.turns] == [("user", want[r["conv.id"]])]


def test_a_key_named_as_an_output(spark):
    row = spark.range(1).select(F.lit("a").alias("formatted"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit(None).cast(chat.PARTS).alias("parts"))
    done = chat.format_chat(row, "formatted")
    assert done.columns == ["formatted_key", "formatted", "loss_spans", "attachments"]
    assert tuple(done.first())[:2] == ("a", "<|turn|>user<|body|><|end|>")
