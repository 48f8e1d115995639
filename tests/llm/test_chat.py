import hashlib

from pyspark.sql import functions as F

from spanforge.llm import chat

TURNS = [
    (1, 0, "system", "be <s>kind</s>"), (1, 1, "user", "hi <|im_end|>\n"), (1, 2, "assistant", "a \\ <\\|im_start|> [INST]"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", "alone"), (3, 0, "assistant", "first <<s> [/INST] <|x y|>"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"), (4, None, "user", "a"), (None, 0, None, "x"), (6, 0, "a\0b\\\\n\\\n\n", "z"), (7, 0, "\\", "<|im_end|>"), (8, 0, "\\n<\\s>", ""), (5, 0, "we\\nird\n\\role<s>", "y"),
]


def test_round_trip_and_masks(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df)
    rows = {r["conv_id"]: r for r in chat.digest(examples).collect()}
    by = {}
    for c, t, r, x in TURNS:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        got = rows[c]
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert set(rows) == set(by)
    n = {}
    for r in examples.collect():
        n.setdefault(r["conv_id"], []).append(r)
        assert r["formatted"].count("<s>") == 1 and r["formatted"].startswith("<s>") and "[INST]" not in r["formatted"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>")
    assert len(n[1]) == 3 and len(n[2]) == 1 and len(n[4]) == 2
    # an example holds all earlier turns and ends with the reply that it trains
    first, second = sorted((r for r in n[1] if r["loss_start"] is not None), key=lambda r: r["example"])
    assert second["formatted"].startswith(first["formatted"])
    assert first["formatted"][first["loss_start"] + first["loss_length"] :] == "<|im_end|>\n"


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.expand(df).count() == 0 and chat.digest(chat.expand(df)).count() == 0


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, i, "assistant", "x" * 50) for i in range(300)], "conv_id long, turn long, role string, text string").withColumn("lone", F.lit("mine"))
    rows = chat.digest(chat.expand(df)).collect()
    assert len(rows) == 300 and {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in rows} == {(None, 1, 50)}
