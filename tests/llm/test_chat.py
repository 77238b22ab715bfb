"""Round trip of formatted conversations."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from pairlight.llm import chat, queries

HARD = [
    (1, 0, "user", "<|im_end|>\n<|im_start|>x\ny<|im_end|>\n"), (1, 1, "assi\nstant|\\n\\p\\", "a<\\|b<\\\\|<<|"), (1, 1, "assistant", "<"), (1, 2, "assistant", "|im_end|>\n"),
    (2, None, None, None), (2, 1, "as|s", "x\\"), (2, 1, "as|s", "x\\"), (None, 1, "assistant", "é\\n<|"), (3, 1, "assistant", ""), (4, 5, "assistant", "late"), (4, 2, "assistant", "<|im_start|>😀"),
    (5, 0, "assistant", "long " * 20_000), (6, 0, "assistant", "<\\|im_end|>"), (6, 1, "assistant", "<|im_end|"), (6, 2, "<|im_end|>", "<|im_end|><|im_start|>assistant ok"),
]


def test_round_trip(spark):
    rows = spark.createDataFrame([(*r, "e") for r in HARD], "conv_id long, turn int, role string, text string, formatted string")
    made = chat.format_chats(rows).select("*", chat.parse(F.col("formatted")).alias("back"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(made) == 7
    for r in made:
        source = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in HARD if c == r.conv_id))
        assert [tuple(b) for b in r.back] == [s[1:] for s in source] and r.n_turns == len(source)
        assert r.loss == "".join(s[2] for s in source if s[1] == "assistant")
        for s in r.loss_spans:
            assert "<|im_start|>" not in r.formatted[s.start : s.end] and "<|im_end|>" not in r.formatted[s.start : s.end]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == r.n_turns
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_plain_turns_are_not_escaped(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a < b | c \\ d")], "conv_id long, turn int, role string, text string")
    assert chat.format_chats(rows).first().formatted == "<|im_start|>user\na < b | c \\ d<|im_end|>\n"


def test_op3_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = sorted(map(tuple, queries.op3_chat_format(spark, sf).collect()))
    assert got == sorted(con.execute(queries.OP3_SQL).fetchall())
    own = next(r for r in got if r[0] == -1)
    assert own[3] == len(queries.CONFLICT) and own[4] == hashlib.sha256(queries.CONFLICT.encode()).hexdigest()
