"""Pairs, prompts and masks against SQL on a table of awkward conversations."""

import duckdb
from pyspark.sql import functions as F

from jobloom.llm import preference_chat as pc
from jobloom.llm import queries, sql

KIND = "conv_id long, turn long, role string, text string, opening string, part string, side string, all int"
TALK = [(0, "user", "hi"), (1, "assistant", "a"), (2, "user", "b")]


def rows_of():
    rows = [(1, *t) for t in TALK] + [(1, 3, "assistant", "cc")] + [(2, *t) for t in TALK] + [(2, 3, "assistant", "cccé😀")]
    rows += [(3, *t) for t in TALK[:2]] + [(4, *t) for t in TALK[:2]] + [(4, 1, "assistant", "a")] + [(5, 0, "user", "hi")]
    rows += [(6, 0, None, None), (None, 0, "user", "lost"), (7, None, "user", "q"), (7, 0, "assistant", None), (8, 0, "user", "x" * 100_000)]
    rows += [(100 + i, 0, "user", "hot") for i in range(61)] + [(100 + i, 1, "assistant", "r" * (i % 7)) for i in range(61)]
    return rows


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "o", "p", "s", 1) for r in rows], KIND)
    out = pc.formatted(df)
    for c in ("chosen_mask", "rejected_mask"):
        out = out.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))
    return out


def test_equals_sql(spark):
    rows = rows_of()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = sorted(map(tuple, formatted(spark, rows).collect()), key=str)
    assert got == sorted(con.execute(sql.OP8).fetchall(), key=str)
    ids = [i for r in got for i in r[:2] if i is not None]
    assert sorted(ids) == sorted({r[0] for r in rows if r[0] is not None})  # each conversation once


def test_prompt_and_masks_make_the_conversations(spark):
    rows = rows_of()
    for r in formatted(spark, rows).collect():
        for own, done, mask in ((r.chosen_id, r.chosen, r.chosen_mask), (r.rejected_id, r.rejected, r.rejected_mask)):
            if own is None:
                continue
            turns = sorted({x[1:] for x in rows if x[0] == own}, key=lambda t: (t[0] is not None, t))
            whole = "".join(f"<|{role or ''}|>\n{text or ''}<|end|>\n" for _, role, text in turns)
            assert r.prompt + done == whole
            spans = [tuple(map(int, s.split(":"))) for s in mask.split(",") if s]
            said = [f"{t or ''}<|end|>\n" for _, role, t in turns[r.n_prompt_turns :] if role == "assistant"]
            assert [done[a:b] for a, b in spans] == said


def test_given_pairs(spark):
    df = spark.createDataFrame([(1, *t) for t in TALK] + [(2, *t) for t in TALK[:1]], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(2, 1), (1, None), (9, 1)], "chosen_id long, rejected_id long")
    got = {(r.chosen_id, r.rejected_id): r for r in pc.formatted(df, pairs).collect()}
    assert got[2, 1].n_prompt_turns == 1 and got[2, 1].chosen == "" and got[1, None].n_prompt_turns == 1
    assert got[9, 1].n_prompt_turns == 0 and got[9, 1].prompt == ""


def test_no_conversations(spark):
    assert formatted(spark, []).count() == 0


def test_given_conversations_make_pairs(spark):
    """Every given conversation has a partner; all but those without an assistant's turn have a mask."""
    for sf in ("sf0.001", "sf0.01"):
        rows = queries.op8(spark, f"/root/testdata/{sf}").collect()
        assert sum(r.rejected_id is None for r in rows) <= 1 and len(rows) >= 10
        two = [r for r in rows if r.rejected_id is not None]
        assert all(r.chosen != r.rejected for r in two)
        for side, mask in [(x, m) for r in two for x, m in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask))]:
            assert bool(mask) == ("<|assistant|>" in side)
        assert sum(bool(r.chosen_mask and r.rejected_mask) for r in two) > 0.5 * len(two)
