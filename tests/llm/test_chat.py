"""Quotation linking: hand-written expectations, a generated fixture, and the SQL of the same rows."""

import random

import duckdb
import pytest

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, level int"
ROWS = [
    (1, 0, "user", "How do I bake bread?\nI have flour and water.", 9),
    (1, 1, "assistant", "> how do I   bake BREAD?\nUse an oven at high heat.", 9),
    (1, 2, "user", ">> How do I bake bread?\n> Use an oven at high heat.\n\nWhich temperature?", 9),
    (1, 3, "user", "> I have flour and water.\n> How do I bake bread?\n> Use an oven at high heat.\nok", 9),
    (2, 0, "user", " > Which temperature?\nI ask the same.", 9),
    (2, 1, "user", "> never said anywhere here\nhm", 9),
    (2, 2, "user", "> quoted before it is said", 9),
    (2, 3, "user", "quoted before it is said", 9),
    (3, 0, None, None, 9),
    (3, 1, "user", "", 9),
    (3, 1, "user", "", 9),
    (3, 1, "user", None, 9),
    (None, 4, "user", "> How do I bake bread?", 9),
    (None, 4, None, "> How do I bake bread?", 9),
    (4, 0, "user", ">yes.\n" + "> > deep " * 2000, 9),
    (4, None, "user", "no turn", 9),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def messages_of(spark, rows):
    return {(r.conv_id, r.turn): r for r in chat.ordered_messages(frame(spark, rows)).collect()}


def test_links(spark):
    got = messages_of(spark, ROWS)
    assert (got[1, 1].reply_turn, got[1, 1].own_text, got[1, 1].depth) == (0, "Use an oven at high heat.", 1)
    assert (got[1, 2].reply_turn, got[1, 2].max_level, got[1, 2].own_text) == (1, 2, "\nWhich temperature?")
    assert (got[1, 2].thread_turn, got[1, 2].depth) == (0, 2)  # an answer to an answer
    assert (got[1, 3].reply_turn, got[1, 3].n_linked, got[1, 3].thread_turn) == (0, 3, 0)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn, got[2, 0].conversation, got[2, 0].position) == (1, 2, 1, 4)
    assert got[2, 1].conversation == 1 and got[2, 1].position == 5
    assert got[2, 1].reply_turn is None and got[2, 2].reply_turn is None and got[None, 4].reply_turn is None
    assert got[3, 0].own_text == "" and got[4, 0].n_quoted == 2
    assert [r.own_text for r in chat.ordered_messages(frame(spark, ROWS)).filter("conv_id = 3 AND turn = 1").collect()] == ["", ""]
    assert chat.reply_conversations(frame(spark, ROWS).limit(0)).count() == 0


def test_conversations_are_built_in_reply_order(spark):
    rows = [
        (5, 0, "user", "first question here", 0), (5, 1, "user", "second question here", 0),
        (5, 2, "assistant", "> first question here\nan answer to the first", 0), (5, 3, "user", "> an answer to the first\nthanks for that", 0),
        (5, 4, "assistant", "> second question here\nan answer to the second", 0),
        (8, 0, "user", "> an answer to the second\nfollowing up", 0), (8, 1, "assistant", "sure", 0),
        (9, 0, "user", "> following up\nme too", 0), (9, 1, "user", "> not yet said by 10", 0), (10, 0, "user", "not yet said by 10", 0),
    ]
    got = {r.conversation: [(m.conv_id, m.turn, m.text) for m in r.messages] for r in chat.build_conversations(frame(spark, rows)).collect()}
    assert got == {
        5: [
            (5, 0, "first question here"), (5, 2, "an answer to the first"), (5, 3, "thanks for that"), (5, 1, "second question here"), (5, 4, "an answer to the second"),
            (8, 0, "following up"), (8, 1, "sure"), (9, 0, "me too"), (9, 1, ""),
        ],
        10: [(10, 0, "not yet said by 10")],
    }
    cut = chat.build_conversations(frame(spark, rows), segment=4).filter("conversation = 5").orderBy("segment").collect()
    assert [[m.position for m in r.messages] for r in cut] == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]


def quoting_rows(seed, conversations, turns):
    """Conversations whose messages quote one another, across conversations too, at several levels."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Delta", "né", "ok"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice("?.!")
    said, rows = ["not said by anyone"], []
    for conv in range(conversations):
        for turn in range(rng.randint(1, turns)):
            body = []
            for _ in range(rng.randint(0, 3)):
                body.append(rng.choice((">", "> ", ">> ", " > >", ">>> ")) + rng.choice(said if rng.random() < 0.7 else said[-6:]))
            for _ in range(rng.randint(0, 2)):
                said.append(line())
                body.append(said[-1])
            for _ in range(rng.choice((1, 1, 1, 2))):
                rows.append((conv, turn, rng.choice(("user", "assistant", None)), "\n".join(body) if rng.random() < 0.97 else None, 0))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [ROWS, quoting_rows(1, 25, 12), quoting_rows(2, 3, 300)], ids=["hand", "many", "long"])
def test_sql_gives_the_same_rows(spark, monkeypatch, rows):
    monkeypatch.setattr("tidemark.llm.common.FREQUENT", 5)  # some keys are frequent even here
    conversations = frame(spark, rows).toPandas()  # noqa: F841
    conversations[["conv_id", "turn"]] = conversations[["conv_id", "turn"]].astype("Int64")
    want = duckdb.sql(chat.ORACLE)
    result = chat.reply_conversations(frame(spark, rows))
    assert sorted(result.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, result.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_short_passages_link_within_their_conversation(spark):
    got = messages_of(spark, [(1, 0, "user", "Thanks!", 0), (1, 1, "user", "long enough to tell", 0), (1, 2, "user", "> Thanks!\nok", 0), (2, 0, "user", "> Thanks!", 0)])
    assert (got[1, 2].n_linked, got[1, 2].reply_turn, got[1, 2].thread_turn, got[1, 2].position) == (1, 0, 0, 1)
    assert got[2, 0].reply_turn is None


def test_another_conversation_is_found_if_the_own_is_first(spark):
    got = messages_of(spark, [(1, 3, "user", "> said over there", 0), (1, 4, "user", "said over there", 0), (7, 2, "user", "said over there", 0), (9, 0, "user", "said over there", 0)])
    assert (got[1, 3].reply_conv, got[1, 3].reply_turn, got[1, 3].conversation) == (7, 2, 1)


def test_deeper_levels_choose_the_reply_where_level_one_has_none(spark):
    got = messages_of(spark, [(1, 0, "user", "the inner passage", 0), (1, 1, "user", "the outer passage", 0), (1, 2, "user", ">> the inner passage", 0), (1, 3, "user", ">> the inner passage\n> the outer passage", 0)])
    assert (got[1, 2].reply_turn, got[1, 2].n_linked) == (0, 1)
    assert (got[1, 3].reply_turn, got[1, 3].n_linked) == (1, 1)


def test_columns_with_other_names_do_no_harm(spark):
    rows = frame(spark, ROWS).selectExpr("*", "'x' AS passage", "1 AS line", "2 AS position", "3 AS place")
    assert chat.reply_conversations(rows).count() == chat.reply_conversations(frame(spark, ROWS)).count()
