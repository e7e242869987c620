"""Conversations whose turns are null or tie, in very many rows."""

import re

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import least_cost

from fathomline.llm import chat_repair


def crowd(spark, n):
    """One conversation without an id: a third of its turns null, a third equal, the rest in order."""
    turn = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS turn"
    role = "element_at(array('user', 'assistant', 'system', 'tool', NULL), cast(id % 5 + 1 AS int)) AS role"
    return spark.range(n).selectExpr("cast(NULL AS long) AS conv_id", turn, role, "concat('t', id) AS text")


@pytest.mark.parametrize("block", [1, 3, 16, 64])
def test_rows_without_turns_are_cut_into_blocks_at_the_same_cost(spark, block):
    rows = crowd(spark, 1500)
    whole, cut = (chat_repair.repair(rows, block=b).agg(F.sum("cost"), F.count("*"), F.countDistinct(F.regexp_extract("rendered", "t[0-9]+", 0))).first() for b in (10**9, block))
    assert whole == cut and cut[1] == cut[2] == 1500
    full = chat_repair._full(rows, block)
    placed = chat_repair._placed(chat_repair._ordered(rows, block), full)
    assert placed.groupBy("conv_id", "block").count().agg(F.max("count")).first()[0] <= 8 * block + 8


def test_ties_are_repaired_at_least_cost(spark):
    roles = ["assistant", "user", "system", None, "user"]
    rows = spark.createDataFrame([(1, None, r, f"x{k}") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    ordered = ["system", "user", "user", "assistant", None]
    for block in (1, 1024):
        out = chat_repair.repair(rows, block=block)
        assert out.agg(F.sum("cost")).first()[0] == least_cost(ordered) and out.count() == 5


def test_the_text_of_a_cut_conversation_is_legal(spark):
    out = chat_repair.repair(crowd(spark, 400), block=4)
    full = chat_repair._placed(chat_repair._ordered(crowd(spark, 400), 4), chat_repair._full(crowd(spark, 400), 4))
    order = {r.text: i for i, r in enumerate(full.orderBy("block", *chat_repair.ORDER, "text").collect())}
    pieces = sorted(out.collect(), key=lambda r: order[re.search(r"t\d+", r.rendered)[0]])
    text = "".join(r.rendered for r in pieces)
    turns = re.findall(r"<\|im_start\|>(\w+)\n", text)
    turns = turns[1:] if turns[0] == "system" else turns
    assert turns == ["user", "assistant"] * (len(turns) // 2) and text.count("<|im_end|>\n") == len(re.findall(r"<\|im_start\|>", text))
