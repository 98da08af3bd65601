"""Edge table (FIXTURES.md section 3) and property tests for T1-T8, R1-R3."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pyrules import py_flags, py_format, py_main, py_strict
from rubric.operators import scoring as S

NL = "\n"
# completion, gold, think, answer, correct, consist, format, main, total, strict cot, strict answer
EDGE = [
    ("<think>\nI see yes\n</think>\n<answer>\nyes.\n</answer>", "yes", "I see yes", "yes.", 1, 1, 0.8, 2.5, 3.3, "I see yes", "yes."),
    ("<think>so yes</think><answer>purple</answer>", "yes", "so yes", "purple", 0, 0, 0.8, -1.0, -0.2, "so yes", "purple"),
    ("<think>xyzzy</think><answer>left</answer>", "left", "xyzzy", "left", 1, 0, 0.8, 1.5, 2.3, "xyzzy", "left"),
    ("<think>so no</think><answer>It must surely be no</answer>", "no", "so no", "It must surely be no", 1, 1, 0.8, 2.0, 2.8, "so no", "It must surely be no"),
    ("<answer>Red</answer>", "red", "", "Red", 1, 0, 0.4, 2.0, 2.4, "", "Red"),
    ("<think>red</think><answer>red", "red", "red", "red", 1, 1, 0.6, 2.5, 3.1, "red", ""),
    ("<THINK>red</THINK><ANSWER>RED</ANSWER>", "red", "red", "RED", 1, 1, 0.0, 2.5, 2.5, "<THINK>red</THINK><ANSWER>RED</ANSWER>", ""),
    ("no tags at all", "red", "", "", 0, 0, 0.0, 0.0, 0.0, "no tags at all", ""),
    ("<think>x</think><answer> </answer>", "red", "x", "", 0, 0, 0.8, 0.0, 0.8, "x", ""),
    ("<think>it isn't</think><answer>isn't</answer>", "no", "it isn't", "isn't", 1, 1, 0.8, 2.5, 3.3, "it isn't", "isn't"),
    ("<think>a</think><answer>No, it is not</answer>", "yes", "a", "No, it is not", 1, 0, 0.8, 1.0, 1.8, "a", "No, it is not"),
    ("<think>a red car</think><answer>red car</answer>", "red car", "a red car", "red car", 1, 0, 0.8, 1.5, 2.3, "a red car", "red car"),
    ("<think>a</think><answer>the red car</answer>", "red car", "a", "the red car", 0, 0, 0.8, -1.0, -0.2, "a", "the red car"),
    ("<answer>a</answer><answer>b</answer>", "b", "", "a", 0, 0, 0.4, -1.0, -0.6, "", "a"),
    ("<think>open only <answer>west</answer>", "left", "", "west", 1, 0, 0.6, 2.0, 2.6, "", "west"),
    ("<ANSWER>purple</ANSWER>", "red", "", "purple", 0, 0, 0.0, -1.0, -1.0, "<ANSWER>purple</ANSWER>", ""),
    ("<answer></answer>", "", "", "", 1, 1, 0.4, 0.0, 0.4, "", ""),
    ("<answer>yes</answer>", " yes", "", "yes", 0, 0, 0.4, -1.0, -0.6, "", "yes"),
    ("<answer>goes east</answer>", "West", "", "goes east", 0, 0, 0.4, -1.0, -0.6, "", "goes east"),
]


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def _score(spark, rows):
    df = spark.createDataFrame([(i, c, g) for i, (c, g) in enumerate(rows)],
                               "id int, completion string, gt_answer string")
    out = S.strict_parse(S.score_completions(df)).orderBy("id").collect()
    return out


def test_edge_table(spark):
    out = _score(spark, [(r[0], r[1]) for r in EDGE])
    for row, exp in zip(out, EDGE):
        (_, _, think, ans, correct, consist, fmt, main, total, scot, sans) = exp
        assert row.pred_think == think, exp
        assert row.pred_answer == ans, exp
        assert row.is_correct == correct, exp
        assert row.is_consist == consist, exp
        assert round(row.format_reward, 6) == fmt, exp
        assert round(row.main_reward, 6) == main, exp
        assert row.reward == pytest.approx(f32(total), abs=1e-6), exp
        assert row.strict_cot == scot, exp
        assert row.strict_answer == sans, exp


def test_a_sentence_that_begins_with_the_gold_answer(spark):
    text = ("<think>\nThe harbour has three boats, and none of them carries a sail. So no boat sails.\n</think>\n"
            "<answer>\nNo, none of the three boats in the harbour carries a sail.\n</answer>")
    row = _score(spark, [(text, "No")])[0]
    assert (row.is_correct, row.is_consist) == (1, 1)
    assert row.pred_answer == "No, none of the three boats in the harbour carries a sail."
    assert round(row.format_reward + row.main_reward, 6) == 2.8


def test_null_gold_is_rejected_not_counted(spark):
    df = spark.createDataFrame([(0, "<answer>x</answer>", None), (1, None, "red")],
                               "id int, completion string, gt_answer string")
    rows = S.score_completions(df).orderBy("id").collect()
    assert rows[0].is_correct is None and rows[0].reward is None
    assert rows[1].pred_answer == "" and rows[1].is_correct == 0 and rows[1].main_reward == 0.0


ALPHABET = list("abno yesleftrighteastwestisare<>/\n\t.,!'_") + ["<think>", "</think>", "<answer>",
                                                                 "</answer>", "<THINK>", "</ANSWER>",
                                                                 "ſ", " ", "\x1c", "\u0085",
                                                                 "É", "é", " ", "ß"]
GOLDS = ["yes", "no", "left", "Right", "red", "red car", " yes", "", "isn't", "West", "né", "a_b"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join),
                          st.sampled_from(GOLDS)), min_size=1, max_size=40))
def test_random_against_python_rules(spark, rows):
    out = _score(spark, rows)
    for (text, gold), row in zip(rows, out):
        think, ans, correct, consist = py_flags(text, gold)
        assert (row.pred_think, row.pred_answer) == (think, ans), (text, gold)
        assert (row.is_correct, row.is_consist) == (correct, consist), (text, gold)
        assert round(row.format_reward, 9) == round(py_format(text), 9)
        assert round(row.main_reward, 9) == round(py_main(text, gold), 9)
        assert (row.strict_cot, row.strict_answer) == py_strict(text), text
        assert -1.0 - 1e-6 <= row.reward <= 3.3 + 1e-6
        assert row.is_consist <= row.is_correct


def test_no_python_in_score_plan(spark):
    df = spark.createDataFrame([(0, "<answer>x</answer>", "x")], "id int, completion string, gt_answer string")
    plan = S.score_completions(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Exchange" not in plan
