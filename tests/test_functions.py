"""Column functions on literal edge rows."""


import pytest
from pyspark.sql import functions as F

from tallyweave.functions import chat, judging as jf, seeds, text as tx, tokens as tk, vectors


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


EDGES = ["", " ", "a", "  a b ", " x ", "\n\tq\r\n", "　é ", "\x1cz\x1f", " a\n\n", "😀 ", "a" + " " * 500 + "b", None]


def test_strip_ws_is_python_strip(spark):
    got = values(spark, [(e,) for e in EDGES], "t string", tx.strip_ws(F.col("t")))
    assert got == [None if e is None else e.strip() for e in EDGES]


def test_contains(spark):
    rows = [("The End",), ("the",), ("x",), (None,)]
    assert values(spark, rows, "t string", tx.contains_ci(F.col("t"), "tHe")) == [True, True, False, False]
    assert values(spark, rows, "t string", tx.contains_regex(F.col("t"), "T.e")) == [True, False, False, None]


RUN_KEYS = [
    ("-a+b--c..d.", "aNb-c.d"),
    ("x" * 95 + "-.-" + "y" * 20, "x" * 95),
    ("a---b....c", "a-b.c"),
    ("..--", ""),
    ("plain/leaf", "plain/leaf"),
    ("u+" * 60, "uN" * 48),
]


def test_run_key_clean(spark):
    got = values(spark, [(k,) for k, _ in RUN_KEYS], "t string", tx.run_key_clean(F.col("t")))
    assert got == [want for _, want in RUN_KEYS]


def test_run_short_name(spark):
    rows = [("org/model-1", "ce", "docs", "inner", None), ("m", "ce", "docs", None, "2.0"), ("m", "ce", "docs", None, None)]
    name = tx.run_short_name(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"))
    got = values(spark, rows, "a string, b string, c string, d string, e string", name)
    assert got == ["model-1-ce-inner-docs", "m-ce-2.0-docs", "m-cedocs"]


def test_checkpoints(spark):
    rows = [("docs-500",), ("original",), ("docs",), ("docs-x",), ("a-b-12",), ("docs-99999999999999999999",), ("docs-1\n",)]
    assert values(spark, rows, "t string", tx.checkpoint_number(F.col("t"))) == [500, 0, None, None, 12, None, None]
    assert values(spark, rows, "t string", tx.checkpoint_type(F.col("t")))[:5] == ["docs", "original", "docs", "docs", "a"]


def test_path_leaf_and_names(spark):
    assert values(spark, [("a/b/c",), ("c",), ("a/",)], "t string", tx.path_leaf(F.col("t"))) == ["c", "c", ""]
    assert values(spark, [("x",), ("y",)], "t string", tx.lookup_name(F.col("t"), {"x": "Ex"})) == ["Ex", "y"]


def test_date_header(spark):
    rows = [("<s>Cutting Knowledge Date: December 2023\nToday Date: 1 May 2024\n\nHello",), ("Hello",)]
    assert values(spark, rows, "t string", tx.strip_date_header(F.col("t"), tx.DATED_HEADER)) == ["<s>Hello", "Hello"]


MESSAGES = "m array<struct<role:string,content:string>>"


def test_chat_render(spark):
    rows = [
        ([("system", "s"), ("user", " q "), ("assistant", " a ")],),
        ([("system", "s")],),
        ([],),
    ]
    got = values(spark, rows, MESSAGES, chat.chat_render(F.col("m")))
    assert got == ["<s>[INST] q [/INST][ASST]  a  [/ASST]</s>", "", ""]


def test_min_response(spark):
    n = 5
    rows = [
        ([("user", "q"), ("assistant", "x" * 5)],),
        ([("user", "q"), ("assistant", "x" * 4)],),
        ([("assistant", "x" * 9), ("assistant", " \n  xxxx")],),
        ([("user", "q")],),
        ([],),
        ([("assistant", "😀" * 5)],),
    ]
    got = values(spark, rows, MESSAGES, chat.response_long_enough(F.col("m"), n))
    assert got == [True, False, False, True, True, True]


DIALOGUES = [
    ("before Human: hi Assistant: yo\n Human:  last ", [("user", "hi"), ("assistant", "yo"), ("user", "last")]),
    ("no marker", []),
    ("", []),
    ("Human:Assistant:", [("user", ""), ("assistant", "")]),
    ("human: no Human: A Human: B", [("user", "A"), ("user", "B")]),
]


def test_dialogue_parse(spark):
    got = values(spark, [(d,) for d, _ in DIALOGUES], "t string", chat.dialogue_parse(F.col("t")))
    assert [[tuple(m) for m in g] for g in got] == [want for _, want in DIALOGUES]


def test_preference_side_is_checked():
    with pytest.raises(ValueError):
        chat.preference_answer(F.lit("a"), F.lit("b"), "other")


SCORES = {
    "": None, "no verdict": None, "#thescore: 4.7": 4, "#thereason: 3 points #thescore: 5": 5, "7 of 10": 7,
    "#thescore: none 3": 3, "3 #thescore: x": None, "#thescore: 1 #thescore: 5": 1, "12.": 12, "9" * 30: None,
}


def test_score_parse(spark):
    got = values(spark, [(s,) for s in [*SCORES, None]], "t string", jf.judge_score_parse(F.col("t")))
    assert got == [*SCORES.values(), None]


LETTERS = {
    "<think>a or b</think> (C)": "c", "A, rather D": "d", "unclear": "unclear", "b": "b", " Unclear ": "unclear",
    "abc": "abc", "éa b": "b", "éa": "éa", "</think>": "", "x</think>A</think> no": "no", "a_b": "a_b",
}


def test_letter_parse(spark):
    got = values(spark, [(s,) for s in LETTERS], "t string", jf.judge_letter_parse(F.col("t")))
    assert got == list(LETTERS.values())


def test_flags(spark):
    assert values(spark, [(4,), (3,), (None,)], "s int", jf.score_flag(F.col("s"))) == [1, 0, 0]
    rows = [("A",), ("refusal",), ("1",), ("c",), (None,)]
    assert values(spark, rows, "v string", jf.is_refusal_verdict(F.col("v"))) == [True, True, True, False, False]


def test_prompt_render_is_single_pass(spark):
    fields = {"question": F.col("q"), "answer": F.lit("{question}")}
    assert values(spark, [("{answer}",)], "q string", jf.judge_prompt_render("{question}|{answer}|{question}", fields)) == [
        "{answer}|{question}|{answer}"
    ]
    with pytest.raises(KeyError):
        jf.judge_prompt_render("{missing}", {})


def test_padding_and_slices(spark):
    rows = [(["a", "b", "c"],), ([],), (list("abcdef"),)]
    schema = "t array<string>"
    assert values(spark, rows, schema, tk.pad_left(F.col("t"), 4, F.lit("-"))) == [["-", "a", "b", "c"], ["-"] * 4, list("abcdef")]
    assert values(spark, rows, schema, tk.pad_left_mask(F.col("t"), 4)) == [[0, 1, 1, 1], [0] * 4, [1] * 6]
    assert values(spark, rows, schema, tk.prompt_tokens(F.col("t"), 2)) == [["a", "b"], [], ["a", "b"]]
    assert values(spark, rows, schema, tk.completion_tokens(F.col("t"), 2, 3)) == [["c"], [], ["c", "d", "e"]]
    assert values(spark, rows, schema, tk.trim_prompt(F.col("t"), F.array(F.lit("x")))) == [["b", "c"], [], list("bcdef")]
    assert values(spark, rows, schema, tk.at_least(F.col("t"), 4, 3)) == [True, False, True]


def test_shift_and_active(spark):
    rows = [([1, 2, 3], [-100, -100, 7]), ([1], [1]), ([], [])]
    got = values(spark, rows, "v array<int>, l array<int>", tk.shift_pairs(F.col("v"), F.col("l")))
    assert [[tuple(p) for p in g] for g in got] == [[(1, -100), (2, 7)], [], []]
    got = values(spark, rows, "v array<int>, l array<int>", tk.active_positions(F.col("v"), F.col("l")))
    assert [[tuple(p) for p in g] for g in got] == [[(2, 7)], [], []]


def test_softmax_of_large_values(spark):
    got = values(spark, [([1000.0, 1000.0],), ([0.0],)], "v array<double>", vectors.softmax(F.col("v")))
    assert got == [[0.5, 0.5], [1.0]]
    assert values(spark, [([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>", vectors.l2_distance(F.col("a"), F.col("b"))) == [5.0]


def test_named_seed_is_stable(spark):
    import hashlib

    assert values(spark, [("docs",)], "n string", seeds.named_seed(F.col("n"))) == [int(hashlib.md5(b"docs").hexdigest()[:8], 16)]
