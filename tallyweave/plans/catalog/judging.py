"""Judge prompts, replies and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import judging as jf, text as tx
from tallyweave.operators import judging as jo
from tallyweave.operators.verdicts import VerdictStore
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources.scratch import scratch_dir

TEMPLATE = "Q: {question}\nA: {answer}\nRules: {rules}"


@query(
    "judge_prompt_render",
    fx.with_views(
        "pairs",
        body="select conv_id, turn, 'Q: ' || prompt || ' {answer}' || chr(10) || 'A: ' || completion || chr(10) || 'Rules: none' as judge_prompt from pairs",
    ),
)
def judge_prompt_render(spark, sf):
    # The braces inside the question must stay as they are.
    fields = {
        "question": F.concat(F.col("prompt"), F.lit(" {answer}")), "answer": F.col("completion"), "rules": F.lit("none")
    }
    return fx.pairs(spark, sf).select("conv_id", "turn", jf.judge_prompt_render(TEMPLATE, fields).alias("judge_prompt"))


@query("judge_score_parse", fx.with_views("verdicts", body="select sample_id, score from verdicts"))
def judge_score_parse(spark, sf):
    return fx.replies(spark, sf).select("sample_id", jf.judge_score_parse(F.col("score_reply")).alias("score"))


@query("judge_letter_parse", fx.with_views("verdicts", body="select sample_id, verdict from verdicts"))
def judge_letter_parse(spark, sf):
    return fx.replies(spark, sf).select("sample_id", jf.judge_letter_parse(F.col("letter_reply")).alias("verdict"))


@query("strip_ws", r"select doc_id, regexp_replace(' ' || chr(10) || text || chr(9) || ' ', '^\s+|\s+$', '', 'g') as text from documents")
def strip_ws(spark, sf):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("\t "))
    return fx.documents(spark, sf).select("doc_id", tx.strip_ws(padded).alias("text"))


@query(
    "judge_batch",
    fx.with_views(
        "pairs",
        body="select conv_id, turn, case when contains(lower(prompt || ' ' || completion), 'avec') then 5 else 2 end as score from pairs",
    ),
)
def judge_batch(spark, sf):
    judge = jo.ScoreJudge(lambda: jo.RuleAsk("avec", "#thescore: 5", "#thescore: 2"), workers=4)
    inputs = {"question": F.col("prompt"), "answer": F.col("completion")}
    return judge.judge_batch(fx.pairs(spark, sf), inputs, "score").select("conv_id", "turn", "score")


@query(
    "judge_resume",
    fx.with_views(
        "pairs",
        body="select conv_id, turn, case when contains(lower(prompt || ' ' || completion), 'und') then 4 else 1 end as score from pairs",
    ),
)
def judge_resume(spark, sf):
    """A run over some of the rows, then one over all of them, which asks for the others only."""
    store = VerdictStore(spark, scratch_dir(spark, "verdict-store"), batch_rows=100)
    judge = jo.ScoreJudge(lambda: jo.RuleAsk("und", "#thescore: 4", "#thescore: 1"), workers=4, model="rule", store=store)
    inputs = {"question": F.col("prompt"), "answer": F.col("completion")}
    rows = fx.pairs(spark, sf)
    judge.judge_batch(rows.where("turn < 2"), inputs, "score")
    return judge.judge_batch(rows, inputs, "score").select("conv_id", "turn", "score")


@query(
    "udf_scorer",
    fx.with_views(
        "pairs",
        body="select conv_id, turn, case when contains(lower(prompt || ' ' || completion), 'und') then 'b' else 'unclear' end as verdict from pairs",
    ),
)
def udf_scorer(spark, sf):
    judge = jo.LetterJudge(lambda: jo.RuleAsk("und", "<think>a?</think> B", " Unclear "), workers=4)
    inputs = {"question": F.col("prompt"), "answer": F.col("completion")}
    return judge.judge_batch(fx.pairs(spark, sf), inputs, "verdict").select("conv_id", "turn", "verdict")


@query(
    "udf_generate",
    fx.with_views(
        "results",
        body="select sample_id, array_to_string(list_reverse(string_split(completion, ' ')), ' ') as generated from results",
    ),
)
def udf_generate(spark, sf):
    prompts = fx.results(spark, sf).select("sample_id", F.col("completion").alias("prompt"))
    return jo.generate_samples(prompts, "prompt", "generated", lambda: jo.reverse_words).select("sample_id", "generated")
