"""Document quality by weak supervision: rules vote or abstain, EM weighs them.

Everything here is DataFrame code. A document's counts become one vote per rule (good,
bad, none). Only the number of documents per combination of votes is needed to fit the
model, at most ``3 ** rules`` rows. Expectation-maximisation runs over that table inside
one SQL expression: for each class, how often a rule votes for it when it votes at all.
Abstaining says nothing. The posterior probability of each combination then meets the
documents by a broadcast of that bounded table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.sources.scratch import materialise

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts; neither holds: the rule abstains."""

    name: str
    good: str
    bad: str


#: Besides COUNTS: n_lines, and n_marks for full stops, question and exclamation marks.
#: Three views of size and sentences, two of symbols, two of repetition.
RULES = (
    Rule("length", "n_words >= 100", "n_words < 30"),
    Rule("word_length", "word_chars between 3 * n_words and 7 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("sentences", "40 * n_marks >= n_words", "120 * n_marks < n_words"),
    Rule("symbols_in_text", "100 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("symbols_by_word", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("lines", "n_lines >= 3 and n_dup_lines = 0", "3 * n_dup_lines > n_lines"),
    Rule("repeats", "20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
)
#: Start of the fit: a rule rarely accuses a good text, and misses half of the bad ones.
START_GOOD, START_BAD = 0.95, 0.5
ROUNDS = 25


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts; null is an empty text. Words are runs of non-white characters.

    Windows of three words are compared by a 64-bit hash inside one text.
    """
    own = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    split = docs.select(
        "*",
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, ".?!", ""))).cast("bigint").alias("n_marks"),
    )
    windows = F.expr(
        "if(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3),"
        " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
    )
    hashed = split.select(
        *own, "word_chars", "n_symbols", "n_marks",
        F.size("_words").cast("bigint").alias("n_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Only texts in which a window comes back are sorted.
    ordered = hashed.withColumn(
        "_sorted",
        F.expr(
            "if(size(array_distinct(_windows)) = size(_windows), null,"
            " sort_array(transform(_windows, (h, i) -> struct(h, i))))"
        ),
    )
    places = F.expr(
        "sort_array(transform(filter(sequence(0, size(_sorted) - 1), j ->"
        " (j > 0 and _sorted[j].h = _sorted[greatest(j - 1, 0)].h)"
        " or (j < size(_sorted) - 1 and _sorted[j].h = _sorted[least(j + 1, size(_sorted) - 1)].h)),"
        " j -> _sorted[j].i))"
    )
    covered = F.expr(
        "if(_sorted is null, 0L, aggregate(_places, struct(0L as n, 0 as upto),"
        " (a, x) -> struct(a.n + (x + 3 - greatest(x, a.upto)) as n, x + 3 as upto), a -> a.n))"
    )
    return (
        ordered.withColumn("_places", F.when(F.col("_sorted").isNotNull(), places))
        .withColumn("n_repeat_words", covered)
        .drop("_windows", "_sorted", "_places")
    )


def vote(rule: Rule) -> Column:
    return F.expr(f"case when {rule.good} then 1 when {rule.bad} then -1 else 0 end")


def _posterior_sql(votes: str, p: str, rules: int) -> str:
    """Probability of "good" given votes, under the parameters ``p``."""
    good = " + ".join(
        f"(case {votes}[{j}] when 1 then ln({p}.alpha[{j}]) when -1 then ln(1 - {p}.alpha[{j}]) else 0D end)" for j in range(rules)
    )
    bad = " + ".join(
        f"(case {votes}[{j}] when -1 then ln({p}.beta[{j}]) when 1 then ln(1 - {p}.beta[{j}]) else 0D end)" for j in range(rules)
    )
    return f"1 / (1 + exp((ln(1 - {p}.prior) + {bad}) - (ln({p}.prior) + {good})))"


def _share_sql(hit: str, weight: str, j: int) -> str:
    """Smoothed share of ``hit`` votes among a rule's votes, by weight."""
    total = f"aggregate(w, 0D, (s, x) -> s + if(x.votes[{j}] = 0, 0D, {weight}))"
    with_hit = f"aggregate(w, 0D, (s, x) -> s + if(x.votes[{j}] = {hit}, {weight}, 0D))"
    return f"(1 + {with_hit}) / (2 + {total})"


def posteriors(combinations: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """``(votes array<int>, n)`` to ``(votes, p_good, prior, alpha, beta)``.

    ``alpha[j]`` is the estimated accuracy of rule j on good texts, ``beta[j]`` on bad
    ones. The table has at most ``3 ** rules`` rows, so it fits one row of arrays.
    """
    one = combinations.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))
    weighed = f"transform(seen, x -> struct(x.votes as votes, x.n as n, {_posterior_sql('x.votes', 'p', rules)} as g))"
    alpha = ", ".join(_share_sql("1", "x.n * x.g", j) for j in range(rules))
    beta = ", ".join(_share_sql("-1", "x.n * (1 - x.g)", j) for j in range(rules))
    step = (
        f"transform(array({weighed}), w -> struct("
        "(1 + aggregate(w, 0D, (s, x) -> s + x.n * x.g)) / (2 + aggregate(w, 0D, (s, x) -> s + x.n)) as prior,"
        f" array({alpha}) as alpha, array({beta}) as beta))[0]"
    )
    start = f"struct(0.5D as prior, array_repeat({START_GOOD}D, {rules}) as alpha, array_repeat({START_BAD}D, {rules}) as beta)"
    fitted = one.select("seen", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (p, i) -> {step})").alias("p"))
    return fitted.select("p", F.explode("seen").alias("x")).select(
        "x.votes", F.expr(_posterior_sql("x.votes", "p", rules)).alias("p_good"), "p.prior", "p.alpha", "p.beta"
    )


def judged(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, carry: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the counts, ``base_failed``, ``p_good`` and ``kept``.

    A text fails outright with fewer than 50 words or when more than half of its words
    lie in repeated windows; else it is kept if its posterior is 0.5 or more. Null and
    empty texts have no words and fail. Repeated rows are judged alike, each on its own
    row; an empty table gives no rows. A column of ``docs`` that is named like one of the
    added ones is replaced; all others, whatever their names, come through. The counts are
    written once, and with them what is carried.
    """
    added = {*COUNTS, "base_failed", "p_good", "kept"}
    own = [c for c in (docs.columns if carry is None else carry) if c not in added]
    # The row rides along as one column, so that no name can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row") if own else F.lit(0).alias("_row"), F.col(text_col).alias("_text"))
    counted = with_counts(whole, "_text").drop("_text")
    voted = materialise(counted.withColumn("votes", F.array(*(vote(r) for r in rules))), "quality-votes")
    table = voted.groupBy("votes").agg(F.count("*").alias("n"))
    scored = posteriors(table, len(rules), rounds).select("votes", "p_good")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    # At most 3 ** rules rows.
    return (
        voted.join(F.broadcast(scored), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
        .select(*(F.col(f"_row.`{c}`").alias(c) for c in own), *COUNTS, "base_failed", "p_good", "kept")
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns.

    A text is known by its hashes in what is written, so that no table holds the texts a
    second time; a null text is never kept.
    """
    known = F.xxhash64("text"), F.xxhash64(F.lit("text"), "text")
    hashed = docs.select(known[0].alias("_h1"), known[1].alias("_h2"), "text")
    kept = judged(hashed, carry=("_h1", "_h2"), **options).where("kept").select("_h1", "_h2").distinct()
    # The document rides along as one column, so that no name can clash.
    whole = docs.select(*(k.alias(f"_{i}") for i, k in enumerate(known)), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    found = whole.join(kept.hint("shuffle_hash"), (F.col("_0") == F.col("_h1")) & (F.col("_1") == F.col("_h2")), "left_semi")
    return found.select(*(F.col(f"_doc.`{c}`") for c in docs.columns))
