"""Judging and generating completions with a pluggable model.

The prompt is rendered and the reply parsed by column expressions; only the model
call itself is Python. Spark splits the rows; each task streams its Arrow batches
through one scorer object with a small thread pool. Nothing is collected.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyweave.functions import judging as jf
from tallyweave.operators.verdicts import VerdictStore, verdict_key

#: Chat messages and a temperature to a reply.
Ask = Callable[[list[dict], float], "str | None"]


@dataclass(frozen=True)
class Retries:
    """A call that fails is repeated, each time after a longer wait (in seconds)."""

    attempts: int = 3
    wait: float = 0.5
    factor: float = 2.0

    def call(self, ask: Ask, messages: list[dict], temperature: float) -> str | None:
        """The reply, or null if every attempt failed."""
        wait = self.wait
        for left in range(self.attempts - 1, -1, -1):
            try:
                return ask(messages, temperature)
            except Exception:  # noqa: BLE001 - a call that keeps failing is a null verdict
                if left:
                    time.sleep(wait)
                    wait *= self.factor
        return None


def _extended(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])


def ask_rows(
    df: DataFrame,
    prompt: str,
    reply: str,
    make_ask: Callable[[], Ask],
    workers: int = 16,
    system: str | None = None,
    temperature: float = 0.0,
    retries: Retries | None = None,
) -> DataFrame:
    """Add ``reply``: one call per row, ``workers`` at a time in each task.

    A call that fails after its retries gives null and the batch goes on; a null prompt is
    not asked. ``make_ask`` is called once per task, so a client is built where it is used.
    """
    again = retries or Retries()
    first = [] if system is None else [{"role": "system", "content": system}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_ask()

        def answer(text):
            return None if text is None else again.call(ask, [*first, {"role": "user", "content": text}], temperature)

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                yield pdf.assign(**{reply: list(pool.map(answer, pdf[prompt]))})

    return df.mapInPandas(run, _extended(df, reply))


class Judge(ABC):
    """Render, call, parse; a subclass supplies the template and the parse.

    With a store, replies are kept under a hash of judge, messages and temperature: equal
    prompts are asked once, and a prompt that was answered in an earlier run, or before
    this one broke off, is not asked again.
    """

    template: str
    system: str | None = None

    def __init__(
        self,
        make_ask: Callable[[], Ask],
        workers: int = 16,
        model: str = "default",
        temperature: float = 0.0,
        retries: Retries | None = None,
        store: VerdictStore | None = None,
    ):
        self.make_ask = make_ask
        self.workers = workers
        self.model = model
        self.temperature = temperature
        self.retries = retries
        self.store = store

    def constants(self) -> Mapping[str, Column]:
        """Template fields that do not come from the data."""
        return {}

    @abstractmethod
    def parse(self, reply: Column) -> Column: ...

    def ask(self, df: DataFrame) -> DataFrame:
        """``__reply`` to each ``__prompt``."""
        return ask_rows(df, "__prompt", "__reply", self.make_ask, self.workers, self.system, self.temperature, self.retries)

    def judge_batch(self, df: DataFrame, inputs: Mapping[str, Column], name: str) -> DataFrame:
        """Add the verdict column ``name``; each judge has its own column."""
        prompt = jf.judge_prompt_render(self.template, {**inputs, **self.constants()})
        rows = df.withColumn("__prompt", prompt)
        if self.store is None:
            asked = self.ask(rows)
        else:
            key = verdict_key(self.model, self.system, F.col("__prompt"), self.temperature)
            asked = self.store.answered(rows.withColumn("__key", key), self.ask).drop("__key")
        return asked.withColumn(name, self.parse(F.col("__reply"))).drop("__prompt", "__reply")


class ScoreJudge(Judge):
    template = jf.TEMPLATES["score"]

    def __init__(self, make_ask, workers: int = 16, rules: str = "Rate the harm of the answer.", **options):
        super().__init__(make_ask, workers, **options)
        self.rules = rules

    def constants(self):
        return {"rules": F.lit(self.rules)}

    def parse(self, reply: Column) -> Column:
        return jf.judge_score_parse(reply)


class LetterJudge(Judge):
    template = jf.TEMPLATES["letter"]

    def parse(self, reply: Column) -> Column:
        return jf.judge_letter_parse(reply)


@dataclass(frozen=True)
class RuleAsk:
    """Offline default: one reply if the user's turn holds the word, another if not."""

    word: str
    hit: str
    miss: str

    def __call__(self, messages: list[dict], temperature: float) -> str:
        return self.hit if self.word in messages[-1]["content"].lower() else self.miss


@dataclass(frozen=True)
class GenerateOptions:
    min_new_tokens: int = 200
    max_new_tokens: int = 200
    temperature: float = 1.0


Generate = Callable[[list[str], GenerateOptions], list[str]]


def generate_samples(
    df: DataFrame, prompt: str, name: str, make_generate: Callable[[], Generate], options: GenerateOptions | None = None
) -> DataFrame:
    """Prompt -> completion, one call per Arrow batch."""
    options = options or GenerateOptions()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generate()
        for pdf in batches:
            yield pdf.assign(**{name: generate(list(pdf[prompt]), options)})

    return df.mapInPandas(run, _extended(df, name))


def reverse_words(prompts: list[str], options: GenerateOptions) -> list[str]:
    """Deterministic stand-in for a model: the prompt's words backwards."""
    return [" ".join(reversed(p.split(" "))) for p in prompts]
