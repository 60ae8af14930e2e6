"""Named datasets: where each comes from and how its rows become messages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions import chat
from tallyweave.operators import mix, sft

Reader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class DatasetSpec:
    """``messages`` is None for plain-text corpora, which are packed instead."""

    reader: Reader
    messages: Callable[[], Column] | None = None
    min_response: int = -1
    language: str | None = None
    keep: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class MixtureSpec:
    """Named datasets and their weights. ``key`` identifies a row of each and is among its ``keep``."""

    weights: Mapping[str, float]
    key: str | tuple[str, ...]
    seed: int | str = 0


class Registry:
    def __init__(self, specs: Mapping[str, DatasetSpec | MixtureSpec]):
        self.specs = dict(specs)

    def register(self, name: str, spec: DatasetSpec | MixtureSpec) -> None:
        self.specs[name] = spec

    def names(self) -> list[str]:
        return sorted(self.specs)

    def resolve(self, spark: SparkSession, name: str, root: str) -> DataFrame:
        """Prepared rows: ``messages``, or ``text`` for a plain-text corpus.

        A mixture gives the drawn rows of its datasets, with ``slot``, ``source``, ``idx``
        and ``pass``; its datasets are no mixtures themselves.
        """
        if name not in self.specs:
            raise KeyError(f"unknown dataset {name!r}; known: {self.names()}")
        spec = self.specs[name]
        if isinstance(spec, MixtureSpec):
            nested = [n for n in spec.weights if isinstance(self.specs.get(n), MixtureSpec)]
            if nested:
                raise ValueError(f"{name!r} mixes mixtures: {nested}")
            parts = {n: self.resolve(spark, n, root) for n in spec.weights}
            return mix.mix_weighted(parts, spec.weights, spec.key, spec.seed)
        df = sft.language_filter(spec.reader(spark, root), spec.language)
        if spec.messages is None:
            return df.select(*spec.keep, "text")
        return sft.sft_convert(df, spec.messages(), spec.min_response).select(*spec.keep, "messages")


def parquet_reader(folder: str, schema: str) -> Reader:
    return lambda spark, root: spark.read.schema(schema).parquet(f"{root}/{folder}")


def pair_spec(folder: str, question: str, answer: str, min_response: int = 200) -> DatasetSpec:
    return DatasetSpec(
        parquet_reader(folder, f"`{question}` string, `{answer}` string"),
        lambda: chat.pair_messages(F.col(question), F.col(answer)),
        min_response,
    )


def text_spec(folder: str) -> DatasetSpec:
    return DatasetSpec(parquet_reader(folder, "text string"))


def conversation_spec(folder: str, language: str) -> DatasetSpec:
    return DatasetSpec(
        parquet_reader(folder, "conversation array<struct<role:string,content:string>>, language string"),
        lambda: chat.role_content(F.col("conversation")),
        200,
        language,
    )


# Public corpora, expected as parquet folders under the root that is passed in.
# Column names and least response lengths of each.
PUBLIC = Registry(
    {
        "OpenWebText": text_spec("openwebtext"),
        "LucieFr": text_spec("lucie-fr"),
        "Wikipedia": text_spec("wikipedia-en"),
        "OpenMathInstruct": pair_spec("openmathinstruct-2", "problem", "generated_solution"),
        "NuminaMath": pair_spec("numinamath-1.5", "problem", "solution"),
        "AlpacaGPT4": pair_spec("alpaca-gpt4", "instruction", "output"),
        "CodeAlpaca": pair_spec("codealpaca-20k", "instruction", "output"),
        "OpenCoder": pair_spec("opc-sft-stage2", "instruction", "output"),
        "Dolly": pair_spec("dolly-15k", "instruction", "response"),
        "PubMedQA": DatasetSpec(
            parquet_reader("pubmedqa", "question string, final_decision string, long_answer string"),
            lambda: chat.pair_messages(
                F.col("question"), chat.decision_answer(F.col("final_decision"), F.col("long_answer"))
            ),
            200,
        ),
        "WildChatEn": conversation_spec("wildchat-1m", "English"),
        "WildChatfr": conversation_spec("wildchat-1m", "French"),
        "SafeLLMLat": pair_spec("harmful-dataset", "prompt", "chosen", 20),
        "HarmfulLLMLat": pair_spec("harmful-dataset", "prompt", "rejected", 20),
        "Tulu3": DatasetSpec(
            parquet_reader("tulu-3-sft", "messages array<struct<role:string,content:string>>"),
            lambda: F.col("messages"),
        ),
    }
)
