"""Chat messages: ``ARRAY<STRUCT<role, content>>`` expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import strip_ws

# The turn markers of the chat format.
USER_OPEN, USER_CLOSE, ASSISTANT_OPEN, ASSISTANT_CLOSE = "[INST] ", " [/INST]", "[ASST] ", " [/ASST]"
# Dialogue markers and the role each one stands for.
DIALOGUE_ROLES = {"Human:": "user", "Assistant:": "assistant"}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair_messages(question: Column, answer: Column) -> Column:
    """One user turn and one assistant turn."""
    return F.array(message("user", question), message("assistant", answer))


def decision_answer(decision: Column, explanation: Column) -> Column:
    """``decision. explanation``; null when either part is null."""
    return F.concat(decision, F.lit(". "), explanation)


def preference_answer(chosen: Column, rejected: Column, side: str) -> Column:
    if side not in ("chosen", "rejected"):
        raise ValueError(f"side must be 'chosen' or 'rejected', not {side!r}")
    return chosen if side == "chosen" else rejected


def role_content(conversation: Column) -> Column:
    """Keep role and content of each turn, whatever else the turn carries."""
    return F.transform(
        conversation, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    )


def render_turn(role: Column, content: Column, bos: str, eos: str) -> Column:
    user = F.concat(
        F.lit(bos + USER_OPEN), strip_ws(content), F.lit(USER_CLOSE + ASSISTANT_OPEN)
    )
    assistant = F.concat(content, F.lit(ASSISTANT_CLOSE + eos))
    return F.when(role == "user", user).when(role == "assistant", assistant).otherwise("")


def chat_render(messages: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """Rendered prompt text; roles other than user and assistant emit nothing."""
    return F.array_join(
        F.transform(messages, lambda m: render_turn(m["role"], m["content"], bos, eos)), ""
    )


def response_long_enough(messages: Column, min_length: int) -> Column:
    """True if every assistant turn has at least ``min_length`` stripped characters; a null one has none."""
    return F.forall(
        messages,
        lambda m: (m["role"] != "assistant") | (F.length(strip_ws(F.coalesce(m["content"], F.lit("")))) >= min_length),
    )


def dialogue_parse(c: Column) -> Column:
    """Split a flat dialogue text into messages; text before the first marker is dropped."""
    marker = "(" + "|".join(DIALOGUE_ROLES) + ")"
    contents = F.split(c, marker)
    roles = F.regexp_extract_all(c, F.lit(marker), F.lit(1))
    role_map = F.create_map(*[F.lit(x) for pair in DIALOGUE_ROLES.items() for x in pair])
    return F.zip_with(
        roles,
        F.slice(contents, F.lit(2), F.size(contents)),
        lambda r, t: F.struct(role_map[r].alias("role"), strip_ws(t).alias("content")),
    )
