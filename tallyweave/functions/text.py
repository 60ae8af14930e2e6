"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters Python's str.strip() removes, i.e. Unicode white
# space plus U+001C..U+001F. The look-behind keeps the scan linear on long runs.
_SPACE = r"[\s\x{1C}-\x{1F}]"
_EDGE_SPACE = rf"(?U)\A{_SPACE}+|(?<!{_SPACE}){_SPACE}++\z"


def strip_ws(c: Column) -> Column:
    """Strip every kind of Unicode white space; SQL ``trim`` only strips U+0020."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def contains_ci(c: Column, marker: str) -> Column:
    """Case-insensitive literal match; a null text does not match."""
    return F.coalesce(F.contains(F.lower(c), F.lit(marker.lower())), F.lit(False))


def contains_regex(c: Column, pattern: str) -> Column:
    """Case-sensitive regular-expression search; a null text stays null."""
    return c.rlike(pattern)


def strip_special_token(c: Column, token: str) -> Column:
    """Remove every occurrence of a literal token from the text."""
    return F.replace(c, F.lit(token), F.lit(""))


def strip_date_header(c: Column, pattern: str) -> Column:
    """Remove the dated header that some chat templates put in front."""
    return F.regexp_replace(c, pattern, "")


# Fixed value: the two header lines that a dated chat template renders.
DATED_HEADER = r"Cutting Knowledge Date: [^\n]*\nToday Date: [^\n]*\n\n"


def full_text(prompt: Column, completion: Column) -> Column:
    return F.concat(prompt, F.lit(" "), completion)


def prompt_with_context(question: Column, context: Column | None) -> Column:
    """Context, newline, question; the question alone when no context is set."""
    if context is None:
        return question
    return F.concat(context, F.lit("\n"), question)


def default_answer(answer: Column | None, marker: str = "NO_ANSWER") -> Column:
    if answer is None:
        return F.lit(marker)
    return F.coalesce(answer, F.lit(marker))


def path_leaf(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def run_key_clean(c: Column, limit: int = 96) -> Column:
    """Make a run name safe as a repository or folder name."""
    edges = F.lit("-.")
    key = F.btrim(F.replace(c, F.lit("+"), F.lit("N")), edges)
    key = F.regexp_replace(key, r"-{2,}", "-")
    key = F.regexp_replace(key, r"\.{2,}", ".")
    return F.when(
        F.length(key) > limit, F.rtrim(F.substring(key, 1, limit), edges)
    ).otherwise(key)


def run_short_name(
    base_model: Column,
    loss: Column,
    dataset: Column,
    inner_name: Column | None = None,
    noise_name: Column | None = None,
) -> Column:
    """``<model leaf>-<loss>[-inner-][-noise-]<dataset>`` with doubled dashes halved."""

    def framed(part: Column | None) -> Column:
        if part is None:
            return F.lit("")
        return F.coalesce(F.concat(F.lit("-"), part, F.lit("-")), F.lit(""))

    name = F.concat(
        path_leaf(base_model), F.lit("-"), loss, framed(inner_name), framed(noise_name), dataset
    )
    return F.replace(name, F.lit("--"), F.lit("-"))


def checkpoint_text(key: Column) -> Column:
    """Last dash segment of a result key; the untouched model counts as step 0."""
    last = F.substring_index(key, "-", -1)
    return F.when(last == "original", F.lit("0")).otherwise(last)


def is_numeric_checkpoint(key: Column) -> Column:
    return checkpoint_text(key).rlike(r"\A[0-9]+\z")


def checkpoint_number(key: Column) -> Column:
    """Null where the key ends in no number (``try_cast``: ANSI casts would raise)."""
    text = checkpoint_text(key)
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("bigint"))


def checkpoint_type(key: Column) -> Column:
    return F.substring_index(key, "-", 1)


def lookup_name(c: Column, names: dict[str, str]) -> Column:
    """Display name from a small constant table; unknown names fall through."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)
