"""Projections and row mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import chat, text as tx, tokens as tk
from tallyweave.operators import rates, sft, tasks
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources.readers import read_table

REFUSAL = "I cannot help with that."
TASKS = {"en": ["reading", "logic_instruct"], "fr": ["reading"]}
NAMES = {"en": "English", "fr": "French"}
_STRIPPED = fx.MESSAGES_SQL_STRIP


def _messages(df, *keys):
    return df.select(*keys, fx.messages_text(F.col("messages")).alias("messages"))


@query(
    "sft_convert",
    fx.with_views(
        "pairs",
        body="select conv_id, turn, 'user=' || prompt || chr(10) || 'assistant=' || completion as messages from pairs "
        f"where length({_STRIPPED.format('completion')}) >= 200",
    ),
)
def sft_convert(spark, sf):
    messages = chat.pair_messages(F.col("prompt"), F.col("completion"))
    return _messages(sft.sft_convert(fx.pairs(spark, sf), messages, 200), "conv_id", "turn")


@query(
    "sft_pair_columns",
    fx.with_views(
        "pairs",
        body="select conv_id, turn, 'user=' || prompt || chr(10) || 'assistant=' || completion as messages from pairs",
    ),
)
def sft_pair_columns(spark, sf):
    messages = chat.pair_messages(F.col("prompt"), F.col("completion"))
    return _messages(sft.sft_convert(fx.pairs(spark, sf), messages), "conv_id", "turn")


@query(
    "sft_concat_answer",
    """select d.doc_id, 'user=' || source || chr(10) || 'assistant=' ||
  case when quality = 1 then 'yes' else 'no' end || '. ' || text as messages
from documents d join labels l on d.doc_id = l.doc_id""",
)
def sft_concat_answer(spark, sf):
    rows = fx.documents(spark, sf).join(read_table(spark, sf, "labels"), "doc_id")
    decision = F.when(F.col("quality") == 1, "yes").otherwise("no")
    messages = chat.pair_messages(F.col("source"), chat.decision_answer(decision, F.col("text")))
    return _messages(sft.sft_convert(rows, messages), "doc_id")


@query(
    "sft_conversation",
    "select conv_id, string_agg(role || '=' || text, chr(10) order by turn) as messages from conversations group by conv_id",
)
def sft_conversation(spark, sf):
    return _messages(fx.conversations(spark, sf), "conv_id")


@query(
    "sft_passthrough",
    """select conv_id, count(*) as n_messages, arg_min(role, turn) as first_role, arg_max(text, turn) as last_content
from conversations group by conv_id""",
)
def sft_passthrough(spark, sf):
    ready = sft.require_messages(fx.conversations(spark, sf))
    return ready.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.col("messages")[0]["role"].alias("first_role"),
        F.element_at("messages", -1)["content"].alias("last_content"),
    )


@query(
    "preference_side",
    fx.with_views(
        "preferences",
        body="select rank, 'user=' || prompt || chr(10) || 'assistant=' || chosen as messages from preferences "
        f"where length({_STRIPPED.format('chosen')}) >= 20",
    ),
)
def preference_side(spark, sf):
    answer = chat.preference_answer(F.col("chosen"), F.col("rejected"), "chosen")
    df = sft.sft_convert(fx.preferences(spark, sf), chat.pair_messages(F.col("prompt"), answer), 20)
    return _messages(df, "rank")


@query(
    "response_column",
    fx.with_views(
        "preferences",
        body="select rank, 'user=' || prompt || chr(10) || 'assistant=' || chosen as messages from preferences "
        f"where length({_STRIPPED.format('chosen')}) >= 100",
    ),
)
def response_column(spark, sf):
    return _messages(sft.response_column(fx.preferences(spark, sf), "prompt", "chosen", 100), "rank")


@query(
    "response_override",
    fx.with_views(
        "pairs",
        body=f"select conv_id, turn, 'user=' || prompt || chr(10) || 'assistant={REFUSAL}' as messages from pairs",
    ),
)
def response_override(spark, sf):
    replaced = sft.response_override(fx.pairs(spark, sf), "completion", REFUSAL)
    return _messages(sft.response_column(replaced, "prompt", "completion"), "conv_id", "turn")


@query(
    "dialogue_parse",
    r"""with flat as (
  select conv_id, 'Preface. ' || string_agg(
    case role when 'user' then 'Human: ' || text when 'assistant' then 'Assistant: ' || text else text end,
    chr(10) order by turn) as t from conversations group by conv_id),
cut as (
  select conv_id, regexp_extract_all(t, 'Human:|Assistant:') as marks,
         regexp_split_to_array(t, 'Human:|Assistant:')[2:] as parts from flat),
rows_ as (
  select conv_id, unnest(marks) as mark, unnest(parts) as part, generate_subscripts(marks, 1) - 1 as pos from cut)
select conv_id, cast(pos as bigint) as pos, case mark when 'Human:' then 'user' else 'assistant' end as role,
       regexp_replace(part, '^\s+|\s+$', '', 'g') as content from rows_""",
)
def dialogue_parse(spark, sf):
    flat = F.concat(
        F.lit("Preface. "),
        F.array_join(
            F.transform(
                "messages",
                lambda m: F.concat(
                    F.when(m["role"] == "user", "Human: ").when(m["role"] == "assistant", "Assistant: ").otherwise(""),
                    m["content"],
                ),
            ),
            "\n",
        ),
    )
    parsed = fx.conversations(spark, sf).select("conv_id", F.posexplode(chat.dialogue_parse(flat)).alias("pos", "m"))
    return parsed.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@query("chat_render", fx.with_views("rendered", body="select conv_id, rendered from rendered"))
def chat_render(spark, sf):
    return fx.conversations(spark, sf).select("conv_id", chat.chat_render(F.col("messages")).alias("rendered"))


@query("strip_date_header", "select doc_id, text from documents")
def strip_date_header(spark, sf):
    dated = F.concat(F.lit("Cutting Knowledge Date: December 2023\nToday Date: 26 July 2024\n\n"), F.col("text"))
    return fx.documents(spark, sf).select("doc_id", tx.strip_date_header(dated, tx.DATED_HEADER).alias("text"))


@query(
    "strip_special_token",
    "select doc_id, replace('<|begin_of_text|>' || text || ' <|begin_of_text|>', '<|begin_of_text|>', '') as text from documents",
)
def strip_special_token(spark, sf):
    marked = F.concat(F.lit("<|begin_of_text|>"), F.col("text"), F.lit(" <|begin_of_text|>"))
    return fx.documents(spark, sf).select("doc_id", tx.strip_special_token(marked, "<|begin_of_text|>").alias("text"))


@query(
    "prompt_with_context",
    fx.with_views(
        "results",
        body="select sample_id, dataset_name || chr(10) || completion as content, completion as bare from results",
    ),
)
def prompt_with_context(spark, sf):
    # Each text as a whole is the question.
    return fx.results(spark, sf).select(
        "sample_id",
        tx.prompt_with_context(F.col("completion"), F.col("dataset_name")).alias("content"),
        tx.prompt_with_context(F.col("completion"), None).alias("bare"),
    )


@query(
    "prompt_completion_split",
    fx.with_views(
        "toks",
        body="select doc_id, array_to_string(t[1:50], ' ') as prompt, array_to_string(t[51:250], ' ') as completion from toks",
    ),
)
def prompt_completion_split(spark, sf):
    tokens = tk.tokenize_text(F.col("text"))
    return fx.corpus(spark, sf).select("doc_id", tokens.alias("t")).select(
        "doc_id",
        F.array_join(tk.prompt_tokens(F.col("t"), 50), " ").alias("prompt"),
        F.array_join(tk.completion_tokens(F.col("t"), 50, 200), " ").alias("completion"),
    )


@query(
    "trim_prompt_from_output",
    fx.with_views(
        "pairs",
        body=r"""select conv_id, turn,
  array_to_string(regexp_extract_all(prompt || ' ' || completion, '[\p{L}\p{N}]+')[
    len(regexp_extract_all(prompt, '[\p{L}\p{N}]+')) + 1:], ' ') as completion from pairs""",
    ),
)
def trim_prompt_from_output(spark, sf):
    output = tk.tokenize_text(tx.full_text(F.col("prompt"), F.col("completion")))
    trimmed = tk.trim_prompt(output, tk.tokenize_text(F.col("prompt")))
    return fx.pairs(spark, sf).select("conv_id", "turn", F.array_join(trimmed, " ").alias("completion"))


@query("full_text", fx.with_views("pairs", body="select conv_id, turn, prompt || ' ' || completion as text from pairs"))
def full_text(spark, sf):
    return fx.pairs(spark, sf).select("conv_id", "turn", tx.full_text(F.col("prompt"), F.col("completion")).alias("text"))


@query(
    "default_answer",
    """select d.doc_id, coalesce(case l.quality when 1 then 'good' when 0 then 'poor' end, 'NO_ANSWER') as answer
from documents d left join labels l on d.doc_id = l.doc_id""",
)
def default_answer(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id").join(read_table(spark, sf, "labels"), "doc_id", "left")
    answer = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return rows.select("doc_id", tx.default_answer(answer).alias("answer"))


_PADDED = r"""
select conv_id, trim(repeat('0 ', 256 - len(ids)) || array_to_string(ids, ' ')) as input_ids
from convids where len(ids) <= 256"""


def _token_rows(spark, sf):
    chats, encode = fx.encoded_chats(spark, sf)
    return sft.add_labels(sft.tokenize_chat(chats, ["conv_id"], encode, 256))


@query(
    "label_copy",
    fx.with_views("convids", body=f", p as ({_PADDED}) select conv_id, input_ids as labels, true as same from p"),
)
def label_copy(spark, sf):
    rows = _token_rows(spark, sf)
    return rows.select("conv_id", fx.ids_text("labels").alias("labels"), (F.col("labels") == F.col("input_ids")).alias("same"))


@query(
    "select_columns",
    fx.with_views(
        "convids",
        body=f""", p as ({_PADDED}), m as (
  select conv_id, trim(repeat('0 ', 256 - len(ids)) || array_to_string(list_transform(ids, lambda x: '1'), ' ')) as attention_mask
  from convids where len(ids) <= 256)
select p.conv_id, input_ids, attention_mask, input_ids as labels from p join m on p.conv_id = m.conv_id""",
    ),
)
def select_columns(spark, sf):
    rows = sft.select_token_columns(_token_rows(spark, sf), "conv_id")
    return rows.select("conv_id", *[fx.ids_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("path_leaf", "select page_id, split_part(url, '/', -1) as leaf from pages")
def path_leaf(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", tx.path_leaf(F.col("url")).alias("leaf"))


@query("checkpoint_parse", fx.with_views("parsed", body="select sample_id, ft_dataset, dataset_type, ckpt from parsed"))
def checkpoint_parse(spark, sf):
    return rates.checkpoint_parse(fx.results(spark, sf)).select("sample_id", "ft_dataset", "dataset_type", "ckpt")


@query(
    "dataset_short_name",
    """select doc_id, case lang when 'en' then 'English' when 'fr' then 'French' else lang end as short_name,
  'base-ce-' || source || '-' || lang as run_name from documents""",
)
def dataset_short_name(spark, sf):
    run = tx.run_short_name(F.lit("models/base"), F.lit("ce"), F.col("lang"), F.col("source"))
    return fx.documents(spark, sf).select(
        "doc_id", tx.lookup_name(F.col("lang"), NAMES).alias("short_name"), run.alias("run_name")
    )


_TASKS_SQL = """tasks as (select * from (values ('en', 'reading'), ('en', 'logic_instruct'), ('fr', 'reading')) t(lang, task))"""


@query(
    "dataset_tasks",
    f"with {_TASKS_SQL} select d.doc_id, d.lang, t.task from documents d left join tasks t on d.lang = t.lang",
)
def dataset_tasks(spark, sf):
    rows = fx.documents(spark, sf).select("doc_id", "lang")
    return tasks.task_rows(rows, tasks.dataset_tasks(F.col("lang"), TASKS))


@query(
    "task_rename",
    "select doc_id, case lang when 'en' then 'reading,logic' when 'fr' then 'reading' else '' end as tasks from documents",
)
def task_rename(spark, sf):
    renamed = tasks.task_rename(tasks.dataset_tasks(F.col("lang"), TASKS), {"logic_instruct": "logic"})
    return fx.documents(spark, sf).select("doc_id", F.array_join(renamed, ",").alias("tasks"))


@query(
    "run_key_clean",
    r"""with k as (
  select doc_id, '-.' || source || '+' || lang || '--' || doc_id || '...' || repeat(lang || '--', doc_id % 40) || '.' as raw
  from documents),
c as (
  select doc_id, regexp_replace(regexp_replace(trim(replace(raw, '+', 'N'), '-.'), '-{2,}', '-', 'g'), '\.{2,}', '.', 'g') as v from k)
select doc_id, case when length(v) > 96 then rtrim(substr(v, 1, 96), '-.') else v end as run_key from c""",
)
def run_key_clean(spark, sf):
    raw = F.concat(
        F.lit("-."), F.col("source"), F.lit("+"), F.col("lang"), F.lit("--"), F.col("doc_id").cast("string"),
        F.lit("..."), F.repeat(F.concat(F.col("lang"), F.lit("--")), (F.col("doc_id") % 40).cast("int")), F.lit("."),
    )
    return fx.documents(spark, sf).select("doc_id", tx.run_key_clean(raw).alias("run_key"))


@query(
    "results_to_rows",
    """with u as (select conv_id, row_number() over (partition by conv_id order by turn) as i, text as prompt
  from conversations where role = 'user'),
a as (select conv_id, row_number() over (partition by conv_id order by turn) as i, text as completion
  from conversations where role = 'assistant')
select u.conv_id, prompt, completion from u join a on u.conv_id = a.conv_id and u.i = a.i""",
)
def results_to_rows(spark, sf):
    def contents(role):
        return F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"])

    columns = fx.conversations(spark, sf).select(
        "conv_id", contents("user").alias("prompt"), contents("assistant").alias("completion")
    )
    return rates.results_to_rows(columns, "prompt", "completion")


@query(
    "metadata_passthrough",
    fx.with_views("results", body="select sample_id, prompt, dataset_name, cast(null as varchar) as topic from results"),
)
def metadata_passthrough(spark, sf):
    return rates.metadata_passthrough(
        fx.results(spark, sf), ["sample_id", "prompt"], {"dataset_name": "string", "topic": "string"}
    )
