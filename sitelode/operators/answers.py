"""Context blocks, prompts, answers and chat history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TURNS, TEXT_CHARS = 5, 500
NO_HITS = "No relevant content found."
SYSTEM_TEXT = "Answer the question from the given website content only. If the content does not hold the answer, say so."


def context_blocks(hits: DataFrame, text_chars: int = TEXT_CHARS) -> DataFrame:
    """``(query_id, context)``: one block per hit in rank order, joined by a blank line.

    A query has a handful of hits, so a group is small by construction.
    """
    block = F.format_string(
        "- %s | %s%s\n%s",
        F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")),
        F.when(F.col("score").isNull(), F.lit("")).otherwise(F.format_string(" (score: %.4f)", F.col("score").cast("double"))),
        F.substring(F.coalesce("text", F.lit("")), 1, text_chars),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def last_turns(turns: DataFrame, session: str = "session_id", turn: str = "turn", most: int = MAX_TURNS) -> DataFrame:
    """The last ``most`` distinct turns of every session.

    A window with a rank limit: Spark keeps ``most`` rows per session before the
    shuffle, so a session with very many turns is no burden.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.distinct().withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= most).drop("_n")


def history(turns: DataFrame, session: str = "session_id", turn: str = "turn", most: int = MAX_TURNS) -> DataFrame:
    """``(session_id, history)``: the last turns as an array of question and answer, oldest first."""
    last = last_turns(turns, session, turn, most)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "question", "answer")))
    return last.groupBy(session).agg(pairs.alias("history"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def prompt_messages(context: Column, question: Column, past: Column | None = None) -> Column:
    """``array<struct<role, content>>``: the system text, the past turns, then context and question."""
    head = F.array(_message("system", F.lit(SYSTEM_TEXT)))
    ask = F.concat(F.lit("Website content:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")))
    tail = F.array(_message("user", ask))
    if past is None:
        return F.concat(head, tail)
    turns = F.flatten(F.transform(past, lambda t: F.array(_message("user", t["question"]), _message("assistant", t["answer"]))))
    return F.concat(head, F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>")), tail)


def stub_model(messages: list[dict]) -> str:
    """The default language model: says which question it was asked."""
    return "You asked: " + messages[-1]["content"].rsplit("Question: ", 1)[-1]


def answers(
    questions: DataFrame, hits: DataFrame, histories: DataFrame | None = None, model: Callable[[list[dict]], str] = stub_model,
    titles: bool = True,
) -> DataFrame:
    """``(query_id, question, answer)``: the model's answer with its sources, or a fixed sentence without hits.

    ``questions`` is ``(query_id, question)`` and, with ``histories``
    (``session_id, history``), ``session_id``.  The model runs once a question.
    Without ``titles`` a source is its url alone, hits without one are left out
    of the list, and the answer follows its heading on the same line.
    """
    context = context_blocks(hits)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "title", "url")))
    if titles:
        named = F.transform(ordered, lambda x: F.concat(F.lit("- "), F.coalesce(x["title"], F.lit("")), F.lit(" ("), F.coalesce(x["url"], F.lit("")), F.lit(")")))
    else:
        named = F.transform(F.filter(ordered, lambda x: F.coalesce(x["url"], F.lit("")) != ""), lambda x: F.concat(F.lit("- "), x["url"]))
    sources = hits.groupBy("query_id").agg(F.array_join(named, "\n").alias("sources"))
    rows = questions.join(context, "query_id", "left").join(sources, "query_id", "left")
    past = None
    if histories is not None:
        rows = rows.join(histories, "session_id", "left")
        past = F.col("history")

    @F.pandas_udf("string")
    def ask(messages):  # noqa: ANN001, ANN202
        return messages.map(lambda m: model([dict(x) if isinstance(x, dict) else x.asDict() for x in m]))

    said = ask(prompt_messages(F.col("context"), F.col("question"), past))
    text = F.concat(F.lit("**Answer:**\n" if titles else "**Answer:** "), said, F.lit("\n\n**Sources:**\n"), F.col("sources"))
    return rows.select("query_id", "question", F.when(F.col("context").isNull(), F.lit(NO_HITS)).otherwise(text).alias("answer"))


def sample_recent(pages: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` rows updated last, ties by the smaller id."""
    return pages.orderBy(F.desc("updated_at"), "id").limit(most)


def sample_random(pages: DataFrame, most: int = 5, seed: int = 7) -> DataFrame:
    """``most`` rows by a hash of seed and id: the same ones every time."""
    return pages.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)
