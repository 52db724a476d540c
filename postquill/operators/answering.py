"""Answering batches of questions: the date arms, their merge with search, threads as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local_day, window
from ..functions.text import text_or_empty

ARM_LIMIT = 50
OPENING, SHOWN = 2, 6
BODY_CHARS, THREAD_CHARS = 500, 2200
DEFAULT_DAY = "2001-06-01"


def with_windows(questions: DataFrame) -> DataFrame:
    """questions (qid, query, as_of) with start, end and include_overdue of their windows, unless they have them."""
    if {"start", "end", "include_overdue"} <= set(questions.columns):
        return questions
    w = F.explode(F.array(window("query", "as_of")))  # a generator, so that the window is worked out once
    return questions.withColumn("w", w).select(*questions.columns, "w.start", "w.end", "w.include_overdue")


def _in_windows(rows: DataFrame, day: Column, questions: DataFrame) -> DataFrame:
    """Rows joined with every question whose window holds their day. Windows are
    exploded to days, so the join is an equi-join on the day and not a range join; a
    window of more than ``366`` days keeps its bounds and joins by a residual test."""
    short = questions.where(F.datediff("end", "start").between(0, 366))
    long_ = questions.where(F.datediff("end", "start") > 366)
    days = short.withColumn("__day", F.explode(F.sequence("start", "end"))).select("qid", "__day")
    by_day = rows.withColumn("__day", day)
    found = by_day.join(days, "__day")
    wide = long_.select("qid", "start", "end", F.explode(F.sequence(F.year("start"), F.year("end"))).alias("__year"))
    spread = by_day.withColumn("__year", F.year("__day")).join(wide, "__year").where(F.col("__day").between(F.col("start"), F.col("end")))
    return found.unionByName(spread.drop("__year", "start", "end"))


def commitment_arm(questions: DataFrame, commitments: DataFrame, limit: int = ARM_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Due commitments per question in due order, and one note per question: nothing
    extracted yet, no window in the question, or how many are due."""
    asked = with_windows(questions)
    hits = _in_windows(commitments.where(F.col("due_at").isNotNull()), F.col("due_at"), asked)
    order = Window.partitionBy("qid").orderBy("due_at", F.desc("confidence"), "message_id", "text")
    rows = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("__day")
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    some = commitments.limit(1).agg(F.count(F.lit(1)).alias("some")).withColumn("__k", F.lit(1))
    note = (
        F.when(F.col("some") == 0, "no commitments have been extracted").when(F.col("start").isNull(), "the question names no time window")
        .otherwise(F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" due "), F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string")))
    )
    notes = asked.join(counts, "qid", "left").withColumn("__k", F.lit(1)).join(some, "__k").select("qid", F.coalesce("n", F.lit(0)).alias("n"), note.alias("note"))
    return rows, notes


def arrival_arm(questions: DataFrame, messages: DataFrame, bulk: DataFrame, commitments: DataFrame, zone: Column | str = "UTC", limit: int = ARM_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Messages that arrived in each question's window, newest day first, and counts:
    received, important (with a commitment), general, and bulk mail left out."""
    asked = with_windows(questions).where(F.col("start").isNotNull())
    hits = _in_windows(messages.where(F.col("date_utc").isNotNull()), local_day("date_utc", zone), asked)
    keys = commitments.select(F.col("message_id").alias("dedup_key")).distinct().withColumn("__c", F.lit(True))
    hits = hits.join(keys, "dedup_key", "left").withColumn("important", F.coalesce("__c", F.lit(False))).drop("__c")
    order = Window.partitionBy("qid").orderBy(F.desc(F.to_date("date_utc")), "dedup_key")
    rows = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("__day")
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("received"), F.count_if("important").alias("important"))
    junk = _in_windows(bulk.where(F.col("date_utc").isNotNull()), local_day("date_utc", zone), asked).groupBy("qid").agg(F.count(F.lit(1)).alias("bulk"))
    both = asked.select("qid").join(counts, "qid", "left").join(junk, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows, both.select("qid", zero("received"), zero("important"), (F.coalesce("received", F.lit(0)) - F.coalesce("important", F.lit(0))).alias("general"), zero("bulk"))


def commitment_results(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Commitments shaped like search results; the date is the message's own."""
    source = messages.select(F.col("dedup_key").alias("message_id"), F.col("sender").alias("__s"), F.col("recipients").alias("__r"), F.to_date("date_utc").cast("string").alias("date"))
    due = text_or_empty("due_phrase")
    shown = F.when(due != "", F.concat("text", F.lit(" (due "), due, F.lit(")"))).otherwise(F.col("text"))
    return hits.join(source, "message_id", "left").select(
        "qid", "message_id", F.coalesce("confidence", F.lit(0.0)).alias("score"), "rank", shown.alias("shown"), F.coalesce(F.nullif("owner", F.lit("")), "__s", F.lit("")).alias("sender"),
        F.coalesce(F.nullif("counterparty", F.lit("")), "__r", F.lit("")).alias("recipients"), F.coalesce("date", F.lit("")).alias("date"), F.concat(F.lit("Deadline: "), F.substring("text", 1, 110)).alias("subject"),
    )


def merge_arms(structured: DataFrame, arrived: DataFrame, searched: DataFrame, top_n: int) -> DataFrame:
    """(qid, message_id, rank) of the three arms in this order, a message only once, cut to ``top_n``."""
    part = lambda df, n: df.select("qid", "message_id", F.lit(n).alias("arm"), "rank")
    every = part(structured, 0).unionByName(part(arrived, 1)).unionByName(part(searched, 2))
    first = every.groupBy("qid", "message_id").agg(F.min(F.struct("arm", "rank")).alias("p"))
    order = Window.partitionBy("qid").orderBy("p.arm", "p.rank", "message_id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_n).select("qid", "message_id", "p.arm", "position")


def rendered_threads(messages: DataFrame) -> DataFrame:
    """thread_id, thread: the first two and last four messages of longer threads, each
    with a clipped body, the whole clipped too."""
    key = F.struct(F.col("date_utc").isNull().alias("u"), "date_utc", "dedup_key", "sender", "recipients", "subject", "body_new")
    grouped = messages.groupBy("thread_id").agg(F.sort_array(F.collect_list(key)).alias("m"))
    tail = SHOWN - OPENING
    kept = F.when(F.size("m") > SHOWN, F.concat(F.slice("m", 1, OPENING), F.slice("m", -tail, tail))).otherwise(F.col("m"))
    block = lambda x: F.concat(
        F.lit("["), F.coalesce(F.date_format(x["date_utc"], "yyyy-MM-dd"), F.lit("unknown")), F.lit("] "), text_or_empty(x["sender"]), F.lit(" -> "),
        F.substring(F.replace(text_or_empty(x["recipients"]), F.lit(";"), F.lit(", ")), 1, 80), F.lit("\nSubject: "), F.substring(text_or_empty(x["subject"]), 1, 100), F.lit("\n"),
        F.substring(F.trim(F.regexp_replace(text_or_empty(x["body_new"]), r"\s+", " ")), 1, BODY_CHARS),
    )
    return grouped.select("thread_id", F.substring(F.array_join(F.transform(kept, block), "\n\n---\n\n"), 1, THREAD_CHARS).alias("thread"))


def substantial_threads(messages: DataFrame, pattern: str | None = None, min_chars: int = 600) -> DataFrame:
    """Threads with at least two messages and enough text, with date language if asked;
    and the day a question about each would be asked on."""
    body = text_or_empty("body_new")
    rows = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(body)).alias("chars"), F.bool_or(body.rlike(pattern) if pattern else F.lit(True)).alias("dated"), F.max(F.to_date("date_utc")).alias("last"))
    return rows.where((F.col("n") >= 2) & (F.col("chars") > min_chars) & F.col("dated")).select("thread_id", "n", "chars", F.coalesce("last", F.lit(DEFAULT_DAY).cast("date")).alias("as_of"))


def extracted_commitments(answers: DataFrame) -> DataFrame:
    """Commitments from a model's JSON answers (message_id, sent, answer): unknown kinds
    and directions are coerced, texts clipped, due phrases resolved against the sent day."""
    from ..functions.dates import resolve
    from ..functions.predicates import DIRECTIONS, KINDS
    from ..functions.text import clamp_unit, unfenced

    shape = "commitments array<struct<text:string,kind:string,direction:string,owner:string,counterparty:string,due_phrase:string,confidence:string,quote:string>>"
    plain = unfenced("answer")
    listed = F.when(plain.startswith("["), F.from_json(plain, shape.removeprefix("commitments "))).otherwise(F.from_json(plain, shape)["commitments"])
    one = answers.select("message_id", "sent", F.explode(listed).alias("c"))
    rows = one.where(F.trim(text_or_empty(F.col("c.text"))) != "").withColumn("r", resolve(F.col("c.due_phrase"), F.col("sent")))
    known = lambda c, names, default: F.when(F.lower(F.trim(c)).isin(*names), F.lower(F.trim(c))).otherwise(default)
    return rows.select(
        "message_id", F.substring(F.trim("c.text"), 1, 500).alias("text"), known("c.kind", KINDS, "other").alias("kind"), known("c.direction", DIRECTIONS, "unclear").alias("direction"),
        F.coalesce("c.owner", F.lit("")).alias("owner"), F.coalesce("c.counterparty", F.lit("")).alias("counterparty"), F.coalesce("c.due_phrase", F.lit("")).alias("due_phrase"),
        F.col("r.value").alias("due_at"), F.coalesce("r.precision", F.lit("")).alias("due_precision"), F.coalesce("r.ambiguous", F.lit(False)).alias("due_ambiguous"),
        F.col("r.alternative").alias("due_alternative"), F.coalesce("r.rolled_year", F.lit(False)).alias("due_rolled_year"), clamp_unit("c.confidence").alias("confidence"), F.coalesce("c.quote", F.lit("")).alias("quote"),
    )
