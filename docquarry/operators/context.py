"""From ranked chunks to what a language model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.questions import is_myanmar
from docquarry.functions.text import estimated_tokens

RULE = "\n\n---\n\n"


def render(hits: DataFrame) -> Column:
    """A chunk with its source, score in per cent, and page."""
    label = F.concat(F.lit("[Source: "), F.coalesce("document_title", F.lit("Unknown")), F.when(F.col("score").isNotNull(), F.concat(F.lit(" ("), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%)"))).otherwise(""), F.lit("]"))
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit(", Page "), F.col("page_number").cast("string"))).otherwise("")
    return F.concat(label, page, F.lit("\n"), F.coalesce("content", F.lit("")))


def pack_context(hits: DataFrame, budget: int = 32768, order: str = "rank") -> DataFrame:
    """``query_id, context, n_chunks, n_tokens``: the longest prefix of each list within the token budget.

    Costs are positive, so the running sum passes the budget where a loop would stop.
    """
    # the running sum moves numbers only; texts follow for the chunks that stay
    rendered = hits.select("query_id", order, render(hits).alias("rendered"))
    priced = rendered.select("query_id", order, estimated_tokens(F.col("rendered")).alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    fitting = priced.withColumn("running", running).where(F.col("running") <= budget).select("query_id", order, "tokens")
    kept = rendered.join(fitting, ["query_id", order])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("rendered").alias("t")))), lambda x: x["t"])
    return kept.groupBy("query_id").agg(F.array_join(parts, RULE).alias("context"), F.count("*").alias("n_chunks"), F.sum("tokens").alias("n_tokens"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n---\n"), context, F.lit("\n---\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def system_prompt(confidence: Column, has_old: Column) -> Column:
    """Base rules, then one for thin evidence and one for old sources, numbered in turn."""
    rules = (
        "Use only the context that is given; nothing else counts as known.",
        "Read every chunk and report each relevant fact, figure and name.",
        "Do not invent facts; say so where the context is silent.",
        "Cite the document after each claim as [Source: title].",
        "Answer in the language of the question.",
        "Chunk headers name the author, project and date of their document; use them.",
        "Order the answer as a short report.",
        "Stay factual and professional.",
        "Write Markdown, without emojis.",
        "Prefer a complete answer to a short one.",
    )
    base = "You answer questions about documents.\n\n" + "\n".join(f"{k}. {r}" for k, r in enumerate(rules, 1))
    low = F.when(confidence == "low", "\n\nLOW CONFIDENCE\n11. Fewer than three good chunks were found. Begin with: \"Based on limited available information\".").otherwise("")
    number = F.when(confidence == "low", "12").otherwise("11")
    old = F.when(has_old, F.concat(F.lit("\n\nOLD DOCUMENTS\n"), number, F.lit(". Some sources are over a year old. Name their dates where time matters."))).otherwise("")
    return F.concat(F.lit(base), low, old)


def scope_note(users: Column, project: Column, start: Column, end: Column) -> Column:
    """The filters of a question in words; empty without filters. ``users`` is an array of names."""
    dates = (
        F.when(start.isNotNull() & end.isNotNull(), F.when(start == end, F.concat(F.lit("- Date: "), start.cast("string"))).otherwise(F.concat(F.lit("- Date range: "), start.cast("string"), F.lit(" to "), end.cast("string"))))
        .when(start.isNotNull(), F.concat(F.lit("- From: "), start.cast("string")))
        .when(end.isNotNull(), F.concat(F.lit("- Until: "), end.cast("string")))
    )
    lines = F.concat_ws("\n", F.when(F.size(users) > 0, F.concat(F.lit("- Users: "), F.array_join(users, ", "))), F.concat(F.lit("- Project: "), project), dates)
    return F.when(lines == "", "").otherwise(F.concat(F.lit("Search scope:\n"), lines))


def refusal(question: Column, nearest: Column) -> Column:
    """Said when nothing was found; ``nearest`` is the closest report date or null."""
    hint = F.when(nearest.isNotNull(), F.concat(F.lit(" The nearest report is dated "), nearest.cast("string"), F.lit("."))).otherwise("")
    burmese = F.concat(F.lit("ဆိုင်ရာ အချက်အလက် မတွေ့ပါ။"), F.when(nearest.isNotNull(), F.concat(F.lit(" "), nearest.cast("string"))).otherwise(""))
    return F.when(is_myanmar(question), burmese).otherwise(F.concat(F.lit("I could not find relevant information in the documents."), hint))


def nearest_date(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``query_id, nearest``: the report date closest to each target (query_id, target); ties to the earlier.

    Only distinct dates are compared, with the one before and the one after each target.
    """
    dates = documents.where("report_date IS NOT NULL").select(F.col("report_date").alias("d")).distinct()
    # distinct dates and targets of one year (some 700 rows at most) share a task; neighbours beyond it come from each year's first and last
    marks = dates.select(F.year("d").alias("y"), "d", F.lit(None).cast("boolean").alias("asked"))
    asked = targets.where("target IS NOT NULL").select(F.year("target").alias("y"), F.col("target").alias("d"), F.lit(True).alias("asked")).distinct()
    both = marks.unionByName(asked)
    w = Window.partitionBy("y").orderBy("d", F.col("asked").isNotNull().cast("int"))
    back = F.last(F.when(F.col("asked").isNull(), F.col("d")), True).over(w)
    ahead = F.first(F.when(F.col("asked").isNull(), F.col("d")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"back": back, "ahead": ahead}).where("asked")
    years = dates.groupBy(F.year("d").alias("yy")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))  # a row per year
    spans = years.agg(F.array_sort(F.collect_list(F.struct("yy", "lo", "hi"))).alias("spans"))
    full = near.join(F.broadcast(spans), how="cross")
    before = F.array_max(F.transform(F.filter("spans", lambda s: s["yy"] < F.col("y")), lambda s: s["hi"]))
    after = F.array_min(F.transform(F.filter("spans", lambda s: s["yy"] > F.col("y")), lambda s: s["lo"]))
    options = F.filter(F.array("back", "ahead", before, after), lambda d: d.isNotNull())
    best = F.array_min(F.transform(options, lambda d: F.struct(F.abs(F.datediff(d, F.col("d"))).alias("gap"), d.alias("at"))))
    return targets.join(full.select(F.col("d").alias("target"), best["at"].alias("nearest")), "target").select("query_id", "nearest")


def history(messages: DataFrame, skip: int = 1, take: int = 4) -> DataFrame:
    """``session_id, history``: the messages before the newest ``skip``, at most ``take``, oldest first."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    some = messages.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") > skip) & (F.col("_n") <= skip + take))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return some.groupBy("session_id").agg(F.array_join(lines, "\n").alias("history"))
