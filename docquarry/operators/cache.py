"""Answers kept by question vector, with versions that make them stale; sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.vectors import cosine, norm


def model_hash(model: Column, temperature: Column, most_tokens: Column) -> Column:
    return F.md5(F.concat_ws("|", model, temperature.cast("string"), most_tokens.cast("string")))


def document_versions(changes: DataFrame) -> DataFrame:
    """``doc_id, version``: 1 when first seen, one more for each change."""
    return changes.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.count("*") + 1).alias("version"))


def global_version(changes: DataFrame) -> DataFrame:
    """One row: the number of changes that name no document, at least 1."""
    return changes.where("doc_id IS NULL").agg(F.greatest(F.count("*"), F.lit(1)).alias("version"))


def stale_entries(cache: DataFrame, versions: DataFrame) -> DataFrame:
    """``entry_id`` of entries that cite a document whose version is not the one they were made with.

    ``doc_versions`` maps documents to versions, ``doc_ids`` lists what is cited; a cited
    document without a kept version is stale. Entries without citations never are.
    """
    cited = cache.select("entry_id", "doc_versions", F.explode("doc_ids").alias("doc_id"))
    now = cited.join(versions, "doc_id", "left").withColumn("version", F.coalesce("version", F.lit(1)))
    kept = F.col("doc_versions")[F.col("doc_id")]
    return now.where(kept.isNull() | (kept != F.col("version"))).select("entry_id").distinct()


def cache_lookup(cache: DataFrame, queries: DataFrame, versions: DataFrame, now: Column, least: float = 0.95, newest: int = 200, days: int = 7) -> DataFrame:
    """``query_id, entry_id, similarity``: the closest live entry of each query, if similar enough.

    Entries are scoped by user (null matches null), model hash and global version; expired
    and stale ones are left out, and the ``newest`` of each scope are compared.
    """
    live = cache.where(F.col("created_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")).join(stale_entries(cache, versions), "entry_id", "left_anti")
    scope = F.hash("user_id", "model_hash", "version")
    order = Window.partitionBy("user_id", "model_hash", "version").orderBy(F.desc("created_at"), "entry_id")
    recent = live.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest).withColumns({"scope": scope, "v_norm": norm(F.col("query_vector"))})
    asked = queries.select("query_id", "query", F.col("user_id").alias("q_user"), F.col("model_hash").alias("q_model"), F.col("version").alias("q_version"), scope.alias("scope"), norm(F.col("query")).alias("q_norm"))
    same = F.col("user_id").eqNullSafe(F.col("q_user")) & F.col("model_hash").eqNullSafe(F.col("q_model")) & F.col("version").eqNullSafe(F.col("q_version"))
    pairs = recent.join(asked, "scope").where(same).where(F.size("query_vector") == F.size("query"))
    scored = pairs.withColumn("similarity", cosine(F.col("query_vector"), F.col("query"), F.col("v_norm"), F.col("q_norm"))).where(F.col("similarity") >= least)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("created_at"), "entry_id")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("query_id", "entry_id", "similarity")


def put(cache: DataFrame, entries: DataFrame, versions: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The cache with new entries (their cited documents' present versions kept with them), without expired rows of the same users."""
    cited = entries.select("entry_id", F.explode_outer("doc_ids").alias("doc_id")).join(versions, "doc_id", "left")
    kept = cited.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.coalesce("version", F.lit(1)))))).alias("doc_versions"))
    users = entries.select("user_id").distinct()
    expired = cache.where(F.col("created_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")).join(users, "user_id", "left_semi").select("entry_id")
    return cache.join(expired, "entry_id", "left_anti").unionByName(entries.join(kept, "entry_id").withColumn("created_at", now), allowMissingColumns=True)


def invalidate(cache: DataFrame, changes: DataFrame) -> DataFrame:
    """The cache without entries that cite a changed document; a change that names none empties it."""
    ids = changes.where("doc_id IS NOT NULL").select("doc_id").distinct()
    hit = cache.select("entry_id", F.explode("doc_ids").alias("doc_id")).join(ids, "doc_id", "left_semi").select("entry_id").distinct()
    flush = changes.where("doc_id IS NULL").limit(1).select(F.lit(1).alias("_all"))
    return cache.join(hit, "entry_id", "left_anti").join(F.broadcast(flush), F.lit(True), "left_anti")


def session_rollup(messages: DataFrame, with_messages: bool = True) -> DataFrame:
    """``session_id, message_count, last_activity_at, last_turn, title`` and, if asked, ``messages``: the title is the start of the first answer."""
    first = F.min_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    kept = [F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")] if with_messages else []
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("created_at").alias("last_activity_at"), F.max("turn").alias("last_turn"), F.substring(first, 1, 50).alias("title"), *kept)


def resolve_sessions(requests: DataFrame, sessions: DataFrame, now: Column, idle_hours: int = 24, most_messages: int = 100) -> DataFrame:
    """Requests (request_id, session_id, user_id) with ``state``: resumed, full, or new."""
    live = (F.col("s.user_id") == F.col("r.user_id")) & F.col("s.deleted_at").isNull() & (F.col("s.last_activity_at") >= now - F.expr(f"INTERVAL {int(idle_hours)} HOURS"))
    joined = requests.alias("r").join(sessions.alias("s"), F.col("r.session_id") == F.col("s.session_id"), "left")
    state = F.when(F.coalesce(live, F.lit(False)), F.when(F.col("s.message_count") >= most_messages, "full").otherwise("resumed")).otherwise("new")
    return joined.select("r.request_id", "r.user_id", F.when(state != "new", F.col("r.session_id")).alias("session_id"), state.alias("state"))


def expire_sessions(sessions: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Sessions with ``deleted_at`` set on those idle for over ``days``."""
    idle = F.col("last_activity_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")
    return sessions.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & idle, now).otherwise(F.col("deleted_at")))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages with ``deleted_at`` set on those of ``gone`` (session_id); what was deleted before keeps its time."""
    ids = gone.select("session_id").distinct().withColumn("gone_now", F.lit(True))
    mark = lambda rows: rows.join(ids, "session_id", "left").withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & F.col("gone_now"), now).otherwise(F.col("deleted_at"))).drop("gone_now")
    return mark(sessions), mark(messages)


def may_use_cache(message_count: Column, enabled: bool = True) -> Column:
    """Whether a question may be answered from the cache: only the first of a session."""
    return F.lit(enabled) & (F.coalesce(message_count, F.lit(0)) <= 1)


def inherit_filters(messages: DataFrame) -> DataFrame:
    """User messages (session_id, turn, user_names, project, date_from, date_to, refused) with filters
    they lack taken from the session's user message before; dates only if the answer to that was no refusal."""
    before = Window.partitionBy("session_id").orderBy("turn")
    lacks = F.col("user_names").isNull() & F.col("project").isNull()
    told = ~F.coalesce(F.lag("refused").over(before), F.lit(False))
    return messages.withColumns({
        "user_names": F.when(lacks, F.lag("user_names").over(before)).otherwise(F.col("user_names")),
        "project": F.when(lacks, F.lag("project").over(before)).otherwise(F.col("project")),
        "date_from": F.when(lacks & F.col("date_from").isNull() & told, F.lag("date_from").over(before)).otherwise(F.col("date_from")),
        "date_to": F.when(lacks & F.col("date_to").isNull() & told, F.lag("date_to").over(before)).otherwise(F.col("date_to")),
    })


def inherit(filters: DataFrame) -> DataFrame:
    """``query_id`` and filters of questions, completed from the question before (old_*), whose answer cited documents or was refused.

    Only questions that name nobody and no project inherit: names and project, and unless the answer was a refusal the dates they lack and the
    documents cited.
    """
    lacks = F.col("user_names").isNull() & F.col("project").isNull() & (F.col("old_user_names").isNotNull() | F.col("old_project").isNotNull() | F.col("old_date_from").isNotNull() | (F.size("cited") > 0))
    told = lacks & ~F.coalesce("refused", F.lit(False))
    dates = told & F.col("date_from").isNull()
    return filters.select(
        "query_id", F.when(lacks, F.col("old_user_names")).otherwise(F.col("user_names")).alias("user_names"), F.when(lacks, F.col("old_project")).otherwise(F.col("project")).alias("project"),
        F.when(dates, F.col("old_date_from")).otherwise(F.col("date_from")).alias("date_from"), F.when(dates, F.col("old_date_to")).otherwise(F.col("date_to")).alias("date_to"),
        F.when(told & (F.size("cited") > 0), F.col("cited")).alias("doc_ids"),
    )
