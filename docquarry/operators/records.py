"""Plain relational operations on documents, vectors and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.questions import classify, expand_synonyms
from docquarry.functions.text import like_pattern
from docquarry.sources.workspace import staged

#: Columns a document list may be sorted by, and columns an update may set.
SORT_KEYS = ("created_at", "title", "report_date", "project", "status", "file_size", "chunks_count", "last_activity_at")
UPDATE_KEYS = ("title", "description", "report_date", "project")
#: Needles that every text is searched for one by one, and first letters of needles that are put into the scan of the texts.
FEW_NEEDLES, LISTED_GRAMS = 200, 2_000


def store_stats(vectors: DataFrame, *by: str) -> DataFrame:
    return vectors.groupBy(*by).agg(F.count("*").alias("n")) if by else vectors.agg(F.count("*").alias("n"))


def page(rows: DataFrame, number: int, per_page: int, sort: str, descending: bool = True, tie: str = "doc_id", allowed: tuple[str, ...] = SORT_KEYS) -> tuple[DataFrame, dict]:
    """A page of a sorted list, and its total, last page, from and to. At most 100 rows a page."""
    if sort not in allowed:
        sort, descending = "created_at", True
    per_page, number = min(max(per_page, 1), 100), max(number, 1)
    total = rows.count()
    start = (number - 1) * per_page
    order = F.desc(sort) if descending else F.asc(sort)
    top = rows.orderBy(order, tie).offset(start).limit(per_page)
    return top, {"total": total, "last_page": max(1, -(-total // per_page)), "from": start + 1 if start < total else None, "to": min(start + per_page, total) if start < total else None}


def search_names(documents: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle, in any case, in one of the columns; its wildcards are plain characters."""
    pattern = like_pattern(needle)
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).ilike(pattern)
    return documents.where(test)


def report_date_filter(column: str, option: str) -> Column:
    """``a:b`` is a range, ``YYYY-MM`` a month, anything else a day."""
    if ":" in option:
        low, high = option.split(":", 1)
        return F.col(column).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    if len(option) == 7:
        year, month = option.split("-")
        return (F.year(column) == int(year)) & (F.month(column) == int(month))
    return F.col(column) == F.lit(option).cast("date")


def documents_missing_vectors(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with a chunk that has no vector."""
    lacking = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("doc_id")
    return documents.join(lacking, "doc_id", "left_semi")


def documents_of_other_model(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Documents with a chunk whose vector is missing or of another model."""
    old = chunks.join(vectors.select("chunk_id", "model_name"), "chunk_id", "left").where(F.col("model_name").isNull() | (F.col("model_name") != model)).select("doc_id")
    return documents.join(old, "doc_id", "left_semi")


def reembed_selection(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str, missing: bool = False, old_model: bool = False, status: str | None = None, project: str | None = None, report_date: str | None = None) -> DataFrame:
    """Documents to embed again: all conditions asked for must hold. Without ``missing`` and ``old_model``, those with chunks."""
    found = documents
    if missing:
        found = documents_missing_vectors(found, chunks, vectors)
    if old_model:
        found = documents_of_other_model(found, chunks, vectors, model)
    if not (missing or old_model):
        found = found.join(chunks.select("doc_id"), "doc_id", "left_semi")
    for column, value in (("status", status), ("project", project)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found if report_date is None else found.where(report_date_filter("report_date", report_date))


def repair_selection(first: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, scanned: int = 1000, most: int = 200) -> DataFrame:
    """At most ``most`` documents without any vector: of those named in ``first`` (doc_id), which go before the others,
    and of the ``scanned`` completed ones with the least ids."""
    wanted = documents.join(first.select("doc_id").distinct().withColumn("turn", F.lit(0)), "doc_id")
    others = documents.where("status = 'completed'").orderBy("doc_id").limit(scanned).withColumn("turn", F.lit(1))
    both = wanted.unionByName(others).groupBy("doc_id").agg(F.min("turn").alias("turn"))
    held = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi").select("doc_id")
    return both.join(held, "doc_id", "left_anti").orderBy("turn", "doc_id").limit(most).select("doc_id")


def of_other_length(rows: DataFrame, column: str, length: int) -> DataFrame:
    """Rows whose value is not ``length`` characters long; nulls are left out."""
    return rows.where(F.char_length(column) != length)


def active(rows: DataFrame, flag: str = "active") -> DataFrame:
    """Rows whose flag is set; a null flag is not."""
    return rows.where(F.coalesce(F.col(flag), F.lit(False)))


def child_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_count"))
    return documents.join(counted, "doc_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0)))


def embedding_gaps(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_id, expected, missing``: chunks of each document and those without a vector."""
    marked = chunks.join(vectors.select("chunk_id", F.lit(1).alias("has")).distinct(), "chunk_id", "left")
    return marked.groupBy("doc_id").agg(F.count("*").alias("expected"), F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).alias("missing"))


def single_model(rows: DataFrame, scope: str, model: str) -> DataFrame:
    """Scopes with exactly one model, and that model."""
    return rows.groupBy(scope).agg(F.count_distinct(model).alias("n"), F.min(model).alias(model)).where("n = 1").select(scope, model)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: bool = True, order: list[str] | None = None) -> DataFrame:
    """Rows by natural key: ``source`` replaces what is there, or (update=False) only adds.

    Of rows of ``source`` with one key that with the greatest ``order`` counts, then (or without it) with the greatest other values, in the order of the columns.
    """
    last = [F.desc_nulls_last(c) for c in [*(order or []), *[c for c in source.columns if c not in keys and c not in (order or [])]]]
    newest = source.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(last or [F.lit(0)])))).where("_n = 1").drop("_n")
    if update:
        return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest)
    return target.unionByName(newest.join(target.select(*keys), keys, "left_anti"))


def sorted_rows(rows: DataFrame, keys: list[tuple[str, str]], place: str | None = None) -> DataFrame:
    """Rows by several keys (column, "asc" or "desc"); nulls come first in rising and last in falling order.

    ``place`` names a column for the place of each row, which puts all rows in one task: for tables of settings.
    """
    order = [F.asc(c) if way == "asc" else F.desc(c) for c, way in keys]
    return rows.orderBy(*order) if place is None else rows.withColumn(place, F.row_number().over(Window.orderBy(*order)))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def purge_user(user_id: object, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, sessions: DataFrame, cache: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to a user."""
    gone = documents.where(F.col("user_id") == user_id)
    lost = chunks.join(gone.select("doc_id"), "doc_id", "left_semi")
    keep = ~F.col("user_id").eqNullSafe(F.lit(user_id))
    return {"documents": documents.where(keep), "chunks": without(chunks, gone, "doc_id"), "vectors": without(vectors, lost, "chunk_id"), "sessions": sessions.where(keep), "cache": cache.where(keep)}


def delete_by_path(documents: DataFrame, chunks: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    gone = documents.where(F.col("file_path").startswith(prefix))
    return documents.where(~F.coalesce(F.col("file_path").startswith(prefix), F.lit(False))), without(chunks, gone, "doc_id")


def update_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents with the allowed columns of ``changes`` (doc_id and new values; null leaves the old)."""
    held = [c for c in changes.columns if c in UPDATE_KEYS]
    new = changes.select("doc_id", *[F.col(c).alias(f"_new_{c}") for c in held])
    return documents.join(new, "doc_id", "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in held}).drop(*[f"_new_{c}" for c in held])


def status_of(jobs: DataFrame) -> DataFrame:
    """``doc_id, status, attempts`` from a job log (doc_id, at, event: queued, started, done, failed)."""
    last = F.max_by("event", F.struct("at", "event"))
    state = F.when(last == "done", "completed").when(last == "failed", "failed").when(last == "started", "processing").otherwise("pending")
    return jobs.groupBy("doc_id").agg(state.alias("status"), F.sum(F.when(F.col("event") == "started", 1).otherwise(0)).alias("attempts"))


def _first_grams(text: Column, listed: list[str] | None) -> Column:
    """The distinct runs of one to three letters of a text, of ``listed`` ones only if they are given; in time linear in its length."""

    def grams(letters: Column) -> Column:
        at = lambda i, k: F.coalesce(F.get(letters, i + k), F.lit(""))
        runs = lambda c, i: F.array(c, F.concat(c, at(i, 1)), F.concat(c, at(i, 1), at(i, 2)))
        return F.flatten(F.transform(letters, runs))

    found = F.transform(F.array(F.split(text, "")), grams)[0]
    return F.array_distinct(found) if listed is None else F.array_intersect(found, F.array(*[F.lit(g) for g in listed]))


def containing(questions: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs of ``questions`` (query_id, q) and ``needles`` (needle, not empty) with the needle anywhere in q.

    Up to FEW_NEEDLES go to the questions as they are. More are met by their first three letters (or all, if fewer): only ids and letters
    are dealt out for that, and a text is read again once for each needle that it may hold.
    """
    needles = staged(needles, "needles")
    asked = questions.where("q <> ''").select("query_id", "q")
    if needles.limit(FEW_NEEDLES + 1).count() <= FEW_NEEDLES:
        return asked.join(F.broadcast(needles), F.contains("q", "needle"))
    first = F.substring("needle", 1, 3)
    listed = [r[0] for r in needles.select(first).distinct().limit(LISTED_GRAMS + 1).collect()]
    grams = asked.select("query_id", F.explode(_first_grams(F.col("q"), listed if len(listed) <= LISTED_GRAMS else None)).alias("gram"))
    may = grams.join(needles.withColumn("gram", first), "gram").drop("gram").distinct()
    return asked.join(may, "query_id").where(F.contains("q", "needle"))


def match_names(questions: DataFrame, names: DataFrame, label: str = "name") -> DataFrame:
    """``query_id, <label>`` for each name that a question contains anywhere, in any case; a trailing ``(...)`` of a name may be absent."""
    base = F.regexp_replace(F.col(label), r"\s*\([^)]*\)$", "")
    forms = names.where(F.length(F.trim(label)) > 0).select(label, F.explode(F.array_distinct(F.array(F.col(label), base))).alias("form")).where("form <> ''")
    found = containing(questions.select("query_id", F.lower("question").alias("q")), forms.select(label, F.lower("form").alias("needle")))
    return found.select("query_id", label).distinct()


def longest_match(matches: DataFrame, label: str = "name") -> DataFrame:
    """The longest name of each query (ties to the lesser)."""
    return matches.groupBy("query_id").agg(F.min_by(label, F.struct(-F.length(label), F.col(label))).alias(label))


def expand_aliases(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Questions (query_id, question) with the canonical words of contained aliases added where absent.

    ``aliases``: alias, canonical, active. An alias may stand anywhere in the question, inside a word too.
    """
    live = aliases.where("active").select(F.lower("alias").alias("needle"), "canonical").where("needle <> ''")
    found = containing(questions.select("query_id", F.lower("question").alias("q")), live).where(~F.contains(F.col("q"), F.lower("canonical")))
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_set("canonical")).alias("more"))
    return questions.join(found, "query_id", "left").withColumn("expanded", F.concat_ws(" ", F.col("question"), F.array_join("more", " "))).drop("more")


def query_variants(questions: DataFrame, aliases: DataFrame, everywhere: bool = False) -> DataFrame:
    """``query_id, variant, question``: the question first, then its form with aliases, then that with synonyms.

    Comparative and analytical questions get variants, others only with ``everywhere``; a variant that says nothing new is left out.
    """
    wide = F.lit(True) if everywhere else classify(F.col("question")).isin("comparative", "analytical")
    told = expand_aliases(questions.select("query_id", "question"), aliases)
    forms = F.array(F.col("question"), F.when(wide, F.col("expanded")), F.when(wide, expand_synonyms(F.col("expanded"))))
    said = F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))
    return told.select("query_id", F.posexplode(said).alias("variant", "question"))


def alias_terms(query_terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Terms (query_id, term) and the canonical terms of those that are aliases: an OR group each."""
    live = aliases.where("active").select(F.lower("alias").alias("word"), F.lower("canonical").alias("canonical"))
    joined = query_terms.withColumn("word", F.lower("term")).join(live, "word", "left")
    return joined.groupBy("query_id", "term").agg(F.array_sort(F.collect_set("canonical")).alias("also"))


def alias_map(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, also``: a map from the words of questions (in lower case) that are aliases to their canonical words; the least of several."""
    words = questions.select("query_id", F.explode(F.array_distinct(F.split(F.lower("question"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    live = aliases.where("active").select(F.lower("alias").alias("word"), "canonical").groupBy("word").agg(F.min("canonical").alias("canonical"))
    return words.join(live, "word").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("also"))
