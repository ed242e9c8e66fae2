"""The public API: documents in, answers with citations out.

Every step is a DataFrame keyed by ``query_id``, so one question and a
million share one plan. What questions compile to and what a search finds are small tables that are written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import questions as q
from docquarry.functions.text import estimated_tokens
from docquarry.operators import cache, chunking, context, embedding, ranking, records, retrieval, textsearch
from docquarry.operators.embedding import EmbeddingProvider, HashingProvider
from docquarry.operators.vector_index import VectorIndex
from docquarry.sources.workspace import staged


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    threshold: float = 0.65
    filtered_threshold: float = 0.45
    floor: float = 0.20
    rrf_constant: int = 60
    over_fetch: int = 3
    mmr_weight: float = 0.7
    chunk_size: int = 1000
    chunk_overlap: int = 200
    context_tokens: int = 32768
    mode: str = "hybrid"  # or vector, or fts
    rerank: bool = False
    variants: bool = False
    stem: bool = False
    complex_from: int = 3
    history: int = 4
    cache_days: int = 7

    def overlay(self, values: dict[str, object]) -> Settings:
        """These settings with those of ``values`` that are known and not null, in the type of the default."""
        known = {f.name: type(f.default) for f in fields(self)}
        return replace(self, **{k: known[k](v) for k, v in values.items() if k in known and v is not None})


class AnswerProvider(Protocol):
    """``answer`` adds ``answer`` to prompts (query_id, system, prompt, context); ``finish_reason`` too, if it knows one."""

    name: str

    def answer(self, prompts: DataFrame) -> DataFrame: ...


class ExtractiveAnswer:
    """Returns the packed context: the deterministic default."""

    name = "extractive"

    def answer(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("answer", F.col("context"))


_ANSWERERS: dict[str, Callable[..., AnswerProvider]] = {"extractive": ExtractiveAnswer}


def register_answerer(name: str, make: Callable[..., AnswerProvider]) -> None:
    _ANSWERERS[name] = make


def answerer_for(name: str, **options: object) -> AnswerProvider:
    """The answer provider registered under a name; an unknown name is an error."""
    if name not in _ANSWERERS:
        raise ValueError(f"{name} is not a known answer provider")
    return _ANSWERERS[name](**options)


@dataclass
class Memory:
    """What a conversation brings to its next question.

    ``messages``: session_id, turn, role, text, cited (document ids, null or empty for a refusal). ``entries`` and ``versions``: the answer
    cache and the documents' versions (see ``operators.cache``), with entries' ``answer`` to give again.
    """

    messages: DataFrame | None = None
    entries: DataFrame | None = None
    versions: DataFrame | None = None


@dataclass
class Engine:
    chunks: DataFrame  # chunk_id, doc_id, content, embedding, and what filters name
    provider: EmbeddingProvider = field(default_factory=HashingProvider)
    settings: Settings = field(default_factory=Settings)
    reranker: ranking.Reranker = field(default_factory=ranking.OverlapReranker)
    llm: AnswerProvider = field(default_factory=ExtractiveAnswer)
    aliases: DataFrame | None = None  # alias, canonical, active
    index: VectorIndex | None = None  # of the chunks, by chunk_id; the exact scan without it

    @staticmethod
    def ingest(documents: DataFrame, provider: EmbeddingProvider | None = None, settings: Settings | None = None) -> DataFrame:
        """Chunks with vectors of ``documents`` (doc_id, text, title, user_name, project, report_date, created_at; user_id if there)."""
        settings, provider = settings or Settings(), provider or HashingProvider()
        cut = chunking.chunk_sections(documents, settings.chunk_size, settings.chunk_overlap)
        chunks = chunking.with_header(cut, documents)
        empty = chunks.sparkSession.createDataFrame([], "key string, embedding array<double>")
        return embedding.embed_cached(chunks, empty, provider)[0]

    def _live(self) -> DataFrame:
        return self.chunks.where("deleted_at IS NULL") if "deleted_at" in self.chunks.columns else self.chunks

    def own_filters(self, said: DataFrame, today: F.Column) -> DataFrame:
        """``query_id, user_names, project, date_from, date_to``: the names, the project and the dates that questions (query_id, question) hold."""
        found = said.select("query_id", q.date_range(F.col("question"), today).alias("d")).select("query_id", F.col("d.from").alias("date_from"), F.col("d.to").alias("date_to"))
        none = found.select("query_id", F.lit(None).cast("array<string>").alias("user_names"), F.lit(None).cast("string").alias("project")).limit(0)
        held = self._live()
        users, projects = none.select("query_id", "user_names"), none.select("query_id", "project")
        if "user_name" in held.columns:
            named = records.match_names(said, held.where("user_name IS NOT NULL").select(F.col("user_name").alias("name")).distinct())
            users = named.groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("user_names"))
        if "project" in held.columns:
            named = records.match_names(said, held.where("project IS NOT NULL").select("project").distinct(), "project")
            projects = records.longest_match(named, "project")
        return found.join(users, "query_id", "left").join(projects, "query_id", "left").select("query_id", "user_names", "project", "date_from", "date_to")

    def _wanted(self, asked: DataFrame, today: F.Column, memory: Memory) -> DataFrame:
        """``query_id, wanted``: questions' own filters; those of a session that name nobody and no project take them from its last question.

        Dates are taken too unless the last answer was a refusal, and then only the documents that it cited are searched.
        """
        said = asked.select("query_id", "question")
        doc_id = self.chunks.schema["doc_id"].dataType.simpleString()
        nothing = F.lit(None).cast(f"array<{doc_id}>")
        if memory.messages is None or "session_id" not in asked.columns:
            own = self.own_filters(said, today).withColumn("doc_ids", nothing)
        else:
            talk = memory.messages.join(asked.select("session_id").distinct(), "session_id", "left_semi")
            last = talk.groupBy("session_id").agg(
                F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("text"),
                F.max_by(F.when(F.col("role") == "assistant", F.coalesce("cited", nothing)), F.when(F.col("role") == "assistant", F.col("turn"))).alias("cited"),
                F.max(F.when(F.col("role") == "assistant", F.lit(True))).alias("told"),
            )
            before = asked.join(last, "session_id").where("text IS NOT NULL").select(F.struct("query_id", F.lit(True).alias("before")).alias("query_id"), F.col("text").alias("question"))
            now = said.select(F.struct("query_id", F.lit(False).alias("before")).alias("query_id"), "question")
            both = self.own_filters(now.unionByName(before), today)
            mine = both.where("NOT query_id.before").select("query_id.query_id", "user_names", "project", "date_from", "date_to")
            old = both.where("query_id.before").select(F.col("query_id.query_id").alias("query_id"), *[F.col(c).alias(f"old_{c}") for c in ("user_names", "project", "date_from", "date_to")])
            cited = asked.join(last, "session_id").select("query_id", "cited", (F.coalesce("told", F.lit(False)) & (F.coalesce(F.size("cited"), F.lit(0)) <= 0)).alias("refused"))
            own = cache.inherit(mine.join(old, "query_id", "left").join(cited, "query_id", "left"))
        return own.select("query_id", F.struct("user_names", "project", "date_from", "date_to", "doc_ids").alias("wanted"))

    def compile(self, asked: DataFrame, today: F.Column, memory: Memory | None = None) -> DataFrame:
        """Questions (query_id, question; session_id if there) with all that a search needs, written once:
        type, complexity, rewrite, terms, searches, embedding_text, wanted (own filters) and ``problem`` (null for a good question)."""
        told = asked.withColumn("question", q.fix_spelling(q.normalise(F.col("question"))))
        wanted = self._wanted(told, today, memory or Memory())
        full = told.join(wanted, "query_id", "left")
        if self.aliases is not None:
            full = full.join(records.expand_aliases(told.select("query_id", "question"), self.aliases).select("query_id", "expanded"), "query_id", "left")
            full = full.join(records.alias_map(told.select("query_id", "question"), self.aliases), "query_id", "left")
        else:
            full = full.withColumns({"expanded": F.col("question"), "also": F.lit(None).cast("map<string,string>")})
        said = full.withColumn("bare", q.without_names(F.col("question"), F.col("wanted.user_names"), F.col("wanted.project")))
        named = said.withColumns({
            "problem": F.when(F.coalesce(F.col("question"), F.lit("")) == "", "empty question"), "type": q.classify(F.col("question")), "complexity": q.complexity(F.col("question")), "terms": q.asked_terms(F.col("bare"), F.col("question")),
            "embedding_text": q.expand_synonyms(q.resolve_times(F.col("expanded"), today)),
        })
        ready = named.withColumns({"rewrite": F.when(F.col("complexity") >= self.settings.complex_from, "complex").otherwise("simple"), "searches": q.search_groups(F.col("terms"), F.col("question"), F.col("also"))})
        return staged(ready.drop("bare", "expanded", "also"), "questions")

    def search(self, asked: DataFrame, today: F.Column, where: dict | None = None, owner: str | int | None = None, memory: Memory | None = None) -> DataFrame:
        """``query_id, rank, chunk_id, score`` and the chunk's columns.

        Deleted chunks never show, and with ``owner`` only the owner's do. All filters of ``where`` hold for every question; a question's own
        ones hold for it unless ``where`` says the same. A model name holds for the vector leg.
        """
        return self._search(self.compile(asked, today, memory), where, owner)

    def _scoped(self, compiled: DataFrame, where: dict) -> DataFrame:
        """``query_id, wanted`` without what the caller's filters decide."""
        drop = set()
        drop |= {"user_names"} if where.get("user_ids") else set()
        drop |= {"project"} if where.get("project") is not None else set()
        drop |= {"doc_ids"} if where.get("document_ids") else set()
        drop |= {"date_from", "date_to"} if any(where.get(k) is not None for k in ("report_date_from", "report_date_to")) else set()
        kept = [(F.lit(None).cast(f.dataType) if f.name in drop else F.col(f"wanted.{f.name}")).alias(f.name) for f in compiled.schema["wanted"].dataType.fields]
        return compiled.select("query_id", F.struct(*kept).alias("wanted"))

    def _search(self, compiled: DataFrame, where: dict | None, owner: str | int | None) -> DataFrame:
        s = self.settings
        where = {**(where or {}), **({"user_ids": [owner]} if owner is not None else {})}
        compiled = compiled.where("problem IS NULL")
        scoped = self._scoped(compiled, where)
        fetch, leg = s.top_k * s.over_fetch, s.top_k * s.over_fetch * s.over_fetch
        live = self._live()
        pool, vector_where = live.where(retrieval.filters(where, vector_leg=False)), retrieval.filters(where)
        compiled = compiled.withColumn("mode", F.lit("hybrid") if s.mode == "hybrid" else F.when(F.col("type") == "factual", "hybrid").otherwise(s.mode))  # names and figures need both legs

        keyed = compiled.where("mode <> 'fts'").select("query_id", F.col("embedding_text").alias("text"))
        if s.variants:
            forms = records.query_variants(compiled.select("query_id", F.col("embedding_text").alias("question")), self._aliases())
            keyed = forms.join(keyed.select("query_id"), "query_id", "left_semi").select("query_id", "variant", F.col("question").alias("text"))
        else:
            keyed = keyed.withColumn("variant", F.lit(0))
        keyed = keyed.withColumn("key", F.xxhash64("query_id", "variant").cast("string"))
        asked = embedding.embed(keyed, self.provider).join(keyed, "key").join(scoped, "query_id").select(F.struct("query_id", "variant").alias("query_id"), F.col("embedding").alias("query"), "wanted")
        if self.index is not None:
            found = self.index.search(asked, leg, tie="chunk_id", where=vector_where)
        else:
            found = retrieval.vector_topk_batch(live.where(vector_where), asked, leg, tie="chunk_id")
        found = found.select("query_id.query_id", "query_id.variant", "rank", "chunk_id", "score").where(F.col("score") >= s.floor)
        by_vector = retrieval.merge_variants(found).drop("variant") if s.variants else found.drop("variant")

        groups = compiled.where("mode <> 'vector'").select("query_id", F.inline("searches"))
        by_text = textsearch.search_texts(pool, groups, leg, "chunk_id", "content", scoped, s.stem)
        if s.mode == "hybrid":
            hits = retrieval.fuse(by_vector, by_text, fetch, constant=s.rrf_constant)
        else:
            both = compiled.where("mode = 'hybrid'").select("query_id")
            fused = retrieval.fuse(by_vector.join(both, "query_id", "left_semi"), by_text.join(both, "query_id", "left_semi"), fetch, constant=s.rrf_constant)
            one = (by_vector if s.mode == "vector" else by_text).join(both, "query_id", "left_anti").where(F.col("rank") <= fetch)
            hits = fused.unionByName(one.select("query_id", "rank", "chunk_id", "score"))
        own = F.exists(F.array(*[F.col(f"wanted.{f.name}").isNotNull() for f in scoped.schema["wanted"].dataType.fields]), lambda x: x)
        bases = scoped.select("query_id", F.when(own | F.lit(bool(where)), s.filtered_threshold).otherwise(s.threshold).alias("base"))
        cut = ranking.elbow_cut(hits.join(bases, "query_id"), F.col("base"), 2 * s.top_k).drop("base")
        full = cut.join(pool.drop("embedding"), "chunk_id").join(compiled.select("query_id", "question"), "query_id")
        if s.rerank:
            full = ranking.rerank(full, self.reranker)
        return ranking.diversify(full, s.top_k, s.mmr_weight)

    def _aliases(self) -> DataFrame:
        return self.aliases if self.aliases is not None else self.chunks.sparkSession.createDataFrame([], "alias string, canonical string, active boolean")

    def _from_cache(self, compiled: DataFrame, memory: Memory, owner: str | int | None, now: F.Column) -> DataFrame | None:
        """``query_id, answer, similarity`` of questions that the cache answers: the first of their session, close to one answered before."""
        if memory.entries is None or memory.versions is None:
            return None
        first = compiled.where("problem IS NULL")
        if memory.messages is not None and "session_id" in compiled.columns:
            counts = memory.messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
            first = first.join(counts, "session_id", "left").where(cache.may_use_cache(F.col("message_count")))
        keyed = first.select("query_id", F.col("embedding_text").alias("text")).withColumn("key", F.xxhash64("query_id").cast("string"))
        user = F.lit(owner).cast(memory.entries.schema["user_id"].dataType)
        asked = embedding.embed(keyed, self.provider).join(keyed, "key").select("query_id", F.col("embedding").alias("query"), user.alias("user_id"), F.lit(self.llm.name).alias("model_hash"), F.lit(1).alias("version"))
        met = cache.cache_lookup(memory.entries, asked, memory.versions, now, days=self.settings.cache_days)
        return met.join(memory.entries.select("entry_id", F.col("answer").alias("kept_answer")), "entry_id").select("query_id", "kept_answer", "similarity")

    def ask(self, asked: DataFrame, today: F.Column, where: dict | None = None, owner: str | int | None = None, memory: Memory | None = None, now: F.Column | None = None) -> DataFrame:
        """One answer record for every question; a refusal, with the nearest report date, where nothing was found.

        ``query_id, question, answer, confidence, n_chunks, cached, rewrite, sources, model, finish_reason, prompt_tokens, answer_tokens``. Questions (query_id, question) may
        carry a session_id, for which ``memory`` gives history, inherited filters and kept answers. An empty question is refused.
        """
        return self._answer(asked, today, where, owner, memory or Memory(), now)[0]

    def _answer(self, asked: DataFrame, today: F.Column, where: dict | None, owner: str | int | None, memory: Memory, now: F.Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        compiled = self.compile(asked, today, memory)
        kept = self._from_cache(compiled, memory, owner, today.cast("timestamp") if now is None else now)
        kept = staged(kept, "kept-answers") if kept is not None else compiled.select("query_id", F.lit(None).cast("string").alias("kept_answer"), F.lit(None).cast("double").alias("similarity")).limit(0)
        open_questions = compiled.join(kept.select("query_id"), "query_id", "left_anti")
        hits = staged(self._search(open_questions, where, owner), "hits")  # at most top_k rows of each question
        titled = hits.withColumns({"document_title": F.col("metadata")["document_title"] if "metadata" in hits.columns else F.lit(None).cast("string"), "page_number": F.lit(None).cast("int")})
        packed = context.pack_context(ranking.edges_first(titled), self.settings.context_tokens, order="place")
        judged = ranking.confidence(hits).select("query_id", "confidence")
        facts = packed.join(judged, "query_id")
        if "created_at" in hits.columns:
            facts = facts.join(ranking.has_old_documents(hits, today), "query_id")
        else:
            facts = facts.withColumn("has_old", F.lit(False))
        told = compiled.join(facts, "query_id")
        note = context.scope_note(F.coalesce("wanted.user_names", F.array().cast("array<string>")), F.col("wanted.project"), F.col("wanted.date_from"), F.col("wanted.date_to"))
        question = F.col("question")
        if memory.messages is not None and "session_id" in compiled.columns:
            told = told.join(context.history(memory.messages, skip=0, take=self.settings.history), "session_id", "left")
            question = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit("Previous conversation:\n"), F.col("history"), F.lit("\n\nCurrent question: "), question)).otherwise(question)
        scoped = F.concat(F.when(note != "", F.concat(note, F.lit(context.RULE))).otherwise(""), F.col("context"))
        prompts = told.withColumns({"system": context.system_prompt(F.col("confidence"), F.col("has_old")), "prompt": context.prompt(scoped, question)})
        said = self.llm.answer(prompts)
        said = said if "finish_reason" in said.columns else said.withColumn("finish_reason", F.lit("stop"))
        cut = F.when(F.col("finish_reason") == "length", "\n\n*[The answer was cut at the token limit.]*").otherwise("")
        answered = said.select("query_id", F.concat("answer", cut).alias("said"), "confidence", "n_chunks", "finish_reason", estimated_tokens(F.concat("system", "prompt")).alias("prompt_tokens"))
        cited = ranking.citations(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "doc_id", "chunk_id", "score", "excerpt"))).alias("cited"))
        cited = cited.select("query_id", F.transform("cited", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["chunk_id"].alias("chunk_id"), x["score"].alias("score"), x["excerpt"].alias("excerpt"))).alias("sources"))
        full = compiled.join(answered, "query_id", "left").join(cited, "query_id", "left").join(kept, "query_id", "left")
        if "report_date" in self.chunks.columns:
            near = context.nearest_date(self._live().where(retrieval.filters({"user_ids": [owner]} if owner is not None else {})).select("report_date"), compiled.select("query_id", F.col("wanted.date_from").alias("target")))
            full = full.join(near, "query_id", "left")
        else:
            full = full.withColumn("nearest", F.lit(None).cast("date"))
        answer = F.coalesce("kept_answer", "said", context.refusal(F.col("question"), F.col("nearest")))
        cached = F.col("kept_answer").isNotNull()
        record = full.select(
            "query_id", "question", answer.alias("answer"), F.when(cached, "cached").otherwise(F.coalesce("confidence", F.lit("none"))).alias("confidence"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), cached.alias("cached"), "rewrite", "sources",
            F.lit(self.llm.name).alias("model"), F.when(F.col("said").isNull() & ~cached, "refusal").otherwise(F.coalesce("finish_reason", F.lit("stop"))).alias("finish_reason"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), estimated_tokens(answer).alias("answer_tokens"),
        )
        return record, compiled, hits

    def ask_stream(self, asked: DataFrame, today: F.Column, where: dict | None = None, owner: str | int | None = None, memory: Memory | None = None) -> Iterator[dict]:
        """Events of one answer, from one search: status, rewrite, cached or sources, text, done. One question only."""
        yield {"type": "status", "message": "searching"}
        record, compiled, hits = self._answer(asked.limit(1), today, where, owner, memory or Memory(), None)
        said = compiled.first()
        answer = record.first()
        if said is None:
            yield {"type": "done", "confidence": "none"}
            return
        yield {"type": "rewrite", "mode": said["rewrite"], "score": said["complexity"], "text": said["embedding_text"]}
        if answer["cached"]:
            yield {"type": "cached"}
        else:
            yield {"type": "sources", "sources": [r.asDict() for r in answer["sources"] or []]}
        for line in answer["answer"].splitlines(keepends=True):
            yield {"type": "chunk", "text": line}
        yield {"type": "done", "confidence": answer["confidence"]}
