"""Documents with their chunks and vectors, replaced and deleted together.

Documents are dealt to buckets by id. A change writes the touched buckets of all tables anew, below a number of its own, and
then one manifest that names them: readers see the old rows or the new ones, and what a killed job left is never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.operators.retrieval import filters
from docquarry.operators.vector_scan import best_of, blocks_of

TABLES = ("documents", "chunks", "vectors")


@dataclass
class DocumentStore:
    """Tables ``documents`` (doc_id), ``chunks`` (doc_id, chunk_id) and ``vectors`` (doc_id, chunk_id, embedding) below a folder."""

    spark: SparkSession
    root: str
    buckets: int = 16

    def _path(self, *parts: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self) -> dict:
        """The last one committed: its version, the data number of each table and bucket, schemas, and the last batch of each source."""
        found = sorted((int(n.split("=")[1]) for n in self._names("manifest") if n.startswith("version=")), reverse=True)
        for version in found:
            if "_SUCCESS" in self._names("manifest", f"version={version}"):
                return json.loads(self.spark.read.text(f"{self.root}/manifest/version={version}").first()[0])
        return {"version": 0, "data": {t: {} for t in TABLES}, "schemas": {}, "batches": {}, "buckets": self.buckets}

    def _next(self) -> int:
        """A number that no manifest and no data has, also of jobs that never ended."""
        used = [n.split("=")[1] for parts in (("manifest",), *((t,) for t in TABLES)) for n in self._names(*parts) if "=" in n]
        return 1 + max(map(int, used), default=0)

    def table(self, name: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The committed rows, of some buckets only if they are given."""
        manifest = manifest or self.manifest()
        if name not in manifest["schemas"]:
            return self.spark.createDataFrame([], "doc_id long")
        schema = StructType.fromJson(manifest["schemas"][name])
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.root}/{name}/data={n}/bucket={b}" for b, n in manifest["data"][name].items() if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).select(*schema.names)

    def replace(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """These documents with these chunks and vectors in place of whatever the store has of them; the version committed.

        Rows of chunks and vectors count if their doc_id is among ``documents``. A ``batch`` (source, number) that was
        committed before changes nothing. All tables change in one commit; of two writers at once one fails.
        """
        ids = documents.select("doc_id").distinct()
        keep = lambda rows: rows.join(ids, "doc_id", "left_semi")
        lengths = vectors if "dimensions" in vectors.columns else vectors.withColumn("dimensions", F.size("embedding"))
        return self._commit(ids, {"documents": documents, "chunks": keep(chunks), "vectors": keep(lengths)}, batch)

    def delete(self, gone: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Takes documents (doc_id), their chunks and their vectors out of all tables."""
        return self._commit(gone.select("doc_id").distinct(), {}, batch)

    def delete_by_path(self, prefix: str) -> int:
        """Takes out the documents whose ``file_path`` begins so."""
        return self.delete(self.table("documents").where(F.col("file_path").startswith(prefix)))

    def _commit(self, ids: DataFrame, new: dict[str, DataFrame], batch: tuple[str, int] | None) -> int:
        before = self.manifest()
        if batch is not None and before["batches"].get(batch[0], -1) >= batch[1]:
            return before["version"]
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(before["buckets"])).cast("int")
        touched = [r[0] for r in ids.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets
        number = self._next()
        after = {**before, "version": number, "data": {t: {b: n for b, n in before["data"][t].items() if int(b) not in touched} for t in TABLES}}
        for name in TABLES:
            rows = new.get(name)
            if name in before["schemas"]:
                kept = self.table(name, touched, before).join(ids, "doc_id", "left_anti")
                rows = kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
            if rows is None:
                continue
            by = ["bucket", "dimensions"] if name == "vectors" else ["bucket"]
            rows.withColumn("bucket", bucket).repartitionByRange(*by, "doc_id").write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/data={number}")
            after["schemas"] = {**after["schemas"], name: json.loads(rows.schema.json())}
            after["data"][name] |= {n.split("=")[1]: number for n in self._names(name, f"data={number}") if n.startswith("bucket=")}
        if batch is not None:
            after["batches"] = {**before["batches"], batch[0]: batch[1]}
        self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1).write.mode("error").text(f"{self.root}/manifest/version={number}")
        return number

    def vacuum(self) -> None:
        """Removes what the last manifest does not name: old versions, and the leavings of jobs that never ended. No job may be under way."""
        held = self.manifest()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in TABLES:
            for number in [n.split("=")[1] for n in self._names(name) if n.startswith("data=")]:
                for bucket in self._names(name, f"data={number}"):
                    if held["data"][name].get(bucket.partition("=")[2]) != int(number):
                        path = self._path(name, f"data={number}", bucket)
                        path.getFileSystem(conf).delete(path, True)

    def joined(self, lengths: list[int] | None = None, where: Column | None = None) -> DataFrame:
        """Vectors (of some lengths only) with their chunk and their document, without deleted documents."""
        held = self.manifest()
        rows = self.table("vectors", manifest=held)
        if lengths is not None:
            rows = rows.where(F.col("dimensions").isin(lengths))
        chunks, documents = self.table("chunks", manifest=held), self.table("documents", manifest=held)
        live = documents.where("deleted_at IS NULL") if "deleted_at" in documents.columns else documents
        more = live.select("doc_id", *[c for c in live.columns if c not in rows.columns and c not in chunks.columns])
        full = rows.join(chunks.drop("doc_id", *[c for c in chunks.columns if c in rows.columns and c not in ("chunk_id", "doc_id")]), "chunk_id").join(more, "doc_id")
        return full if where is None else full.where(where)

    def search(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        """``query_id, rank, chunk_id, score``: the k best chunks of each query (query_id, query; own filters ``wanted``).

        Vectors, chunks and documents are joined in one plan, and only vectors of the queries' lengths are read.
        """
        blocks = blocks_of(queries)
        rows = self.joined(sorted({d for b in blocks for d in b.units}), filters(where or {}))
        return best_of(rows.withColumn("v", F.col("embedding")), blocks, queries, k, "chunk_id", rows.columns)

    def stats(self, *by: str) -> DataFrame:
        """Vectors in all, or by columns such as dimensions and model_name."""
        rows = self.table("vectors")
        return rows.groupBy(*by).agg(F.count("*").alias("n")) if by else rows.agg(F.count("*").alias("n"))
