"""What a change log does to versions and kept answers, and what time does to kept rows; as streams and in batch."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docquarry.operators import cache

#: How long embeddings, answers and idle sessions are kept.
RETENTION = {"embeddings": "24 hours", "answers": "7 days", "sessions": "30 days"}


def expirations(touches: DataFrame, keep: str, key: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """``key, expired_at, touches``: each time a key was not touched for ``keep``.

    A row lives from its first touch until ``keep`` after its last. With ``late`` as a stream, in append mode: a row comes when the watermark
    passes its end. In batch, ends after the last touch of all are still open to the reader's clock.
    """
    timed = touches.withWatermark(ts, late) if late else touches
    return timed.groupBy(key, F.session_window(ts, keep).alias("w")).agg(F.count("*").alias("touches")).select(key, F.col("w.end").alias("expired_at"), "touches")


@dataclass
class AnswerState:
    """Versions of documents, the global version, and kept answers, below a folder; each change commits all of them at once."""

    spark: SparkSession
    root: str

    def _last(self) -> dict:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)), reverse=True) if fs.exists(path) else []
        for n in found:
            if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/number={n}/_SUCCESS")):
                return json.loads(self.spark.read.text(f"{self.root}/commits/number={n}").first()[0])
        return {"number": 0, "global": 1, "batch": -1, "schemas": {}}

    def _commit(self, last: dict, tables: dict[str, DataFrame], **more: object) -> None:
        n = last["number"] + 1
        schemas = {}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/number={n}")
            schemas[name] = json.loads(rows.schema.json())
        said = json.dumps({**last, **more, "number": n, "schemas": schemas})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/commits/number={n}")

    def _table(self, last: dict, name: str) -> DataFrame | None:
        if name not in last["schemas"]:
            return None
        return self.spark.read.schema(StructType.fromJson(last["schemas"][name])).parquet(f"{self.root}/{name}/number={last['number']}")

    def versions(self) -> DataFrame:
        """``doc_id, version`` of documents that ever changed; others have 1."""
        found = self._table(self._last(), "versions")
        return found if found is not None else self.spark.createDataFrame([], "doc_id string, version bigint")

    def global_version(self) -> int:
        return self._last()["global"]

    def entries(self) -> DataFrame | None:
        """The kept answers; null before the first."""
        return self._table(self._last(), "entries")

    def put(self, entries: DataFrame, now: F.Column, days: int = 7) -> None:
        """Keeps new answers (see ``operators.cache.put``)."""
        last = self._last()
        held = self._table(last, "entries")
        empty = entries.withColumns({"doc_versions": F.lit(None).cast("map<string,bigint>"), "created_at": now}).limit(0)
        self._commit(last, {"versions": self.versions(), "entries": cache.put(held if held is not None else empty, entries, self.versions(), now, days)})

    def change(self, changes: DataFrame, batch: int | None = None) -> None:
        """Counts changes (doc_id; null: of no document in particular) up and drops the answers that cite a changed document; one that names none drops all.

        A batch number not above the last one changes nothing.
        """
        last = self._last()
        if batch is not None and batch <= last["batch"]:
            return
        counts = changes.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("n"))
        both = self.versions().select("doc_id", (F.col("version") - 1).alias("n")).unionByName(counts)
        versions = both.groupBy("doc_id").agg((F.sum("n") + 1).alias("version"))
        unnamed = changes.where("doc_id IS NULL").count()
        held = self._table(last, "entries")
        tables = {"versions": versions} | ({"entries": cache.invalidate(held, changes.select(F.col("doc_id").cast("string").alias("doc_id")))} if held is not None else {})
        # the first change that names no document makes 1, which the global version is from the start
        total = last.get("unnamed", 0) + unnamed
        self._commit(last, tables, batch=last["batch"] if batch is None else batch, unnamed=total, **{"global": max(1, total)})

    def listen(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies a stream of changes, batch by batch."""
        return changes.writeStream.foreachBatch(lambda rows, number: self.change(rows, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
