"""A keyword index that is kept in step with changes: segments, tombstones, and merges of segments of like size.

A micro-batch of changes becomes one segment: the postings of its documents as they are now, and which documents it speaks
for. A document's newest segment holds; postings in older ones are dead. Whenever FAN segments of one size class are
there, they are merged and their dead postings go, so a document is rewritten about log(n) times.
"""

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.operators import keyword
from shotlake.operators.versions import Commits
from shotlake.sources.stages import keep

#: Segments of one size class that are merged, and the documents of the smallest class.
FAN, SMALLEST = 4, 1000
#: Bytes of text whose words a task counts at a time, and postings of a file: splits go by packed bytes, and postings pack well.
TEXT_BYTES, FILE_POSTS = 4_000_000, 250_000


class Segmented:
    """columns: the text columns with their weights, as in keyword.tokenised. The folder must be one that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, doc: str, kind: str, columns: dict[str, float], stemmed: bool = False, fan: int = FAN, smallest: int = SMALLEST):
        self.spark, self.folder, self.doc, self.columns, self.stemmed, self.fan, self.smallest = spark, folder.rstrip("/"), doc, columns, stemmed, fan, smallest
        self.docs_schema, self.posts_schema = f"doc {kind}, seq int, len int, gone boolean", f"doc {kind}, seq int, term string, tf double, in_first boolean"
        self.commits = Commits(spark, self.folder, "path string, docs long, oldest int, newest int")

    def _tier(self, docs: int) -> int:
        return max(0, math.ceil(math.log(max(1, docs) / self.smallest, self.fan)))

    def _tables(self, segments: list) -> tuple[DataFrame, DataFrame]:
        if not segments:
            return self.spark.createDataFrame([], self.docs_schema), self.spark.createDataFrame([], self.posts_schema)
        return tuple(self.spark.read.schema(s).parquet(*(f"{x[0]}/{name}" for x in segments)) for name, s in (("docs", self.docs_schema), ("posts", self.posts_schema)))

    def _newest(self, segments: list) -> tuple[DataFrame, DataFrame]:
        """Of these segments, the newest word on each document, and its postings."""
        docs, posts = self._tables(segments)
        last = docs.groupBy("doc").agg(F.max_by(F.struct("seq", "len", "gone"), "seq").alias("x")).select("doc", "x.*")
        # postings stream past the documents of their partition, without being sorted
        return last, posts.join(last.filter("NOT gone").select("doc", "seq").hint("shuffle_hash"), ["doc", "seq"], "left_semi")

    def _put(self, docs: DataFrame, posts: DataFrame, oldest: int, newest: int) -> tuple:
        path = f"{self.folder}/segments/{uuid.uuid4().hex}"
        docs.select("doc", "seq", "len", "gone").write.parquet(f"{path}/docs")
        posts.select("doc", "seq", "term", "tf", "in_first").write.option("maxRecordsPerFile", FILE_POSTS).parquet(f"{path}/posts")
        return path, self.spark.read.schema(self.docs_schema).parquet(f"{path}/docs").count(), oldest, newest

    def apply(self, changes: DataFrame, batch: int | None = None, deleted: str = "deleted", at: str = "at") -> int:
        """Takes in changes (the document, its text columns, whether it is deleted, when). Of several changes of a document the latest holds.

        A batch that was taken in before changes nothing, so a stream may hand it over again. An empty one adds no segment. Returns the version.
        """
        version, rows = self.commits.get()
        seq = version + 1 if batch is None else batch
        if seq <= version:
            return version
        segments = [tuple(r) for r in rows if r["path"]]
        counted = self._counted(changes, deleted, at)
        docs = counted.groupBy("doc").agg(F.sum("n").cast("int").alias("len"), F.max("gone").alias("gone")).withColumn("seq", F.lit(seq))
        new = self._put(docs, counted.filter("term IS NOT NULL").withColumn("seq", F.lit(seq)), seq, seq)
        segments += [new] if new[1] else []
        self.commits.put(seq, self._merged(segments) or [(None, 0, 0, 0)])
        return seq

    def _counted(self, changes: DataFrame, deleted: str, at: str) -> DataFrame:
        """A written stage (term, doc, tf, in_first, n, gone) of the latest change of each document; one without words, or gone, has a row with a null term.

        Texts are dealt by document into parts of about TEXT_BYTES, and each part's words are counted where it lies, so a task's memory does not grow with the batch.
        """
        size = changes.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in self.columns), F.lit(0)).cast("long"))).first()[0] or 0
        held = F.struct(*(F.col(c) for c in self.columns), F.coalesce(F.col(deleted), F.lit(False)).alias("gone"))
        rows = changes.select(F.col(self.doc).alias("doc"), held.alias("x"), F.col(at).alias("_at")).repartition(1 + size // TEXT_BYTES, "doc")
        last = rows.groupBy("doc").agg(F.max_by("x", "_at").alias("x")).select("doc", "x.*")
        words = last.select("doc", "gone", F.explode_outer(F.when(~F.col("gone"), keyword.terms(self.columns, self.stemmed))).alias("t")).select("doc", "gone", "t.*")
        return keep(words.groupBy("term", "doc").agg(F.sum("w").alias("tf"), F.max("f").alias("in_first"), F.count("term").alias("n"), F.max("gone").alias("gone")), "segment-words", most=FILE_POSTS)

    def _merged(self, segments: list) -> list:
        while True:
            tiers: dict[int, list] = {}
            for s in segments:
                tiers.setdefault(self._tier(s[1]), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
            if full is None:
                return segments
            docs, posts = self._newest(full)
            # what a tombstone hides may lie in a segment outside this merge, so tombstones go only when nothing older is left outside
            rest = [s for s in segments if s not in full]
            if not any(s[2] < max(x[3] for x in full) for s in rest):
                docs = docs.filter("NOT gone")
            one = self._put(docs, posts, min(s[2] for s in full), max(s[3] for s in full))
            segments = rest + ([one] if one[1] else [])

    def segments(self) -> list[tuple]:
        """(path, documents, oldest batch, newest batch) of each segment."""
        return [tuple(r) for r in self.commits.get()[1] if r["path"]]

    def lengths(self) -> DataFrame:
        """(doc, len) of the documents that are there."""
        return self._newest(self.segments())[0].filter("NOT gone").select("doc", "len")

    def postings(self) -> DataFrame:
        """(term, doc, tf, in_first), as keyword.postings gives them for the documents that are there."""
        return self._newest(self.segments())[1].select("term", "doc", "tf", "in_first")

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Takes in all that a stream of changes has now, a segment per micro-batch."""
        changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, n)).start().awaitTermination()
