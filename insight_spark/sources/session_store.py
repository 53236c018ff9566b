"""Chunks of conversations stored with their vectors and posting blocks, and searched from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.operators import retrieval as ret
from insight_spark.operators.postings import PostingIndex
from insight_spark.operators.scale import kept
from insight_spark.sources import chunk_store


class SessionStore:
    """A folder with the chunk store, the index and the word weights of the vectors.

    The weights are fitted on the first chunks that come in and then kept, so that vectors
    of later chunks and of questions can be compared with the stored ones.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 256):
        self.spark, self.path, self.width = spark, path, width
        self.index = PostingIndex(spark, f"{path}/postings", "string")

    def weights(self) -> list[float]:
        return self.spark.read.parquet(f"{self.path}/weights").first()["weights"]

    def add(self, chunks: DataFrame) -> None:
        """Store chunks (chunk_id, conversation, text); conversations that occur in them are replaced."""
        # A text is tokenised once: weights, vectors and postings all come from the stored words.
        named = chunks.select("chunk_id", F.col("conversation").alias("conversation_id"), "text")
        given = kept(ret.hashed_words(named, "text", self.width), "chunks")
        if not self._has_weights():
            fitted = ret.embedding_weights(given, "text", self.width)
            self.spark.createDataFrame([(fitted,)], "weights array<double>").write.parquet(f"{self.path}/weights")
        chunk_store.write_chunks(ret.embed_with(given, self.weights(), "text"), f"{self.path}/chunks")
        self.index.add(given, "chunk_id", "text", "conversation_id", replace=True, stored="_words")

    def _has_weights(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/weights/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def delete(self, conversation: str) -> bool:
        """Remove a conversation from the chunks and from the index."""
        return chunk_store.delete_chunks(self.spark, f"{self.path}/chunks", conversation) | self.index.delete(conversation)

    def chunks(self) -> DataFrame:
        return chunk_store.read_chunks(self.spark, f"{self.path}/chunks").select(
            "chunk_id", F.col("conversation_id").alias("conversation"), "text", "embedding"
        )

    def search(self, asked: DataFrame, k: int = 10) -> DataFrame:
        """Reranked chunks for questions (query_id, conversation, text), each within its conversation: words and vectors
        fused, copies dropped. The texts read are those of the candidates."""
        questions = kept(ret.embed_with(asked.select("query_id", "conversation", "text"), self.weights(), "text"), "asked")
        known = self.chunks()
        words = self.index.search(questions, doc_id="chunk_id", k=k, scope="conversation")
        vectors = ret.vector_topk(known.drop("text"), questions, "chunk_id", k=k, scope="conversation")
        found = ret.hybrid_candidates(ret.rrf_fusion(words, vectors, "query_id", "chunk_id"), known, "query_id", "chunk_id")
        pairs = found.join(questions.select("query_id", "text"), "query_id")
        score = ret.coverage_scorer(self.index.frequency, self.index.documents())
        return ret.rerank_topk(pairs, "query_id", "text", "chunk", "chunk_id", score)
