"""Hybrid search: vector and word rankings over chunks and files, fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.shared import kept
from .fusion import best_per_path, collapse, fuse, take
from .lexical import LexicalIndex, file_documents, search
from .nearest import nearest_rescored


@dataclass(frozen=True)
class HybridIndex:
    """chunks (id, path, ord, start_line, end_line, symbol, content, vector) with word indexes over them and over files."""

    chunks: DataFrame
    words: LexicalIndex
    files: DataFrame
    file_words: LexicalIndex
    settings: Settings = Settings()

    @classmethod
    def build(cls, chunks: DataFrame, settings: Settings = Settings()) -> HybridIndex:
        parts = [F.col("path"), F.col("symbol"), F.col("content")] if settings.path_tokens else [F.col("content")]
        files = file_documents(chunks)
        return cls(chunks, LexicalIndex.build(chunks, "id", parts), files, LexicalIndex.build(files, "path", parts), settings)

    def stored(self) -> HybridIndex:
        """Chunks, files and both word indexes written to the shared folder once."""
        fresh = HybridIndex.build(kept(self.chunks, "chunks"), self.settings)
        files = kept(fresh.files, "files")
        parts = [F.col("path"), F.col("symbol"), F.col("content")] if self.settings.path_tokens else [F.col("content")]
        return HybridIndex(fresh.chunks, fresh.words.stored(), files, LexicalIndex.build(files, "path", parts).stored(), self.settings)

    def _candidates(self, queries: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
        s, depth = self.settings, top * self.settings.candidate_factor
        near = nearest_rescored(self.chunks.select("id", "vector"), queries, depth, s.rescore_factor)
        words = search(self.words, queries, depth, s.k1, s.b)
        # short lists that fusion reads several times
        return kept(near, "near"), kept(words, "words")

    def search_chunks(self, queries: DataFrame, top: int = 10) -> DataFrame:
        """(query_id, rank, score, chunk columns) from (query_id, query, vector)."""
        s = self.settings
        near, words = self._candidates(queries, top)
        lists = near.select("query_id", F.lit(0).alias("list_idx"), "rank", "id").unionByName(words.select("query_id", F.lit(1).alias("list_idx"), "rank", "id"))
        best = take(fuse(lists, s.fusion_k, [s.vector_weight, s.lexical_weight], n_lists=2), top)
        return best.drop("first").join(self.chunks.drop("vector"), "id")

    def search_files(self, queries: DataFrame, top: int = 10, spans: int = 2) -> DataFrame:
        """(query_id, rank, score, path, span_rank, id, start_line, end_line, symbol, content).

        Each list is brought down to files before fusion; the spans of a file are the best of the chunk
        lists, fused alike, and all carry the file's score.  A file that only the file index found shows
        as a whole, with no id.
        """
        s = self.settings
        near, words = self._candidates(queries, top)
        paths = self.chunks.select("id", "path")
        near, words = near.join(paths, "id"), words.join(paths, "id")
        whole = search(self.file_words, queries, top * s.candidate_factor, s.k1, s.b).withColumnRenamed("id", "path")
        lists = None
        for i, one in enumerate((near, words, whole)):
            own = collapse(one).withColumn("list_idx", F.lit(i))
            lists = own if lists is None else lists.unionByName(own)
        files = take(fuse(lists, s.fusion_k, [s.vector_weight, s.lexical_weight, s.file_weight], s.fusion_alpha, 3), top)
        files = files.select("query_id", F.col("id").alias("path"), "score", "rank")
        both = near.select("query_id", F.lit(0).alias("list_idx"), "rank", "id").unionByName(words.select("query_id", F.lit(1).alias("list_idx"), "rank", "id"))
        fused = fuse(both, s.fusion_k, [s.vector_weight, s.lexical_weight], s.fusion_alpha, 2).join(paths, "id")
        chosen = best_per_path(fused, spans).select("query_id", "path", "id", "span_rank")
        hits = files.join(chosen, ["query_id", "path"], "left")
        detail = self.chunks.select("id", "start_line", "end_line", "symbol", "content")
        found = hits.filter(F.col("id").isNotNull()).join(detail, "id")
        alone = hits.filter(F.col("id").isNull()).withColumn("span_rank", F.lit(1)).join(self.files, "path")
        cols = ["query_id", "rank", "score", "path", "span_rank", "id", "start_line", "end_line", "symbol", "content"]
        return found.select(*cols).unionByName(alone.select(*cols))

    def search_first_spans(self, queries: DataFrame, top: int = 10) -> DataFrame:
        """One span per file; files without a chunk are left out."""
        return self.search_files(queries, top, 1).filter(F.col("id").isNotNull())
