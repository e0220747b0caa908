"""A facade over one repository: build, search, read, graph questions, evaluation, status and diagnosis."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.vectors import hash_embedding, hash_vectors
from .operators import evaluation, graph
from .operators.chunking import chunker, chunker_id, embed_text
from .operators.hybrid import HybridIndex
from .operators.languages import is_skipped
from .operators.lexical import LexicalIndex
from .operators.syntax import go_calls
from .sources.catalog import Catalog, stale_fields
from .sources.repo_files import read_tree
from .sources.shared import kept
from .workspace import EMBEDDING, LOADING, SCANNING, STORING, Progress


def save_words(catalog: Catalog, settings: Settings) -> None:
    """Files and both word indexes of the stored chunks."""
    catalog._swap("files", HybridIndex.build(catalog.chunks(), settings).files)
    parts = [F.col("path"), F.col("symbol"), F.col("content")] if settings.path_tokens else [F.col("content")]
    catalog.save_lexical("chunk", LexicalIndex.build(catalog.chunks(), "id", parts))
    catalog.save_lexical("file", LexicalIndex.build(catalog._read("files"), "path", parts))


def load_index(catalog: Catalog, settings: Settings) -> HybridIndex:
    """The stored index; word indexes that don't fit the chunks any more are made again."""
    chunks = catalog.chunks()
    words = catalog.load_lexical("chunk", chunks)
    if words is None or catalog._read("files") is None:
        save_words(catalog, settings)
        words = catalog.load_lexical("chunk")
    return HybridIndex(catalog.chunks(), words, catalog._read("files"), catalog.load_lexical("file"), settings)


class Repository:
    def __init__(self, spark: SparkSession, root: str, index_dir: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root, settings
        self.catalog = Catalog(spark, index_dir)
        self._graph: DataFrame | None = None

    @property
    def fields(self) -> dict[str, object]:
        s = self.settings
        return {"embedder": f"hash-{s.dimensions}", "dim": s.dimensions, "chunker": chunker_id(s.chunker, s)}

    def files(self) -> DataFrame:
        return read_tree(self.spark, self.root).filter(~is_skipped(F.col("path"), F.col("content")))

    def index(self, progress: Progress = lambda phase, done, total: None) -> dict[str, object]:
        """Build what is missing; an index that fits is used as it is (files is then None)."""
        if self.catalog.ensure(self.fields) and (n := self.catalog.inspect()["chunks"]):
            progress(LOADING, n, n)
            return {"files": None, "chunks": n, "reused": True}
        progress(SCANNING, 0, 0)
        files = kept(self.files(), "files")
        n_files = files.count()
        progress(SCANNING, n_files, n_files)
        made = chunker(self.settings.chunker)(files, self.settings)
        made = made.withColumn("embed_text", embed_text(F.col("path"), F.col("content"), F.col("embed_text")))
        made = kept(made, "made")
        n_chunks = made.count()
        progress(EMBEDDING, 0, n_chunks)
        full = self.catalog.embed(made, self.fields["embedder"], self.settings.dimensions, lambda texts: hash_vectors(texts, "id", F.col("text"), self.settings.dimensions))
        progress(STORING, 0, n_chunks)
        self.catalog.upsert(full.drop("embed_text"))
        save_words(self.catalog, self.settings)
        progress(STORING, n_chunks, n_chunks)
        return {"files": n_files, "chunks": n_chunks, "reused": False}

    def hybrid(self) -> HybridIndex:
        self.index()
        return load_index(self.catalog, self.settings)

    def queries(self, texts: list[str]) -> DataFrame:
        q = self.spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")
        return q.withColumn("vector", hash_embedding(F.col("query"), self.settings.dimensions))

    def search(self, text: str, top: int = 10, spans: int = 2, content: bool = True) -> DataFrame:
        got = self.hybrid().search_files(self.queries([text]), top if top > 0 else 10, spans if spans > 0 else 2).orderBy("rank", "span_rank")
        return got if content else got.drop("content")

    def lines(self, text: str, top: int = 10, spans: int = 2) -> list[str]:
        """Hits as text; further spans of a file are indented."""
        out = []
        for r in self.search(text, top, spans, False).collect():
            place = f"{r['path']}:{r['start_line']}-{r['end_line']}"
            out.append(f"{r['rank']:2d}. [{r['score']:.3f}] {place}" if r["span_rank"] == 1 else " " * 12 + place)
        return out or ["no results"]

    def evaluate(self, gold: list[tuple[str, list[str]]], ks: list[int] = [5, 7, 10, 15, 20]) -> DataFrame:  # noqa: B006
        hits = self.hybrid().search_first_spans(self.queries([q for q, _ in gold]), max(ks)).select("query_id", F.col("path").alias("id"), "rank")
        want = self.spark.createDataFrame([(i, r) for i, (_, r) in enumerate(gold)], "query_id bigint, relevant array<string>")
        return evaluation.evaluate(hits, want, ks)

    def evaluation_report(self, path: str, verbose: bool = False, ks: list[int] = [5, 7, 10, 15, 20]) -> list[str]:  # noqa: B006
        """Lines on a query set in a JSON file: one with recalls and MRR, or one per query with its rank and a sum."""
        gold = evaluation.read_query_set(self.spark, path)
        asked = gold.select("query_id", "query").withColumn("vector", hash_embedding(F.col("query"), self.settings.dimensions))
        ks = [10] if verbose else ks
        hits = self.hybrid().search_first_spans(asked, max(ks)).select("query_id", F.col("path").alias("id"), "rank")
        total = [r["line"] for r in evaluation.report_line(evaluation.evaluate(hits, gold, ks)).collect()]
        if not verbose:
            return total
        each = evaluation.verbose_lines(evaluation.per_query(hits, gold, ks), gold)
        return [r["line"] for r in each.orderBy("query_id").toLocalIterator()] + total

    def graph(self, edges: DataFrame | None = None) -> DataFrame:
        """Given edges (from a compiler, say), else calls by name from the Go files of the tree."""
        if edges is not None:
            self._graph = graph.edge_set(edges)
        if self._graph is None:

            def calls(frames):  # noqa: ANN001, ANN202
                import pandas as pd

                for f in frames:
                    yield pd.DataFrame([e for t in f["content"] for e in go_calls(t)], columns=["src", "dst"])

            tree = read_tree(self.spark, self.root, suffixes=".go", prune_root="false")
            self._graph = tree.select("content").mapInPandas(calls, "src string, dst string").distinct()
        return self._graph

    def impact(self, name: str) -> dict[str, object]:
        found, total = self._resolve(name)
        return {"candidates": found, "total": total} if total != 1 else {"nodes": sorted(r["node"] for r in graph.impact(self.graph(), self.spark.createDataFrame([(found[0],)], "node string")).collect())}

    def trace(self, start: str, end: str) -> dict[str, object]:
        for found, total in (a := self._resolve(start), b := self._resolve(end)):
            if total != 1:
                return {"candidates": found, "total": total}
        return {"path": graph.trace(self.graph(), a[0][0], b[0][0])}

    def _resolve(self, name: str, most: int = 20) -> tuple[list[str], int]:
        """The first candidates for a name, and how many there are."""
        found = kept(graph.resolve(graph.nodes(self.graph()), name), "candidates")
        return [r["node"] for r in found.orderBy("node").limit(most).collect()], found.count()

    def status(self) -> dict[str, object]:
        return self.catalog.inspect()

    def diagnose(self, model: str | None = None) -> list[tuple[str, str, str]]:
        """(mark, label, detail) rows on runtime, model, settings and index; nothing is written."""
        from dataclasses import fields
        from importlib.util import find_spec

        seen = self.catalog.inspect()
        out = [("ok" if find_spec("onnxruntime") else "info", "runtime", "onnxruntime " + ("found" if find_spec("onnxruntime") else "absent; hashing embedder only"))]
        if model:
            whole = os.path.isfile(model) and os.path.getsize(model) > 0
            out.append(("ok", "model", f"{model}, {os.path.getsize(model)} bytes") if whole else ("bad", "model", f"{model} is missing" if not os.path.exists(model) else f"{model} is empty"))
        changed = [f"{f.name}={getattr(self.settings, f.name)}" for f in fields(Settings) if getattr(self.settings, f.name) != f.default]
        out.append(("info", "tuning", " ".join(changed) or "defaults"))
        if seen["fingerprint"] is None:
            out.append(("info", "index", "none yet"))
        else:
            from .sources.catalog import SCHEMA_VERSION, fingerprint

            drift = stale_fields(seen["fingerprint"], fingerprint({"schema": SCHEMA_VERSION, **self.fields}))
            out.append(("bad", "index", f"stale: {', '.join(drift)}") if drift else ("ok", "index", f"{seen['chunks']} chunks"))
        return out
