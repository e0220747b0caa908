"""A stored index: chunks and word indexes as Parquet, a manifest that tells how they were made, and a vector cache.

Every table is a folder of its own name and version.  The manifest, one small file that is replaced in one step,
says which versions are current, so a reader or a crash never meets half a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import LexicalIndex

SCHEMA_VERSION, LEXICAL_VERSION = 1, 2


def fingerprint(fields: dict[str, object]) -> str:
    return " ".join(f"{k}={v}" for k, v in fields.items())


def parse_fingerprint(text: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in text.split(" ") if "=" in p)


def stale_fields(stored: str, now: str) -> list[str]:
    """Names of the fields that differ or are missing, in the order of the present ones."""
    a, b = parse_fingerprint(stored), parse_fingerprint(now)
    return [k for k in [*b, *[x for x in a if x not in b]] if a.get(k) != b.get(k)]


def ids_digest(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (n, digest) that changes with any id, whatever the order of rows."""
    return ids.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(id_col).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # the manifest: {"fingerprint": text, "tables": {name: folder}, "lexical": {kind: {version, n, digest}}}

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):  # noqa: ANN202
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        files, at = self._files(), self._path("manifest.json")
        if not files.exists(at):
            return {"fingerprint": None, "tables": {}, "lexical": {}}
        stream = files.open(at)
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict, gone: list[str] = ()) -> None:
        """Put the manifest in the place of the old one, then delete folders that it doesn't name any more."""
        files, aside = self._files(), self._path(f"manifest-{uuid.uuid4().hex}")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(files.makeQualified(aside).toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        over[0] = fs.Options.Rename.OVERWRITE
        context.rename(files.makeQualified(aside), files.makeQualified(self._path("manifest.json")), over)
        for name in gone:
            files.delete(self._path(name), True)

    def _read(self, name: str) -> DataFrame | None:
        at = self._manifest()["tables"].get(name)
        return self.spark.read.parquet(f"{self.folder}/{at}") if at else None

    def _write(self, name: str, df: DataFrame) -> str:
        at = f"{name.replace('/', '-')}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{at}")
        return at

    def _swap(self, name: str, df: DataFrame) -> None:
        """Replace a table that ``df`` may read from."""
        self._replace({name: self._write(name, df)})

    def _replace(self, tables: dict[str, str], drop: list[str] = (), **entries) -> None:  # noqa: ANN003
        m = self._manifest()
        gone = [m["tables"][n] for n in [*tables, *drop] if n in m["tables"]]
        m["tables"] = {n: at for n, at in m["tables"].items() if n not in drop} | tables
        m.update(entries)
        self._commit(m, gone)

    def inspect(self) -> dict[str, object]:
        """What is stored, without making or changing anything: fingerprint (None if absent) and chunks."""
        chunks = self._read("chunks")
        return {"fingerprint": self._manifest()["fingerprint"], "chunks": chunks.count() if chunks is not None else 0}

    def ensure(self, fields: dict[str, object]) -> bool:
        """Stamp a new index; drop chunks and word indexes if they were made otherwise.  True if what is stored fits."""
        now, m = fingerprint({"schema": SCHEMA_VERSION, **fields}), self._manifest()
        if m["fingerprint"] == now:
            return True
        gone = [at for n, at in m["tables"].items() if n != "vector_cache"]
        self._commit({"fingerprint": now, "tables": {n: at for n, at in m["tables"].items() if n == "vector_cache"}, "lexical": {}}, gone)
        return False

    # chunks

    def chunks(self) -> DataFrame | None:
        return self._read("chunks")

    def upsert(self, new: DataFrame, id_col: str = "id") -> None:
        """Put chunks in; a row with a known id takes the place of the old one."""
        old = self.chunks()
        self._swap("chunks", new if old is None else upserted(old, new, id_col))

    # word indexes

    def save_lexical(self, kind: str, index: LexicalIndex) -> LexicalIndex:
        """Store an index under a name; it becomes visible as a whole."""
        tables: dict[str, str] = {}

        def put(df: DataFrame, label: str) -> DataFrame:
            tables[f"{kind}/{label}"] = at = self._write(f"{kind}/{label}", df)
            return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{at}")

        stored = index.write(put)
        state = ids_digest(stored.lengths).first()
        before = self._manifest()
        known = before["lexical"] | {kind: {"version": LEXICAL_VERSION, "n": state["n"], "digest": state["digest"]}}
        # tables that an earlier version of the layout had
        self._replace(tables, [n for n in before["tables"] if n.startswith(f"{kind}/") and n not in tables], lexical=known)
        return stored

    def load_lexical(self, kind: str, ids: DataFrame | None = None, id_col: str = "id") -> LexicalIndex | None:
        """None if absent, of another version, or made of other ids (not looked at if ``ids`` is None)."""
        state = self._manifest()["lexical"].get(kind)
        if state is None or state["version"] != LEXICAL_VERSION:
            return None
        if ids is not None and tuple(ids_digest(ids, id_col).first()) != (state["n"], state["digest"]):
            return None
        return LexicalIndex.of_rows(self._read(f"{kind}/rows"), self._read(f"{kind}/stats"))

    # vector cache

    def embed(self, chunks: DataFrame, embedder: str, dim: int, vector: Column | Callable[[DataFrame], DataFrame], text: str = "embed_text") -> DataFrame:
        """``chunks`` with vectors: known ones from the cache, the others computed once per text and added to it.

        ``vector`` is a column, or makes (id, vector) of (id, text) for many texts at once.
        """
        keyed = chunks.withColumn("_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        folder = self._manifest()["tables"].get("vector_cache") or f"vector_cache-{uuid.uuid4().hex}"
        at = f"{self.folder}/{folder}"
        schema = "embedder string, hash string, vector array<double>"
        fits = lambda df: df.filter((F.col("embedder") == embedder) & (F.size("vector") == dim))
        cache = self.spark.read.schema(schema).parquet(at) if self._files().exists(self._path(folder)) else self.spark.createDataFrame([], schema)
        misses = split_cache(keyed, fits(cache))[1]
        once = misses.dropDuplicates(["_hash"])
        made = once.select(F.col("_hash").alias("id"), vector.alias("vector")) if isinstance(vector, Column) else vector(once.select(F.col("_hash").alias("id"), F.col(text).alias("text")))
        made = made.select(F.lit(embedder).alias("embedder"), F.col("id").alias("hash"), "vector").filter(F.col("vector").isNotNull())
        made.write.mode("append").parquet(at)  # rows are only ever added, and equal ones may come twice
        self._replace({} if "vector_cache" in self._manifest()["tables"] else {"vector_cache": folder})
        full = fits(self.spark.read.schema(schema).parquet(at)).dropDuplicates(["hash"]).select(F.col("hash").alias("_hash"), "vector")
        return keyed.join(full, "_hash", "left").drop("_hash")


def split_cache(keyed: DataFrame, cache: DataFrame, key: str = "_hash") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``keyed`` rows against the hashes of a cache."""
    have = cache.select(F.col("hash").alias(key)).distinct()
    return keyed.join(have, key, "left_semi"), keyed.join(have, key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    last = new.dropDuplicates([key])
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)
