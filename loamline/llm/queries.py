"""The queries of the ten operators over their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets
from .chat import BLOCK, CLOSE, END, OPEN, format_chats, read_chats
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract_pages
from .mixing import CAP, SEED, WEIGHTS, mix
from .pieces import encode_and_check
from .quality import fit_quality, judge_quality
from .secrets import find_secrets, joined
from .simhash import near_groups
from .token_files import read_token_files, write_token_files
from .toxicity import fit_chain, score_toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    formatted = format_chats(turns.unionByName(own))
    whole = F.struct("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars")).alias("conv_id")
    back = read_chats(formatted.select(whole, "formatted", "loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.col("conv_id.formatted_chars").alias("formatted_chars"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_quality(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, rules, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score_toxicity(docs, chain)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1,
    "op2_token_files": op2,
    "op3_simhash": op3,
    "op4_chat_format": op4,
    "op5_quality_rules": op5,
    "op6_secrets": op6,
    "op7_pieces": op7,
    "op8_toxicity": op8,
    "op9_mixing": op9,
    "op10_main_text": op10,
}

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _escape_sql(x: str) -> str:
    for a, b in (("\\", "\\e"), (BLOCK, "\\ls>"), (END, "\\l/s>"), (OPEN, "\\bINST]"), (CLOSE, "\\b/INST]")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), b AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS first FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escape_sql("text")}) + {len(OPEN + CLOSE)} + CASE WHEN first THEN {len(BLOCK + END)} + length({_escape_sql("role")}) ELSE 0 END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""


def _places_sql(name: str, pattern: str, rank: int, kind: str, keep: str) -> str:
    """A CTE of (doc_id, start, rank, kind, found) of the matches of a pattern."""
    q = pattern.replace("'", "''")
    return f"""
{name} AS (
  SELECT doc_id, found, {rank} AS rank, '{kind}' AS kind,
    (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (
    SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS found
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{q}') AS hits, regexp_split_to_array(coalesce(text, ''), '{q}') AS gaps FROM documents)
  ) WHERE {keep}
)"""


_PARTS = "[" + ", ".join(map(str, secrets.PARTS)) + "]"
_LIMIT = "CASE " + " ".join(f"WHEN regexp_matches(found, '{p}') THEN {secrets._limit(bits)}" for _, p, bits in secrets.CLASSES) + " END"
_WORST = f"""list_min([list_sum([{_PARTS}[length(w) - length(replace(w, ch, '')) + 1] FOR ch IN list_distinct(string_split(w, ''))])
  FOR w IN [found[k:k + {secrets.WINDOW - 1}] FOR k IN range(1, length(found) - {secrets.WINDOW - 2})]])"""
_PARTS_OF = f"regexp_split_to_array(found, '{secrets.SEPARATORS}')"
_ALLOWED = f"""(regexp_matches(found, '{secrets.UUID}')
  OR (regexp_matches(found, '{secrets.SEPARATORS}') AND len([p FOR p IN {_PARTS_OF} IF NOT regexp_matches(p, '{secrets.PLAIN_PART}')]) = 0)
  OR (len([p FOR p IN {_PARTS_OF} IF regexp_matches(p, '{secrets.PLACEHOLDER}')]) > 0
    AND coalesce(list_sum([length(p) FOR p IN {_PARTS_OF} IF NOT regexp_matches(p, '{secrets.PLACEHOLDER}')]), 0) < {secrets.WINDOW}))"""
SECRETS_SQL = f"""
WITH {_places_sql("assign", secrets.ASSIGN, 0, "assign", f"length(regexp_extract(found, '{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 6")},
{_places_sql("access", secrets.ACCESS, 1, "access", "length(found) >= 20")},
{_places_sql("hexes", secrets.HEX, 2, "hex", "length(found) >= 24")},
{_places_sql("runs", "[A-Za-z0-9+/_=-]{24,}", 3, "entropy", "regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]')")},
base AS (SELECT doc_id, start, rank, kind, start + length(found) AS stop FROM (FROM assign UNION ALL BY NAME FROM access UNION ALL BY NAME FROM hexes)),
random AS (
  SELECT doc_id, start, rank, kind, start + length(found) AS stop FROM runs
  WHERE NOT {_ALLOWED} AND {_WORST} <= {_LIMIT}
),
every AS (
  SELECT * FROM base UNION ALL BY NAME
  SELECT * FROM random r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND r.start < b.stop)
),
sums AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN sums USING (doc_id)
"""

MIX_SQL = f"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][k % {len(WEIGHTS)} + 1] AS weight, {CAP} * source_size::DOUBLE AS room
  FROM (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes GROUP BY source)
),
fill AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(room) OVER (ORDER BY room / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY room / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM per
),
level AS (SELECT arg_min(own, (room / weight, k)) AS level FROM fill WHERE own * weight <= room),
targets AS (
  SELECT source, source_size, docs, k, least(coalesce(level * weight, room), room) AS target FROM fill, level
),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS share,
    ((t.k * 40503 + {SEED * 30011}) % 65536) / 65536 AS shift, t.docs,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS r
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
placed AS (SELECT *, CASE WHEN r % 2 = 0 THEN r // 2 ELSE docs - 1 - r // 2 END AS spot FROM ranked)
SELECT doc_id, size, source_size, target, ((floor((spot + 1) * share + shift) - floor(spot * share + shift)) * size)::BIGINT AS taken FROM placed
"""

ORACLES: dict[str, str] = {"op1_exact_dedup": EXACT_SQL, "op4_chat_format": CHAT_SQL, "op6_secrets": SECRETS_SQL, "op9_mixing": MIX_SQL}
