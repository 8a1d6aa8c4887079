"""The thin queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .chat import PART, digests, write_chats
from .common import released, table
from .dedup_exact import exact_groups
from .embedding import linked
from .extraction import main_texts
from .licenses import scanned
from .merkle import merkle_manifest
from .minhash import near_classes
from .mixing import mixed
from .packing import packed
from .sharding import write_shards
from .tokenfile import read_tokens, write_tokens
from .toxicity import fit, held_out, scored, training_rows

N_SHARDS = 8


def tokenizer_path(name: str) -> str:
    """A public tokenizer file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written in coded blocks and read back."""
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word shingles, similarity 0.8."""
    return near_classes(table(spark, sf_dir, "documents"), 0.8).select("doc_id", "n_words", "class_id", "kept")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    return linked(table(spark, sf_dir, "embeddings"), 0.98)


PLANTED = "\\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, formatted, written, read back and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = turns.unionByName(planted).withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages"))).cast(PART)))
    return digests(spark.read.parquet(write_chats(turns)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of all documents."""
    return scanned(table(spark, sf_dir, "documents")).drop("spans")


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents interleaved by source, to the tempered natural weights."""
    return mixed(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents; see ``exact_groups``."""
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 8 shards, written, read back and digested."""
    written = spark.read.parquet(write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), N_SHARDS))
    return written.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


TOXIC_FROM = 0.7


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents; labels of held-out rows are never read into the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with released(spark):
        model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    rows = scored(docs, model).select("doc_id", "score", "n_words", F.size("segments").alias("n_segments"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_words", "n_segments")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2048, 0)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by two tokenizers, aligned."""
    return alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle tree over all documents by source, with proofs checked against tampered texts."""
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_token_blocks": op1_token_blocks, "op2_minhash_near_dedup": op2_minhash_near_dedup, "op3_embedding_near_dedup": op3_embedding_near_dedup, "op4_chat_formatting": op4_chat_formatting, "op5_license_scan": op5_license_scan, "op6_pfair_mixing": op6_pfair_mixing, "op7_exact_dedup": op7_exact_dedup, "op8_sharding": op8_sharding, "op9_toxicity": op9_toxicity, "op10_best_fit_packing": op10_best_fit_packing, "op11_tokenizer_alignment": op11_tokenizer_alignment, "op12_merkle_manifest": op12_merkle_manifest, "op13_html_extraction": op13_html_extraction}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"

# bit by bit: each bit of each character, lowest first
_CRC32 = "xor(list_reduce([4294967295] || flatten([[(ascii(({0})[p]) >> b) & 1 FOR b IN range(8)] FOR p IN range(1, len({0}) + 1)]), lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"

_ESCAPED = "replace(replace(replace({}, '\\', '\\\\'), '<', '\\<'), '>', '\\>')"

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# op2 compares every pair of documents that shares enough shingles and op3 every pair of one label: made for the small tables that SQL is run on.
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
     c AS (SELECT doc_id, g, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS part FROM s GROUP BY 1, 2),
     q AS (SELECT a.doc_id AS x, b.doc_id AS y FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(least(a.part, b.part)) >= 0.8 - 1e-9),
     u AS (SELECT x, y, g, coalesce(max(n) FILTER (WHERE doc_id = x), 0) AS a, coalesce(max(n) FILTER (WHERE doc_id = y), 0) AS b FROM q JOIN c ON doc_id = x OR doc_id = y GROUP BY 1, 2, 3),
     h AS (SELECT x, y, a, b, count(*) AS n FROM u GROUP BY 1, 2, 3, 4),
     j AS (SELECT i.x, i.y, i.n * i.a * i.b / sum(k.n * greatest(k.a * i.b, k.b * i.a)) AS part FROM h i JOIN h k ON k.x = i.x AND k.y = i.y WHERE i.a > 0 AND i.b > 0 GROUP BY i.x, i.y, i.a, i.b, i.n),
     l AS (SELECT x, y FROM j GROUP BY 1, 2 HAVING sum(part) >= 0.8 - 1e-12), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
     r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x), f AS (SELECT x, min(root) AS class_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, class_id, doc_id = class_id AS kept FROM d JOIN f ON f.x = doc_id""",
    "op3_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
     p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
     r AS (SELECT vec_id AS x, vec_id AS root FROM e UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.x)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.x = vec_id) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM e JOIN r ON r.x = vec_id GROUP BY vec_id""",
    "op4_chat_formatting": f"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, text), '')) AS loss_sha256,
       CAST(sum(length('<turn:></turn>') + 1 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op7_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text FROM documents),
     c AS (SELECT id, doc_id, source, {_FIELD.format("doc_id")} || {_FIELD.format("source")} || {_FIELD.format("lang")} || {_FIELD.format("n_chars")} AS head, text,
                  CASE WHEN {_CRC32.format("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LOWER.replace("coalesce(text, '')", "text")} ELSE text END AS changed FROM d),
     l AS (SELECT id, doc_id, source, sha256(head || {_FIELD.format("text")}) AS leaf, sha256(head || {_FIELD.format("changed")}) AS other FROM c),
     s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t, count(*) OVER () AS sources FROM (SELECT DISTINCT source FROM l)),
     r AS (SELECT l.*, s.t, s.sources, row_number() OVER (PARTITION BY s.t ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS r, count(*) OVER (PARTITION BY s.t) AS n FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
     a AS (SELECT t, 0 AS level, r AS j, n AS m, leaf AS h FROM r UNION ALL SELECT t, level + 1, j // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY j)) FROM a WHERE m > 1 GROUP BY t, level, j // 16, m),
     b AS (SELECT 0 AS level, a.t AS j, s.sources AS m, a.h FROM a JOIN s USING (t) WHERE a.m = 1 UNION ALL SELECT level + 1, j // 16, (m + 15) // 16, sha256(string_agg(h, '' ORDER BY j)) FROM b WHERE m > 1 GROUP BY level, j // 16, m),
     x AS (SELECT t, level, j, m, h FROM a UNION ALL SELECT -1, level, j, m, h FROM b),
     g AS (SELECT t, level, j, coalesce(string_agg(h, '' ORDER BY j) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                  coalesce(string_agg(h, '' ORDER BY j) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM x WHERE m > 1 WINDOW w AS (PARTITION BY t, level, j // 16 ORDER BY j)),
     f AS (SELECT id, t, t AS up, 0 AS level, r AS j, CASE WHEN leaf = other THEN leaf ELSE other END AS h, '' AS proof FROM r
           UNION ALL SELECT f.id, CASE WHEN g.j IS NULL THEN -1 ELSE f.t END, f.up, CASE WHEN g.j IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN g.j IS NULL THEN f.up ELSE f.j // 16 END,
                  CASE WHEN g.j IS NULL THEN f.h ELSE sha256(g.before || f.h || g.after) END, CASE WHEN g.j IS NULL THEN f.proof ELSE f.proof || g.before || g.after END
           FROM f LEFT JOIN g ON g.t = f.t AND g.level = f.level AND g.j = f.j WHERE NOT (f.t = -1 AND g.j IS NULL)),
     e AS (SELECT f.* FROM f LEFT JOIN g ON g.t = f.t AND g.level = f.level AND g.j = f.j WHERE f.t = -1 AND g.j IS NULL)
SELECT r.doc_id, r.source, r.leaf, a.h AS subroot, b.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = b.h AS verified
FROM r JOIN e USING (id) JOIN a ON a.t = r.t AND a.m = 1 JOIN b ON b.m = 1""",
}
