"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, ctw, decontaminate, langid, near_dup, sentencepieces, shared, sharding, token_counts, token_files

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trips(table(spark, sf_dir, "documents"), sentencepieces.public_model())


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"))


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARDS, SHARDS + 1)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with their numbers of words and then revised to BPE counts; all are
    deleted and inserted again; batches are folded in between, and every batch comes twice."""
    docs = table(spark, sf_dir, "documents").select("text", "source", "lang")
    words = docs.withColumn("old_tokens", token_counts.counted_words(F.col("text")))
    folder = shared.new_folder(spark, "rollups")
    store = token_counts.Rollups(spark, f"{folder}/store")
    counts = shared.written(token_counts.with_bpe_counts(words, bpe.public_path("byte_bpe_50k.json")), f"{folder}/counts")
    old, new = F.col("old_tokens"), F.col("new_tokens")
    batches = {
        "insert": token_counts.signed(counts, None, old, new_version="words-1"),
        "revise": token_counts.signed(counts, old, new, "words-1", "byte_bpe_50k"),
        "delete": token_counts.signed(counts, new, None, "byte_bpe_50k"),
        "again": token_counts.signed(counts, None, new, new_version="byte_bpe_50k"),
    }
    for name in ("insert", "revise", "insert", "revise"):
        store.commit(name, batches[name])
    store.fold()
    for name in ("delete", "insert", "again", "delete", "again"):
        store.commit(name, batches[name])
    store.fold()
    return shared.settled(store.totals(), folder)


def op8_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"), ctw.held_out_of(F.col("doc_id")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_class, n_aligned (pairs of its text that were aligned and are links)."""
    folder = shared.new_folder(spark, "near-dup")
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), folder=folder)
    return shared.settled(near_dup.with_links(*found), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sentencepiece, op2_nearest_neighbours, op3_language_id, op4_chat_format, op5_token_files, op6_hash_tree_shards, op7_token_counts, op8_context_tree_score, op9_decontamination, op10_near_duplicates)
    return {f.__name__: f for f in found}


_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_nearest_neighbours": """
            WITH v AS (
                SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
            SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5""",
        "op4_chat_format": r"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
            p AS (
                SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                       string_agg(sha256(role || chr(31) || text), '' ) OVER w AS prefix
                FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
            whole AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n_turns GROUP BY 1, 2),
            stay AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE place < n_turns))
            SELECT s.conv_id, s.n_turns, s.n_copies,
                   string_agg('<|im_start|>' || t.role || chr(10) ||
                       regexp_replace(t.text, '<(\|im_(start|end)\|>)', '<\\\1', 'g') || '<|im_end|>' || chr(10), '' ORDER BY t.turn NULLS FIRST, t.role, t.text) AS text
            FROM stay s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY 1, 2, 3""",
        "op9_decontamination": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
            b AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
            pat AS (
                SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p
                FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT n FROM pat),
            win AS (
                SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
                FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
            hit AS (SELECT win.r, win.i, win.n, pat.item FROM win JOIN pat ON win.n = pat.n AND win.p = pat.p),
            covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
            found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
            SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
                   sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)""",
    }
