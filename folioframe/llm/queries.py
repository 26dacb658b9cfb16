"""One query per operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_kn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document.  Null texts and those without a letter are "und"; of languages
    that tie the first by name; repeated rows are predicted alike; an empty table gives none."""
    from folioframe.llm.langid import held_out, predict_language, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    out = docs.select("doc_id", held_out().alias("held_out"), predict_language(docs, model).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; null texts are empty, repeated rows counted alike."""
    from folioframe.llm.tokens import token_count

    docs = _read(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", n_bytes, token_count(spark, F.col("text"), tokenizer_path()).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op1_hpylm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document.  A null id counts as the empty text for the held-out rule."""
    from folioframe.llm.hpylm import score_texts

    docs = _read(spark, sf_dir, "documents")
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
    out = score_texts(docs, learn)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: doc_id and the least id of its class (null for a null id)."""
    from folioframe.llm.neardup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document.  Items of null id count as one item, and aren't in the digest."""
    from folioframe.llm.decontaminate import find_contamination, n_hit

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _read(spark, sf_dir, "benchmark"), drop_text=True)
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
    FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
spot AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM d, (SELECT DISTINCT n FROM win) AS k, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT r, item, i, n FROM spot JOIN win USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op4_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once windows of documents of smaller id are gone from it."""
    from folioframe.llm.debruijn import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, p FROM win JOIN least USING (k), unnest(range(i, i + 50)) AS t(p) WHERE m < doc_id),
kept AS (SELECT r, string_agg(w[p], ' ' ORDER BY p) AS kept, count(*) AS n
    FROM (SELECT r, w, p FROM d, unnest(range(1, len(w) + 1)) AS t(p)) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes; equal texts lie in one shard, unless they are more than any has room for."""
    from folioframe.llm.sharding import shard

    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    out = shard(docs, F.col("n_bytes") + 1, F.col("text_hash"), [F.col("doc_id")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, read back from normalised archives by their offsets."""
    from folioframe.llm.warc import round_trip

    out = round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top, count(*) AS n FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
    CASE WHEN n > 1 AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (h)
"""


def op7_oph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    from folioframe.llm.fingerprint import fingerprint_pairs

    out = fingerprint_pairs(_read(spark, sf_dir, "documents"))
    out = out.withColumn("edited_sha256", F.sha2("edited_text", 256))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null sources are one source, the last."""
    from folioframe.llm.mixing import mix_sources, word_count

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n_words"))
    return mix_sources(docs, F.col("n_words")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hpylm_score": op1_hpylm_score,
        "op2_probminhash_dedup": op2_probminhash_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_debruijn_dedup": op4_debruijn_dedup,
        "op5_sampled_splitters": op5_sampled_splitters,
        "op6_warc_normalise": op6_warc_normalise,
        "op7_oph_fingerprint": op7_oph_fingerprint,
        "op8_block_mix": op8_block_mix,
        "op9_kn_langid": op9_kn_langid,
        "op10_token_count": op10_token_count,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": OP3_SQL,
        "op4_debruijn_dedup": OP4_SQL,
        "op6_warc_normalise": OP6_SQL,
    }
