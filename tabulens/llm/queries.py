"""The registered queries of the operators, and SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import align, ann, chat, licenses, lines, packing, pieces, quality, resample, simhash, tokens, warc, winnow
from tabulens.llm.common import UPPER
from tabulens.sources.tables import table

HELD_OUT_FOLDS = 5


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels.where(fold() != 0))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_model(docs, table(spark, folder, "labels"))
    return quality.scored(docs, model).select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(licenses.scan_runs(table(spark, folder, "documents")))


def _labelled(found: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p["first"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("matches", lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
    )


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.compared(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        winnow.digest(F.col("marks")).alias("fingerprint"),
        winnow.digest(F.col("edited_marks")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.size("marks").alias("n_marks"),
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, folder, "pages"))
    found = warc.resolved(warc.read_archives(manifest))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    found = pieces.sampled(table(spark, folder, "documents"), model, decode=True)
    return found.select("doc_id", *pieces.crc32_of(), F.sha2("decoded", 256).alias("decoded_sha256"),
                        (F.col("decoded") == F.col("text")).alias("lossless"))


def op9_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.read_shards(tokens.write_shards(table(spark, folder, "documents"), tokenizer_path()))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    bitmaps = lines.keep_bitmaps(docs)
    kept = lines.with_kept_text(docs, bitmaps, counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return align.aligned_documents(table(spark, folder, "documents"), a, b)


def op12_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold the template's own marks."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(chat.TARGET).alias("role"), marks.alias("text"),
    )
    return chat.digests(chat.formatted(given.unionByName(own)))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# ---------------------------------------------------------------- SQL

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages WHERE page_id IS NOT NULL),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {lines.MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCUMENTS}),
x AS (SELECT k.*, g.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_licenses, op3_neighbours, op4_winnowing, op5_simhash,
        op6_packing, op7_warc, op8_segmentation, op9_token_shards, op10_line_dedup,
        op11_alignment, op12_chat_windows, op13_resampling,
    )
}
SQL: dict[str, str] = {"op7_warc": _WARC_SQL, "op10_line_dedup": _LINES_SQL}
