"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from knotwork.llm import grammar, licenses, mixing, negatives, packing, pages, periods, pii, quality, repeats, simhash, spans, vectors
from knotwork.llm.common import scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op3_simhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op11_periods")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return periods.digests(periods.find(docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"]))


@query("op13_negatives")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, folder, "embeddings").withColumn("label", label))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_tokens")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark)
    grammar.write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return grammar.read(spark, path)


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality.rate(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op4_mixing", """
WITH sized AS (
    SELECT doc_id, source, text, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
    FROM documents),
sources AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS w FROM sources),
level AS (
    SELECT arg_min((1.5 * whole - below) / above, point) AS level FROM (
        SELECT (SELECT sum(source_size) FROM weighed) AS whole,
            coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
            sum(w) OVER (ORDER BY 2 * source_size / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
            2 * source_size / w AS point
        FROM weighed)
    WHERE (1.5 * whole - below) / above < point),
aimed AS (SELECT k, source_size, least(2.0 * source_size, w * level)::DOUBLE AS target FROM weighed, level),
placed AS (
    SELECT s.*, a.source_size, a.target, floor(a.target)::BIGINT AS take,
        (sum(size) OVER (PARTITION BY k ORDER BY md5(doc_id::VARCHAR), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
    FROM sized s JOIN aimed a USING (k))
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 3) AS target,
    CASE WHEN size = 0 THEN 0 ELSE take // source_size * size + greatest(least(take % source_size - start, size), 0) END::BIGINT AS taken
FROM placed""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@query("op6_pii")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query("op9_embeddings")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op7_spans")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return spans.without_repeats(table(spark, folder, "documents"))


def document_files(docs: DataFrame) -> DataFrame:
    """``docs`` as files: source, language and thousand as directories; one that opens with a notice is a licence file."""
    notice = F.coalesce(F.col("text").rlike(r"(?i)^[^\n]*licen[sc]e"), F.lit(False))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("unnumbered"))
    folder = [F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.expr("doc_id div 1000").cast("string"), F.lit("unnumbered"))]
    return docs.select("doc_id", F.concat_ws("/", *folder, F.when(notice, F.concat(F.lit("LICENSE-"), doc)).otherwise(F.concat(doc, F.lit(".txt")))).alias("path"), "text")


@query("op1_licenses")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(document_files(table(spark, folder, "documents")), ["doc_id"])


@query("op8_pages")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op5_repeats")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"))
