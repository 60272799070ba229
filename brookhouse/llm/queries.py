"""One query per operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, extract, langid, line_dedup, merkle, mixing, ngram_join, packing, prefix_trie, quality, suffix_dedup, toxicity, vectors
from .common import fold, table
from .sql import MERKLE_SQL, MIX_SQL, QUALITY_SQL, TRIE_SQL


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Line-first cleaning of every document."""
    out = quality.clean(table(spark, folder, "documents").select("doc_id", "text"))
    names = (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_bad_lines", "lost_chars",
    )
    digest = F.md5(F.col("quality.clean_text").cast("binary")).alias("clean_md5")
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names], digest)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those outside fold 1 of 3."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    documents = documents.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = langid.train(documents.filter(~F.col("held_out")))
    out = langid.identify(documents.drop("lang"), model)
    return out.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.bits_per_byte")


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors with the same label and a cosine of 0.93 or more."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages")
    out = extract.extract(pages, extract.train(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document after deleting blocks of lines that align with an earlier one."""
    out = line_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "lines.n_lines", "lines.n_deleted", "lines.words_left", F.length("text").cast("bigint").alias("n_chars"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur elsewhere."""
    out = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "deduped.n_bytes", "deduped.n_removed", "deduped.n_spans", F.sha2("deduped.kept", 256).alias("kept_sha256"),
        "deduped.n_chars")


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return ngram_join.similar_groups(table(spark, folder, "documents"), size=4, num=85, den=100).drop("text_key", "part")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of a document that the mixture draws, with its place."""
    out = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return out.select(
        "doc_id", "source", "mix.n_tokens", F.round("mix.weight", 9).alias("weight"), "mix.epoch", "mix.block_order", "mix.doc_order",
    )


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document, learned from the labels outside fold 2 of 4."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    documents = documents.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    scorer = toxicity.train(documents.filter(~F.col("held_out")), table(spark, folder, "labels").select("doc_id", "toxic"))
    out = toxicity.score(documents, scorer)
    return out.select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in sequences of 1024 ids."""
    return packing.pack(table(spark, folder, "documents"), **tokenizer_files())


def op11_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    import public_tokenizers

    files = {"ranks": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    out = bpe.decode(bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), **files, keep=["doc_id"]), **files)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary")
    return out.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A Merkle manifest of the documents, and what every witness proves of the row, tampered with in one of seven."""
    documents = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    tampered = merkle.leaf(*[more if c == "n_chars" else F.col(c) for c in fields])
    hit = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 7) == 0)
    documents = documents.select(*fields, F.when(hit, tampered).alias("changed"))
    proven = merkle.manifest(documents, "lang", "doc_id", fields, carry=["doc_id", "changed"])
    out = merkle.fold(proven.withColumn("now", F.coalesce("changed", "leaf")), "now")
    return out.select(
        "doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], F.lower(F.hex("proof")).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def tokenizer_files() -> dict[str, str]:
    """The public byte-level vocabulary of 50k tokens, as a tokenizer file and as ranks."""
    import public_tokenizers

    return {
        "tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN,
    }


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_merkle_manifest": op13_merkle_manifest,
}

SQL: dict[str, str] = {
    "op1_quality_rules": QUALITY_SQL,
    "op8_mixing": MIX_SQL,
    "op11_conversation_prefix_trie": TRIE_SQL,
    "op13_merkle_manifest": MERKLE_SQL,
}
