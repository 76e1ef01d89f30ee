"""The registered queries of the operators for training text, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import anchors, chosen_path, line_variants, mixing, nn_descent, pieces, sharding, spelling, templates, token_blocks, toxicity, warc, whitening
from hindcast.llm.common import table

#: File of the vocabulary, by its name in the public package of tokenizers, and the id that ends a document.
VOCABULARY, END_ID = "word_bpe_49k.json", 2

#: The same of the merge-type vocabulary for sentencepiece.
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return token_blocks.token_digest(table(spark, folder, "documents"), vocabulary(), END_ID)


def op2_cover_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return anchors.without_repeats(table(spark, folder, "documents"))


def op3_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_digests(table(spark, folder, "pages"))


def op4_chosen_path(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, folder, "documents"))


def op5_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, folder, "embeddings"))


def op6_line_variants(spark: SparkSession, folder: str) -> DataFrame:
    return line_variants.repeated_lines(table(spark, folder, "documents"))


def op7_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, folder, "labels")))


def op8_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return templates.document_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.document_shards(table(spark, folder, "documents"))


def op10_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_spelling_forms(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, folder, "documents"))


def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_digest(table(spark, folder, "documents"), vocabulary(PIECES), END_ID)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_cover_anchors": op2_cover_anchors,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_chosen_path": op4_chosen_path,
    "op5_nn_descent": op5_nn_descent,
    "op6_line_variants": op6_line_variants,
    "op7_toxic_segments": op7_toxic_segments,
    "op8_template_leaks": op8_template_leaks,
    "op9_feistel_shards": op9_feistel_shards,
    "op10_budget_mix": op10_budget_mix,
    "op11_whitening": op11_whitening,
    "op12_spelling_forms": op12_spelling_forms,
    "op13_pieces": op13_pieces,
    "pipeline": pipeline,
}
CHECKS: dict[str, str] = {
    "op3_warc_salvage": warc.PAGE_DIGESTS_SQL,
    "op4_chosen_path": chosen_path.near_duplicates_sql(),
    "op5_nn_descent": nn_descent.NEAR_VECTORS_SQL,
    "op6_line_variants": line_variants.repeated_lines_sql(),
    "op9_feistel_shards": sharding.document_shards_sql(),
    "op12_spelling_forms": spelling.SPELLING_FORMS_SQL,
}
