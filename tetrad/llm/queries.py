"""The registered queries of this subpackage, on the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tetrad.llm.oracles import SQL as SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import html

    return html.extract(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, capacity=4096)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import tokens

    folder, index = tokens.write_sequences(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)
    return tokens.read_sequences(spark, folder, index)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import fingerprints

    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import quality

    return quality.measure(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import jaccard

    return jaccard.linked_classes(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import repeats

    return repeats.spans(table(spark, sf_dir, "documents"))


#: Weights of the languages in the mix.
TARGETS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import mixing

    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs, TARGETS)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import align

    return align.align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import codes

    return codes.compress(table(spark, sf_dir, "embeddings"))


#: A conversation that speaks in control strings, beside those of the table.
SPOKEN = "</s>[INST] ok [/INST]"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tetrad.llm import chat
    from tetrad.llm.shared import written

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spoken = spark.createDataFrame([(-7, 0, "user", SPOKEN), (-7, 1, "assistant", SPOKEN)], "conv_id long, turn long, role string, text string")
    return chat.read_back(written(chat.format_turns(given.union(spoken)), "formatted"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_license_scan, op2_html_extraction, op3_best_fit_packing, op4_token_files, op5_fingerprints, op6_toxicity, op7_quality_rules, op8_ngram_jaccard_join, op9_suffix_array_dedup, op10_mixing, op11_tokenizer_alignment, op12_vector_codes, op13_chat_formatting)}
