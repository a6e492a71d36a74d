"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidemark.llm.alignment import LEFT, RIGHT, align_tokenizers
from tidemark.llm.common import table
from tidemark.llm.hilbert import hilbert_shards
from tidemark.llm.html import extract
from tidemark.llm.lempel_ziv import fingerprints
from tidemark.llm.mixing import mixing_rates
from tidemark.llm.neighbours import near_vectors
from tidemark.llm.packing import TOKENIZER, pack_documents
from tidemark.llm.prefixes import TOKENIZER as BYTE_TOKENIZER
from tidemark.llm.prefixes import count_tokens
from tidemark.llm.secrets import find_secrets
from tidemark.llm.simhash import simhash_components
from tidemark.llm.substring import remove_repeats
from tidemark.llm.toxicity import severity
from tidemark.llm.variants import spelling_variants


def op1_ordinal_toxicity(spark, sf_dir):
    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_soft_mixing(spark, sf_dir):
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_difference_cover(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_lempel_ziv(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_dom_boosting(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str = TOKENIZER):
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_randomness_battery(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op9_hilbert_shards(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents"))


def op10_simhash_golay(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_prefix_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_TOKENIZER))


def op12_spelling_trie(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file(LEFT), tokenizer_file(RIGHT))


def queries():
    return {
        "op1_ordinal_toxicity": op1_ordinal_toxicity,
        "op2_soft_mixing": op2_soft_mixing,
        "op3_difference_cover": op3_difference_cover,
        "op4_nn_descent": op4_nn_descent,
        "op5_lempel_ziv": op5_lempel_ziv,
        "op6_dom_boosting": op6_dom_boosting,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_randomness_battery": op8_randomness_battery,
        "op9_hilbert_shards": op9_hilbert_shards,
        "op10_simhash_golay": op10_simhash_golay,
        "op11_prefix_counts": op11_prefix_counts,
        "op12_spelling_trie": op12_spelling_trie,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql():
    return {}
