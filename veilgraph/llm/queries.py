"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from . import bpe, chat, codes, jaccard, media, mixing, pii, secrets_scan, toxicity, vectors
from .scratch import table


def op4_media_chunks(spark, sf_dir):
    """Media as content-defined chunks, put together again and verified."""
    return media.op4(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_addressable_codes(spark, sf_dir):
    """Token ids as directly addressable codes, read back from the files."""
    return codes.op5(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ngram_jaccard(spark, sf_dir):
    """N-gram Jaccard join: 3-word shingles, 90 %, and the components of its links."""
    return jaccard.op6(table(spark, sf_dir, "documents"))


def op7_tool_links(spark, sf_dir):
    """Chat formatting with tool calls linked, ordered, validated and in canonical JSON."""
    return chat.op7(table(spark, sf_dir, "conversations"))


def op8_numpy_bpe(spark, sf_dir):
    """BPE encoding and decoding in batched numpy merge rounds."""
    return bpe.op8(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_sorted_projections(spark, sf_dir):
    """Embedding near-duplicates by sorted projection passes."""
    return vectors.op9(table(spark, sf_dir, "embeddings"))


def op10_pareto_mix(spark, sf_dir):
    """Mixing sources to target weights by Pareto order sampling."""
    return mixing.op10(table(spark, sf_dir, "documents"))


def op1_nearest_toxicity(spark, sf_dir):
    """Toxicity by nearest labelled examples under exact TF-IDF cosine."""
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_infotheoretic_pii(spark, sf_dir):
    """Personal data by base patterns and information-theoretic sanitisation."""
    return pii.op2(table(spark, sf_dir, "documents"))


def op3_markov_secrets(spark, sf_dir):
    """Secrets by base patterns and two character Markov models."""
    return secrets_scan.op3(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nearest_toxicity": op1_nearest_toxicity,
    "op2_infotheoretic_pii": op2_infotheoretic_pii,
    "op3_markov_secrets": op3_markov_secrets,
    "op4_media_chunks": op4_media_chunks,
    "op5_addressable_codes": op5_addressable_codes,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_tool_links": op7_tool_links,
    "op8_numpy_bpe": op8_numpy_bpe,
    "op9_sorted_projections": op9_sorted_projections,
    "op10_pareto_mix": op10_pareto_mix,
}

ORACLE_SQL = {
    "op10_pareto_mix": mixing.ORACLE,
}
