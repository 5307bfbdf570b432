"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, html_extract, langid, lm, minhash, mixing, packing, substrings, token_rollup, vector_dedup
from .common import table


#: Tokenizer versions of the token rollup: the English vocabulary that packing uses, then the multilingual one.
TOKENIZERS = {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def _documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    return {
        "op1_substring_dedup": _documents(substrings.digests),
        "op2_nearest_neighbours": lambda spark, sf_dir: ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0),
        "op3_mixing": _documents(mixing.mix),
        "op4_language_id": _documents(langid.predict_languages),
        "op10_lm_scoring": _documents(lm.score),
        "op5_html_extraction": lambda spark, sf_dir: html_extract.extract_pages(table(spark, sf_dir, "pages")),
        "op6_vector_dedup": lambda spark, sf_dir: vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings")),
        "op7_token_rollup": lambda spark, sf_dir: token_rollup.replay(table(spark, sf_dir, "documents"), token_rollup.shared_folder(spark), {n: tokenizer_path(f) for n, f in TOKENIZERS.items()}),
        "op8_minhash_dedup": _documents(lambda docs: minhash.near_duplicates(docs, width=2, percent=80)),
        "op9_packing": _documents(lambda docs: packing.pack(docs, tokenizer_path())),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substrings.ORACLE, "op3_mixing": mixing.ORACLE, "op6_vector_dedup": vector_dedup.ORACLE, "op8_minhash_dedup": minhash.ORACLE}
