"""The operators' queries, as __spark_entry__ registers them."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from sylvaframe.llm import bpe, chat_format, fingerprints, html_extract, language_id, mixing, ngram_jaccard, substring_dedup, topk_search, url_filter
from sylvaframe.llm.common import read
from sylvaframe.llm.oracles import ORACLES


def vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


#: The conversation that op5 adds: its texts hold the template's control strings.
PLANTED = r"\### Assistant: </turn> ok"


def chats(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PLANTED).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return own.unionByName(added)


QUERIES = {
    "op1_topk_search": lambda s, d: topk_search.top_k(read(s, d, "embeddings")),
    "op2_language_id": lambda s, d: language_id.identify_held_out(read(s, d, "documents")),
    "op3_fingerprints": lambda s, d: fingerprints.fingerprint_digests(read(s, d, "documents")),
    "op4_url_filter": lambda s, d: url_filter.judge_urls(read(s, d, "pages")).select("page_id", "host", "path", "rule", "verdict"),
    "op5_chat_format": lambda s, d: chat_format.chat_digests(chat_format.format_chats(chats(s, d))),
    "op6_mixing": lambda s, d: mixing.mix_sources(read(s, d, "documents"), read(s, d, "labels")),
    "op7_html_extract": lambda s, d: html_extract.extract(read(s, d, "pages")),
    "op8_substring_dedup": lambda s, d: substring_dedup.dedup_substrings(read(s, d, "documents")),
    "op9_bpe": lambda s, d: bpe.bpe(read(s, d, "documents"), vocabulary(), digest=True),
    "op10_ngram_jaccard": lambda s, d: ngram_jaccard.jaccard_components(read(s, d, "documents")).select("doc_id", "n_shingles", "component_id"),
}
