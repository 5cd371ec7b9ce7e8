"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers

from promptloom.llm import bpe, conversations, decontaminate, divergence, jaccard, licenses, lm, neighbours, oracle, pii, quality, repeats, toxicity, urls
from promptloom.llm.registry import QUERIES, SQL, query, read

__all__ = ["QUERIES", "SQL"]


@query("op10_bpe")
def op10_bpe(spark, sf):
    return bpe.encode_documents(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_pii")
def op2_pii(spark, sf):
    return pii.report(read(spark, sf, "documents")).drop("found")


@query("op3_toxicity")
def op3_toxicity(spark, sf):
    return toxicity.report(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op4_licenses")
def op4_licenses(spark, sf):
    return licenses.report(read(spark, sf, "documents"))


@query("op5_neighbours")
def op5_neighbours(spark, sf):
    return neighbours.search(read(spark, sf, "embeddings"), "vec_id % 20 = 0")


@query("op6_decontamination", oracle.DECONTAMINATION)
def op6_decontamination(spark, sf):
    found = decontaminate.report(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.drop("items", "spans", "matches", "n_longest")


@query("op8_urls")
def op8_urls(spark, sf):
    return urls.judge(read(spark, sf, "pages"))


@query("op9_repeats", oracle.REPEATS)
def op9_repeats(spark, sf):
    return repeats.remove_repeats(read(spark, sf, "documents"))


@query("op7_jaccard", oracle.JACCARD)
def op7_jaccard(spark, sf):
    return jaccard.near_duplicates(read(spark, sf, "documents"))


@query("op1_lm")
def op1_lm(spark, sf):
    return lm.score_documents(read(spark, sf, "documents"), "crc32(cast(doc_id AS string)) % 10 = 0")


@query("op13_conversations", oracle.CONVERSATIONS)
def op13_conversations(spark, sf):
    return conversations.trie(read(spark, sf, "conversations"))


@query("op11_divergence", oracle.DIVERGENCE)
def op11_divergence(spark, sf):
    return divergence.audit(read(spark, sf, "documents"))


@query("op12_quality")
def op12_quality(spark, sf):
    return quality.report(read(spark, sf, "documents"), read(spark, sf, "labels"))
