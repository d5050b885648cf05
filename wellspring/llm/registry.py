"""Queries and SQL of the llm operators."""

from __future__ import annotations

from . import decontaminate, extract, lm, mixing, positive, quality, runs, sharding, simhash, surrogates, toxicity, trie, urls

QUERIES = {
    "op1_extract": extract.op1_extract,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_mix": mixing.op3_mix,
    "op4_surrogates": surrogates.op4_surrogates,
    "op5_score": lm.op5_score,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_shard": sharding.op8_shard,
    "op9_simhash": simhash.op9_simhash,
    "op10_urls": urls.op10_urls,
    "op11_runs": runs.op11_runs,
    "op12_trie": trie.op12_trie,
    "op13_quality": positive.op13_quality,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_mix": mixing.ORACLE,
    "op12_trie": trie.ORACLE,
}
