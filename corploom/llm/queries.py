"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from corploom.llm import brown_ngrams, chat_format, collocations, curriculum_mix, decontaminate, exact_dedup, language_id, license_rules, merkle_manifest, ordinal_quality, prefix_tokens, pu_toxicity, simhash_dedup

MODULES = (chat_format, decontaminate, exact_dedup, ordinal_quality, pu_toxicity, prefix_tokens, curriculum_mix, license_rules, simhash_dedup, brown_ngrams, merkle_manifest, language_id, collocations)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
