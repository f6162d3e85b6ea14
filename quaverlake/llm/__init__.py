"""Operators of a training-data pipeline. Each module has `query` and `SQL` (None: SQL can't express it)."""

from . import ann, chat, decontaminate, divergence, filter_audit, minhash, packing, pii, sharding, simhash, toxicity, unigram, warc

_MODULES = {
    "op1_pii": pii,
    "op2_toxicity": toxicity,
    "op3_packing": packing,
    "op4_neighbours": ann,
    "op5_simhash": simhash,
    "op6_sharding": sharding,
    "op7_sentencepiece": unigram,
    "op8_warc": warc,
    "op9_chat": chat,
    "op10_decontaminate": decontaminate,
    "op11_filter_audit": filter_audit,
    "op12_divergence": divergence,
    "op13_minhash": minhash,
}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if m.SQL}
