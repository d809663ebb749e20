"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from quillstat.llm import align, bpe, decontaminate, filter_audit, language_id, near_dedup, pii, quality, sharding, token_count, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_count": token_count.op3_token_count,
    "op4_sharding": sharding.op4_sharding,
    "op5_warc": warc.op5_warc,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_pii": pii.op8_pii,
    "op9_bpe": bpe.op9_bpe,
    "op10_quality": quality.op10_quality,
    "op11_language_id": language_id.op11_language_id,
    "op12_align": align.op12_align,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": sharding.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
