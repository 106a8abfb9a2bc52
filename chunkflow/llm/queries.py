"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import aligning, bytebpe, decontam, langid, lines, minhash, packing, quality, runs, tokencount, topk, urls, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_url_filters": urls.op2_url_filters,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_minhash": minhash.op8_minhash,
    "op9_language_id": langid.op9_language_id,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_byte_bpe": bytebpe.op11_byte_bpe,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_alignment": aligning.op13_alignment,
}

SQL = {
    "op2_url_filters": urls.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op6_warc": warc.OP6_SQL,
}
