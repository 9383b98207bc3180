"""Queries and SQL of this subpackage, for the entry point."""

from __future__ import annotations

from cairn.llm import langid, licenses, minhash, mixing, neighbours, packing, quality, records, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_minhash": minhash.op3_minhash,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_records": records.op5_token_records,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": langid.op7_language_id,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_packing": packing.op10_packing,
}

SQL = {
    "op6_mixing": mixing.SQL,
}
