"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from slatekit.llm import (decontam, fingerprint, hardneg, langid, licenses, merkle, mixing, neardup, pii,
                          secret_scan, sharding, warc, wordpack)

REGISTRY = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_language_id": langid.op2_language_id,
    "op3_sharding": sharding.op3_sharding,
    "op4_mixing": mixing.op4_mixing,
    "op5_secrets": secret_scan.op5_secrets,
    "op6_personal_data": pii.op6_personal_data,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_licenses": licenses.op9_licenses,
    "op10_warc": warc.op10_warc,
    "op11_token_ids": wordpack.op11_token_ids,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "page_language_id": langid.page_language_id,
}

SQL = {
    "op1_near_duplicates": neardup.SQL,
    "op4_mixing": mixing.SQL,
    "op7_decontamination": decontam.SQL,
    "op10_warc": warc.SQL,
    "op12_hard_negatives": hardneg.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
