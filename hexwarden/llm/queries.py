"""The registered queries of this folder, ``opN_<name>``, and their SQL where SQL can express them."""

from __future__ import annotations

from hexwarden.llm import (
    audit,
    decontamination,
    embeddings,
    licenses,
    maintext,
    mixing,
    passages,
    quality,
    repeats,
    simhash,
    spelling,
    tokenfiles,
    toxicity,
)

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_repeats": repeats.query,
    "op3_embeddings": embeddings.query,
    "op4_passages": passages.query,
    "op5_tokenfiles": tokenfiles.query,
    "op6_licenses": licenses.query,
    "op7_toxicity": toxicity.query,
    "op8_simhash": simhash.query,
    "op9_maintext": maintext.query,
    "op10_decontamination": decontamination.query,
    "op11_audit": audit.query,
    "op12_quality": quality.query,
    "op13_spelling": spelling.query,
}

ORACLES = {
    "op1_mixing": mixing.SQL,
    "op6_licenses": licenses.sql(),
    "op11_audit": audit.SQL,
    "op12_quality": quality.SQL,
    "op13_spelling": spelling.SQL,
}
