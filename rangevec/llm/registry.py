"""Queries and SQL of the operators, by name."""

from __future__ import annotations

from rangevec.llm import context_tree, decontaminate, exact_dedup, language, licenses, lines, packing, pii, simhash, warc

QUERIES = {
    "op1_context_tree": context_tree.op1_context_tree,
    "op2_simhash": simhash.op2_simhash,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_packing": packing.op6_packing,
    "op7_language": language.op7_language,
    "op8_pii": pii.op8_pii,
    "op9_licenses": licenses.op9_licenses,
    "op10_warc": warc.op10_warc,
}

#: DuckDB SQL for those that SQL can express over whole tables.
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
