"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from . import audit, bytebpe, jaccard, licenses, lines, mixing, order, pieces, pii, quality, toxicity, turns, vectors

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_personal_data": pii.op2_personal_data,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_training_order": order.op5_training_order,
    "op6_pieces": pieces.op6_pieces,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_embedding_dedup": vectors.op9_embedding_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_byte_bpe": bytebpe.op11_byte_bpe,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_turn_repair": turns.op13_turn_repair,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL, "op3_ngram_jaccard": jaccard.OP3_SQL, "op4_source_mixing": mixing.OP4_SQL, "op9_embedding_dedup": vectors.OP9_SQL, "op12_filter_audit": audit.OP12_SQL,
    "op13_turn_repair": turns.OP13_SQL,
}
