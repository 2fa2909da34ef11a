"""The registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from . import chat, cover_tree, language_id, language_model, merge_dropout, packing, quality_classifier, quality_rules, simhash, token_counts

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_cover_tree": cover_tree.op2_cover_tree,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_language_id": language_id.op7_language_id,
    "op8_merge_dropout": merge_dropout.op8_merge_dropout,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat_prefix_tree": chat.op10_chat_prefix_tree,
}

_V = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"

ORACLE = {
    "op2_cover_tree": f"""
        WITH v AS (SELECT vec_id, {_V} AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                     CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
}
