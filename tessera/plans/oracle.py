"""DuckDB text of the fixture views (FIXTURES.md part 2) and a helper that
prepends the ones a query needs as CTEs. Used only by ``oracle_sql()``."""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[list[str], str]] = {
    "fx_event": ([], """
        SELECT event_id, user_id AS csno, ts, CAST(weekofyear(ts) AS INTEGER) AS wk, value,
               'm' || json_extract_string(props, '$.k') AS word
        FROM events"""),
    "fx_dict": ([], """
        SELECT 'm' || CAST(p_partkey - p_partkey % 3 AS VARCHAR) AS word,
               list(DISTINCT p_type ORDER BY p_type) AS categories
        FROM part GROUP BY 1"""),
    "fx_target": ([], """
        SELECT * FROM (VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('SMALL', 4))
        AS t(category, class_id)"""),
    "fx_truth": (["fx_event"], """
        SELECT csno, list(word ORDER BY ts, event_id) AS words
        FROM fx_event WHERE wk >= 4 GROUP BY csno"""),
    "fx_cand": (["fx_event"], """
        SELECT csno, wk AS cand_no, list(word ORDER BY ts, event_id) AS words
        FROM fx_event WHERE wk <= 3 GROUP BY csno, wk"""),
    "fx_tok_e": (["fx_event"], """
        SELECT csno, wk AS cand_no, word, value,
               row_number() OVER (PARTITION BY csno, wk ORDER BY ts, event_id) AS n,
               count(*) OVER (PARTITION BY csno, wk) AS n_last
        FROM fx_event WHERE wk <= 3"""),
    "fx_token": (["fx_tok_e"], """
        SELECT csno, cand_no, CAST(2*n-1 AS INTEGER) AS pos, word[1:2] AS token, -value/100 AS score
        FROM fx_tok_e
        UNION ALL
        SELECT csno, cand_no, CAST(2*n AS INTEGER), '##' || word[3:], -value/200
        FROM fx_tok_e WHERE length(word) > 2
        UNION ALL
        SELECT csno, cand_no, CAST(2*n+1 AS INTEGER), '[EOW]', -0.5 FROM fx_tok_e WHERE n = n_last
        UNION ALL
        SELECT csno, cand_no, CAST(2*n+2 AS INTEGER), '[' || cand_no || ']', -0.25 FROM fx_tok_e WHERE n = n_last"""),
    "fx_pair": (["fx_cand", "fx_truth"], """
        SELECT c.csno, c.cand_no, array_to_string(c.words, ' ') AS cand,
               array_to_string(t.words, ' ') AS answer
        FROM fx_cand c JOIN fx_truth t USING (csno)"""),
    "fx_done": ([], """
        SELECT user_id AS csno FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00'"""),
    "fx_special": ([], """
        SELECT * FROM (VALUES ('[EOHW]', 1), ('[EOW]', 2)) s(token, ord)
        UNION ALL SELECT '[' || i || ']', i + 2 FROM range(1, 53) r(i)"""),
    "fx_vocab_base": (["fx_token"], """
        SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id
        FROM (SELECT DISTINCT token FROM fx_token)"""),
    "fx_vocab": (["fx_vocab_base", "fx_special"], """
        SELECT token, id FROM fx_vocab_base
        UNION ALL
        SELECT token, CAST((SELECT max(id) FROM fx_vocab_base) + row_number() OVER (ORDER BY ord) AS INTEGER)
        FROM fx_special WHERE token NOT IN (SELECT token FROM fx_vocab_base)"""),
    # H22 + C3 on the dictionary side: (word, class_id) of target words.
    "fx_dict_one": (["fx_dict", "fx_target"], """
        SELECT u.word, arg_min(u.category, (CASE WHEN t.class_id IS NULL THEN 1 ELSE 0 END) * 1000000 + u.pos) AS category
        FROM (SELECT word, unnest(categories) AS category,
                     unnest(generate_series(1, len(categories))) AS pos FROM fx_dict) u
        LEFT JOIN fx_target t USING (category) GROUP BY u.word"""),
    "fx_word_class": (["fx_dict_one", "fx_target"], """
        SELECT d.word, t.class_id FROM fx_dict_one d JOIN fx_target t USING (category)
        WHERE d.category IS NOT NULL AND length(d.category) > 0"""),
    "fx_true_cls": (["fx_truth", "fx_word_class"], """
        SELECT x.csno, coalesce(list(DISTINCT wc.class_id ORDER BY wc.class_id)
                                FILTER (WHERE wc.class_id IS NOT NULL), []) AS classes
        FROM (SELECT csno, replace(unnest(words), '#', '') AS word FROM fx_truth) x
        LEFT JOIN fx_word_class wc USING (word) GROUP BY x.csno"""),
    "fx_pred_cls": (["fx_cand", "fx_word_class"], """
        SELECT x.csno, coalesce(list(DISTINCT wc.class_id ORDER BY wc.class_id)
                                FILTER (WHERE wc.class_id IS NOT NULL), []) AS classes
        FROM (SELECT csno, replace(unnest(words), '#', '') AS word FROM fx_cand) x
        LEFT JOIN fx_word_class wc USING (word) GROUP BY x.csno"""),
    # Evaluation rows: one per customer with truth, multi-hot over classes 0..4.
    "fx_eval": (["fx_true_cls", "fx_pred_cls", "fx_target"], """
        SELECT t.csno,
               list_transform(range(0, (SELECT max(class_id) FROM fx_target) + 1),
                   lambda c: CAST(list_contains(t.classes, c) AS INTEGER)) AS y_true_ml,
               list_transform(range(0, (SELECT max(class_id) FROM fx_target) + 1),
                   lambda c: CAST(list_contains(coalesce(p.classes, []), c) AS INTEGER)) AS y_pred_ml
        FROM fx_true_cls t LEFT JOIN fx_pred_cls p USING (csno)"""),
    "fx_confusion": (["fx_eval"], """
        SELECT CAST(c AS INTEGER) AS class,
               CAST(sum(y_true_ml[c+1] * y_pred_ml[c+1]) AS BIGINT) AS tp,
               CAST(sum((1 - y_true_ml[c+1]) * y_pred_ml[c+1]) AS BIGINT) AS fp,
               CAST(sum(y_true_ml[c+1] * (1 - y_pred_ml[c+1])) AS BIGINT) AS fn,
               CAST(sum((1 - y_true_ml[c+1]) * (1 - y_pred_ml[c+1])) AS BIGINT) AS tn
        FROM (SELECT *, unnest(range(0, len(y_true_ml))) AS c FROM fx_eval) GROUP BY c"""),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for dep in FIXTURE_SQL[n][0]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(needs: list[str], body: str, ctes: list[tuple[str, str]] = (),
                  recursive: bool = False) -> str:
    """``WITH <fixtures needed, in dependency order>, <own ctes> <body>``."""
    parts = [f"{n} AS ({FIXTURE_SQL[n][1]})" for n in _order(needs)]
    parts += [f"{n} AS ({q})" for n, q in ctes]
    kw = "WITH RECURSIVE " if recursive else "WITH "
    head = (kw + ",\n".join(parts) + "\n") if parts else ""
    return head + body
