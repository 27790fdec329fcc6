"""The pN_ queries and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this subpackage that defines it
_MODULES = {
    "p1_found": "bundles",
    "p1_bundles": "bundles",
    "p2_found": "canonical",
    "p3_found": "defects",
    "p4_found": "truncation",
    "p4_rates": "truncation",
    "p5_found": "neardup",
    "p5_groups": "neardup",
    "p6_found": "repetition",
    "p6_shares": "repetition",
    "p7_ids": "tokens",
    "p8_found": "leakage",
    "p8_leaks": "leakage",
    "p9_pieces": "splitting",
}


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({text}, '<\|[^|]*\|>', ' ', 'g')), '[\pL\pN]+')"


def _runs(words: str, n: int) -> str:
    return f"list_transform(range(1, CAST(len({words}) - {n} + 2 AS BIGINT)), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))"


_TEXTS = """texts AS (SELECT 'chosen' AS field_name, pair_id AS id, chosen AS t FROM preference_pair UNION SELECT 'rejected', pair_id, rejected FROM preference_pair UNION SELECT 'response', response_id, response FROM sampled_response)"""


def queries() -> dict:
    return {name: getattr(import_module(f"tracemill.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """WITH n AS (SELECT sample_id, len(rtrim(array_to_string(list_transform(coalesce(input_ids, []), lambda x: CASE WHEN x = 0 THEN ' ' ELSE 'x' END), ''))) AS tokens, coalesce(len(pixel_values), 0) AS tiles FROM packing_sample)
SELECT DISTINCT sample_id FROM n WHERE tokens > 8192 OR tiles > 40""",
        "p5_found": f"""WITH {_TEXTS}, w AS (SELECT field_name, id, {_words('t')} AS w FROM texts WHERE t IS NOT NULL), g AS (SELECT DISTINCT field_name, id, unnest({_runs('w', 3)}) AS g FROM w WHERE len(w) >= 30),
n AS (SELECT field_name, id, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT a.field_name, a.id AS id_a, b.id AS id_b, count(*) AS s FROM g a JOIN g b ON a.field_name = b.field_name AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT s.field_name, id_a, id_b FROM s JOIN n x ON x.field_name = s.field_name AND x.id = id_a JOIN n y ON y.field_name = s.field_name AND y.id = id_b WHERE s / (x.n + y.n - s) >= 0.6""",
        "p6_found": f"""WITH v AS (SELECT 'conversations.value' AS field_name, conv_id AS record_id, CAST(generate_subscripts(conversations, 1) - 1 AS INTEGER) AS turn_pos, unnest(conversations).value AS t FROM conversation_record
UNION SELECT 'chosen', pair_id, -1, chosen FROM preference_pair UNION SELECT 'rejected', pair_id, -1, rejected FROM preference_pair),
w AS (SELECT field_name, record_id, turn_pos, {_words('t')} AS w FROM v WHERE t IS NOT NULL), g AS (SELECT field_name, record_id, turn_pos, {_runs('w', 5)} AS g FROM w WHERE len(w) >= 20)
SELECT DISTINCT field_name, record_id, turn_pos FROM g WHERE 1 - len(list_distinct(g)) / len(g) >= 0.3""",
        "p8_found": f"""WITH i AS (SELECT item_id, {_words('item_text')} AS w FROM eval_items), x AS (SELECT DISTINCT item_id, unnest({_runs('w', 12)}) AS g FROM i WHERE len(w) >= 12),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest({_runs('w', 12)}) AS g FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM y JOIN x USING (g)""",
    }
