"""The same results as ``turnwise.plans.catalog.QUERIES``, in SQL for DuckDB."""

from __future__ import annotations

TOKEN = r"<\|im_start\|>|<\|im_end\|>|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\r\f\x0B]"
NL = "chr(10)"


def _turn(role: str, content: str) -> str:
    return f"('<|im_start|>' || {role} || {NL} || {content} || '<|im_end|>' || {NL})"


HEADER = f"('<|im_start|>assistant' || {NL})"

EXCHANGES = """exchanges AS (
  SELECT a.conv_id, a.turn, a.conv_id || '-' || a.turn AS row_id, a.text AS asked, b.text AS answered,
         coalesce(s.system, '') AS system
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON s.conv_id = a.conv_id
  WHERE a.role = 'user' AND b.role = 'assistant')"""
ANSWERED = EXCHANGES + ", answered AS (SELECT row_id, asked, answered, system FROM exchanges)"
PAIRED = EXCHANGES + """, paired AS (
  SELECT a.row_id, a.conv_id, a.turn, a.system, a.asked, a.answered, b.asked AS asked_later, b.answered AS answered_later
  FROM exchanges a JOIN exchanges b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2)"""

ALPACA_USER = f"CASE WHEN system <> '' THEN asked || {NL} || {NL} || system ELSE asked END"
ALPACA_TEXT = _turn("'user'", f"({ALPACA_USER})") + " || " + _turn("'assistant'", "answered")
ORCA_PROMPT = (
    f"CASE WHEN system <> '' THEN {_turn(chr(39) + 'system' + chr(39), 'system')} ELSE '' END || "
    + _turn("'user'", "asked")
)
ORCA_TEXT = ORCA_PROMPT + " || " + _turn("'assistant'", "answered")


def _cut(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN}')"


def _vocabulary(table: str, size: int | None = None) -> str:
    """CTE ``voc(token, n, id)``, of all tokens or of the most frequent ones."""
    limit = "" if size is None else f"WHERE id < {size}"
    return f"""words AS (SELECT unnest({_cut('text')}) AS token FROM {table}),
      counted AS (SELECT token, count(*) AS n FROM words GROUP BY token),
      ranked AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM counted),
      voc AS (SELECT token, n, id FROM ranked {limit})"""


def _ids(source: str, key: str, text: str, unknown: int = -1) -> str:
    """CTE ``ids(key, ids)`` with one id list per row of ``source``."""
    return f"""pieces AS (SELECT {key}, {_cut(text)} AS toks FROM {source}),
      placed AS (SELECT {key}, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM pieces),
      numbered AS (SELECT {key}, list(coalesce(id, {unknown}) ORDER BY pos) AS found
                   FROM placed LEFT JOIN voc USING (token) GROUP BY {key}),
      ids AS (SELECT {key}, coalesce(found, []) AS ids FROM pieces LEFT JOIN numbered USING ({key}))"""


def _bytes(text: str) -> str:
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    return f"list_transform({pairs}, lambda p: ('0x' || p)::INT)"


def _digest(values: str) -> str:
    return f"md5(array_to_string({values}, ','))"


ENCODED = f"""WITH {_vocabulary('documents')}, {_ids('documents', 'doc_id', 'text')}
  SELECT doc_id, len(ids)::BIGINT AS n_ids, {_digest('ids')} AS digest FROM ids"""

def _labelled(ctes: str, ids: str, ignored: str) -> str:
    """``ignored`` is the number of leading labels that are -100; it may exceed the number of ids."""
    label = f"list_concat(list_transform(range(0, {ignored}), lambda i: -100), {ids}[{ignored} + 1:])"
    return f"""WITH {ctes}, kept AS (SELECT row_id, {ids} AS k, {ignored} AS ign, {label} AS lab FROM source)
      SELECT row_id, len(k)::BIGINT AS n_ids, {_digest('k')} AS ids_digest, len(k)::BIGINT AS n_attended,
             len(lab)::BIGINT AS n_labels, len(list_filter(lab, lambda x: x = -100))::BIGINT AS n_ignored,
             {_digest('lab')} AS labels_digest
      FROM kept"""


CHAT_IDS = f"""{ANSWERED},
   source AS (SELECT row_id, {_bytes(f'({ORCA_TEXT})')} AS ids, octet_length(encode({ORCA_PROMPT} || {HEADER})) AS p
              FROM answered)"""

CHAT_WORDS = f"""{ANSWERED},
   chats AS (SELECT row_id, {ORCA_TEXT} AS text, len({_cut(f'({ORCA_PROMPT} || {HEADER})')}) AS p FROM answered),
   {_vocabulary('chats')}, {_ids('chats', 'row_id', 'text')},
   source AS (SELECT row_id, ids, p FROM ids JOIN chats USING (row_id))"""

CONVERSATION_IDS = f"""
   firsts AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS f FROM conversations GROUP BY conv_id),
   texts AS (SELECT conv_id AS row_id, string_agg({_turn('role', 'text')}, '' ORDER BY turn) AS text,
                    octet_length(encode(coalesce(string_agg({_turn('role', 'text')}, '' ORDER BY turn)
                                 FILTER (f IS NULL OR turn < f), '') || {HEADER})) AS p
             FROM conversations JOIN firsts USING (conv_id) GROUP BY conv_id),
   source AS (SELECT row_id, {_bytes('text')} AS ids, p FROM texts)"""

BYTE_IDS = f"{ANSWERED}, source AS (SELECT row_id, {_bytes(f'({ALPACA_TEXT})')} AS ids FROM answered)"


def _padded(side: str) -> str:
    def pad(values: str, fill: int) -> str:
        gap = f"list_transform(range(0, w - len({values})), lambda i: {fill})"
        return f"list_concat({gap}, {values})" if side == "left" else f"list_concat({values}, {gap})"

    return f"""WITH {BYTE_IDS},
      placed AS (SELECT row_id, ids[:400] AS k,
                        (row_number() OVER (ORDER BY md5(row_id || '-42')) - 1) // 16 AS batch_id FROM source),
      sized AS (SELECT *, max(len(k)) OVER (PARTITION BY batch_id) AS w,
                       list_transform(k, lambda x: 1) AS mask FROM placed)
      SELECT row_id, batch_id::BIGINT AS batch_id, w::BIGINT AS width, {_digest(pad('k', 256))} AS ids_digest,
             {_digest(pad('mask', 0))} AS mask_digest, {_digest(pad('k', -100))} AS labels_digest
      FROM sized"""


def _exact_split(source: str, key: str, size: float) -> str:
    return f"""SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5({key} || '-42'))
                 <= ceil(count(*) OVER () * {size}::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM {source}"""


def _hash_split(key: str, size: float) -> str:
    lead = f"('0x' || substr(md5({key} || '-42'), 1, 8))::BIGINT"
    return f"CASE WHEN {lead} / 4294967296.0::DOUBLE < {size} THEN 'validation' ELSE 'train' END"


TRIPLES = f"{PAIRED}, triples AS (SELECT row_id, asked AS prompt, answered AS chosen, answered_later AS rejected FROM paired)"

PREDICTIONS = """predictions AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS model, event_type AS task,
         event_id AS doc_id, (value > 10)::INT::DOUBLE AS correct FROM events)"""
METRICS = """metrics AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS model,
         event_type || '-' || floor(value / 20)::INT AS task, avg((event_id % 5 > 1)::INT::DOUBLE) AS value
  FROM events GROUP BY ALL)"""
WIDE = METRICS + """, wide AS (
  SELECT task, max(value) FILTER (model = 'base') AS base, max(value) FILTER (model = 'sft') AS sft,
         max(value) FILTER (model = 'dpo') AS dpo FROM metrics GROUP BY task)"""


def _points_text(after: str, before: str) -> str:
    diff = f"(({after} - {before}) * 100)"
    return f"coalesce(CASE WHEN {diff} > 0 THEN '+' ELSE '' END || printf('%.1f', {diff}) || '%', '')"


def _value_text(c: str) -> str:
    return f"CASE WHEN coalesce({c}, 0) <> 0 THEN printf('%.2f', {c} * 100) ELSE 'N/A' END"


TEXT = f"""{WIDE}, shown AS (
  SELECT task, {_value_text('base')} AS base, {_value_text('sft')} AS sft, {_value_text('dpo')} AS dpo,
         {_points_text('sft', 'base')} AS sft_vs_base, {_points_text('dpo', 'sft')} AS dpo_vs_sft FROM wide)"""
STAGE = "CASE model WHEN 'base' THEN 1 WHEN 'sft' THEN 2 ELSE 3 END"

PRICE = "o_totalprice::DECIMAL(15,2)::VARCHAR"
RESPONSES = f"""responses AS (
  SELECT o_orderkey AS doc_id, 'Steps' || {NL} || '#### ' || {PRICE} AS answer,
    CASE o_orderkey % 4
      WHEN 0 THEN 'Adding up.' || {NL} || '#### ' || {PRICE}
      WHEN 1 THEN 'It costs $' || {PRICE} || '. Question: next </s>'
      WHEN 2 THEN '#### 1,' || {PRICE} || ' then #### 7<|im_end|> Question:'
      ELSE 'no idea' END AS response FROM orders)"""
STRICT = "nullif(regexp_extract({0}, '#### (\\-?[0-9\\.\\,]+)', 1), '')"
FLEXIBLE = "regexp_extract_all({0}, '(-?[$0-9.,]{{2,}})|(-?[0-9]+)')[-1]"
CUT = "regexp_replace(response, '(?s)(Question:|</s>|<\\|im_end\\|>).*$', '')"
NORMAL = (
    "lower(regexp_replace(regexp_replace(replace(replace({0}, ',', ''), '$', ''), '(?s).*#### ', '', 'g'), "
    "'\\.$', '', 'g'))"
)


def _matched(found: str) -> str:
    return f"coalesce({NORMAL.format(found)} = {NORMAL.format('answer')}, false)::INT::DOUBLE"


def _first_upper(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"


def _checks() -> str:
    names = ("conversations", "documents", "events", "orders", "embeddings")
    rows = [f"SELECT '{n}' AS \"check\", count(*) AS n_rows, count(*) > 0 AS passed FROM {n}" for n in names]
    return " UNION ALL ".join(rows)


ORACLES: dict[str, str] = {
    "conversation_messages": f"""
      SELECT conv_id, 0::BIGINT AS part, 1::BIGINT AS n_parts, count(*) AS n_messages,
             md5(string_agg(role || ':' || text, {NL} ORDER BY turn)) AS digest
      FROM conversations GROUP BY conv_id""",
    "alpaca_messages": f"""WITH {ANSWERED}
      SELECT row_id, 2::BIGINT AS n_messages,
             md5('user:' || ({ALPACA_USER}) || {NL} || 'assistant:' || answered) AS digest FROM answered""",
    "openorca_messages": f"""WITH {ANSWERED}
      SELECT row_id, CASE WHEN system <> '' THEN 3 ELSE 2 END::BIGINT AS n_messages,
             md5(CASE WHEN system <> '' THEN 'system:' || system || {NL} ELSE '' END
                 || 'user:' || asked || {NL} || 'assistant:' || answered) AS digest FROM answered""",
    "sharegpt_messages": f"""
      SELECT conv_id || '-0' AS row_id, count(*) AS n_messages,
             md5(string_agg(CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ':' || text, {NL}
                            ORDER BY turn)) AS digest
      FROM conversations GROUP BY conv_id""",
    "ultrafeedback_triples": f"WITH {TRIPLES} SELECT * FROM triples",
    "hh_triples": f"""WITH {PAIRED}
      SELECT row_id, '' AS prompt,
             {NL} || {NL} || 'Human: ' || asked || {NL} || {NL} || 'Assistant: ' || answered AS chosen,
             {NL} || {NL} || 'Human: ' || asked || {NL} || {NL} || 'Assistant: ' || answered_later AS rejected
      FROM paired""",
    "hh_prompt_recovery": f"""WITH {PAIRED},
      sides AS (SELECT row_id, asked = CASE WHEN turn % 4 < 2 THEN asked ELSE asked_later END AS same,
                       system || {NL} || {NL} || 'Human: ' || asked || {NL} || {NL} || 'Assistant:' AS head, answered,
                       system || {NL} || {NL} || 'Human: ' || CASE WHEN turn % 4 < 2 THEN asked ELSE asked_later END
                         || {NL} || {NL} || 'Assistant:' AS other, answered_later FROM paired)
      SELECT row_id, CASE WHEN same THEN head ELSE '' END AS prompt,
             CASE WHEN same THEN '' ELSE head END || ' ' || answered AS chosen,
             CASE WHEN same THEN '' ELSE other END || ' ' || answered_later AS rejected, same AS recovered FROM sides""",
    "rejected_instructions": f"""WITH {ANSWERED}
      SELECT conv_id || '-' || turn AS row_id, text AS instruction FROM conversations
      WHERE role = 'user' AND conv_id || '-' || turn NOT IN (SELECT row_id FROM answered)""",
    "contaminated_documents": """
      WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents),
      b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM benchmark),
      runs AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 7], ' ') AS run
               FROM (SELECT doc_id, w, unnest(range(1, len(w) - 7 + 1)) AS k FROM d WHERE len(w) >= 8)),
      wanted AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS run
                 FROM (SELECT item_id, w, unnest(range(1, len(w) - 7 + 1)) AS k FROM b WHERE len(w) >= 8)),
      short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS run FROM b WHERE len(w) BETWEEN 1 AND 7),
      met AS (SELECT doc_id, item_id FROM runs JOIN wanted USING (run)
              UNION SELECT doc_id, item_id FROM d JOIN short ON contains(' ' || array_to_string(w, ' ') || ' ', run)),
      hits AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM met GROUP BY doc_id)
      SELECT doc_id, coalesce(n, 0) AS n_items, coalesce(n, 0) > 0 AS contaminated FROM documents LEFT JOIN hits USING (doc_id)""",
    "helpsteer_unchanged": "SELECT * FROM labels",
    "chat_render": f"SELECT conv_id, turn, {_turn('role', 'text')} AS rendered FROM conversations",
    "chat_render_lists": f"WITH {ANSWERED} SELECT row_id, {ORCA_TEXT} AS rendered FROM answered",
    "generation_prompt": f"WITH {ANSWERED} SELECT row_id, {ORCA_PROMPT} || {HEADER} AS prompt FROM answered",
    "prompt_part": """
      WITH first AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS f FROM conversations GROUP BY conv_id)
      SELECT conv_id, turn, role, text FROM conversations JOIN first USING (conv_id) WHERE f IS NULL OR turn < f""",
    "vocabulary_topk": f"WITH {_vocabulary('documents', 2000)} SELECT token, n, id FROM voc",
    "encode_regex": ENCODED,
    "encode_join": ENCODED,
    "encode_bytes": f"""WITH b AS (SELECT doc_id, {_bytes('text')} AS ids FROM documents)
      SELECT doc_id, len(ids)::BIGINT AS n_ids, {_digest('ids')} AS digest FROM b""",
    "full_labels": _labelled(CHAT_IDS, "ids[:256]", "0"),
    "completion_labels": _labelled(CHAT_IDS, "ids[:256]", "least(p, len(ids[:256]))"),
    "completion_labels_compat": _labelled(CHAT_IDS, "ids[:64]", "p"),
    "conversation_labels": _labelled(CONVERSATION_IDS, "ids[:256]", "least(p, len(ids[:256]))"),
    "conversation_labels_compat": _labelled(CONVERSATION_IDS, "ids[:64]", "p"),
    "completion_labels_join": _labelled(CHAT_WORDS, "ids[:40]", "least(p, len(ids[:40]))"),
    "saved_corpus_read": f"""WITH {ANSWERED}
      SELECT row_id, asked AS instruction, system AS input, answered AS output FROM answered WHERE length(asked) % 5 <> 0""",
    "json_corpus_read": f"""WITH {ANSWERED}
      SELECT 'json' AS found_as, row_number() OVER (ORDER BY row_id) - 1 AS row_id, asked AS instruction, system AS input,
             answered AS output FROM answered""",
    "preference_corpus_read": f"WITH {TRIPLES} SELECT * FROM triples WHERE length(prompt) % 3 = 1",
    "prepared_preference_files": f"WITH {TRIPLES} SELECT * FROM triples",
    "result_files_read": f"WITH {METRICS} SELECT model, task, round(value, 6) AS value FROM metrics",
    "metrics_file_read": f"WITH {METRICS} SELECT model, task, round(value, 6) AS value FROM metrics",
    "special_tokens": _labelled(BYTE_IDS, "list_concat([256], ids[:298], [257])", "0"),
    "padded_batches_right": _padded("right"),
    "padded_batches_left": _padded("left"),
    "length_filter": """SELECT doc_id, octet_length(encode(text))::BIGINT AS n_ids FROM documents
      WHERE octet_length(encode(text)) <= 1500""",
    "overlong_count": """SELECT count(*) AS n_rows,
      count(*) FILTER (octet_length(encode(text)) > 1500) AS n_dropped FROM documents""",
    "preference_budget": f"""WITH {TRIPLES},
      n AS (SELECT row_id, len({_cut('prompt')})::BIGINT AS prompt_tokens, len({_cut('chosen')})::BIGINT
            AS chosen_tokens, len({_cut('rejected')})::BIGINT AS rejected_tokens FROM triples)
      SELECT *, prompt_tokens <= 40 AS prompt_fits,
             prompt_tokens + greatest(chosen_tokens, rejected_tokens) <= 180 AS pair_fits FROM n""",
    "allowed_tasks": "SELECT event_id, event_type AS task FROM events WHERE event_type IN ('click', 'view', 'piqa')",
    "exact_split": _exact_split("documents", "doc_id", 0.02),
    "hash_split": f"SELECT doc_id, {_hash_split('doc_id', 0.02)} AS split FROM documents",
    "preference_split": f"WITH {TRIPLES} {_exact_split('triples', 'row_id', 0.1)}",
    "split_stats": f"""
      WITH whole AS (SELECT conv_id, string_agg({_turn('role', 'text')}, '' ORDER BY turn) AS text
                     FROM conversations GROUP BY conv_id),
      n AS (SELECT {_hash_split('conv_id', 0.2)} AS split, len({_cut('text')}) AS t FROM whole)
      SELECT split, count(*) AS n_rows, min(t)::BIGINT AS min_tokens, max(t)::BIGINT AS max_tokens,
             round(avg(t), 6) AS avg_tokens FROM n GROUP BY split""",
    "split_rows": f"SELECT split, count(*) AS n_rows FROM ({_exact_split('documents', 'doc_id', 0.02)}) GROUP BY split",
    "corpus_rows": f"WITH {TRIPLES} SELECT count(*) AS n_rows FROM triples",
    "prepared_alpaca": f"""WITH {BYTE_IDS}, parts AS ({_exact_split('answered', 'row_id', 0.02)})
      SELECT row_id, split, len(ids[:256])::BIGINT AS n_ids, {_digest('ids[:256]')} AS labels_digest
      FROM source JOIN parts USING (row_id)""",
    "preview": """SELECT doc_id AS row_id, substr(text, 1, 50) || '...' AS preview FROM documents
      ORDER BY doc_id LIMIT 5""",
    "table_checks": _checks(),
    "all_passed": f"SELECT bool_and(passed) AS all_passed FROM ({_checks()})",
    "primary_metric": """
      SELECT event_id, event_type AS task, CASE event_id % 6 WHEN 4 THEN 1.0 ELSE value END AS value
      FROM events WHERE event_id % 6 <> 5""",
    "run_times": """SELECT event_id, make_timestamp(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) AS run_at FROM events""",
    "latest_result": f"""
      WITH m AS (SELECT CASE user_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS model, event_id, ts
                 FROM events)
      SELECT model, arg_max(event_id, (date_trunc('year', ts), ts)) AS event_id FROM m GROUP BY model""",
    "comparison": f"""WITH {WIDE}
      SELECT task, round(base, 6) AS base, round(sft, 6) AS sft, round(dpo, 6) AS dpo,
             round((sft - base) * 100, 6) AS sft_vs_base, round((dpo - sft) * 100, 6) AS dpo_vs_sft FROM wide""",
    "comparison_text": f"WITH {TEXT} SELECT * FROM shown",
    "comparison_csv": f"""WITH {TEXT}
      SELECT 0 AS section, '' AS item, 'task,base,sft,dpo,sft_vs_base,dpo_vs_sft' AS line
      UNION ALL SELECT 1, task, concat_ws(',', task, base, sft, dpo, sft_vs_base, dpo_vs_sft) FROM shown""",
    "comparison_markdown": f"""WITH {TEXT},
      fixed(section, item, line) AS (VALUES
        (0, '000000', '# Stages'), (0, '000001', ''), (0, '000002', '生成时间: 2025-01-02 03:04:05'),
        (1, '000000', ''), (1, '000001', '## 模型对比'), (1, '000002', ''), (1, '000003', '| 模型 | 描述 |'),
        (1, '000004', '|------|------|'), (1, '000005', '| Base | start |'), (1, '000006', '| SFT | tuned |'),
        (1, '000007', '| DPO | preferred |'), (2, '000000', ''), (2, '000001', '## 评估结果'), (2, '000002', ''),
        (2, '000003', '| Benchmark | Base (%) | SFT (%) | DPO (%) | SFT vs Base | DPO vs SFT |'),
        (2, '000004', '|-----------|----------|---------|---------|-------------|------------|'),
        (4, '000000', ''), (4, '000001', '## 平均性能'), (4, '000002', ''), (5, '000003', ''),
        (6, '000000', ''), (6, '000001', '## 结论'), (6, '000002', ''), (6, '000003', '[请根据实际结果填写结论和分析]')),
      averages AS (SELECT avg(value) FILTER (model = 'base') AS b, avg(value) FILTER (model = 'sft') AS s,
                          avg(value) FILTER (model = 'dpo') AS d FROM metrics)
      SELECT section, item, line FROM fixed
      UNION ALL SELECT 3, task, '| ' || concat_ws(' | ', task, base, sft, dpo, sft_vs_base, dpo_vs_sft) || ' |' FROM shown
      UNION ALL SELECT 5, '000000', '- **Base 平均**: ' || printf('%.2f', b * 100) || '%' FROM averages
      UNION ALL SELECT 5, '000001', '- **SFT 平均**: ' || printf('%.2f', s * 100) || '%' FROM averages
      UNION ALL SELECT 5, '000002', '- **DPO 平均**: ' || printf('%.2f', d * 100) || '%' FROM averages
      UNION ALL SELECT 5, '000004', '- SFT 相对 Base 提升: **' || printf('%+.2f', (s - b) * 100) || '%**' FROM averages
      UNION ALL SELECT 5, '000005', '- DPO 相对 SFT 提升: **' || printf('%+.2f', (d - s) * 100) || '%**' FROM averages
      """,
    "metrics_json": f"""WITH {METRICS},
      placed AS (SELECT {STAGE} * 3 AS section, task AS item, value,
                        lead(task) OVER (PARTITION BY model ORDER BY task) IS NULL AS last FROM metrics),
      fixed(section, item, line) AS (VALUES (0, '000000', '{{'), (0, '000001', '  "timestamp": "2025-01-02T03:04:05",'),
        (2, '000000', '  "base": {{'), (4, '000000', '  }},'), (5, '000000', '  "sft": {{'), (7, '000000', '  }},'),
        (8, '000000', '  "dpo": {{'), (10, '000000', '  }}'), (11, '000000', '}}'))
      SELECT section, item, line FROM fixed UNION ALL
      SELECT section, item, '    "' || item || '": ' || value::VARCHAR || CASE WHEN last THEN '' ELSE ',' END FROM placed""",
    "run_names": """
      SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS name,
             strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown,
             regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS iso FROM events""",
    "complete_tasks": f"""WITH {WIDE}
      SELECT task, round(base * 100, 6) AS base, round(sft * 100, 6) AS sft, round(dpo * 100, 6) AS dpo
      FROM wide WHERE base IS NOT NULL AND sft IS NOT NULL AND dpo IS NOT NULL""",
    "incomplete_tasks": f"WITH {WIDE} SELECT task FROM wide WHERE base IS NOT NULL AND (sft IS NULL OR dpo IS NULL)",
    "stage_gains": f"""WITH {METRICS}
      SELECT task, model, round(value, 6) AS value,
             round((value - lag(value) OVER (PARTITION BY task ORDER BY {STAGE})) * 100, 6) AS gain FROM metrics""",
    "model_averages": f"WITH {METRICS} SELECT model, round(avg(value), 6) AS average FROM metrics GROUP BY model",
    "average_gains": f"""WITH {METRICS},
      a AS (SELECT {STAGE}::BIGINT AS stage_no, model, avg(value) * 100 AS points FROM metrics GROUP BY model)
      SELECT stage_no, model, round(points, 6) AS points,
             round(points - lag(points) OVER (ORDER BY stage_no), 6) AS gain FROM a""",
    "tasks_per_model": f"WITH {METRICS} SELECT model, count(*) AS n_tasks FROM metrics GROUP BY model",
    "task_names": f"WITH {METRICS} SELECT DISTINCT task FROM metrics ORDER BY task",
    "task_labels": f"""SELECT event_id, {_first_upper('event_type')} || ' Gsm8K It''S' AS label,
      event_type || {NL} || 'gsm8k it''s' AS wrapped FROM events""",
    "accuracy_stderr": f"""WITH {PREDICTIONS}
      SELECT model, task, round(avg(correct), 6) AS acc,
             round(sqrt(avg(correct) * (1 - avg(correct)) / (count(*) - 1)), 6) AS acc_stderr, count(*) AS n
      FROM predictions GROUP BY model, task""",
    "multiple_choice": """
      WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, label % len(embedding) AS gold FROM embeddings),
      n AS (SELECT *, list_transform(range(1, len(e) + 1), lambda k: e[k] / length('choice ' || k)::DOUBLE) AS z FROM s)
      SELECT vec_id, (list_position(e, list_max(e)) - 1 = gold)::INT::DOUBLE AS acc,
             (list_position(z, list_max(z)) - 1 = gold)::INT::DOUBLE AS acc_norm FROM n""",
    "strict_extract": f"WITH {RESPONSES} SELECT doc_id, {STRICT.format('response')} AS found FROM responses",
    "flexible_extract": f"WITH {RESPONSES} SELECT doc_id, {FLEXIBLE.format('response')} AS found FROM responses",
    "exact_match": f"""WITH {RESPONSES}
      SELECT doc_id, {_matched(STRICT.format(CUT))} AS strict, {_matched(FLEXIBLE.format(CUT))} AS flexible
      FROM responses""",
    "stop_cut": f"WITH {RESPONSES} SELECT doc_id, {CUT} AS kept FROM responses",
    "limit_per_task": f"""WITH {PREDICTIONS}
      SELECT task, doc_id FROM predictions QUALIFY row_number() OVER (PARTITION BY task ORDER BY doc_id) <= 100""",
    "sample_counts": f"""WITH {PREDICTIONS}
      SELECT task, count(*) AS original, least(count(*), 100) AS effective FROM predictions GROUP BY task""",
    "few_shot_context": f"""WITH {ANSWERED},
      items AS (SELECT row_id, {_hash_split('row_id', 0.3)} AS split, answered,
                       'Question: ' || asked || {NL} || 'Answer:' AS q FROM answered),
      shots AS (SELECT md5(row_id || '-42') AS h, q || ' ' || answered AS example FROM items
                WHERE split = 'train' ORDER BY h LIMIT 5),
      context AS (SELECT string_agg(example, {NL} || {NL} ORDER BY h) AS c FROM shots),
      asked AS (SELECT row_id, c || {NL} || {NL} || q AS prompt FROM items, context WHERE split = 'validation')
      SELECT row_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM asked""",
    "question_prompts": f"""WITH {ANSWERED}
      SELECT row_id, 'Question: ' || asked || {NL} || 'Answer:' AS prompt FROM answered""",
    "lettered_prompts": f"""
      SELECT o_orderkey, 'Question: Which order is ' || o_orderkey || '?' || {NL} || 'A. ' || o_orderstatus || {NL}
        || 'B. ' || o_orderpriority || {NL} || 'C. x' || {NL} || 'D. y' || {NL} || 'E. z' || {NL} || 'Answer:' AS prompt
      FROM orders""",
    "gold_index": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END::BIGINT AS gold FROM orders",
    "activity_queries": f"""SELECT o_orderkey, o_orderpriority || ': ' || o_orderstatus || ' ' ||
      {_first_upper('lower(o_orderpriority)')} AS query FROM orders""",
    "blank_sentences": """
      SELECT o_orderkey, 'Order ' || o_orderkey || ' is ' || o_orderstatus || '|Order ' || o_orderkey || ' is '
        || o_orderpriority AS contexts, 'today' AS continuation,
        CASE o_orderkey % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END::BIGINT AS gold FROM orders""",
}
ORACLES["prepared_instruction_files"] = ORACLES["prepared_alpaca"]
