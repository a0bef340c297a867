"""SQL of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from docquarry.functions.vectors import LSH_SEED, projection_signs

CHUNKS = r"""
RECURSIVE docs AS (SELECT doc_id::VARCHAR AS source_path, chr(10) || chr(10) || text AS text FROM documents WHERE length(text) > 0),
lists AS (
  SELECT source_path,
         list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$'),
                                    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s
  FROM docs),
sentences AS MATERIALIZED (SELECT source_path, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x, len(s) AS n FROM lists),
cuts AS (
  SELECT DISTINCT x AS g, 0::BIGINT AS k, '' AS part, x AS rest FROM sentences WHERE strlen(x) > 800
  UNION ALL
  SELECT g, k + 1, substr(rest, 1, m), substr(rest, m + 1) FROM (
    SELECT g, k, rest, list_max(list_filter(range(least(200, length(rest)), least(800, length(rest)) + 1), lambda n: strlen(substr(rest, 1, n)) <= 800)) AS m
    FROM cuts WHERE rest <> '')),
sliced AS MATERIALIZED (SELECT g, list(part ORDER BY k) AS parts FROM cuts WHERE k > 0 GROUP BY g),
steps AS (
  SELECT source_path, s, 0::BIGINT AS i, '' AS cur, '' AS last, []::VARCHAR[] AS out FROM lists
  UNION ALL
  SELECT source_path, s, i + 1,
         CASE WHEN parts IS NOT NULL THEN ''
              WHEN cur <> '' AND strlen(cur) + strlen(x) > 800
              THEN CASE WHEN last <> '' THEN last || ' ' ELSE '' END || x || ' '
              ELSE cur || x || ' ' END,
         CASE WHEN parts IS NOT NULL THEN last ELSE x END,
         CASE WHEN parts IS NOT NULL THEN CASE WHEN cur <> '' THEN list_prepend(trim(cur), parts) ELSE parts END
              WHEN cur <> '' AND strlen(cur) + strlen(x) > 800 THEN [trim(cur)] ELSE [] END
  FROM (SELECT source_path, s, i, cur, last, s[i + 1] AS x FROM steps WHERE i < len(s)) LEFT JOIN sliced ON x = g),
emitted AS (
  SELECT source_path, i, out FROM steps WHERE len(out) > 0
  UNION ALL
  SELECT st.source_path, st.i + 1, [trim(cur)] FROM steps st WHERE st.i = len(s) AND trim(cur) <> ''),
packed AS (SELECT source_path, flatten(list(out ORDER BY i)) AS c FROM emitted GROUP BY source_path),
paragraphs AS (
  SELECT source_path, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g') AS p FROM docs)
"""

PACKS = CHUNKS.replace("chr(10) || chr(10) || text AS text", "text AS text")

_SPLIT = """
  list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$'),
    lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')
"""
_HASHED = "hashed AS (SELECT doc_id::VARCHAR AS source_path, sha256(text) AS content_hash FROM documents)"
_LEDGER = """ledger AS (
  SELECT source_path, CASE WHEN content_hash[1] = '1' THEN reverse(content_hash) ELSE content_hash END AS content_hash
  FROM hashed WHERE content_hash[1] <> '0')"""
_STATUS = """CASE WHEN l.content_hash IS NULL THEN 'new' WHEN l.content_hash <> h.content_hash THEN 'changed' ELSE 'unchanged' END"""
_UUID = """(SELECT lower(h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
   substr('89ab', (instr('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32])
   FROM (SELECT sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({name})) AS h))"""
_POINTS = f"""points AS (
  SELECT vec_id, label, embedding, vec_id::VARCHAR AS source_path, 'v' || vec_id AS text, {_UUID.format(name="vec_id || '#0'")} AS point_id FROM embeddings)"""
_CENTRES = """centres AS (
  SELECT query_id, list(m ORDER BY i) AS c FROM (
    SELECT label::BIGINT AS query_id, i, avg(x::DOUBLE)::FLOAT AS m
    FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL) GROUP BY query_id)"""


def _quantized(vector: str) -> str:
    """scale, values and norm of a FLOAT list, in single precision where the library is."""
    scale = f"(greatest(list_max(list_transform({vector}, lambda x: abs(x))), 1.1920928955078125e-07::FLOAT)::FLOAT / 127.0::FLOAT)::FLOAT"
    return f"""{scale} AS scale,
      list_transform({vector}, lambda x: greatest(-127, least(127, round((x::FLOAT / {scale})::FLOAT::DOUBLE)))::INT) AS vals,
      sqrt(list_sum(list_transform({vector}, lambda x: x::DOUBLE * x::DOUBLE))) AS norm"""


def _cosine(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}.vals, {b}.vals), lambda t: t[1] * t[2]))"
    return f"CASE WHEN {a}.norm = 0 OR {b}.norm = 0 THEN 0 ELSE {dot} * {a}.scale::DOUBLE * {b}.scale::DOUBLE / ({a}.norm * {b}.norm) END"


def _bucket(values: str, dim: int, bits: int) -> str:
    rows = ", ".join("'" + "".join("+" if x > 0 else "-" for x in row) + "'" for row in projection_signs(dim, bits, LSH_SEED))
    dot = f"list_sum(list_transform(range(1, {dim + 1}), lambda j: CASE WHEN s[j] = '+' THEN {values}[j] ELSE -{values}[j] END))"
    hits = f"list_transform([{rows}], lambda s: {dot} >= 0)"
    total = f"list_sum(list_transform(list_zip({hits}, range({bits})), lambda t: CASE WHEN t[1] THEN (1::HUGEINT << t[2]::INT) ELSE 0::HUGEINT END))"
    return f"(CASE WHEN {total} >= 9223372036854775808::HUGEINT THEN {total} - 18446744073709551616::HUGEINT ELSE {total} END)::BIGINT"


def _bytes(table: str, key: str, text: str, signed: bool, dim: int = 64) -> str:
    value = "b / 255.0::DOUBLE * 2 - 1" if signed else "b / 255.0::DOUBLE"
    return f"""raw AS (SELECT {key} AS k, hex(encode({text})) AS h FROM {table}),
    byte AS (
      SELECT k, i % {dim} AS place, (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS b
      FROM (SELECT k, h, unnest(range(length(h) // 2)) AS i FROM raw)),
    summed AS (SELECT k, place, sum({value}) AS v FROM byte GROUP BY k, place),
    full_ AS (
      SELECT a.k, p.place, coalesce(v, 0) AS v FROM (SELECT DISTINCT k FROM raw) a CROSS JOIN range({dim}) p(place)
      LEFT JOIN summed s ON s.k = a.k AND s.place = p.place),
    unit AS (SELECT k, place, CASE WHEN n > 0 THEN v / n ELSE 0 END AS x FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY k)) AS n FROM full_))"""


_GRAMS = "list_distinct(list_transform(range(strlen({t}) - 2), lambda i: hex(encode({t}))[2 * i + 1 : 2 * i + 6]))"
_LINES = """turns AS (
  SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 10 AS form, text AS q, md5(text) AS answer FROM conversations),
parsed AS (
  SELECT CASE WHEN form <> 8 THEN id::VARCHAR END AS id,
         CASE WHEN form = 2 THEN 'foo' WHEN form <> 8 THEN 'tools/call' END AS method,
         CASE WHEN form IN (0, 9) THEN q END AS query,
         CASE form WHEN 1 THEN -32600 WHEN 2 THEN -32601 WHEN 3 THEN -32602 WHEN 4 THEN -32602 WHEN 5 THEN -32602 WHEN 6 THEN -32602 END AS error_code,
         CASE form WHEN 1 THEN 'Invalid JSON-RPC version' WHEN 2 THEN 'Method not found' WHEN 3 THEN 'Invalid tools/call request'
              WHEN 4 THEN 'Unsupported tool' WHEN 5 THEN 'Missing tool arguments' WHEN 6 THEN 'Invalid query argument' END AS error_message,
         form = 8 AS parse_error, answer
  FROM turns WHERE form <> 7)"""

ORACLES = {
    "clean_markdown": r"""
      WITH c AS (SELECT page_id, regexp_replace(regexp_replace('![shot](data:image/png;base64,' || md5(url) || ') ' || html,
        '!\[.*?\]\(data:image/[^;]+;base64,[^\)]+\)', '[IMAGE REMOVED]', 'g'), '<!--.*?-->', '', 'gs') AS t FROM pages)
      SELECT page_id, sha256(t) AS hash, length(t) AS n_chars FROM c""",
    "reference_links": r"""
      WITH t AS (SELECT page_id, '[' || page_id || ']: ' || url || chr(10) || html AS t FROM pages),
      l AS (SELECT page_id, t, coalesce(list_aggregate(list_transform(list_filter(string_split(t, chr(10)),
        lambda x: regexp_matches(x, '^\[([^\]]+)\]:\s*(.+)$')), lambda x: x || chr(10)), 'string_agg', ''), '') AS links FROM t)
      SELECT page_id, links, md5(links || chr(10) || chr(10) || t) AS payload_md5 FROM l""",
    "split_sentences": f"""
      WITH s AS (SELECT doc_id::VARCHAR AS source_path, {_SPLIT} AS s FROM documents)
      SELECT source_path, len(s)::BIGINT AS n_sentences, md5(coalesce(list_aggregate(s, 'string_agg', '|'), '')) AS sentences_md5 FROM s""",
    "pack_sentences": f"""WITH {PACKS}
      SELECT source_path, unnest(range(len(c))) AS place, unnest(c) AS text FROM packed""",
    "chunk_documents": f"""WITH {CHUNKS},
      chosen AS (
        SELECT packed.source_path, CASE WHEN strlen(p) > 800 THEN packed.c ELSE [p] END AS c
        FROM packed JOIN paragraphs USING (source_path) WHERE p <> '')
      SELECT source_path, unnest(range(len(c))) AS chunk_index, unnest(c) AS text FROM chosen""",
    "point_id": f"""WITH {CHUNKS},
      chosen AS (
        SELECT packed.source_path, CASE WHEN strlen(p) > 800 THEN packed.c ELSE [p] END AS c
        FROM packed JOIN paragraphs USING (source_path) WHERE p <> ''),
      places AS (SELECT source_path, unnest(range(len(c))) AS chunk_index FROM chosen)
      SELECT source_path, chunk_index, {_UUID.format(name="source_path || '#' || chunk_index")} AS point_id FROM places""",
    "byte_slices": """
      WITH RECURSIVE cuts AS (
        SELECT doc_id::VARCHAR AS source_path, -1::BIGINT AS place, '' AS text, text AS rest FROM documents
        UNION ALL
        SELECT source_path, place + 1, substr(rest, 1, m), substr(rest, m + 1) FROM (
          SELECT source_path, place, rest,
                 list_max(list_filter(range(least(200, length(rest)), least(800, length(rest)) + 1), lambda n: strlen(substr(rest, 1, n)) <= 800)) AS m
          FROM cuts WHERE rest <> ''))
      SELECT source_path, place, text FROM cuts WHERE place >= 0""",
    "decode_documents": """
      WITH t AS (SELECT doc_id::VARCHAR AS source_path, lang = 'de' AS rejected, replace(text, '. ', '.' || chr(10)) AS t FROM documents)
      SELECT source_path, rejected, CASE WHEN NOT rejected THEN md5(CASE WHEN t = '' OR ends_with(t, chr(10)) THEN t ELSE t || chr(10) END) END AS text_md5 FROM t""",
    "chunk_markdown": r"""
      WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS p, lang, source AS s, regexp_extract(text, '[a-zA-Z]+') AS w FROM documents),
      rows AS (
        SELECT p, unnest(range(1, 41)) AS i, '| ' || unnest(range(1, 41)) || ' | ' || s || ' xxxxxxxxxxxxxxxxxxxx ' || chr(10) AS r FROM d),
      steps AS (
        SELECT p, 0::BIGINT AS i, 'Table' || chr(10) || '| n | s ' || chr(10) AS block, '' AS done FROM d
        UNION ALL
        SELECT p, i, CASE WHEN strlen(block || r) > 800 THEN '| n | s ' || chr(10) ELSE block || r END,
               CASE WHEN strlen(block || r) > 800 THEN trim(block || r, ' ' || chr(10)) ELSE '' END
        FROM (SELECT s.p, s.i + 1 AS i, block, r FROM steps s JOIN rows n ON n.p = s.p AND n.i = s.i + 1)),
      parts AS (
        SELECT p, 1 AS a, 0 AS b, 'Document ' || p || 'In ' || lang || ' from the ' || s || '.' AS t FROM d
        UNION ALL SELECT p, 2, 0, 'first' FROM d
        UNION ALL SELECT p, 3, 0, w || 'inner' FROM d
        UNION ALL SELECT p, 4, 0, '```' || chr(10) || 'print(' || p || ')' || chr(10) || '```' FROM d
        UNION ALL SELECT p, 5, i, done FROM steps WHERE done <> ''
        UNION ALL SELECT p, 6, 0, trim(block, ' ' || chr(10)) FROM steps WHERE i = 40
        UNION ALL SELECT p, 7, 0, w || chr(10) || 'ref & ' || p FROM d)
      SELECT p AS source_path, row_number() OVER (PARTITION BY p ORDER BY a, b) - 1 AS chunk_index, t AS text FROM parts WHERE t <> ''""",
    "chunk_shapes": r"""
      WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z]+') AS w FROM documents),
      p AS (SELECT doc_id, unnest(range(0, (len(w) + 1) // 2)) AS i, w FROM w),
      s AS (SELECT doc_id, i, w[2 * i + 1] AS a, coalesce(w[2 * i + 2], 'end') AS b, doc_id % 5 AS kind FROM p),
      parts AS (
        SELECT doc_id, i, 0 AS n, CASE kind WHEN 1 THEN a || chr(10) || b WHEN 3 THEN a WHEN 4 THEN b ELSE a || b END AS t FROM s
        UNION ALL SELECT doc_id, i, 1, '```' || chr(10) || b || chr(10) || '```' FROM s WHERE kind = 3)
      SELECT doc_id::VARCHAR AS source_path, row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1 AS chunk_index, t AS text FROM parts""",
    "content_hash": f"WITH {_HASHED} SELECT * FROM hashed",
    "changed_documents": f"""WITH {_HASHED}, {_LEDGER}
      SELECT h.source_path, h.content_hash, {_STATUS} AS status FROM hashed h LEFT JOIN ledger l ON h.source_path = l.source_path""",
    "update_ledger": f"""WITH {_HASHED}, {_LEDGER},
      new AS (SELECT h.* FROM hashed h LEFT JOIN ledger l ON h.source_path = l.source_path WHERE {_STATUS} <> 'unchanged')
      SELECT * FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.source_path = l.source_path) UNION ALL SELECT * FROM new""",
    "ledger_json": f"WITH {_HASHED} SELECT * FROM hashed",
    "stable_files": "SELECT doc_id::VARCHAR AS source_path, n_chars AS length FROM documents WHERE lang NOT IN ('de', 'es')",
    "commit_unchanged": "SELECT doc_id::VARCHAR AS source_path, n_chars AS length FROM documents WHERE lang NOT IN ('de', 'fr')",
    "markdown_changes": """
      SELECT event_id, CASE event_type WHEN 'view' THEN 'Create' ELSE 'Modify' END AS kind, 'd/' || user_id || '.md' AS path
      FROM events WHERE event_type IN ('view', 'click') AND value > 50""",
    "upsert_points": f"""WITH {_POINTS},
      updates AS (SELECT point_id, source_path, 'new ' || text AS text, len(embedding)::INT AS dim FROM points WHERE label >= 3)
      SELECT point_id, source_path, text, len(embedding)::INT AS dim FROM points p
      WHERE label <= 5 AND NOT EXISTS (SELECT 1 FROM updates u WHERE u.point_id = p.point_id) UNION ALL SELECT * FROM updates""",
    "trigrams": """
      WITH w AS (SELECT DISTINCT item_id, h[2 * i + 1 : 2 * i + 6] AS g FROM (
        SELECT item_id, lower(hex(encode(text))) AS h, unnest(range(strlen(text) - 2)) AS i FROM benchmark))
      SELECT item_id, count(*) AS n_trigrams, md5(string_agg(g, ',' ORDER BY g)) AS trigrams_md5 FROM w GROUP BY item_id""",
    "jaccard": """
      WITH w AS (SELECT DISTINCT item_id, h[2 * i + 1 : 2 * i + 6] AS g FROM (
        SELECT item_id, hex(encode(text)) AS h, unnest(range(strlen(text) - 2)) AS i FROM benchmark)),
      n AS (SELECT item_id, count(*) AS n FROM w GROUP BY item_id),
      b AS (SELECT x.item_id, count(*) AS k FROM w x JOIN w y ON x.g = y.g AND x.item_id + 1 = y.item_id GROUP BY ALL)
      SELECT p.item_id, q.item_id AS other_id, round((coalesce(k, 0)::FLOAT / (p.n + q.n - coalesce(k, 0))::FLOAT)::FLOAT::DOUBLE, 4) AS jaccard
      FROM n p JOIN n q ON p.item_id + 1 = q.item_id LEFT JOIN b ON b.item_id = p.item_id""",
    "quantize": f"""
      WITH q AS (SELECT vec_id, {_quantized("embedding")} FROM embeddings)
      SELECT vec_id, list_aggregate(list_transform(vals, lambda x: x::VARCHAR), 'string_agg', ',') AS values,
             round(scale::DOUBLE, 6) AS scale, round(norm::FLOAT::DOUBLE, 4) AS norm FROM q""",
    "quantized_cosine": f"""
      WITH {_CENTRES},
      a AS (SELECT vec_id, label::INT AS label, {_quantized("embedding")} FROM embeddings),
      b AS (SELECT query_id, {_quantized("c")} FROM centres)
      SELECT vec_id, a.label, round({_cosine("a", "b")}, 3) AS score FROM a JOIN b ON a.label = b.query_id""",
    "lsh_bucket": f"""
      WITH q AS (SELECT vec_id, {_quantized("embedding")} FROM embeddings)
      SELECT vec_id, {_bucket("vals", 64, 16)} AS bucket_16, {_bucket("vals", 64, 64)} AS bucket_64 FROM q""",
    "lsh_candidates": f"""
      WITH q AS (SELECT vec_id, {_quantized("embedding")} FROM embeddings),
      b AS (SELECT vec_id, {_bucket("vals", 64, 6)} AS bucket FROM q WHERE norm > 0)
      SELECT x.vec_id, y.vec_id AS candidate, x.bucket FROM b x JOIN b y ON x.bucket = y.bucket WHERE x.vec_id % 100 = 0""",
    "embed_chunk": f"WITH {_bytes('benchmark', 'item_id', 'text', False)} SELECT k AS item_id, place, round(x, 4) AS x FROM unit",
    "embed_query": f"WITH {_bytes('benchmark', 'item_id', 'text', True)} SELECT k AS item_id, place, round(x, 4) AS x FROM unit",
    "with_fallback": f"""
      WITH {_bytes("embeddings", "vec_id", "'v' || vec_id", False)},
      own AS (SELECT k, max(CASE WHEN place = 0 THEN x END) AS a, max(CASE WHEN place = 1 THEN x END) AS b FROM unit GROUP BY k)
      SELECT vec_id, 64 AS dim, round(CASE WHEN label = 0 THEN a ELSE embedding[1]::DOUBLE END, 4) AS first,
             round(CASE WHEN label = 0 THEN b ELSE embedding[2]::DOUBLE END, 4) AS second FROM embeddings JOIN own ON vec_id = k""",
    "with_query_fallback": f"""
      WITH {_bytes("embeddings", "vec_id", "'v' || vec_id", True)},
      own AS (SELECT k, max(CASE WHEN place = 0 THEN x END) AS a, max(CASE WHEN place = 1 THEN x END) AS b FROM unit GROUP BY k)
      SELECT vec_id, 64 AS dim, round(CASE WHEN label = 1 THEN a ELSE embedding[1]::DOUBLE END, 4) AS first,
             round(CASE WHEN label = 1 THEN b ELSE embedding[2]::DOUBLE END, 4) AS second FROM embeddings JOIN own ON vec_id = k""",
    "base64_vectors": """
      WITH h AS (SELECT vec_id, md5(vec_id::VARCHAR) AS h FROM embeddings),
      b AS (
        SELECT vec_id, place, list_transform(range(3), lambda i: ('0x' || h[6 * place + 2 * i + 1 : 6 * place + 2 * i + 2])::BIGINT) AS b
        FROM h, (VALUES (0::BIGINT), (1)) t(place))
      SELECT vec_id, place, round(CASE WHEN place = 1 THEN -1 ELSE 1 END * pow(2::DOUBLE, b[3] // 128 - 1)
        * (1 + ((b[3] % 128) * 65536 + b[2] * 256 + b[1]) / 8388608.0::DOUBLE), 6) AS x FROM b""",
    "similarity_join": f"""
      WITH {_POINTS}
      SELECT q.vec_id AS query_id, p.point_id, round(round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12), 4) AS score
      FROM points q, points p WHERE q.vec_id % 100 = 0""",
    "topk_search": f"""
      WITH {_POINTS},
      scored AS (
        SELECT q.vec_id AS query_id, p.point_id, p.source_path, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS s
        FROM points q, points p WHERE q.vec_id % 100 = 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS rank FROM scored)
      SELECT query_id, rank::INT AS rank, point_id, source_path, round(s, 4) AS score FROM ranked WHERE rank <= 5""",
    "answer_queries": f"""
      WITH {_POINTS},
      scored AS (
        SELECT q.vec_id AS query_id, p.point_id, p.text, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS s
        FROM points q, points p WHERE q.vec_id % 100 = 0),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, point_id) AS rank FROM scored)
      SELECT query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS answer FROM ranked WHERE rank <= 5 GROUP BY query_id""",
    "probe_cache": f"""
      WITH {_bytes("(SELECT DISTINCT text FROM conversations)", "text", "text", True)},
      v AS (SELECT k, list(x::FLOAT ORDER BY place) AS e FROM unit GROUP BY k),
      q AS (SELECT k AS query, {_quantized("e")} FROM v),
      c AS (SELECT *, {_bucket("vals", 64, 64)} AS bucket FROM q),
      entries AS (SELECT text AS query, min(conv_id * 1000000 + turn) AS seq FROM conversations WHERE role = 'user' GROUP BY text),
      pairs AS (
        SELECT a.query, b.query AS matched, seq, {_cosine("a", "b")} AS score
        FROM c a JOIN c b ON a.bucket = b.bucket JOIN entries e ON e.query = b.query WHERE a.norm > 0 AND b.norm > 0),
      best AS (SELECT query, arg_max({{'m': matched, 's': score}}, {{'s': score::FLOAT, 'n': -seq}}) AS b FROM pairs GROUP BY query),
      hits AS (
        SELECT query, b.m AS matched, b.s AS score, CASE WHEN b.s >= 0.95 THEN 'SureHit' 
          WHEN b.s >= 0.85 AND len(list_intersect({_GRAMS.format(t="query")}, {_GRAMS.format(t="b.m")}))::DOUBLE
            / len(list_distinct(list_concat({_GRAMS.format(t="query")}, {_GRAMS.format(t="b.m")}))) >= 0.25 THEN 'GreyZone' ELSE 'Miss' END AS o FROM best)
      SELECT conv_id || '-' || turn AS query_id, coalesce(o, 'Miss') AS outcome, CASE WHEN o <> 'Miss' THEN matched END AS matched_query,
             CASE WHEN o <> 'Miss' THEN round(score, 2) END AS score, CASE WHEN o <> 'Miss' THEN md5(matched) END AS value
      FROM conversations LEFT JOIN hits ON text = query""",
    "debounce": """
      WITH e AS (SELECT user_id AS root, event_type AS path, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
      s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 600 SECOND THEN 1 ELSE 0 END)
              OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
      SELECT root, epoch_us(min(ts)) AS started, list_aggregate(list_sort(list(DISTINCT path)), 'string_agg', ',') AS paths FROM s GROUP BY root, n""",
    "pack_requests": """
      WITH b AS (SELECT conv_id::VARCHAR AS source_path, turn // 2 AS batch, count(*)::INT AS n_inputs, list(text ORDER BY turn) AS t FROM conversations GROUP BY ALL)
      SELECT source_path, batch, n_inputs, md5('{"model":"m","input":' || to_json(t)::VARCHAR || '}') AS body_md5 FROM b""",
    "decode_responses": """
      WITH e AS (SELECT vec_id, label % 4 AS f, embedding AS e, list_reverse(embedding) AS r FROM embeddings)
      SELECT vec_id AS request_id, 0::BIGINT AS item, round(e[1]::DOUBLE, 4) AS first, len(e)::INT AS dim, NULL::VARCHAR AS error FROM e WHERE f < 3
      UNION ALL SELECT vec_id, 1, round(r[1]::DOUBLE, 4), len(e)::INT, NULL FROM e WHERE f < 2
      UNION ALL SELECT vec_id, NULL, NULL, NULL, 'embedding response did not include any embeddings' FROM e WHERE f = 3""",
    "parse_requests": f"WITH {_LINES} SELECT id, method, query, error_code, error_message, parse_error FROM parsed",
    "search_replies": f"""WITH {_LINES}
      SELECT id, '{{"jsonrpc":"2.0","id":' || id || CASE WHEN error_code IS NOT NULL
          THEN ',"error":{{"code":' || error_code || ',"message":"' || error_message || '"}}}}'
          ELSE ',"result":{{"content":[{{"type":"text","text":"' || answer || '"}}],"isError":false}}}}' END AS reply
      FROM parsed WHERE NOT parse_error""",
}
ORACLES["topk_cells"] = ORACLES["topk_search"]
