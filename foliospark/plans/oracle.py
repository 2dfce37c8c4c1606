"""DuckDB SQL for the queries of ``plans.queries``."""

from __future__ import annotations

_KIND_NAMES = ("archive", "doc", "docx", "email", "html", "image", "odp", "ods", "odt", "pdf", "ppt", "pptx", "rtf", "text", "xls", "xlsx")
_FAMILY = """CASE WHEN kind IN ('docx', 'doc', 'odt', 'rtf') THEN 'word' WHEN kind IN ('xlsx', 'xls', 'ods') THEN 'sheet' WHEN kind IN ('pptx', 'ppt', 'odp') THEN 'slides' WHEN kind = 'pdf' THEN 'paged'
  WHEN kind = 'image' THEN 'image' WHEN kind IN ('html', 'text') THEN 'markup' WHEN kind IN ('email', 'archive') THEN 'container' ELSE 'unknown' END"""
_OFF_NOTE = "no sendable image and render_fallback is off"
_WARNING = "WARNING: this document needs vision but has no sendable image; treat it as unverifiable rather than as a clean result"
_REASONS = (
    "Outlook .msg is an OLE2 container with no stdlib reader. Convert it to .eml, or install extract-msg and register a backend for it.",
    "Apple Pages is a proprietary bundle; export to .docx or PDF.",
    "Apple Numbers is a proprietary bundle; export to .xlsx or PDF.",
    "Apple Keynote is a proprietary bundle; export to .pptx or PDF.",
    "7-Zip archives need py7zr; only .zip is built in.",
    "RAR archives need rarfile plus an unrar binary.",
)
_THRESHOLD = f"CASE {_FAMILY} WHEN 'slides' THEN 400 WHEN 'sheet' THEN 80 WHEN 'markup' THEN 120 ELSE 180 END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _kind(t: str) -> str:
    """The kind of a text's bytes, by the rules that texts can meet."""
    head = f"substr({t}, 1, 2048)"
    hits = " + ".join(f"CAST(regexp_matches({head}, '(?m)^{h}:') AS INT)" for h in ("Subject", "From", "To", "Date", "Received", "Message-ID"))
    return f"""CASE WHEN {t} LIKE '%PDF%' AND starts_with({t}, '%PDF') THEN 'pdf' WHEN starts_with({t}, '{{\\rt') THEN 'rtf'
      WHEN starts_with({t}, 'PK' || chr(3) || chr(4)) THEN 'unknown' WHEN starts_with({t}, 'BM') OR starts_with({t}, 'GIF87a') OR starts_with({t}, 'GIF89a') THEN 'image'
      WHEN regexp_matches({t}, '^\\s*(<svg |<\\?xml)') THEN 'image' WHEN starts_with({t}, 'From ') OR ({hits}) >= 3 OR (({hits}) = 2 AND contains({t}, 'MIME-Version:')) THEN 'email'
      WHEN regexp_matches(substr({t}, 1, 8192), '(?i)<\\s*(!doctype\\s+html|html|head|body|table|div|p|img)\\b') THEN 'html'
      WHEN length({t}) > 0 AND (length({t}) - length(regexp_replace({t}, '[\\x01-\\x08\\x0e-\\x1f]', '', 'g'))) < 0.05 * strlen({t}) THEN 'text' ELSE 'unknown' END"""


_IMAGES = """
  SELECT p_partkey % 200 AS doc_id, p_partkey AS pos, p_size % 7 AS ord, CASE WHEN p_type LIKE 'S%' THEN 'image/x-emf' ELSE 'image/png' END AS mime, p_name AS name,
    CASE WHEN p_partkey % 17 <> 0 THEN p_size * 40 END AS width, CASE WHEN p_partkey % 17 <> 0 THEN p_size * 30 END AS height,
    CAST(round((p_retailprice - 895) * 250) AS INT) AS nbytes, sha256(p_brand || CAST(p_size AS VARCHAR)) AS sha
  FROM part"""


def _filtered(w: int, h: int, b: int, px: int, vector: bool, duplicates: bool, most: int | None) -> str:
    """CTEs that end in ``done``: images with status, reason and rank."""
    cap = f"ok2 AND rk > {most}" if most is not None else "FALSE"
    return f"""
img AS ({_IMAGES}
), judged AS (
  SELECT *, CASE WHEN {'TRUE' if vector else 'FALSE'} AND mime = 'image/x-emf' THEN 'vector format ' || mime WHEN nbytes < {b} THEN nbytes || 'B under min_bytes={b}'
    WHEN width IS NULL OR height IS NULL THEN 'dimensions unknown' WHEN width < {w} OR height < {h} THEN width || 'x' || height || ' under minimum'
    WHEN width * height < {px} THEN (width * height) || 'px under min_pixels' ELSE 'ok' END AS why FROM img
), once AS (
  SELECT *, why IN ('ok', 'dimensions unknown') AS ok1, row_number() OVER (PARTITION BY doc_id, why IN ('ok', 'dimensions unknown'), sha ORDER BY pos) AS nth FROM judged
), ranked AS (
  SELECT *, ok1 AND ({'nth = 1' if duplicates else 'TRUE'}) AS ok2 FROM once
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, ok2 ORDER BY coalesce(CASE WHEN width * height <> 0 THEN width * height END, 0) DESC, nbytes DESC, ord, pos) AS rk FROM ranked
), done AS (
  SELECT *, CASE WHEN ok2 AND NOT ({cap}) THEN 'kept' ELSE 'rejected' END AS status,
    CASE WHEN {cap} THEN 'beyond max_images={most}' WHEN ok1 AND NOT ok2 THEN 'duplicate of an earlier image' ELSE why END AS reason,
    CASE WHEN ok2 AND NOT ({cap}) THEN rk END AS rank FROM numbered
)"""


_DEFAULT, _STRICT = _filtered(200, 200, 15000, 90000, False, True, None), _filtered(600, 600, 60000, 500000, False, True, None)
_KINDS = "[" + ", ".join(f"'{k}'" for k in _KIND_NAMES) + "]"
_PICTURED = f"""
docs AS (
  SELECT doc_id, {_KINDS}[CAST(doc_id % 16 AS INT) + 1] AS kind, doc_id % 400 AS g,
    {_strip("coalesce(text, '')")} AS text FROM documents
), counted AS (
  SELECT doc_id AS g, count(*) AS n_all, count(*) FILTER (status = 'kept') AS n_kept, count(*) FILTER (status <> 'kept') AS n_rejected FROM done GROUP BY 1
), pictured AS (
  SELECT d.*, coalesce(n_all, 0) AS n_all, coalesce(n_kept, 0) AS n_kept, coalesce(n_rejected, 0) AS n_rejected, {{threshold}} AS threshold FROM docs d LEFT JOIN counted c USING (g)
), decided AS (
  SELECT *, CASE WHEN length(text) >= threshold AND n_kept > 0 THEN 'hybrid' WHEN length(text) >= threshold THEN 'text_only' WHEN n_kept > 0 THEN 'image_only'
    WHEN text = '' AND n_all = 0 THEN 'empty' WHEN n_all = 0 AND kind = 'text' THEN 'text_only' ELSE 'image_only' END AS strategy FROM pictured
)"""
_PICTURED_DEFAULT = _PICTURED.format(threshold=_THRESHOLD)
_NOTE = "strategy || ': ' || length(text) || ' body chars (threshold ' || threshold || '), ' || n_kept || ' image(s) kept, ' || n_rejected || ' filtered out'"
_TURNS = f"turns AS (SELECT 'conv' || conv_id AS root, turn, role, {_strip("coalesce(text, '')")} AS text, 'turn' || turn || '.txt' AS file FROM conversations)"
_TREE = f"""WITH {_TURNS}, parts AS (
  SELECT root, -1 AS place, 'Subject: ' || root AS part FROM (SELECT DISTINCT root FROM turns)
  UNION ALL SELECT root, turn, '--- ' || file || ' ---' || chr(10) || text FROM turns WHERE role <> 'system' AND text <> ''
), trees AS (SELECT root, string_agg(part, chr(10) || chr(10) ORDER BY place) AS t FROM parts GROUP BY root)"""
_TEXT_RULE = "CASE WHEN length(t) >= 120 THEN 'text_only' WHEN t = '' THEN 'empty' ELSE 'text_only' END"
_DOC_TEXT = _strip("coalesce(text, '')")
_HTML_BODY = r"""regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<head>.*?</head>', '', 's'), '</?(p|div|br|tr|li|h[1-6]|section|article|header|footer|blockquote|pre|table)\b[^>]*>', chr(10), 'g')"""
_ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&eacute;", "é"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def _unescaped(x: str) -> str:
    for name, char in _ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return x


_HTML_TEXT = _strip(r"regexp_replace(regexp_replace(" + _unescaped(r"regexp_replace(" + _HTML_BODY + r", '</?[a-zA-Z!][^>]*>', '', 'g')") + r", '[ \t\x{a0}]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')")
_JSON_TEXT = "replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
_ROWS = "SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"


def _values(pairs: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in p) + ")" for p in pairs)


ORACLE: dict[str, str] = {
    "detect_documents": f"SELECT doc_id, {_kind('t')} AS kind FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "detect_pages": f"SELECT page_id, {_kind('t')} AS kind, 'utf-8' AS charset FROM (SELECT page_id, html AS t FROM pages)",
    "sniff_mimes": """
WITH m AS (SELECT p_partkey, p_partkey % 14 AS k, p_size % 7 AS s FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/bmp' WHEN 5 THEN 'image/tiff' WHEN 6 THEN 'image/tiff'
  WHEN 7 THEN 'image/x-emf' WHEN 8 THEN 'image/x-wmf' WHEN 9 THEN 'image/webp' WHEN 10 THEN 'image/heic' WHEN 11 THEN 'image/svg+xml' WHEN 12 THEN 'image/svg+xml'
  ELSE CASE s WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/tiff' WHEN 3 THEN 'image/heic' WHEN 4 THEN 'image/svg+xml' ELSE 'application/octet-stream' END END AS mime FROM m""",
    "image_sizes": """
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 8 < 7 THEN p_size * 37 + 1 END AS w, CASE WHEN p_partkey % 8 < 7 THEN p_partkey % 1000 + 1 END AS h FROM part)
SELECT p_partkey, coalesce(CAST(w AS BIGINT), -1) AS width, coalesce(CAST(h AS BIGINT), -1) AS height, coalesce(CAST(w * h AS BIGINT), -1) AS pixels FROM s""",
    "text_strategies": f"""
WITH d AS (SELECT doc_id, {_DOC_TEXT} AS t FROM documents), s AS (SELECT *, {_TEXT_RULE} AS strategy FROM d)
SELECT doc_id, strategy, strategy || ': ' || length(t) || ' body chars (threshold 120), 0 image(s) kept, 0 filtered out' AS note FROM s""",
    "strategy_counts_by_language": f"WITH d AS (SELECT lang, {_DOC_TEXT} AS t FROM documents) SELECT lang, {_TEXT_RULE} AS strategy, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM d GROUP BY 1, 2",
    "family_thresholds": f"""
WITH k(kind) AS (VALUES {_values([(k,) for k in _KIND_NAMES])}), f AS (SELECT kind, {_FAMILY} AS family, {_THRESHOLD} AS threshold FROM k), d AS (SELECT length({_DOC_TEXT}) AS n FROM documents)
SELECT kind, family, threshold, (SELECT count(*) FROM d WHERE n >= threshold) AS trusted FROM f""",
    "html_titles": f"SELECT page_id, 'html' AS kind, {_strip(_unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)"))} AS title, '0' AS media_count FROM pages",
    "html_texts": f"WITH t AS (SELECT page_id, {_HTML_TEXT} AS text FROM pages) SELECT page_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t",
    "html_texts_compat": "SELECT page_id, 0 AS n_chars, 'empty' AS strategy FROM pages",
    "delimited_tables": f"""
WITH r AS ({_ROWS}), o AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY n_name || ';' || n_nationkey) - 1 AS i FROM r),
t AS (SELECT r_name, string_agg(n_name || ' | ' || n_nationkey, chr(10) ORDER BY i) AS text, 2 * count(*) AS n_cells, coalesce(max(CASE WHEN n_name = 'FRANCE' THEN CAST(n_nationkey AS VARCHAR) END), '') AS france FROM o GROUP BY r_name)
SELECT r_name || '.csv' AS name, text, text AS piped, n_cells, france, i, n_name AS label, CAST(n_nationkey AS VARCHAR) AS value FROM o JOIN t USING (r_name)""",
    "image_reasons": f"WITH {_DEFAULT} SELECT pos AS p_partkey, why AS reason, ok1 AS accepted FROM done",
    "image_filter": f"WITH {_filtered(200, 200, 15000, 90000, True, True, 3)} SELECT doc_id, pos AS p_partkey, status, reason, coalesce(rank, 0) AS rank FROM done",
    "filter_profiles": " UNION ALL ".join(f"(WITH {f} SELECT '{n}' AS profile, status, count(*) AS n FROM done GROUP BY status)" for n, f in (("default", _DEFAULT), ("strict", _STRICT), ("all", _filtered(0, 0, 0, 0, False, False, None)))),
    "strategies_with_images": f"WITH {_DEFAULT}, {_PICTURED_DEFAULT} SELECT doc_id, kind, strategy, n_kept, n_rejected FROM decided",
    "prepare_notes": f"""WITH {_STRICT}, {_PICTURED.format(threshold='500')}
SELECT doc_id, strategy, strategy IN ('hybrid', 'image_only') AS needs_vision, {_NOTE} || CASE WHEN n_kept = 0 AND strategy <> 'text_only' THEN chr(10) || '{_OFF_NOTE}' ELSE '' END
  || CASE WHEN n_kept = 0 AND strategy IN ('hybrid', 'image_only') THEN chr(10) || '{_WARNING}' ELSE '' END AS notes FROM decided""",
    "boilerplate_left_out": r"""
WITH t AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'system' AND regexp_matches(text, '\S')), '') AS body, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (regexp_matches(text, '\S')), '') AS full_text FROM conversations GROUP BY conv_id)
SELECT conv_id, length(body) AS n_body, length(full_text) AS n_text, sha256(body) AS body_sha256 FROM t""",
    "trees_flattened": f"{_TREE} SELECT root AS root_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM trees",
    "leaves_by_anti_join": f"WITH {_TURNS} SELECT root || '#' || turn AS doc_id, file AS name, 1 AS depth FROM turns",
    "prepare_containers": f"""{_TREE}, d AS (SELECT *, CASE WHEN length(t) >= 180 THEN 'text_only' ELSE 'image_only' END AS strategy FROM trees)
SELECT root AS doc_id, 'email' AS kind, strategy, length(t) AS n_chars, strategy || ': ' || length(t) || ' body chars (threshold 180), 0 image(s) kept, 0 filtered out'
  || CASE WHEN strategy = 'image_only' THEN chr(10) || 'containers are not rendered; use prepare_all() to handle each member on its own' || chr(10) || '{_WARNING}' ELSE '' END AS notes FROM d""",
    "prepare_members": f"""WITH {_TURNS}, b AS (SELECT *, CASE WHEN role = 'system' THEN '' ELSE text END AS t FROM turns), d AS (SELECT *, {_TEXT_RULE} AS strategy FROM b)
SELECT root || '#' || turn AS doc_id, file AS name, strategy, length(t) AS n_chars, strategy || ': ' || length(t) || ' body chars (threshold 120), 0 image(s) kept, 0 filtered out'
  || CASE WHEN strategy = 'empty' THEN chr(10) || '{_OFF_NOTE}' ELSE '' END AS notes FROM d""",
    "archive_limits": """
WITH m AS (
  SELECT l_orderkey % 300 AS archive, *, CAST(trunc(l_extendedprice * 50) AS BIGINT) AS size, CASE WHEN l_quantity > 45 THEN 1000 ELSE CAST(trunc(l_extendedprice * 10) AS BIGINT) END AS packed FROM lineitem
), b AS (
  SELECT *, packed > 0 AND size > 200 * packed AS bomb, row_number() OVER w AS idx, sum(CASE WHEN packed > 0 AND size > 200 * packed THEN 0 ELSE size END) OVER (w ROWS UNBOUNDED PRECEDING) AS total
  FROM m WINDOW w AS (PARTITION BY archive ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)
), c AS (SELECT *, min(CASE WHEN idx > 200 OR (NOT bomb AND total > 536870912) THEN idx END) OVER (PARTITION BY archive) AS stop FROM b)
SELECT archive, CASE WHEN idx >= coalesce(stop, 1000000000) THEN 'cut' WHEN bomb THEN 'bomb' ELSE 'kept' END AS status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(idx) AS last_idx FROM c GROUP BY 1, 2""",
    "member_names": """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN substr(p_name || '.txt', 1, 120) WHEN 1 THEN p_name WHEN 2 THEN '.' || p_name WHEN 3 THEN 'Thumbs.db' WHEN 4 THEN 'attachment' ELSE p_name || ' (1)[2].csv' END AS safe,
  p_partkey % 6 NOT IN (2, 3, 4) AS opened, CASE p_partkey % 6 WHEN 0 THEN '.txt' WHEN 3 THEN '.db' WHEN 5 THEN '.csv' ELSE '' END AS suffix, 'ppt/slides/slide' || lpad(CAST(p_partkey AS VARCHAR), 20, '0') || '.xml' AS key FROM part""",
    "capped_slides": "SELECT p_brand AS deck, 'slide' || p_partkey || '.xml' AS part FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5",
    "sheet_rows": """
WITH c AS (
  SELECT l_suppkey AS sheet, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS row_no, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, CASE WHEN l_quantity > 25 THEN l_returnflag ELSE '' END AS text FROM lineitem
), n AS (SELECT *, row_number() OVER (PARTITION BY sheet, row_no ORDER BY l_linenumber, l_partkey, d, text) AS col FROM c WHERE row_no <= 2000),
k AS (SELECT *, max(CASE WHEN text <> '' THEN col END) OVER (PARTITION BY sheet, row_no) AS last_col FROM n WHERE col <= 64)
SELECT sheet, row_no, string_agg(text, ' | ' ORDER BY col) AS cells FROM k WHERE col <= last_col GROUP BY sheet, row_no""",
    "cell_types": """
WITH s AS (SELECT p_partkey % 10 AS book, p_size AS idx, min(p_name) AS s FROM part GROUP BY 1, 2 HAVING p_size < 40)
SELECT p.p_partkey, CASE p.p_partkey % 5 WHEN 0 THEN coalesce(s.s, '') WHEN 1 THEN CASE WHEN p.p_size % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END WHEN 3 THEN CAST(p.p_size AS VARCHAR) ELSE '' END AS text
FROM part p LEFT JOIN s ON s.book = p.p_partkey % 10 AND s.idx = p.p_size""",
    "relationship_targets": """
SELECT 'rId' || p_partkey AS rid, CASE WHEN p_size > 10 THEN 'media/' || p_partkey || '.png' END AS target, CASE WHEN p_size <= 10 THEN 'no target' WHEN p_size < 40 THEN 'ok' ELSE 'not inside' END AS status FROM part""",
    "unused_media": "SELECT p_partkey % 100 AS doc, 'media/' || p_partkey || '.png' AS name FROM part WHERE p_size % 5 > 0 AND p_size % 3 <> 0",
    "payload_parts": """
WITH d AS (SELECT doc_id, to_base64(encode(coalesce(text, ''))) AS b FROM documents)
SELECT doc_id, sha256('data:image/png;base64,' || b) AS url_sha256, sha256('{"type":"image_url","image_url":{"url":"data:image/png;base64,' || b || '"}}') AS openai_sha256,
  sha256('{"type":"image","source":{"type":"base64","media_type":"image/png","data":"' || b || '"}}') AS anthropic_sha256 FROM d""",
    "message_contents": f"""WITH {_DEFAULT}, {_PICTURED_DEFAULT}, emf AS (SELECT doc_id AS g, count(*) AS n FROM done WHERE status = 'kept' AND mime = 'image/x-emf' GROUP BY 1)
SELECT d.doc_id, 1 + CASE WHEN text <> '' THEN 1 ELSE 0 END AS n_parts, 0 AS images_sent, sha256('[{{"type":"text","text":"Read this."}}' || CASE WHEN text <> '' THEN
  ',{{"type":"text","text":"Text layer extracted from the source file, for cross-checking what you read in the image(s):\\n\\n' || {_JSON_TEXT.format('text')} || '"}}' ELSE '' END || ']') AS content_sha256,
  1 + coalesce(emf.n, 0) + CASE WHEN n_kept = 0 AND strategy <> 'text_only' THEN 1 ELSE 0 END + CASE WHEN n_kept = 0 AND strategy IN ('hybrid', 'image_only') THEN 1 ELSE 0 END AS n_notes FROM decided d LEFT JOIN emf USING (g)""",
    "prompts": """
WITH f AS (SELECT n_regionkey, string_agg('  ' || n_name || ': number ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS lines FROM nation GROUP BY 1)
SELECT n_regionkey, concat_ws(chr(10), CASE WHEN n_regionkey % 2 = 0 THEN 'Read this document and extract the fields below.' ELSE 'Look.' END, '', 'Return ONLY a JSON object with exactly these keys:', lines, '', 'Rules:',
  '- Use null for any field that is absent or not legible. Never guess.', '- Copy values exactly as written, including spelling and formatting.', '- If the document is not the expected type, set every field to null.') AS prompt FROM f""",
    "replies": "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k, event_id % 6 < 4 AS parsed FROM events",
    "readings": f"""
WITH d AS (SELECT doc_id, {_DOC_TEXT} AS t FROM documents), n AS (SELECT *, length('How long?') + length('Document text:') + 2 + length(t) AS k FROM d)
SELECT doc_id, t <> '' AND k % 5 <> 0 AS ok, CASE WHEN t <> '' AND k % 5 <> 0 THEN k ELSE -1 END AS chars, CASE WHEN t = '' THEN 'nothing extractable in this document' WHEN k % 5 = 0 THEN 'model response was not parseable JSON' END AS error, FALSE AS used_vision FROM n""",
    "kind_report": f"WITH {_DEFAULT}, {_PICTURED_DEFAULT} SELECT kind, strategy, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM decided GROUP BY 1, 2",
    "kind_facts": f"""
WITH k(kind) AS (VALUES {_values([(k,) for k in _KIND_NAMES])})
SELECT kind, {_FAMILY} AS family, kind IN ('email', 'archive') AS is_container, kind <> 'text' AS can_hold_images, kind IN ('pdf', 'image') AS can_render FROM k""",
    "unreadable_files": f"WITH u(i, reason) AS (VALUES {_values([*enumerate(_REASONS), (6, None)])}) SELECT n_nationkey, reason FROM nation JOIN u ON CAST(u.i AS INT) = n_nationkey % 7",
    "roundtrip_docx": r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
s AS (SELECT doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l), t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), '') AS text, count(*) FILTER (line <> '') AS n FROM s GROUP BY doc_id)
SELECT doc_id, 'docx' AS kind, n AS n_blocks, sha256(text) AS text_sha256, 'Clerk' AS author FROM t""",
    "roundtrip_office": f"""
WITH r AS ({_ROWS}), t AS (
  SELECT r_name, string_agg(n_name || ' | ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS piped, string_agg(n_name || ' ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS lines, string_agg(n_name || chr(10) || n_nationkey, chr(10) ORDER BY n_nationkey) AS loose FROM r GROUP BY r_name
), f(fmt, kind, n_tables) AS (VALUES ('docx', 'docx', 1), ('xlsx', 'xlsx', 1), ('pptx', 'pptx', 0), ('odt', 'odt', 1), ('ods', 'ods', 1), ('rtf', 'rtf', 0), ('eml', 'email', 0))
SELECT r_name, fmt, kind, n_tables, CASE fmt WHEN 'docx' THEN r_name || chr(10) || piped WHEN 'xlsx' THEN '[' || r_name || ']' || chr(10) || piped WHEN 'pptx' THEN r_name || chr(10) || 'a note' || chr(10) || lines
  WHEN 'odt' THEN r_name || chr(10) || piped || chr(10) || loose WHEN 'ods' THEN piped || chr(10) || loose WHEN 'rtf' THEN r_name || chr(10) || lines
  ELSE 'From: a@example.org' || chr(10) || 'To: b@example.org' || chr(10) || 'Subject: ' || r_name || chr(10) || 'Date: Tue, 12 Mar 2024 10:00:00 +0000' || chr(10) || lines END AS text,
  CASE fmt WHEN 'xlsx' THEN r_name || ',Empty' END AS sheets FROM t, f""",
    "roundtrip_archives": f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS raw, {_strip("coalesce(text, '')")} AS text FROM conversations)
SELECT 'c' || conv_id || '.zip' AS root_id, role || '/turn' || turn || '.txt' AS origin, {_kind('raw')} AS kind, 1 AS depth, CASE WHEN {_kind('raw')} = 'text' THEN length(text) ELSE -1 END AS n_chars, CASE WHEN {_kind('raw')} = 'text' THEN sha256(text) END AS text_sha256 FROM t""",
    "package_images": """
WITH p AS (SELECT *, p_partkey % 7 AS k, p_size || 'x3' AS a, (p_size + 1) || 'x3' AS b, (p_size + 2) || 'x3' AS c FROM part)
SELECT p_partkey, ['docx', 'xlsx', 'odt', 'odt', 'rtf', 'rtf', 'docx'][k + 1] AS kind, CASE k WHEN 1 THEN '[S]' || chr(10) || p_name WHEN 6 THEN '' ELSE p_name END AS text,
  CASE k WHEN 0 THEN 'a.png ' || a || ', b.png ' || b || ', lost.png ' || c || ' loose' WHEN 1 THEN 'image1.png ' || a WHEN 2 THEN 'scan.png ' || a || ', lost.png ' || b || ' loose' WHEN 3 THEN 'inline-image ' || a WHEN 6 THEN '' ELSE 'pict1.png ' || a END AS images,
  CASE k WHEN 0 THEN 'word/document.xml: relationship |1 media part(s) unreferenced by |contains OLE embeddings (word/em' WHEN 2 THEN '1 picture(s) unreferenced by con' WHEN 3 THEN 'image target not inside package:' WHEN 6 THEN 'word/document.xml: unparseable X' ELSE '' END AS warnings FROM p""",
    "saved_images": """
WITH p AS (SELECT *, p_partkey % 7 AS k FROM part), i AS (
  SELECT p_partkey, p_name, n, p_size + n AS w FROM p, range(3) t(n) WHERE k IN (0, 1, 2, 3, 4, 5) AND n < CASE k WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 1 END
) SELECT p_partkey || '-00' || n || '.png' AS path, sha256(unhex('89504E470D0A1A0A0000000D49484452' || printf('%08X', CAST(w AS INT)) || '00000003') || encode(p_name)) AS data_sha256 FROM i""",
    "mail_trees": """
WITH s AS (SELECT s_name, s_suppkey, s_suppkey || '.eml' AS root FROM supplier), rows AS (
  SELECT root AS doc_id, root AS root_id, '' AS parent_id, 0 AS depth, 'email' AS kind, root AS name, '' AS origin, 2 AS n_children, 'From: a@example.org' || chr(10) || 'To: b@example.org' || chr(10) || 'Subject: ' || s_name || chr(10) || 'Date: Tue, 12 Mar 2024 10:00:00 +0000' || chr(10) || s_name || chr(10) || chr(10) || 'number ' || s_suppkey AS text,
    'bad.docx: skipped (UnsupportedFormat: bad.docx: detected unknown, which has no registered backend)' AS warnings FROM s
  UNION ALL SELECT root || '#0', root, root, 1, 'text', 'note.txt', 'note.txt', 0, s_name, '' FROM s
  UNION ALL SELECT root || '#1', root, root, 1, 'archive', 'deep.zip', 'deep.zip', 1, '', 'old.7z: skipped (UnsupportedFormat: old.7z: 7-Zip archives need py7zr; only .zip is built in.)' FROM s
  UNION ALL SELECT root || '#1.0', root, root || '#1', 2, 'archive', 'a.zip', 'a.zip', 1, '', '' FROM s
  UNION ALL SELECT root || '#1.0.0', root, root || '#1.0', 3, 'archive', 'b.zip', 'b.zip', 0, '', 'nesting depth 3 reached; members not opened' FROM s
) SELECT * FROM rows""",
    "leaf_summaries": "SELECT s_suppkey || '.eml#0' AS doc_id, 'note.txt [text]: text_only, 0 image(s), ' || length(s_name) || ' text chars' AS summary FROM supplier",
    "report_lines": f"""WITH {_TURNS}, b AS (SELECT *, CASE WHEN role = 'system' THEN '' ELSE text END AS t FROM turns), d AS (SELECT *, {_TEXT_RULE} AS strategy FROM b), l AS (
  SELECT root || '#' || turn AS doc_id, list_filter(['kind         text', 'strategy     ' || strategy, 'text         ' || length(t) || ' chars', 'tables       0', 'images       0 kept, 0 filtered',
    'note         ' || strategy || ': ' || length(t) || ' body chars (threshold 120), 0 image(s) kept, 0 filtered out', CASE WHEN strategy = 'empty' THEN 'note         {_OFF_NOTE}' END], lambda x: x IS NOT NULL) AS lines FROM d
) SELECT doc_id, CAST(unnest(range(len(lines))) AS INT) AS n, unnest(lines) AS line FROM l""",
    "html_tables_and_images": """
SELECT p_partkey, p_brand || ',' || p_size || '|' || p_name || ',b' AS tables, 'inline1:' || sha256(p_name) || ',inline2:' || sha256('a b') AS images,
  'remote image not fetched: https://e.org/x.png|image path escapes the document folder: ../up.png|referenced image not found on disk: p' || p_size || '.png?v=1' AS warnings FROM part""",
    "image_documents": """
SELECT p_partkey || '.png' AS doc_id, 'image' AS kind, 1 AS n, 1 AS page, 'image/png' AS mime, CAST(p_size AS INT) AS width, 7 AS height, p_partkey || '.png' AS name,
  sha256(unhex('89504E470D0A1A0A0000000D49484452' || printf('%08X', CAST(p_size AS INT)) || '00000007') || encode(p_name)) AS sha256 FROM part""",
    "ole_kinds": """
WITH p AS (SELECT p_partkey, ['doc', 'xls', 'xls', 'ppt', 'unknown', NULL][CAST(p_partkey % 6 AS INT) + 1] AS named, ['doc', 'xls', 'ppt', 'doc', 'doc', 'text', 'doc'][CAST(p_partkey % 7 AS INT) + 1] AS suffixed FROM part)
SELECT p_partkey, coalesce(named, suffixed) AS kind FROM p""",
    "kinds_supported": f"SELECT kind FROM (VALUES {_values([(k,) for k in _KIND_NAMES])}) t(kind)",
    "file_errors": f"""
SELECT n_name || ['.msg', '.docx', '.eml'][n_nationkey % 3 + 1] AS doc_id, CASE n_nationkey % 3 WHEN 2 THEN 'email' ELSE 'unknown' END AS kind, CASE n_nationkey % 3 WHEN 2 THEN 1 ELSE 0 END AS n_blocks,
  CASE WHEN n_nationkey % 3 < 2 THEN 'UnsupportedFormat' END AS error, CASE n_nationkey % 3 WHEN 0 THEN n_name || '.msg: {_REASONS[0]}' WHEN 1 THEN n_name || '.docx: detected unknown, which has no registered backend' END AS message FROM nation""",
}
