"""Reference answers as SQL for DuckDB, written apart from the Spark operators.

``VIEWS`` holds the shared inputs; a query gets the ones it names, in order, as CTEs.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "f1_docs": """SELECT o_orderkey AS doc_id, o_orderpriority AS source, o_custkey AS owner, CAST(count(l_orderkey) AS INT) AS page_count
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_custkey""",
    "f1_pages": """SELECT l_orderkey AS doc_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS page_no,
 l_partkey AS image_id, l_quantity AS size_mb, CAST((l_linenumber % 4) * 90 AS INT) AS rotate,
 CAST(CASE l_returnflag WHEN 'A' THEN 595 WHEN 'N' THEN 612 ELSE 842 END AS DOUBLE) AS page_w,
 CAST(CASE l_returnflag WHEN 'A' THEN 842 WHEN 'N' THEN 792 ELSE 595 END AS DOUBLE) AS page_h,
 CASE WHEN l_linestatus = 'F' THEN l_quantity END AS crop_inset FROM lineitem""",
    "f2_lines": """SELECT doc_id, line_no, CAST(ceil(line_no / 52.0) AS INT) AS page_no, text FROM (
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pno, lno) AS INT) AS line_no, text FROM (
  SELECT doc_id, pno, unnest(generate_series(1, len(ls))) AS lno, rtrim(unnest(ls)) AS text FROM (
   SELECT doc_id, pno, CASE WHEN trim(p) = '' THEN [''] ELSE regexp_extract_all(trim(regexp_replace(p, ' +', ' ', 'g')), '(?s).{1,82}(?: |$)|.{82}') END AS ls FROM (
    SELECT doc_id, unnest(generate_series(1, len(ps))) AS pno, unnest(ps) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)))))""",
    "f2_docs": "SELECT doc_id, max(page_no) AS page_count FROM f2_lines GROUP BY doc_id",
    "f2_pages": "SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM f2_lines GROUP BY doc_id, page_no",
    "f3_lines": """SELECT doc_id, line_no, tag, CASE WHEN tag = 'li' AND line_no % 2 = 0 THEN '• ' || shown ELSE shown END AS text,
 CAST(CASE WHEN tag = 'h1' THEN 24 WHEN tag = 'footer' THEN 9 WHEN tag = 'div' THEN 10 WHEN tag = 'p' AND line_no % 7 = 0 THEN 14 + (line_no // 7) % 8 ELSE 12 END AS DOUBLE) AS size,
 CAST(CASE WHEN tag = 'li' AND line_no % 3 = 2 THEN 108 WHEN tag = 'li' THEN 96 WHEN line_no % 3 = 0 THEN 78 ELSE 72 END AS DOUBLE) AS x0,
 CAST(ceil(line_no / 5.0) AS INT) AS page_no, CAST(ceil(line_no / 3.0) AS INT) AS block_no FROM (
 SELECT page_id AS doc_id, CAST(unnest(generate_series(1, len(g1))) AS INT) AS line_no, unnest(g1) AS tag, trim(unnest(g2)) AS shown FROM (
  SELECT page_id, regexp_extract_all(html, '<(h1|p|li|div|footer)(?: [^>]*)?>(?:<b>|<a [^>]*>)?([^<]*)', 1) AS g1, regexp_extract_all(html, '<(h1|p|li|div|footer)(?: [^>]*)?>(?:<b>|<a [^>]*>)?([^<]*)', 2) AS g2 FROM pages))""",
    "f3_seen": "SELECT * FROM f3_lines WHERE text <> ''",
    "w15_size": """SELECT doc_id, body FROM (SELECT doc_id, b AS body, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, b DESC) AS k FROM (
 SELECT doc_id, round(size * 2) / 2 AS b, sum(greatest(length(text), 1)) AS w FROM f3_seen GROUP BY ALL)) WHERE k = 1""",
    "w15_left": """SELECT doc_id, page_no, e AS page_left FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, e) AS k FROM (SELECT doc_id, page_no, round(x0) AS e, count(*) AS n FROM f3_seen GROUP BY ALL)) WHERE k = 1""",
    "w15_level": """SELECT z.doc_id, b, least(row_number() OVER (PARTITION BY z.doc_id ORDER BY b DESC), 6) AS level
 FROM (SELECT DISTINCT doc_id, round(size * 2) / 2 AS b FROM f3_seen) z JOIN w15_size s ON s.doc_id = z.doc_id WHERE b > body * 1.1""",
    "w15_line": """SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.page_no, l.block_no ORDER BY line_no) AS k, l.size > s.body * 1.1 AS heading, v.level, p.page_left,
 regexp_matches(l.text, '^[•●◦▪▫■□‣⁃·\\-–][ \\x{A0}]') AND trim(substr(l.text, 3)) <> '' AS bullet,
 regexp_replace(trim(CASE WHEN NOT (l.size > s.body * 1.1) AND regexp_matches(l.text, '^[•●◦▪▫■□‣⁃·\\-–][ \\x{A0}]') AND trim(substr(l.text, 3)) <> '' THEN substr(l.text, 3) ELSE l.text END), '[\\s\\x{A0}]+', ' ', 'g') AS shown
 FROM f3_seen l JOIN w15_size s ON s.doc_id = l.doc_id JOIN w15_left p ON p.doc_id = l.doc_id AND p.page_no = l.page_no LEFT JOIN w15_level v ON v.doc_id = l.doc_id AND v.b = round(l.size * 2) / 2""",
    # block by block, line by line
    "w15_walk": """SELECT *, CASE WHEN heading THEN 'heading' WHEN bullet OR x0 >= page_left + size THEN 'item' ELSE 'paragraph' END AS kind, CASE WHEN heading THEN NULL WHEN bullet OR x0 >= page_left + size THEN x0 END AS anchor FROM w15_line WHERE k = 1
 UNION ALL SELECT l.*, CASE WHEN l.heading THEN 'heading' WHEN l.bullet THEN 'item' WHEN w.anchor IS NOT NULL AND l.x0 >= w.anchor + l.size * 0.5 THEN 'tail' WHEN l.x0 >= l.page_left + l.size THEN 'item' ELSE 'paragraph' END,
 CASE WHEN l.heading THEN NULL WHEN l.bullet THEN l.x0 WHEN w.anchor IS NOT NULL AND l.x0 >= w.anchor + l.size * 0.5 THEN w.anchor WHEN l.x0 >= l.page_left + l.size THEN l.x0 END
 FROM w15_line l JOIN w15_walk w ON w.doc_id = l.doc_id AND w.page_no = l.page_no AND w.block_no = l.block_no AND l.k = w.k + 1""",
    "a13_rules": """SELECT page_id AS doc_id, list_filter([CASE WHEN page_id % 11 = 0 THEN 'encrypted' END, CASE WHEN regexp_matches(html, '(?is)<script[^>]*>.*?</script>') THEN 'script' END, CASE WHEN regexp_matches(html, '(?i) href="file:[^"]*"') THEN 'launch' END,
 CASE WHEN regexp_matches(html, '(?i) href="[^#"][^"]*"') THEN 'external reference' END, CASE WHEN page_id % 3 = 2 THEN 'no conformance claim' END, CASE WHEN page_id % 5 = 0 THEN 'font not embedded' END,
 CASE WHEN page_id % 3 = 0 AND page_id % 2 <> 0 THEN 'part 1 needs version 1.4' END, CASE WHEN page_id % 3 = 0 AND contains(lower(html), 'opacity') THEN 'part 1 forbids transparency' END], lambda x: x IS NOT NULL) AS issues FROM pages""",
    "f4_outline": """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS seq, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level,
 text AS title, CAST(turn + 1 AS INT) AS page FROM conversations""",
    "f4_docs": "SELECT conv_id AS doc_id, CAST(count(*) AS INT) AS page_count FROM conversations GROUP BY conv_id",
    # parents and subtree ends by plain comparison with every other item of the document
    "f4_links": """SELECT a.*, (SELECT max(b.seq) FROM f4_outline b WHERE b.doc_id = a.doc_id AND b.seq < a.seq AND b.level < a.level) AS pseq,
 coalesce((SELECT min(b.seq) FROM f4_outline b WHERE b.doc_id = a.doc_id AND b.seq > a.seq AND b.level <= a.level),
  (SELECT max(b.seq) + 1 FROM f4_outline b WHERE b.doc_id = a.doc_id)) AS nseq FROM f4_outline a""",
    "f4_depth": """SELECT doc_id, seq, 1 AS depth FROM f4_links WHERE pseq IS NULL
 UNION ALL SELECT l.doc_id, l.seq, d.depth + 1 FROM f4_links l JOIN f4_depth d ON d.doc_id = l.doc_id AND d.seq = l.pseq""",
    "f4_tree": """SELECT l.doc_id, l.seq - 1 AS idx, l.level, l.title, l.page, l.pseq - 1 AS parent, d.depth, l.nseq - l.seq - 1 AS descendants,
 CAST(row_number() OVER (PARTITION BY l.doc_id, l.pseq ORDER BY l.seq) AS INT) AS sibling FROM f4_links l JOIN f4_depth d ON d.doc_id = l.doc_id AND d.seq = l.seq""",
    # seven edits of each outline, one after the other, on lists
    "f4_replay": """WITH RECURSIVE e AS (SELECT doc_id, unnest([
   {'step': 1, 'op': 'add', 'target': doc_id % 5, 'title': 'Added first', 'page': 1}, {'step': 2, 'op': 'remove', 'target': (doc_id + 1) % 4, 'title': NULL, 'page': NULL},
   {'step': 3, 'op': 'up', 'target': doc_id % 3 + 1, 'title': NULL, 'page': NULL}, {'step': 4, 'op': 'add', 'target': 2, 'title': 'Added later', 'page': 2},
   {'step': 5, 'op': 'down', 'target': 0, 'title': NULL, 'page': NULL}, {'step': 6, 'op': 'remove', 'target': 50, 'title': NULL, 'page': NULL}, {'step': 7, 'op': 'up', 'target': 2, 'title': NULL, 'page': NULL}]) AS e FROM f4_docs),
  s AS (SELECT doc_id, 0 AS step, list({'level': CAST(level AS INT), 'depth': CAST(depth AS INT), 'title': title, 'page': CAST(page AS INT)} ORDER BY idx) AS l, false AS changed, CAST(NULL AS VARCHAR) AS error FROM f4_tree GROUP BY doc_id
   UNION ALL SELECT doc_id, step + 1, CASE WHEN top THEN l || [{'level': 1, 'depth': 1, 'title': title, 'page': page}] WHEN NOT found THEN l
     WHEN op = 'add' THEN l[1:z] || [{'level': l[k + 1].level + 1, 'depth': l[k + 1].depth + 1, 'title': title, 'page': page}] || l[z + 1:]
     WHEN op = 'remove' THEN l[1:k] || l[z + 1:]
     WHEN op = 'up' AND l[p + 1].depth = l[k + 1].depth THEN l[1:p] || l[k + 1:z] || l[p + 1:k] || l[z + 1:]
     WHEN op = 'down' AND z < len(l) AND l[z + 1].depth = l[k + 1].depth THEN l[1:k] || l[z + 1:y] || l[k + 1:z] || l[y + 1:] ELSE l END,
    top OR (found AND (op IN ('add', 'remove') OR (op = 'up' AND coalesce(l[p + 1].depth = l[k + 1].depth, false)) OR (op = 'down' AND z < len(l) AND coalesce(l[z + 1].depth = l[k + 1].depth, false)))),
    CASE WHEN NOT top AND NOT found THEN 'NoSuchBookmark' END FROM (
    SELECT *, coalesce(list_min(list_filter(range(z + 1, len(l)), lambda i: l[i + 1].depth <= l[z + 1].depth)), len(l)) AS y, list_max(list_filter(range(0, k), lambda i: l[i + 1].depth <= l[k + 1].depth)) AS p FROM (
     SELECT *, coalesce(list_min(list_filter(range(k + 1, len(l)), lambda i: l[i + 1].depth <= l[k + 1].depth)), len(l)) AS z FROM (
      SELECT s.doc_id, s.step, s.l, e.op, e.title, e.page, e.target - CASE WHEN e.op = 'add' THEN 1 ELSE 0 END AS k, e.op = 'add' AND e.target = 0 AS top,
       e.target - CASE WHEN e.op = 'add' THEN 1 ELSE 0 END BETWEEN 0 AND len(s.l) - 1 AS found FROM s JOIN (SELECT doc_id, unnest(e) FROM e) e ON e.doc_id = s.doc_id AND e.step = s.step + 1))))
 SELECT * FROM s""",
    "f5_tree": """SELECT concat('r', CAST(r_regionkey AS VARCHAR)) AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS tag, CAST(0 AS INT) AS rot FROM region
 UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR)), concat('r', CAST(n_regionkey AS VARCHAR)), NULL, CASE WHEN n_nationkey % 2 = 0 THEN CAST((n_nationkey % 4) * 90 AS INT) END FROM nation
 UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), concat('n', CAST(c_nationkey AS VARCHAR)), CASE WHEN c_acctbal < 0 THEN c_mktsegment END, NULL FROM customer
 UNION ALL SELECT concat('o', CAST(o_orderkey AS VARCHAR)), concat('c', CAST(o_custkey AS VARCHAR)), NULL, NULL FROM orders""",
    "f5_num": """SELECT id, parent, tag, rot, CASE substr(id, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END * 1000000000000 + CAST(substr(id, 2) AS BIGINT) AS num,
 CAST(substr(id, 2) AS BIGINT) AS key FROM f5_tree""",
    "f6_images": """SELECT p_partkey AS image_id, p_size * 40 AS px_w, p_size * 30 AS px_h, p_partkey % 10 = 0 AS masked,
 CASE p_partkey % 5 WHEN 0 THEN 'JPX' WHEN 1 THEN 'DCT' WHEN 2 THEN NULL ELSE 'FLATE' END AS filter,
 CASE p_partkey % 7 WHEN 0 THEN 'Indexed' WHEN 1 THEN 'DeviceCMYK' WHEN 2 THEN 'DeviceGray' WHEN 3 THEN 'G' ELSE 'DeviceRGB' END AS colorspace, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE 8 END AS bits FROM part""",
    # JPEG is always read; raw and deflated samples need eight bits of gray or red, green and blue
    "f6_readable": """SELECT *, CASE WHEN filter = 'DCT' THEN true WHEN filter = 'JPX' THEN false ELSE bits = 8 AND colorspace IN ('DeviceRGB', 'RGB', 'DeviceGray', 'G') END AS readable FROM f6_images""",
    "f6_placements": """SELECT l_partkey AS image_id, l_orderkey AS doc_id, CASE WHEN l_linestatus = 'F' AND l_partkey % 3 <> 0 THEN l_quantity * 12 ELSE 0 END AS draw_w, CASE WHEN l_linestatus = 'F' AND l_partkey % 3 <> 0 THEN l_quantity * 9 ELSE 0 END AS draw_h FROM lineitem""",
    "f6_dpi": """SELECT i.image_id, px_w, px_h, greatest(px_w / (w / 72.0), px_h / (h / 72.0)) AS dpi FROM f6_images i
 JOIN (SELECT image_id, max(draw_w) AS w, max(draw_h) AS h FROM f6_placements GROUP BY image_id HAVING max(draw_w) > 0 AND max(draw_h) > 0) m ON m.image_id = i.image_id""",
    "f6_outcome": """SELECT i.image_id, i.px_w, i.px_h, d.dpi, CASE WHEN masked THEN 'mask' WHEN filter = 'JPX' THEN 'unsupported filter' WHEN NOT readable THEN 'unsupported samples'
 WHEN greatest(i.px_w, i.px_h) <= 64 THEN 'tiny' WHEN d.dpi IS NULL THEN 'never drawn' WHEN d.dpi <= 72.0 * 1.15 THEN 'already small' ELSE 'recompress' END AS outcome
 FROM f6_readable i LEFT JOIN f6_dpi d ON d.image_id = i.image_id""",
    "f7_runs": """SELECT doc_id, page_no, line_no, text, CAST(72 AS DOUBLE) AS x0, 72 + CAST(5.5 AS DOUBLE) * length(text) AS x1,
 CAST(769.89 AS DOUBLE) - CAST(13.2 AS DOUBLE) * ((line_no - 1) % 52) - 11 AS y0, CAST(769.89 AS DOUBLE) - CAST(13.2 AS DOUBLE) * ((line_no - 1) % 52) AS y1 FROM f2_lines WHERE text <> ''""",
    "f7_rects": """SELECT rect_id, page_no, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1
 FROM (VALUES (1, 1, 100, 600, 200, 700), (2, 2, 0, 0, 80, 800), (3, 1, 400, 100, 560, 140)) AS t(rect_id, page_no, x0, y0, x1, y1)""",
    # glyphs one by one, to check the closed form
    "f7_hits": """SELECT r.doc_id, r.line_no, q.rect_id, length(r.text) AS glyphs, count(*) AS removed
 FROM f7_runs r JOIN f7_rects q ON q.page_no = r.page_no AND r.y0 < q.y1 AND r.y1 > q.y0 AND r.x0 < q.x1 AND r.x1 > q.x0, range(0, length(r.text)) AS s(i)
 WHERE 72 + 5.5 * s.i < q.x1 AND 72 + 5.5 * (s.i + 1) > q.x0 GROUP BY r.doc_id, r.line_no, q.rect_id, length(r.text)""",
    "f8_fields": """SELECT u.doc_id, f.name, f.ftype, f.options, CASE WHEN f.ftype <> 'Btn' THEN 0 WHEN u.doc_id % 3 = 1 THEN 65536 WHEN u.doc_id % 3 = 2 THEN 32768 ELSE 0 END AS flags FROM (SELECT DISTINCT user_id AS doc_id FROM events) u CROSS JOIN (VALUES ('view', 'Tx', NULL), ('click', 'Btn', NULL), ('signup', 'Ch', '0,1,2'), ('purchase', 'Sig', NULL)) AS f(name, ftype, options)""",
    "f8_values": """SELECT user_id AS doc_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'bool' END AS kind,
 CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS VARCHAR) ELSE 'true' END AS value FROM events e
 WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type)""",
    "f8_outcome": """SELECT v.doc_id, v.name, CASE WHEN f.name IS NULL THEN 'not_found' WHEN r.reason IS NULL THEN 'filled' ELSE 'unsupported' END AS outcome, r.reason FROM f8_values v
 LEFT JOIN f8_fields f ON f.doc_id = v.doc_id AND f.name = v.name
 LEFT JOIN LATERAL (SELECT CASE WHEN f.flags = 65536 THEN 'pushbutton' WHEN f.ftype = 'Btn' AND v.kind = 'text' THEN 'no choice ' || v.value || ' among: on, off' WHEN f.flags = 32768 THEN 'choice name wanted' WHEN f.ftype = 'Sig' THEN 'signature' WHEN f.ftype = 'Tx' AND v.kind <> 'text' THEN 'text wanted'
  WHEN f.ftype = 'Ch' AND v.kind <> 'text' THEN 'option wanted' WHEN f.ftype = 'Ch' AND v.value NOT IN ('0', '1', '2') THEN 'no option ' || v.value || ' among: 0, 1, 2' END AS reason) r ON true""",
    "f9_edits": """SELECT event_id, ts, user_id AS doc_id, CAST(event_id % 7 + 1 AS INT) AS page_no,
 CASE event_type WHEN 'view' THEN 90 WHEN 'click' THEN 180 WHEN 'signup' THEN -90 WHEN 'purchase' THEN 270 ELSE 0 END AS degrees FROM events""",
    "f9_fold": """SELECT doc_id, page_no, CAST(((sum(degrees) % 360) + 360) % 360 AS INT) AS rotation FROM f9_edits GROUP BY doc_id, page_no HAVING ((sum(degrees) % 360) + 360) % 360 <> 0""",
    "f9_jobs": """SELECT event_id AS seq, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancel' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS action FROM events""",
    # the queue played event by event
    "f9_status": """SELECT job_id, list_reduce(list_prepend('none', list(action ORDER BY seq)), lambda s, a:
  CASE WHEN a = 'cancel' THEN CASE WHEN s = 'queued' THEN 'cancelled' ELSE s END WHEN s = 'none' AND a <> 'queued' THEN s ELSE a END) AS status FROM f9_jobs GROUP BY job_id""",
    "f9_annots": """SELECT user_id AS doc_id, CAST(event_id % 5 + 1 AS INT) AS page_no, event_id AS annot_id,
 CASE event_type WHEN 'purchase' THEN 'Widget' WHEN 'click' THEN 'Link' WHEN 'signup' THEN 'Popup' WHEN 'view' THEN 'Highlight' ELSE 'Stamp' END AS subtype,
 event_id % 3 <> 0 AS has_appearance, event_id % 11 = 0 AS hidden FROM events""",
    # starts that hold, one leading to the next
    "f9_queue": """SELECT user_id % 16 AS queue, event_id AS seq, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancel' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS action FROM events""",
    "f9_start": """SELECT q.queue, q.seq, q.ended, (SELECT min(n.seq) FROM f9_queue n WHERE n.queue = q.queue AND n.action = 'running' AND n.seq > q.ended) AS next
 FROM (SELECT s.queue, s.seq, (SELECT min(e.seq) FROM f9_queue e WHERE e.queue = s.queue AND e.job_id = s.job_id AND e.action IN ('done', 'failed') AND e.seq > s.seq) AS ended FROM f9_queue s WHERE s.action = 'running') q""",
    "f9_held": """SELECT s.* FROM f9_start s JOIN (SELECT queue, min(seq) AS seq FROM f9_start GROUP BY queue) f ON f.queue = s.queue AND f.seq = s.seq
 UNION ALL SELECT s.* FROM f9_held h JOIN f9_start s ON s.queue = h.queue AND s.seq = h.next""",
    "f9_run": """SELECT v.*, CASE WHEN action = 'running' AND NOT held THEN 'AlreadyRunning' WHEN action IN ('done', 'failed') AND NOT held THEN 'NotRunning'
  WHEN action = 'cancel' AND coalesce(last_value(CASE WHEN held OR action IN ('queued', 'cancel') THEN action END IGNORE NULLS) OVER (PARTITION BY queue, job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> 'queued' THEN 'NotWaiting' END AS reason
 FROM (SELECT q.*, q.seq IN (SELECT seq FROM f9_held UNION ALL SELECT ended FROM f9_held WHERE ended IS NOT NULL) AS held FROM f9_queue q) v""",
    "f10_pairs": """SELECT a.vec_id AS pair_id, a.embedding AS left_s, b.embedding AS right_s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0""",
    "f11_ranges": """SELECT d.doc_id, r.start_page, r.style, r.prefix, r.first FROM f1_docs d JOIN (VALUES ('1-URGENT',1,'lower-roman','',1),('1-URGENT',3,'decimal','A-',1),('2-HIGH',2,'upper-alpha','',26),
 ('5-LOW',1,'none','Cover',1),('5-LOW',2,'decimal','',1)) AS r(source,start_page,style,prefix,first) ON r.source = d.source""",
    "f11_specs": """SELECT doc_id, s.pos, s.spec FROM f1_docs d JOIN (VALUES ('1-URGENT', 0, '1:lower-roman', -1), ('1-URGENT', 1, '3:decimal:A-', -1), ('2-HIGH', 0, '2:upper-alpha::26', -1),
 ('5-LOW', 0, '1:none:Cover', -1), ('5-LOW', 1, '2:decimal::0', -1), ('*', 0, '3:decimal', 0), ('*', 1, '2:decimal', 0), ('*', 0, 'x:decimal', 1)) AS s(source, pos, spec, parity)
 ON s.source = d.source OR (s.source = '*' AND d.source NOT IN ('1-URGENT', '2-HIGH', '5-LOW') AND d.doc_id % 2 = s.parity)""",
    "f11_read": """SELECT doc_id, pos, spec, TRY_CAST(p[1] AS INT) AS start_page, p[2] AS style, coalesce(p[3], '') AS prefix, coalesce(TRY_CAST(p[4] AS INT), 1) AS first,
 lag(TRY_CAST(p[1] AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (SELECT *, string_split(spec, ':') AS p FROM f11_specs)""",
    "f11_bad": """SELECT doc_id, arg_min(detail, pos) AS detail FROM (SELECT *, CASE WHEN start_page IS NULL THEN 'START is not a number' WHEN start_page = 0 THEN 'pages are numbered from 1'
 WHEN start_page <= coalesce(prev, 0) THEN 'starts must grow' WHEN first = 0 THEN 'first number is at least 1' END AS detail FROM f11_read) WHERE detail IS NOT NULL GROUP BY doc_id""",
    "f11_good": "SELECT doc_id, start_page, style, prefix, first FROM f11_read WHERE doc_id NOT IN (SELECT doc_id FROM f11_bad)",
    "f12_specs": """SELECT doc_id, page_count, CASE doc_id % 10 WHEN 0 THEN 'all' WHEN 1 THEN '1-3' WHEN 2 THEN '2-' WHEN 3 THEN '-2' WHEN 4 THEN '3-1'
 WHEN 5 THEN '1,1,2' WHEN 6 THEN ' 1 , 2 ' WHEN 7 THEN '9-' WHEN 8 THEN '1,,2' ELSE '0' END AS spec FROM f1_docs""",
    "f12_segs": """SELECT doc_id, page_count, spec, seg, piece, CASE WHEN lower(trim(spec)) = 'all' THEN 1 WHEN starts_with(piece, '-') THEN 1 ELSE TRY_CAST(split_part(piece, '-', 1) AS BIGINT) END AS a,
 CASE WHEN lower(trim(spec)) = 'all' OR (ends_with(piece, '-') AND piece <> '-') THEN page_count WHEN contains(piece, '-') THEN TRY_CAST(split_part(piece, '-', 2) AS BIGINT) ELSE TRY_CAST(piece AS BIGINT) END AS b
 FROM (SELECT *, trim(unnest(string_split(trim(spec), ','))) AS piece, unnest(generate_series(1, len(string_split(trim(spec), ',')))) AS seg FROM f12_specs)""",
    "f12_bad": """SELECT doc_id, CASE WHEN bool_or(d IS NOT NULL) THEN 'InvalidPageRange' ELSE 'PageOutOfRange' END AS error,
 coalesce(arg_min(d, seg) FILTER (d IS NOT NULL), arg_min(o, seg) FILTER (o IS NOT NULL) || ' > ' || any_value(page_count)) AS detail FROM (
 SELECT *, CASE WHEN lower(trim(spec)) = 'all' THEN NULL WHEN piece = '' THEN 'empty part' WHEN a IS NULL OR (b IS NULL AND NOT ends_with(piece, '-')) THEN 'no number' WHEN a = 0 OR piece = '0' THEN 'zero' END AS d,
 CASE WHEN lower(trim(spec)) = 'all' THEN NULL WHEN page_count = 0 OR a > page_count THEN a WHEN b > page_count THEN b END AS o FROM f12_segs) WHERE d IS NOT NULL OR o IS NOT NULL GROUP BY doc_id""",
    "f12_sel": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg, i) AS INT) AS pos, CAST(a + sign(b - a) * i AS INT) AS page_no FROM (
 SELECT doc_id, seg, a, b, unnest(generate_series(0, abs(b - a))) AS i FROM f12_segs WHERE doc_id NOT IN (SELECT doc_id FROM f12_bad) AND page_count > 0)""",
    "f12_uniq": """SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS pos FROM (
 SELECT doc_id, page_no, min(pos) AS pos FROM f12_sel GROUP BY doc_id, page_no)""",
    # pages of the documents whose specification holds, with a flag
    "f12_pages": """SELECT p.*, u.pos IS NOT NULL AS selected, u.pos FROM f1_pages p LEFT JOIN f12_uniq u ON u.doc_id = p.doc_id AND u.page_no = p.page_no
 WHERE p.doc_id NOT IN (SELECT doc_id FROM f12_bad)""",
    "f12_shown": """SELECT *, coalesce(crop_inset, 0) AS sx0, coalesce(crop_inset, 0) AS sy0, page_w - coalesce(crop_inset, 0) AS sx1, page_h - coalesce(crop_inset, 0) AS sy1 FROM f12_pages""",
    "f12_crop": """SELECT doc_id, page_no, selected, greatest(598, 0) AS x0, greatest(100, 0) AS y0, least(640, page_w) AS x1, least(900, page_h) AS y1 FROM f12_pages""",
    "f12_inset": """SELECT doc_id, page_no, selected, sx0 + CASE rotate WHEN 90 THEN 40 WHEN 180 THEN 250 WHEN 270 THEN 10 ELSE 300 END AS x0, sy0 + CASE rotate WHEN 90 THEN 300 WHEN 180 THEN 40 WHEN 270 THEN 250 ELSE 10 END AS y0,
 sx1 - CASE rotate WHEN 90 THEN 10 WHEN 180 THEN 300 WHEN 270 THEN 40 ELSE 250 END AS x1, sy1 - CASE rotate WHEN 90 THEN 250 WHEN 180 THEN 10 WHEN 270 THEN 300 ELSE 40 END AS y1 FROM f12_shown""",
    "f1_halves": """SELECT doc_id, page_no, coalesce(crop_inset, 0) AS x0, coalesce(crop_inset, 0) AS y0, page_w / 2 - 250 AS m0, page_w / 2 + 250 AS m1, page_w - coalesce(crop_inset, 0) AS x1, page_h - coalesce(crop_inset, 0) AS y1 FROM f1_pages""",
    "f13_meta": """SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS author, lang AS subject, CAST(NULL AS VARCHAR) AS keywords FROM documents""",
    "f13_edits": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'set' ELSE 'keep' END AS title_op, 'Untitled' AS title_val, CASE doc_id % 4 WHEN 1 THEN 'clear' ELSE 'keep' END AS author_op,
 CASE doc_id % 4 WHEN 2 THEN 'set' ELSE 'keep' END AS keywords_op, 'a,b' AS keywords_val FROM documents WHERE doc_id % 4 <> 3""",
    "f14_md": """SELECT doc_id, concat('# ', title, chr(10), '* item **one**', chr(10), chr(10), chr(10), repeat(chr(96), 3), chr(10), '# not a heading', chr(10), chr(10), repeat(chr(96), 3), chr(10), title, chr(10), '---', chr(10),
 '> quoted [label](http://x)', chr(10), chr(10), '---', chr(10), '1. snake_case 2 * 3', chr(10), chr(10), substr(text, length(title) + 2)) AS md FROM f13_meta""",
}

SQL: dict[str, str] = {
    "p1_page_range_resolve": "SELECT doc_id, pos, page_no FROM f12_sel",
    "p2_page_range_rejects": "SELECT doc_id, error, detail FROM f12_bad",
    "p3_page_range_unique": "SELECT doc_id, pos, page_no FROM f12_uniq",
    "p4_page_range_canonical": """SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN '1-2' WHEN 6 THEN '1,2' ELSE spec END AS canonical FROM f12_specs WHERE doc_id % 10 < 8""",
    "s1_scan_corpus": """SELECT d.doc_id, d.source, d.page_count, CAST(coalesce(sum(CAST(size_mb * 1000000 AS BIGINT)), 0) AS BIGINT) AS size_bytes, coalesce(bool_or(crop_inset IS NOT NULL), false) AS cropped,
 any_value(CASE o_orderstatus WHEN 'O' THEN '1.4' WHEN 'F' THEN '1.7' ELSE '2.0' END) AS version, bool_or(o_totalprice > 150000) AS encrypted, 'Order ' || d.doc_id AS title, 'Customer ' || any_value(o_custkey) AS author, any_value(o_orderpriority) AS subject,
 any_value(o_orderstatus) AS keywords, CASE WHEN d.doc_id % 3 <> 0 THEN 'desk' END AS creator, CAST(NULL AS VARCHAR) AS producer
 FROM f1_docs d JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN f1_pages p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.source, d.page_count""",
    "s2_merge_inputs": """SELECT d.owner AS merge_id, CAST(row_number() OVER (PARTITION BY d.owner ORDER BY d.doc_id, p.page_no) AS BIGINT) AS page_no, d.doc_id, p.page_no AS source_page
 FROM f1_docs d JOIN f1_pages p ON p.doc_id = d.doc_id""",
    "s2_merge_facts": """SELECT owner AS merge_id, CAST(sum(page_count) AS BIGINT) AS page_count, arg_min(source, doc_id) AS source, max(source) AS version FROM f1_docs GROUP BY owner""",
    "w17_running_page_offsets": """SELECT owner AS merge_id, doc_id AS input_ord, CAST(coalesce(sum(page_count) OVER (PARTITION BY owner ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM f1_docs""",
    "w4_arrange_pages": """SELECT s.doc_id, s.pos AS page_no, s.page_no AS source_page, CAST(row_number() OVER (PARTITION BY s.doc_id, s.page_no ORDER BY s.pos) AS INT) AS copy_no, p.image_id
 FROM f12_sel s JOIN f1_pages p ON p.doc_id = s.doc_id AND p.page_no = s.page_no""",
    "w5_delete_pages": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INT) AS page_no, page_no AS source_page FROM f12_pages WHERE NOT selected""",
    "w5_delete_rejects": """SELECT doc_id, 'EmptySelection' AS error, 'every page would be deleted' AS detail FROM f12_specs WHERE doc_id NOT IN (SELECT doc_id FROM f12_bad)
 AND page_count = (SELECT count(*) FROM f12_uniq u WHERE u.doc_id = f12_specs.doc_id)""",
    "w6_move_pages": """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN selected THEN doc_id % 4 + 2 - 0.5 ELSE page_no END, pos) AS INT) AS page_no, page_no AS source_page
 FROM f12_pages p WHERE doc_id % 4 + 2 <= (SELECT page_count + 1 FROM f1_docs d WHERE d.doc_id = p.doc_id)""",
    "w6_move_rejects": """SELECT s.doc_id, CASE WHEN b.error IS NOT NULL THEN b.error WHEN page_count = 0 THEN 'EmptySelection' ELSE 'PageOutOfRange' END AS error FROM f12_specs s LEFT JOIN f12_bad b ON b.doc_id = s.doc_id
 WHERE b.error IS NOT NULL OR page_count = 0 OR s.doc_id % 4 + 2 > page_count + 1""",
    "w1_split_every": """SELECT doc_id, CAST(c + 1 AS INT) AS chunk_no, CAST(max(c) OVER (PARTITION BY doc_id) + 1 AS INT) AS chunks, first_page, last_page FROM (
 SELECT doc_id, (page_no - 1) // 2 AS c, min(page_no) AS first_page, max(page_no) AS last_page FROM f1_pages GROUP BY doc_id, (page_no - 1) // 2)""",
    "w2_split_by_outline": """SELECT doc_id, page AS page_no, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY s) AS INT) AS chunk_no FROM (
 SELECT doc_id, page, sum(CASE WHEN pseq IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS s FROM f4_links)""",
    "w3_split_by_size": """WITH z AS (SELECT doc_id, page_no, CAST(size_mb * 1000000 AS BIGINT) AS bytes FROM f1_pages),
 w AS (SELECT doc_id, page_no, bytes, bytes AS total, 1 AS chunk FROM z WHERE page_no = 1
  UNION ALL SELECT z.doc_id, z.page_no, z.bytes, CASE WHEN w.total + z.bytes > 60000000 THEN z.bytes ELSE w.total + z.bytes END, CASE WHEN w.total + z.bytes > 60000000 THEN w.chunk + 1 ELSE w.chunk END
  FROM z JOIN w ON z.doc_id = w.doc_id AND z.page_no = w.page_no + 1)
 SELECT doc_id, CAST(chunk AS INT) AS chunk_no, min(page_no) AS first_page, max(page_no) AS last_page, CAST(sum(bytes) AS BIGINT) AS size_bytes FROM w GROUP BY doc_id, chunk""",
    "s4_split_manifest": """SELECT doc_id, CAST(c + 1 AS INT) AS chunk_no, concat('doc', doc_id, '-', lpad(CAST(c + 1 AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INT), '0'), 'of', length(CAST(n AS VARCHAR)), '_', CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END) AS name FROM (
 SELECT doc_id, (page_no - 1) // 2 AS c, min(page_no) AS a, max(page_no) AS b, count(*) OVER (PARTITION BY doc_id) AS n FROM f1_pages GROUP BY doc_id, (page_no - 1) // 2)
 UNION ALL SELECT doc_id, 1, concat('doc', doc_id, '-extract-', CASE WHEN min(page_no) = max(page_no) THEN CAST(min(page_no) AS VARCHAR) WHEN count(*) = max(page_no) - min(page_no) + 1 THEN concat(min(page_no), '-', max(page_no)) ELSE string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) END)
 FROM f12_uniq GROUP BY doc_id""",
    "s11_page_image_names": """SELECT s.doc_id, s.pos, concat('doc', s.doc_id, '-', lpad(CAST(s.page_no AS VARCHAR), CAST(length(CAST(d.page_count AS VARCHAR)) AS INT), '0'), '.png') AS name FROM f12_sel s JOIN f1_docs d ON d.doc_id = s.doc_id""",
    "s1_file_corpus": "SELECT 'orders' AS name, count(*) AS rows, true AS readable FROM orders UNION ALL SELECT 'lineitem' AS name, count(*) AS rows, true AS readable FROM lineitem UNION ALL SELECT 'documents' AS name, count(*) AS rows, true AS readable FROM documents UNION ALL SELECT 'pages' AS name, count(*) AS rows, true AS readable FROM pages UNION ALL SELECT 'events' AS name, count(*) AS rows, true AS readable FROM events",
    "s5_write_partitioned": """SELECT doc_id, CAST((page_no - 1) // 2 AS INT) AS chunk, count(*) AS pages, CAST(sum(image_id) AS BIGINT) AS image_sum FROM f1_pages GROUP BY doc_id, (page_no - 1) // 2""",
    "s5_atomic_save": """SELECT doc_id, CAST((page_no - 1) // 2 AS INT) AS chunk, count(*) AS pages, CAST(sum(image_id) AS BIGINT) AS image_sum FROM f1_pages WHERE doc_id % 3 <> 1 GROUP BY doc_id, (page_no - 1) // 2""",
    "s5_taken_names": """WITH n AS (SELECT concat('doc', doc_id % 1000, '-', c + 1) AS name FROM (SELECT DISTINCT doc_id, (page_no - 1) // 2 AS c FROM f1_pages))
 SELECT name FROM n GROUP BY name HAVING count(*) > 1 OR name IN (SELECT concat('doc', doc_id, '-1') FROM f1_docs WHERE doc_id % 10 = 3)""",
    "u4_lost_objects": """SELECT source AS doc_id, doc_id AS id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id <> (SELECT max(doc_id) FROM documents e WHERE e.source = d.source)""",
    "a12_rescue_choice": """SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'rescanned' ELSE 'loaded' END AS version, CAST(count(*) AS INT) AS page_count FROM lineitem GROUP BY l_orderkey""",
    "s7_paginate_text": "SELECT doc_id, page_no, line_no, text FROM f2_lines",
    "s3_extract_text": """WITH sp AS (SELECT doc_id, page_count, CASE doc_id % 10 WHEN 0 THEN [1, page_count] WHEN 1 THEN [1, 3] WHEN 2 THEN [2, page_count] WHEN 3 THEN [1, 2] WHEN 4 THEN [3, 1] WHEN 7 THEN [9, page_count] END AS r FROM f2_docs),
 sel AS (SELECT doc_id, i + 1 AS pos, r[1] + sign(r[2] - r[1]) * i AS page_no FROM (SELECT *, unnest(generate_series(0, abs(r[2] - r[1]))) AS i FROM sp WHERE r IS NOT NULL AND greatest(r[1], r[2]) <= page_count)
  UNION ALL SELECT doc_id, v.pos, v.page_no FROM f2_docs d JOIN (VALUES (5, 1, 1), (5, 2, 1), (5, 3, 2), (6, 1, 1), (6, 2, 2)) AS v(k, pos, page_no) ON v.k = d.doc_id % 10 WHERE d.page_count >= 2)
 SELECT sel.doc_id, CAST(pos AS INT) AS pos, CAST(sel.page_no AS INT) AS page_no, text || chr(12) AS text FROM sel JOIN f2_pages p ON p.doc_id = sel.doc_id AND p.page_no = sel.page_no""",
    "s6_pages_to_html": """WITH e AS (SELECT m.doc_id, page_count, replace(replace(replace(replace(replace(CASE WHEN title = '' THEN concat('doc', m.doc_id) ELSE title END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS t FROM f13_meta m JOIN f2_docs d ON d.doc_id = m.doc_id)
 SELECT doc_id, 0 AS seq, concat('<!DOCTYPE html>', chr(10), '<html lang="en">', chr(10), '<head>', chr(10), '<meta charset="utf-8">', chr(10), '<title>', t, '</title>', chr(10), '</head>', chr(10), '<body>', chr(10), '<h1>', t, '</h1>', chr(10)) AS html FROM e
 UNION ALL SELECT doc_id, CAST(page_count + 1 AS INT), concat('</body>', chr(10), '</html>', chr(10)) FROM e
 UNION ALL SELECT doc_id, page_no, concat('<section class="page" id="page-', page_no, '">', chr(10), '<h2>Page ', page_no, '</h2>', chr(10), '<pre>',
  replace(replace(replace(replace(replace(trim(text, concat(' ', chr(9), chr(10), chr(13))), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;'), '</pre>', chr(10), '</section>', chr(10)) FROM f2_pages""",
    "s8_markdown_to_lines": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '#+$', ''), '\*\*|__|~~|`', '', 'g'), '(\S)\*', '\1', 'g'), '\*(\S)', '\1', 'g') AS atx,
 regexp_replace(regexp_replace(regexp_replace(rtrim(title), '\*\*|__|~~|`', '', 'g'), '(\S)\*', '\1', 'g'), '\*(\S)', '\1', 'g') AS setext FROM f13_meta),
 rest AS (SELECT doc_id, unnest(ls) AS s, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(substr(text, length(split_part(text, chr(10), 1)) + 2), chr(10)) AS ls FROM documents)),
 plain AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rtrim(ltrim(s)), '\*\*|__|~~|`', '', 'g'), '(\S)\*', '\1', 'g'), '\*(\S)', '\1', 'g'), '(^|[^\p{L}\p{N}])_', '\1', 'g'), '_([^\p{L}\p{N}]|$)', '\1', 'g') AS line FROM rest),
 more AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) + 14 AS n FROM (SELECT *, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM plain) WHERE line <> '' OR before <> ''),
 u AS (SELECT doc_id, line, n FROM more UNION ALL SELECT doc_id, '', 14 FROM t UNION ALL SELECT doc_id, unnest(['', trim(atx), '', '- item one', '', '# not a heading', '', setext, '', 'quoted label', '', '- - -', '- snake_case 2 * 3']) AS line, unnest(generate_series(1, 13)) AS n FROM t)
 SELECT doc_id, CAST(n AS INT) AS line_no, line AS text FROM u""",
    "s8_markdown_title": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '#+$', ''), '\*\*|__|~~|`', '', 'g'), '(\S)\*', '\1', 'g'), '\*(\S)', '\1', 'g')) AS title FROM f13_meta""",
    "a17_size_by_page": "SELECT doc_id, page_no, CAST(strlen(text) AS BIGINT) AS bytes FROM f2_pages",
    "p5_pages_with_text": "SELECT doc_id, page_no, count(*) AS text_lines FROM f3_lines WHERE regexp_matches(text, '[^\\s\\x{A0}]') GROUP BY doc_id, page_no",
    "p7_rotate_pages": "SELECT doc_id, page_no, nullif(CASE WHEN selected THEN (rotate + 90) % 360 ELSE rotate END, 0) AS rotate FROM f12_pages",
    "p7_rotate_rejects": """SELECT doc_id, error, detail FROM f12_bad UNION ALL SELECT doc_id, 'EmptySelection', NULL FROM f12_specs WHERE page_count = 0 AND doc_id NOT IN (SELECT doc_id FROM f12_bad)""",
    "p8_crop_pages": """SELECT doc_id, page_no, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM f12_crop WHERE selected AND doc_id NOT IN (SELECT doc_id FROM f12_crop WHERE selected AND (x1 <= x0 OR y1 <= y0))""",
    "p8_crop_rejects": """SELECT doc_id, 'InvalidCropBox' AS error, 'page ' || min(page_no) AS detail FROM f12_crop WHERE selected AND (x1 <= x0 OR y1 <= y0) GROUP BY doc_id""",
    "p9_crop_margins": """SELECT doc_id, page_no, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM f12_inset WHERE selected AND doc_id NOT IN (SELECT doc_id FROM f12_inset WHERE selected AND (x1 <= x0 OR y1 <= y0))""",
    "p9_crop_margins_rejects": """SELECT doc_id, 'InvalidCropBox' AS error, 'page ' || min(page_no) AS detail FROM f12_inset WHERE selected AND (x1 <= x0 OR y1 <= y0) GROUP BY doc_id""",
    "p10_set_mediabox": """SELECT doc_id, page_no, 0.0::DOUBLE AS media_x0, 0.0::DOUBLE AS media_y0, 30.0::DOUBLE AS media_x1, 400.0::DOUBLE AS media_y1,
 CASE WHEN k THEN crop_inset END AS crop_x0, CASE WHEN k THEN crop_inset END AS crop_y0, CASE WHEN k THEN least(page_w - crop_inset, 30) END AS crop_x1, CASE WHEN k THEN least(page_h - crop_inset, 400) END AS crop_y1
 FROM (SELECT *, crop_inset < 30 AS k FROM f12_pages WHERE selected)""",
    "p10_set_mediabox_rejects": "SELECT doc_id, 'InvalidMediaBox' AS error FROM f12_specs WHERE page_count >= 3 AND doc_id NOT IN (SELECT doc_id FROM f12_bad)",
    "p10_reset_crop": "SELECT doc_id, page_no, CASE WHEN NOT selected THEN crop_inset END AS crop_inset FROM f12_pages",
    "p11_scale_pages": """SELECT doc_id, page_no, tw AS media_w, th AS media_h, round(s, 4) AS scale_x, round(s, 4) AS scale_y, round((tw - page_w * s) / 2, 4) + 0.0 AS offset_x, round((th - page_h * s) / 2, 4) + 0.0 AS offset_y FROM (
 SELECT *, least(tw / page_w, th / page_h) AS s FROM (SELECT *, CAST(CASE WHEN rotate IN (90, 270) THEN 792 ELSE 612 END AS DOUBLE) AS tw, CAST(CASE WHEN rotate IN (90, 270) THEN 612 ELSE 792 END AS DOUBLE) AS th FROM f12_pages WHERE selected))""",
    "p12_halve_pages": """WITH g AS (SELECT * FROM f1_halves WHERE doc_id NOT IN (SELECT doc_id FROM f1_halves WHERE m0 <= x0 OR x1 <= m1 OR y1 <= y0))
 SELECT doc_id, CAST(2 * page_no - 1 AS INT) AS page_no, round(x0, 4) AS x0, round(y0, 4) AS y0, round(m0, 4) AS x1, round(y1, 4) AS y1 FROM g
 UNION ALL SELECT doc_id, CAST(2 * page_no AS INT), round(m1, 4), round(y0, 4), round(x1, 4), round(y1, 4) FROM g""",
    "p12_halve_rejects": """SELECT doc_id, 'InvalidCropBox' AS error, 'page ' || min(page_no) AS detail FROM f1_halves WHERE m0 <= x0 OR x1 <= m1 OR y1 <= y0 GROUP BY doc_id""",
    "p12_halve_across_swapped": """WITH h AS (SELECT *, page_h / 2 + 5 AS up, page_h / 2 - 5 AS low FROM f1_halves JOIN (SELECT doc_id, page_no, page_h FROM f1_pages) USING (doc_id, page_no)), g AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE low <= y0 OR y1 <= up OR x1 <= x0))
 SELECT doc_id, CAST(2 * page_no - 1 AS INT) AS page_no, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(low, 4) AS y1 FROM g
 UNION ALL SELECT doc_id, CAST(2 * page_no AS INT), round(x0, 4), round(up, 4), round(x1, 4), round(y1, 4) FROM g""",
    "p13_fit_images": """WITH i AS (SELECT image_id, greatest(px_w, 1)::DOUBLE AS a, greatest(px_h, 1)::DOUBLE AS b FROM f6_images), s AS (SELECT *, least(523.276::DOUBLE / a, 769.89::DOUBLE / b) AS k FROM i)
 SELECT image_id, 595.276::DOUBLE AS page_w, 841.89::DOUBLE AS page_h, round((595.276::DOUBLE - a * k) / 2, 4) AS x, round((841.89::DOUBLE - b * k) / 2, 4) AS y, round(a * k, 4) AS w, round(b * k, 4) AS h, 'a4' AS mode FROM s
 UNION ALL SELECT image_id, round(a / 150 * 72, 4), round(b / 150 * 72, 4), 0.0, 0.0, round(a / 150 * 72, 4), round(b / 150 * 72, 4), 'image' FROM i""",
    "j7_overlay_pairs": """SELECT b.doc_id, b.page_no, d.doc_id AS overlay_id, o.page_no AS overlay_page, round(least(b.page_w / o.page_w, b.page_h / o.page_h), 4) AS scale
 FROM f1_pages b JOIN f1_docs d ON d.doc_id = b.doc_id + 1 JOIN f1_pages o ON o.doc_id = d.doc_id AND o.page_no = least(b.page_no, d.page_count)""",
    "w7_page_numbers": """SELECT doc_id, page_no, 'bottom-right' AS anchor, t AS text, round(page_w - 36 - length(t) * 5.0, 4) AS x, 36.0::DOUBLE AS y FROM (
 SELECT p.*, concat('Page ', p.page_no, ' of ', d.page_count) AS t FROM f12_pages p JOIN f1_docs d ON d.doc_id = p.doc_id WHERE selected)""",
    "w8_header_footer": """WITH c AS (SELECT p.*, d.page_count FROM f1_pages p JOIN f1_docs d ON d.doc_id = p.doc_id)
 SELECT doc_id, page_no, 'top-center' AS anchor, concat(page_count, ' pages') AS text, round((page_w - length(concat(page_count, ' pages')) * 4.5) / 2, 4) AS x, round(page_h - 24 - 9, 4) AS y FROM c
 UNION ALL SELECT doc_id, page_no, 'bottom-center', concat('- ', page_no, ' -'), round((page_w - length(concat('- ', page_no, ' -')) * 4.5) / 2, 4), 24.0::DOUBLE FROM c""",
    "w9_nup_layout": """WITH c AS (SELECT *, (page_no - 1) % 6 AS cell, (595.276::DOUBLE - 40 - 16) / 3 AS cw, (841.89::DOUBLE - 40 - 8) / 2 AS ch FROM f1_pages), s AS (SELECT *, cell // 3 AS r, cell % 3 AS k, least(cw / page_w, ch / page_h) AS z FROM c)
 SELECT doc_id, page_no, CAST((page_no - 1) // 6 + 1 AS INT) AS sheet, CAST(r AS INT) AS row_no, CAST(k AS INT) AS col_no, round(20 + k * (cw + 8) + (cw - page_w * z) / 2, 4) AS x, round(841.89::DOUBLE - 20 - (r + 1) * ch - r * 8 + (ch - page_h * z) / 2, 4) AS y, round(z, 4) AS scale_x, round(z, 4) AS scale_y FROM s""",
    # the printed order of one signature, spelled out
    "w9_nup_by_column": """SELECT doc_id, page_no, CAST((page_no - 1) // 6 + 1 AS INT) AS sheet, CAST((page_no - 1) % 6 % 2 AS INT) AS row_no, CAST((page_no - 1) % 6 // 2 AS INT) AS col_no, round(((page_no - 1) % 6 // 2) * (595.276::DOUBLE / 3), 4) AS x,
 round(841.89::DOUBLE - ((page_no - 1) % 6 % 2 + 1) * (841.89::DOUBLE / 2), 4) AS y, round(595.276::DOUBLE / 3 / page_w, 4) AS scale_x, round(841.89::DOUBLE / 2 / page_h, 4) AS scale_y FROM f1_pages""",
    "w10_booklet_long_edge": """WITH o AS (SELECT unnest([8, 1, 2, 7, 6, 3, 4, 5]) AS place, unnest(generate_series(0, 7)) AS k), s AS (SELECT doc_id, page_count, unnest(generate_series(0, (page_count + 7) // 8 - 1)) AS sig FROM f1_docs WHERE page_count > 0)
 SELECT doc_id, CAST(sig * 8 + k + 1 AS INT) AS slot, CAST((sig * 8 + k) // 2 + 1 AS INT) AS side, CAST((sig * 8 + k) % 2 AS INT) AS row_no, 0 AS col_no, CAST(CASE WHEN sig * 8 + place <= page_count THEN sig * 8 + place END AS INT) AS page_no FROM s, o""",
    "w10_booklet_order": """WITH o AS (SELECT unnest([8, 1, 2, 7, 6, 3, 4, 5]) AS place, unnest(generate_series(0, 7)) AS k), s AS (SELECT doc_id, page_count, unnest(generate_series(0, (page_count + 7) // 8 - 1)) AS sig FROM f1_docs WHERE page_count > 0)
 SELECT doc_id, CAST(sig * 8 + k + 1 AS INT) AS slot, CAST((sig * 8 + k) // 2 + 1 AS INT) AS side, 0 AS row_no, CAST((sig * 8 + k) % 2 AS INT) AS col_no, CAST(CASE WHEN sig * 8 + place <= page_count THEN sig * 8 + place END AS INT) AS page_no FROM s, o""",
    "w11_outline_tree": "SELECT doc_id, idx, CAST(parent AS INT) AS parent, depth, sibling, CAST(descendants AS INT) AS descendants FROM f4_tree",
    "w12_outline_add": """WITH a AS (SELECT d.doc_id, CAST(CASE WHEN d.doc_id % 5 = 0 THEN page_count ELSE t.idx + t.descendants + 1 END AS INT) AS spot, CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE t.level + 1 END AS level FROM f4_docs d LEFT JOIN f4_tree t ON t.doc_id = d.doc_id AND t.idx = d.doc_id % 5 - 1 WHERE d.doc_id % 5 = 0 OR t.idx IS NOT NULL)
 SELECT doc_id, spot AS idx, level, 'Added' AS title, 1 AS page FROM a UNION ALL SELECT t.doc_id, CASE WHEN t.idx >= spot THEN t.idx + 1 ELSE t.idx END, t.level, t.title, t.page FROM f4_tree t JOIN a ON a.doc_id = t.doc_id""",
    "w12_outline_add_rejects": "SELECT doc_id, 'NoSuchBookmark' AS error FROM f4_docs WHERE doc_id % 5 > page_count",
    "w12_outline_edits": "SELECT doc_id, CAST(i - 1 AS INT) AS idx, l[i].level AS level, l[i].depth AS depth, l[i].title AS title, l[i].page AS page FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM f4_replay WHERE step = 7)",
    "w12_outline_edit_outcomes": "SELECT doc_id, CAST(step AS BIGINT) AS step, changed, error FROM f4_replay WHERE step > 0",
    "w13_outline_remove_rejects": "SELECT doc_id, 'NoSuchBookmark' AS error FROM f4_docs WHERE doc_id % 5 >= page_count",
    "w13_outline_remove": """SELECT t.doc_id, CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY t.idx) - 1 AS INT) AS idx, t.level, t.title, t.page FROM f4_tree t JOIN f4_tree k ON k.doc_id = t.doc_id AND k.idx = k.doc_id % 5 WHERE t.idx < k.idx OR t.idx > k.idx + k.descendants""",
    "w14_outline_move": """WITH k AS (SELECT n.doc_id, n.idx AS i, n.descendants AS d, o.idx AS oi FROM f4_tree n LEFT JOIN f4_tree o ON o.doc_id = n.doc_id AND o.parent IS NOT DISTINCT FROM n.parent AND o.sibling = n.sibling - 1 WHERE n.idx = n.doc_id % 5)
 SELECT t.doc_id, CAST(row_number() OVER (PARTITION BY t.doc_id ORDER BY CASE WHEN oi IS NOT NULL AND t.idx BETWEEN i AND i + d THEN oi - 0.5 ELSE t.idx END, t.idx) - 1 AS INT) AS idx, t.level, t.title, t.page, oi IS NOT NULL AS moved FROM f4_tree t JOIN k ON k.doc_id = t.doc_id""",
    "s9_outline_export": """SELECT doc_id, idx, concat(CASE WHEN sibling > 1 THEN ',' ELSE '' END, '{"title":', to_json(title), ',"page":', page, ',"children":[', repeat(']}', CAST(greatest(depth - coalesce(lead(depth) OVER (PARTITION BY doc_id ORDER BY idx), 1) + 1, 0) AS INT))) AS fragment FROM f4_tree""",
    "s9_outline_import": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS s, unnest(generate_series(1, len(ls))) AS i, len(ls) AS n FROM l)
 SELECT doc_id, CASE WHEN i % 2 = 1 THEN lpad(CAST((i + 1) // 2 AS VARCHAR), 10, '0') ELSE lpad(CAST(i // 2 AS VARCHAR), 10, '0') || '/0000000001' END AS path, CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END AS depth, s AS title, CAST(i AS BIGINT) AS page FROM x WHERE n <= 12""",
    "s9_outline_import_deep": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:10] AS ls FROM documents), x AS (SELECT doc_id, unnest(ls) AS s, unnest(generate_series(1, len(ls))) AS i FROM l)
 SELECT doc_id, repeat('0000000001/', CAST(i - 1 AS INT)) || '0000000001' AS path, CAST(i AS INT) AS depth, s AS title, CAST(i AS BIGINT) AS page FROM x""",
    "s9_outline_import_rejects": """SELECT doc_id, 'PageOutOfRange' AS error, CAST(13 AS BIGINT) AS page FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) > 12""",
    "j1_outline_destinations": """WITH hop AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN seq + 1 END AS up, CASE WHEN seq % 3 <> 0 THEN seq END AS page FROM f4_outline),
 walk AS (SELECT doc_id, seq AS start, seq AS at, 1 AS n FROM hop UNION ALL SELECT w.doc_id, w.start, h.up, n + 1 FROM walk w JOIN hop h ON h.doc_id = w.doc_id AND h.seq = w.at WHERE h.up IS NOT NULL AND n < 16),
 named AS (SELECT w.doc_id, w.start, h.page FROM walk w JOIN hop h ON h.doc_id = w.doc_id AND h.seq = w.at WHERE h.page IS NOT NULL),
 r AS (SELECT t.*, CASE t.seq % 5 WHEN 0 THEN t.seq WHEN 2 THEN CASE WHEN t.seq + 2 <= d.page_count THEN t.seq + 2 END WHEN 4 THEN NULL ELSE n.page END AS dest FROM (SELECT *, idx + 1 AS seq FROM f4_tree) t JOIN f4_docs d ON d.doc_id = t.doc_id
  LEFT JOIN named n ON n.doc_id = t.doc_id AND n.start = CASE t.seq % 5 WHEN 1 THEN t.seq WHEN 3 THEN t.seq + 1 END)
 SELECT doc_id, idx, title, CAST(dest AS INT) AS page FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.doc_id = r.doc_id AND x.dest IS NULL AND r.idx BETWEEN x.idx AND x.idx + x.descendants)""",
    "j2_page_labels": """WITH g AS (SELECT p.doc_id, p.page_no, r.style, r.prefix, r.first + p.page_no - r.start_page AS n FROM f1_pages p LEFT JOIN f11_ranges r ON r.doc_id = p.doc_id AND r.start_page = (SELECT max(start_page) FROM f11_ranges x WHERE x.doc_id = p.doc_id AND x.start_page <= p.page_no))
 SELECT doc_id, page_no, CASE WHEN style IS NULL THEN CAST(page_no AS VARCHAR) ELSE prefix || CASE style WHEN 'decimal' THEN CAST(n AS VARCHAR) WHEN 'none' THEN '' WHEN 'upper-alpha' THEN repeat(chr(CAST(65 + (n - 1) % 26 AS INT)), CAST((n - 1) // 26 + 1 AS INT))
  ELSE concat(repeat('x', CAST(n // 10 AS INT)), list_extract(['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'], CAST(n % 10 + 1 AS INT))) END END AS label FROM g""",
    "p16_label_ranges_check": "SELECT doc_id, start_page, style, prefix, first FROM f11_good",
    "p16_label_ranges_rejects": "SELECT doc_id, 'InvalidPageLabel' AS error, detail FROM f11_bad",
    "p16_label_ranges_replace": "SELECT * FROM f11_good UNION ALL SELECT doc_id, start_page, style, prefix, first FROM f11_ranges WHERE doc_id NOT IN (SELECT doc_id FROM f11_good)",
    "j3_inherit_attributes": """WITH w AS (SELECT id AS leaf, id, parent, tag, rot, 0 AS depth FROM f5_tree WHERE starts_with(id, 'o') UNION ALL SELECT w.leaf, t.id, t.parent, t.tag, t.rot, depth + 1 FROM w JOIN f5_tree t ON t.id = w.parent)
 SELECT leaf AS id, arg_min(tag, depth) FILTER (tag IS NOT NULL) AS tag, arg_min(rot, depth) FILTER (rot IS NOT NULL) AS rot FROM w GROUP BY leaf""",
    "j8_trust_chain": """WITH w AS (SELECT id AS leaf, id, parent, 0 AS n, false AS root FROM f5_tree WHERE starts_with(id, 'o') UNION ALL SELECT w.leaf, t.id, t.parent, n + 1, starts_with(t.id, 'n') AND t.key % 2 = 0 FROM w JOIN f5_num t ON t.id = w.parent WHERE NOT w.root AND n < 10)
 SELECT leaf AS id, bool_or(root) AS trusted, arg_max(id, n) AS stopped_at, CASE WHEN bool_or(root) THEN 'trusted' ELSE 'no trusted issuer' END AS outcome FROM w GROUP BY leaf""",
    "j14_qualified_names": """WITH f AS (SELECT id, parent, key, CASE substr(id, 1, 1) WHEN 'r' THEN tag WHEN 'n' THEN id WHEN 'c' THEN CASE WHEN tag IS NULL THEN id END ELSE 'p' || (key % 3) END AS name FROM f5_num),
 w AS (SELECT id, key, name AS qualified FROM f WHERE parent IS NULL AND name IS NOT NULL UNION ALL SELECT f.id, f.key, w.qualified || '.' || f.name FROM f JOIN w ON f.parent = w.id WHERE f.name IS NOT NULL)
 SELECT qualified, arg_min(id, key) AS id FROM w GROUP BY qualified""",
    "g1_reachable": """WITH w AS (SELECT id, 0 AS level FROM f5_tree WHERE id = 'r0' UNION ALL SELECT t.id, level + 1 FROM w JOIN f5_tree t ON t.parent = w.id) SELECT id, level FROM w""",
    "a6_prune_unreachable": """WITH w AS (SELECT id, num FROM f5_num WHERE id = 'r0' UNION ALL SELECT t.id, t.num FROM w JOIN f5_num t ON t.parent = w.id WHERE coalesce(t.tag, '') <> 'BUILDING')
 SELECT id, row_number() OVER (ORDER BY num) AS new_id FROM w""",
    "w16_first_page_order": """WITH w AS (SELECT id, key + 1 AS page FROM f5_num WHERE starts_with(id, 'n') UNION ALL SELECT t.id, w.page FROM w JOIN f5_tree t ON t.parent = w.id),
 c AS (SELECT t.id, t.num, min(w.page) AS page FROM f5_num t LEFT JOIN w ON w.id = t.id GROUP BY t.id, t.num)
 SELECT id, CAST(page AS BIGINT) AS claimed_by, row_number() OVER (ORDER BY page NULLS LAST, CASE WHEN starts_with(id, 'n') THEN 0 ELSE 1 END, num) AS pos FROM c""",
    "a18_articles": """WITH n AS (SELECT conv_id AS doc_id, count(*) AS beads, max(turn) AS last FROM conversations GROUP BY conv_id)
 SELECT n.doc_id, c.turn AS thread_id, CASE WHEN c.turn = 0 THEN c.text ELSE 'Untitled' END AS title, n.beads, CAST(c.turn + 1 AS INT) AS first_page FROM n JOIN conversations c ON c.conv_id = n.doc_id AND c.turn <= 1""",
    "g2_chain_rank": "SELECT conv_id AS doc_id, turn AS node, turn + 1 AS pos FROM conversations",
    "a5_dedup_exact": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents",
    "a5_dedup_by_dictionary": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text, lang, source) AS canonical FROM documents",
    "a5_rewrite_refs": """WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents)
 SELECT l.quality AS src, coalesce(c.canonical, l.doc_id) AS dst, c.canonical <> l.doc_id AS moved, count(*) AS refs FROM labels l LEFT JOIN c ON c.doc_id = l.doc_id GROUP BY ALL""",
    "a4_optimize_report": """WITH o AS (SELECT source, text, doc_id IN (SELECT doc_id FROM labels) AS live, coalesce(strlen(text), 0) AS size FROM documents),
 n AS (SELECT *, row_number() OVER (PARTITION BY source, text, live) AS n FROM o)
 SELECT source, CAST(sum(size) AS BIGINT) AS bytes_before, CAST(sum(CASE WHEN live AND n = 1 THEN size ELSE 0 END) AS BIGINT) AS bytes_after, CAST(sum(CASE WHEN live AND n = 1 THEN 0 ELSE size END) AS BIGINT) AS bytes_saved,
 round(CASE WHEN sum(size) = 0 THEN 0.0 ELSE sum(CASE WHEN live AND n = 1 THEN 0 ELSE size END)::DOUBLE / sum(size) END, 4) AS ratio, count(*) FILTER (NOT live OR n > 1 OR size = 0) AS objects_removed, count(*) FILTER (live AND n > 1 AND size > 0) AS duplicates, count(*) FILTER (NOT live) AS unreachable FROM n GROUP BY source""",
    "a4_optimize_safe": """SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes_before, CAST(sum(strlen(text)) AS BIGINT) AS bytes_after, CAST(0 AS BIGINT) AS bytes_saved, CAST(0 AS DOUBLE) AS ratio,
 count(*) FILTER (coalesce(strlen(text), 0) = 0) AS objects_removed, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS unreachable FROM documents GROUP BY source""",
    "a1_body_font_size": """SELECT doc_id, arg_max(b, struct_pack(w := w, b := b)) AS body FROM (SELECT doc_id, round(size * 2) / 2 AS b, sum(greatest(length(text), 1)) AS w FROM f3_lines GROUP BY ALL) GROUP BY doc_id""",
    "a2_heading_levels": """WITH z AS (SELECT doc_id, round(size * 2) / 2 AS b, sum(greatest(length(text), 1)) AS w FROM f3_lines GROUP BY ALL), y AS (SELECT *, first_value(b) OVER (PARTITION BY doc_id ORDER BY w DESC, b DESC) AS body FROM z)
 SELECT doc_id, b AS bucket, CAST(least(row_number() OVER (PARTITION BY doc_id ORDER BY b DESC), 6) AS INT) AS level FROM y WHERE b > body * 1.1""",
    "a3_page_left_margin": """SELECT doc_id, page_no, e AS page_left FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, e) AS k FROM (SELECT doc_id, page_no, round(x0) AS e, count(*) AS n FROM f3_lines GROUP BY ALL)) WHERE k = 1""",
    "w15_line_kinds": "SELECT doc_id, line_no, kind, CAST(CASE WHEN kind = 'heading' THEN level END AS INT) AS level FROM w15_walk",
    "w15_to_markdown": """WITH e AS (SELECT *, count(CASE WHEN kind <> 'tail' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS opened, lag(kind) OVER d AS pk, lag(block_no) OVER d AS pb, lag(page_no) OVER d AS pp FROM w15_walk WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
 f AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS k2 FROM e WHERE kind <> 'tail')
 SELECT e.doc_id, e.line_no, CASE WHEN e.pk IS NULL THEN '' WHEN e.kind = 'tail' OR (e.kind = 'paragraph' AND e.pk = 'paragraph' AND e.pb = e.block_no AND e.pp = e.page_no) THEN ' ' WHEN e.kind = 'item' AND f.k2 = 'item' THEN chr(10) ELSE chr(10) || chr(10) END
  || CASE e.kind WHEN 'heading' THEN repeat('#', CAST(e.level AS INT)) || ' ' WHEN 'item' THEN '- ' ELSE '' END || e.shown AS fragment FROM e LEFT JOIN f ON f.doc_id = e.doc_id AND f.line_no = e.line_no""",
    "w15_plain_paragraphs": """SELECT doc_id, line_no, CASE WHEN pb IS NULL THEN '' WHEN pb = block_no AND pp = page_no THEN ' ' ELSE chr(10) || chr(10) END || regexp_replace(trim(text), '[\\s\\x{A0}]+', ' ', 'g') AS fragment
 FROM (SELECT *, lag(block_no) OVER d AS pb, lag(page_no) OVER d AS pp FROM f3_seen WINDOW d AS (PARTITION BY doc_id ORDER BY line_no))""",
    "j4_redact_area": """SELECT p.doc_id, q.rect_id, count(*) AS pages_redacted, count(*) AS boxes_drawn, CAST(coalesce(max(h.gone), 0) AS BIGINT) AS runs_removed, CAST(coalesce(max(h.cut), 0) AS BIGINT) AS runs_trimmed, CAST(coalesce(max(h.glyphs), 0) AS BIGINT) AS glyphs_removed
 FROM f2_pages p JOIN f7_rects q ON q.page_no = p.page_no LEFT JOIN (SELECT doc_id, rect_id, count(*) FILTER (removed = glyphs) AS gone, count(*) FILTER (removed < glyphs) AS cut, sum(removed) AS glyphs FROM f7_hits GROUP BY ALL) h ON h.doc_id = p.doc_id AND h.rect_id = q.rect_id GROUP BY p.doc_id, q.rect_id""",
    "j4_redact_kept": "SELECT doc_id, line_no, text FROM f7_runs r WHERE NOT EXISTS (SELECT 1 FROM f7_hits h WHERE h.doc_id = r.doc_id AND h.line_no = r.line_no)",
    "j5_redact_find": """SELECT doc_id, needle, count(*) AS runs_removed, CAST(sum(length(text)) AS BIGINT) AS glyphs_removed, count(DISTINCT page_no) AS pages_redacted FROM f7_runs JOIN (VALUES ('the'), ('est'), ('ou'), ('zzqx')) AS n(needle) ON contains(text, needle) GROUP BY doc_id, needle""",
    "j5_redact_requests": """WITH q AS (SELECT DISTINCT doc_id, unnest([substr(text, 5, 6), substr(text, 1, 1), substr(text, 20, 2), substr(text, 40, 3), 'zzqx']) AS needle FROM documents)
 SELECT q.doc_id, needle, count(*) AS runs_removed, CAST(sum(length(r.text)) AS BIGINT) AS glyphs_removed, count(DISTINCT page_no) AS pages_redacted FROM q JOIN f7_runs r ON r.doc_id = q.doc_id AND contains(r.text, needle) WHERE needle <> '' GROUP BY q.doc_id, needle""",
    "j5_request_rejects": """WITH q AS (SELECT DISTINCT doc_id, unnest([substr(text, 5, 6), substr(text, 1, 1), substr(text, 20, 2), substr(text, 40, 3), 'zzqx']) AS needle FROM documents)
 SELECT doc_id, needle, CASE WHEN needle = '' THEN 'EmptySearchText' ELSE 'TextNotFound' END AS error FROM q WHERE needle = '' OR NOT EXISTS (SELECT 1 FROM f7_runs r WHERE r.doc_id = q.doc_id AND contains(r.text, q.needle))""",
    "j5_redact_rejects": """SELECT d.doc_id, needle, 'TextNotFound' AS error FROM documents d CROSS JOIN (VALUES ('the'), ('est'), ('ou'), ('zzqx')) AS n(needle) WHERE NOT EXISTS (SELECT 1 FROM f7_runs r WHERE r.doc_id = d.doc_id AND contains(r.text, needle))""",
    "j6_redact_paths": """SELECT doc_id, rect_id, count(*) AS paths_removed FROM (SELECT *, CASE WHEN line_no % 2 = 0 THEN 2 ELSE 0 END AS g FROM f7_runs WHERE line_no % 7 <> 0) r JOIN (VALUES (1, 1, 60, 300, 600, 800), (2, 2, 71, 100, 300, 770)) AS q(rect_id, page_no, a0, b0, a1, b1) ON q.page_no = r.page_no
 WHERE x0 - g >= a0 AND y0 - g >= b0 AND x1 + g <= a1 AND y1 + g <= b1 GROUP BY doc_id, rect_id""",
    "j9_verify_digest": """SELECT doc_id, doc_id % 7 IN (0, 6) OR (doc_id % 7 = 4 AND false) AS intact, CASE doc_id % 7 WHEN 1 THEN 'range of 3 numbers' WHEN 2 THEN 'range outside the content' WHEN 3 THEN 'no range' WHEN 4 THEN 'changed' WHEN 5 THEN 'no digest' ELSE 'equal' END AS reason FROM documents""",
    "j11_compare_pages": """SELECT pair_id, CAST(c AS INT) AS changed, 21 AS total, round(c * 100.0::DOUBLE / 21, 4) AS percent FROM (SELECT pair_id, len(list_filter(generate_series(0, 20), lambda p: abs(left_s[p * 3 + 1]::DOUBLE - right_s[p * 3 + 1]::DOUBLE) > 0.2 OR abs(left_s[p * 3 + 2]::DOUBLE - right_s[p * 3 + 2]::DOUBLE) > 0.2 OR abs(left_s[p * 3 + 3]::DOUBLE - right_s[p * 3 + 3]::DOUBLE) > 0.2)) AS c FROM f10_pairs)""",
    "a8_image_effective_dpi": "SELECT image_id, round(dpi, 4) AS dpi FROM f6_dpi",
    "a7_image_triage": "SELECT image_id, outcome, CASE WHEN outcome = 'recompress' THEN greatest(CAST(round(px_w * (72.0::DOUBLE / dpi)) AS INT), 1) END AS new_w, CASE WHEN outcome = 'recompress' THEN greatest(CAST(round(px_h * (72.0::DOUBLE / dpi)) AS INT), 1) END AS new_h FROM f6_outcome",
    "a9_compress_report": """WITH c AS (SELECT image_id, outcome, CAST(px_w AS BIGINT) * px_h * 3 AS b, CASE WHEN outcome = 'recompress' THEN CAST(greatest(CAST(round(px_w * (72.0::DOUBLE / dpi)) AS INT), 1) AS BIGINT) * greatest(CAST(round(px_h * (72.0::DOUBLE / dpi)) AS INT), 1) * 3 ELSE CAST(px_w AS BIGINT) * px_h * 3 END AS a FROM f6_outcome),
 g AS (SELECT doc_id, outcome, count(*) AS images, CAST(sum(b) AS BIGINT) AS bytes_before, CAST(sum(a) AS BIGINT) AS bytes_after FROM (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS image_id FROM lineitem) u JOIN c ON c.image_id = u.image_id GROUP BY doc_id, outcome)
 SELECT g.*, CAST(t.n AS BIGINT) AS examined, CAST(t.r AS BIGINT) AS recompressed FROM g JOIN (SELECT doc_id, sum(images) AS n, sum(CASE WHEN outcome = 'recompress' THEN images ELSE 0 END) AS r FROM g GROUP BY doc_id) t ON t.doc_id = g.doc_id""",
    "a10_filter_report": """SELECT doc_id, count(*) AS images_examined, count(*) FILTER (NOT masked AND readable) AS usable, count(*) FILTER (masked) AS skipped_mask, count(*) FILTER (NOT masked AND NOT readable) AS skipped_samples
 FROM (SELECT DISTINCT u.doc_id, p.image_id FROM f12_uniq u JOIN f1_pages p ON p.doc_id = u.doc_id AND p.page_no = u.page_no) x JOIN f6_readable i ON i.image_id = x.image_id GROUP BY doc_id""",
    "a10_filter_targets": """SELECT doc_id, image_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS ord FROM (SELECT u.doc_id, p.image_id, min(u.pos) AS pos FROM f12_uniq u JOIN f1_pages p ON p.doc_id = u.doc_id AND p.page_no = u.page_no GROUP BY u.doc_id, p.image_id)""",
    "s10_asset_manifest": """SELECT doc_id, image_id, CAST(n AS INT) AS n, concat('doc', doc_id, '-image-', n, CASE WHEN filter = 'DCT' THEN '.jpg' ELSE '.png' END) AS name FROM (
 SELECT doc_id, u.image_id, filter, row_number() OVER (PARTITION BY doc_id ORDER BY u.image_id) AS n FROM (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS image_id FROM lineitem) u JOIN f6_readable i ON i.image_id = u.image_id WHERE readable)""",
    "a11_repair_audit": """SELECT *, wrong_length = 0 AND unreachable = 0 AND repeated = 0 AND NOT missing_root AS is_clean FROM (SELECT source AS doc_id, count(*) FILTER (n_chars <> strlen(text)) AS wrong_length, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unreachable,
 count(*) - count(DISTINCT doc_id % 97) AS repeated, NOT bool_or(doc_id % 97 = 0) AS missing_root FROM documents GROUP BY source)""",
    "a11_last_definitions": "SELECT source AS doc_id, doc_id % 97 AS obj_no, max(doc_id) AS id FROM documents GROUP BY ALL",
    "p14_sanitize_pages": """SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>')) AS INT) AS javascript_removed, CAST(len(regexp_extract_all(s, '(?i) href="file:[^"]*"')) AS INT) AS launch_removed, CAST(len(regexp_extract_all(s, '(?i) href="[^#"][^"]*"')) AS INT) AS external_removed, md5(regexp_replace(s, '(?i) href="[^#"][^"]*"', '', 'g')) AS clean_md5
 FROM (SELECT *, regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g') AS s FROM pages)""",
    "a13_conformance_check": "SELECT doc_id, unnest(issues) AS issue FROM a13_rules",
    "a13_conformance_summary": "SELECT doc_id, CAST(len(issues) AS BIGINT) AS issues, len(issues) = 0 AS conformant FROM a13_rules",
    "p15_strip_identifying": """SELECT user_id AS doc_id, CAST(sum(CASE WHEN event_type <> 'signup' THEN len(json_keys(props)) ELSE 0 END) AS BIGINT) AS info_keys_removed, count(*) FILTER (event_type = 'signup') AS metadata_removed, sha256('key' || user_id) AS new_id FROM events GROUP BY user_id""",
    "p6_metadata_edit": """SELECT m.doc_id, nullif(CASE WHEN title_op = 'set' THEN title_val ELSE title END, '') AS title, CASE WHEN author_op = 'clear' THEN NULL ELSE author END AS author, subject, CASE WHEN keywords_op = 'set' THEN keywords_val ELSE keywords END AS keywords FROM f13_meta m LEFT JOIN f13_edits e ON e.doc_id = m.doc_id""",
    "a15_ocr_triage": """SELECT doc_id, count(*) AS pages, count(*) FILTER (t > 0) AS already_text, count(*) FILTER (t = 0) AS needed, count(*) FILTER (t = 0 AND h = 0) AS nothing_found FROM (
 SELECT doc_id, page_no, sum(CASE WHEN tag <> 'h1' THEN length(text) ELSE 0 END) AS t, sum(CASE WHEN tag = 'h1' THEN length(text) ELSE 0 END) AS h FROM f3_lines GROUP BY ALL) GROUP BY doc_id""",
    "a16_flatten_report": """SELECT doc_id, count(*) FILTER (b AND w) AS widgets_flattened, count(*) FILTER (b AND NOT w) AS annots_flattened, count(*) FILTER (NOT hidden AND NOT has_appearance AND subtype NOT IN ('Link', 'Popup')) AS skipped, count(DISTINCT CASE WHEN b THEN page_no END) AS pages_flattened, count(*) FILTER (w AND NOT hidden AND NOT has_appearance) = 0 AS form_removed
 FROM (SELECT *, NOT hidden AND has_appearance AS b, subtype = 'Widget' AS w FROM f9_annots) GROUP BY doc_id""",
    "a16_flatten_forms_only": """SELECT doc_id, count(*) FILTER (b AND w) AS widgets_flattened, CAST(0 AS BIGINT) AS annots_flattened, count(*) FILTER (w AND NOT hidden AND NOT has_appearance) AS skipped, count(DISTINCT CASE WHEN b AND w THEN page_no END) AS pages_flattened, count(*) FILTER (w AND NOT hidden AND NOT has_appearance) = 0 AS form_removed
 FROM (SELECT *, NOT hidden AND has_appearance AS b, subtype = 'Widget' AS w FROM f9_annots) GROUP BY doc_id""",
    "a14_edit_log_fold": "SELECT doc_id, page_no, rotation FROM f9_fold",
    "a14_dirty_documents": """WITH s AS (SELECT doc_id, page_no, CAST(((sum(degrees) % 360) + 360) % 360 AS INT) AS rotation FROM f9_edits WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL)
 SELECT doc_id, count(*) AS changed_pages FROM (SELECT coalesce(a.doc_id, s.doc_id) AS doc_id, a.rotation AS x, nullif(s.rotation, 0) AS y FROM f9_fold a FULL JOIN s ON s.doc_id = a.doc_id AND s.page_no = a.page_no) WHERE x IS DISTINCT FROM y GROUP BY doc_id""",
    "t1_job_status": "SELECT job_id, status, status IN ('done', 'failed', 'cancelled') AS finished FROM f9_status WHERE status <> 'none'",
    "t1_queue_summary": "SELECT status, count(*) AS jobs FROM f9_status WHERE status <> 'none' GROUP BY status",
    "t1_job_status_stream": "SELECT job_id, status, status IN ('done', 'failed', 'cancelled') AS finished FROM f9_status WHERE status <> 'none'",
    "t1_queue_run": "SELECT queue, seq, job_id, action, reason IS NULL AS accepted, reason FROM f9_run",
    "t1_queue_run_stream": "SELECT queue, seq, job_id, action, reason IS NULL AS accepted, reason FROM f9_run",
    "t2_edit_log_stream": "SELECT doc_id, page_no, rotation FROM f9_fold",
    "j10_form_fill": "SELECT doc_id, name, outcome, reason FROM f8_outcome",
    "j10_form_report": "SELECT doc_id, count(*) FILTER (outcome = 'filled') AS filled, count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'unsupported') AS unsupported FROM f8_outcome GROUP BY doc_id",
    "j10_form_data": "SELECT event_id AS doc_id, 'name' AS name, 'text' AS kind, event_type || event_id AS value FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, 'agree', 'bool', CASE WHEN event_id % 5 = 0 OR value > 10 THEN 'true' ELSE 'false' END FROM events WHERE event_id % 5 IN (0, 4)",
    "j10_form_data_rejects": """SELECT event_id AS doc_id, 'InvalidFormData' AS error, CASE event_id % 5 WHEN 1 THEN 'value of k is number' WHEN 2 THEN 'value of a is null' ELSE 'not an object' END AS detail FROM events WHERE event_id % 5 IN (1, 2, 3)""",
    "j12_attachment_rejects": "SELECT user_id AS doc_id, event_id AS seq, 'InvalidAttachment' AS error FROM events WHERE event_id % 10 = 0",
    "j12_attachments_upsert": "SELECT user_id AS doc_id, event_type AS name, arg_max(props, event_id) AS payload, CAST(strlen(arg_max(props, event_id)) AS BIGINT) AS size FROM events GROUP BY user_id, event_type",
    "j12_extract_found": """SELECT user_id AS doc_id, event_type AS name, props AS payload, CAST(strlen(props) AS BIGINT) AS size FROM events e WHERE event_type IN ('click', 'signup')
 AND event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type)""",
    "j12_extract_missing": """SELECT u.doc_id, n.name, 'NoSuchAttachment' AS error FROM (SELECT DISTINCT user_id AS doc_id FROM events) u CROSS JOIN (VALUES ('click'), ('signup'), ('nothing')) AS n(name) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.doc_id AND e.event_type = n.name)""",
    "j13_layer_visibility": "SELECT user_id AS doc_id, event_type AS name, max(event_id) % 2 = 1 AS visible FROM events GROUP BY user_id, event_type",
    "j13_layer_rejects": """SELECT DISTINCT user_id AS doc_id, 'error' AS name, CASE WHEN EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type <> 'error') THEN 'NoSuchLayer' ELSE 'NoLayers' END AS error FROM events e WHERE event_type = 'error'""",
    "u2_collect_signature_fields": "SELECT user_id AS doc_id, event_id AS obj, CASE WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS src, CASE WHEN event_type = 'purchase' THEN 'form' ELSE 'page' END || event_id AS name FROM events",
    "e_decode_text": "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') ELSE text END) AS text_md5 FROM documents",
    "e_human_sizes": """SELECT doc_id, CASE WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN format('{:.1f} KB', z / 1024.0::DOUBLE) WHEN z < 1073741824 THEN format('{:.1f} MB', z / 1048576.0::DOUBLE) ELSE format('{:.1f} GB', z / 1073741824.0::DOUBLE) END AS size, CASE WHEN doc_id % 3 = 1 THEN '1 page' ELSE doc_id % 3 || ' pages' END AS pages FROM (SELECT doc_id, n_chars * n_chars AS z FROM documents)""",
    "e_pdf_dates": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +05:30' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01 00:00:00') || ' +00:00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') || ' +00:00' END AS shown FROM orders""",
    "e_colors": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round((p_partkey // 65536 % 256) / 255.0::DOUBLE, 4) WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 END AS r, CASE p_partkey % 4 WHEN 0 THEN round((p_partkey // 256 % 256) / 255.0::DOUBLE, 4) WHEN 1 THEN 0.5 WHEN 2 THEN round(p_partkey / 10000.0::DOUBLE, 4) END AS g, CASE p_partkey % 4 WHEN 0 THEN round((p_partkey % 256) / 255.0::DOUBLE, 4) WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 END AS b FROM part""",
    "e_render_pixels": "SELECT doc_id, page_no, CAST(round(page_w * 150.0::DOUBLE / 72) AS INT) AS px_w, CAST(round(page_h * 150.0::DOUBLE / 72) AS INT) AS px_h FROM f1_pages",
}


#: Views of Markdown, and the same over odd pages alone.
_MARKDOWN = ("f3_seen", "w15_size", "w15_left", "w15_level", "w15_line", "w15_walk")


def _of_odd_pages(sql: str) -> str:
    return re.sub(rf"\b({'|'.join(_MARKDOWN)})\b", r"\1_odd", sql)


VIEWS |= {f"{name}_odd": _of_odd_pages(VIEWS[name]) for name in _MARKDOWN}
VIEWS["f3_seen_odd"] += " AND page_no % 2 = 1"
SQL["w15_markdown_of_pages"] = _of_odd_pages(SQL["w15_to_markdown"])


def _needed(sql: str) -> list[str]:
    names: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in names:
                names.append(name)
                visit(VIEWS[name].replace(name, ""))

    visit(sql)
    return [name for name in VIEWS if name in names]


def full(sql: str) -> str:
    """A query with the views it uses in front."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
    body = sql.strip()
    own = re.match(r"WITH (.*)", body, re.S)
    if own and parts:
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + own.group(1)
    if parts:
        return "WITH RECURSIVE " + ", ".join(parts) + " " + body
    return body.replace("WITH ", "WITH RECURSIVE ", 1) if own else body


def oracles() -> dict[str, str]:
    return {name: full(sql) for name, sql in SQL.items()}
