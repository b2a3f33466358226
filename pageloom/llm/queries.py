"""One query for each operator here, over its whole table; ``SQL`` holds those DuckDB can answer too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm import decontaminate, extraction, fixity, hard_negatives, manifest, multi_index, packing, preference, preferences, secrets, setsketch, sharding, token_counts
from pageloom.llm.common import ids_crc_mod3, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_simhash_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("mark")


@query
def op4_trigram_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, d, "documents")))


@query
def op7_pairwise_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    ranker = preference.learn(docs, read(spark, d, "labels"), where=ids_crc_mod3() != 1)
    out = preference.scored(docs, ranker)
    return out.select("doc_id", F.coalesce(ids_crc_mod3() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_setsketch_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return setsketch.components(read(spark, d, "documents"))


@query
def op9_pre_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(read(spark, d, "documents"))


@query
def op10_hierarchical_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


@query
def op1_inverted_multi_index(spark: SparkSession, d: str) -> DataFrame:
    return multi_index.search(read(spark, d, "embeddings"), F.col("id") % 20 == 0)


@query
def op5_tree_model_extraction(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(read(spark, d, "pages"))


@query
def op2_preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation is preferred to itself with the next one's last reply."""
    turns = read(spark, d, "conversations")
    pair = F.col("conv_id").alias("pair_id")
    return preferences.format_preferences(turns.select(pair, "turn", "role", "text"), preferences.with_foreign_reply(turns).select(pair, "turn", "role", "text"))


SQL["op2_preference_pairs"] = """
WITH named AS (SELECT conv_id, turn, lower(role) AS role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
reply AS (SELECT conv_id, max(turn) AS last, max_by(text, turn) AS reply FROM named WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM named),
b AS (SELECT n.conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM named n LEFT JOIN reply r USING (conv_id) WHERE last IS NULL OR turn < last
 UNION ALL SELECT r.conv_id, r.last, 'assistant', coalesce(s.reply, '') FROM reply r JOIN reply s ON s.conv_id = r.conv_id + 1),
diff AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.turn, b.turn)) AS f FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.turn = b.turn
 WHERE a.pair_id IS NULL OR b.pair_id IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
parts AS (SELECT a.*, CASE WHEN f IS NULL OR turn < f THEN 'prompt' ELSE 'chosen' END AS part FROM a LEFT JOIN diff USING (pair_id)
 UNION ALL SELECT b.*, 'rejected' FROM b JOIN diff USING (pair_id) WHERE turn >= f),
shown AS (SELECT pair_id, part, turn, role, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) AS head,
 '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS piece FROM parts)
SELECT pair_id, part, turn, role, piece, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) END AS loss_start,
 CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(piece) - 1 END AS loss_end FROM shown
"""


def _damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults: of every 97 pages one has a changed character, one is cut off, one is lost."""
    turn, n = F.col("page_id") % 97, F.length("html")
    html = (
        F.when(turn == 5, F.concat(F.substr("html", F.lit(1), F.floor(n / 2)), F.lit("#"), F.substr("html", F.floor(n / 2) + 2)))
        .when(turn == 36, F.substr("html", F.lit(1), F.floor(n / 3)))
        .otherwise(F.col("html"))
    )
    return pages.where(F.coalesce(turn != 71, F.lit(True))).select("page_id", "url", html.alias("html"))


@query
def op6_merkle_fixity(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages")
    return fixity.audit(pages, _damaged(pages))


SQL["op6_merkle_fixity"] = """
WITH both_ AS (
 SELECT 'p' AS side, page_id, url, coalesce(html, '') AS html FROM pages
 UNION ALL SELECT 'r', page_id, url, coalesce(CASE page_id % 97 WHEN 5 THEN substr(html, 1, CAST(floor(length(html) / 2) AS BIGINT)) || '#' || substr(html, CAST(floor(length(html) / 2) AS BIGINT) + 2)
  WHEN 36 THEN substr(html, 1, CAST(floor(length(html) / 3) AS BIGINT)) ELSE html END, '') FROM pages WHERE page_id % 97 <> 71),
records AS (SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
 || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_),
hashed AS (SELECT side, page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS sha, CAST(floor(page_id / 1000) AS BIGINT) AS file_no FROM records),
placed AS (SELECT *, CAST(sum(length) OVER (PARTITION BY side, file_no ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM hashed)
SELECT p.page_id, CASE WHEN r.page_id IS NULL THEN 'missing' ELSE 'corrupt' END AS status, p.file_no, p."offset", p.length, p.sha AS primary_sha256, r.sha AS replica_sha256
FROM (SELECT * FROM placed WHERE side = 'p') p LEFT JOIN (SELECT * FROM placed WHERE side = 'r') r ON p.page_id = r.page_id WHERE r.page_id IS NULL OR r.sha <> p.sha
"""


@query
def op11_postorder_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every document's proof, folded from a tampered row (n_chars one higher) where 7 divides the CRC-32 of its id."""
    docs = read(spark, d, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, manifest.leaf_digest(n_chars=F.col("n_chars") + 1))
    return manifest.verify(manifest.build(docs, claim=claim)).withColumnRenamed("key", "doc_id")


SQL["op11_postorder_manifest"] = """
WITH RECURSIVE rows_ AS (SELECT doc_id, source, lang, n_chars, text,
 xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295) % 7 = 0 AS tampered FROM documents),
parts AS (SELECT doc_id, lang, n_chars, coalesce(tampered, false) AS tampered, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
 coalesce(strlen(text) || ':' || text, '-') AS tail FROM rows_),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
 CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claim FROM parts),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
tree AS (SELECT grp, 0 AS lvl, idx, leaf AS h FROM leaves
 UNION ALL SELECT grp, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM tree) WHERE c > 1 GROUP BY grp, lvl, idx // 2),
tops AS (SELECT grp, max(lvl) AS height, arg_max(h, lvl) AS h, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM tree WHERE idx = 0 GROUP BY grp),
forest AS (SELECT 0 AS lvl, place AS idx, h FROM tops
 UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM forest) WHERE c > 1 GROUP BY lvl, idx // 2),
top AS (SELECT max(lvl) AS height, arg_max(h, lvl) AS root FROM forest),
steps AS (SELECT l.grp, l.idx, k AS step, (l.idx >> k) & 1 = 1 AS at_left, t.h FROM leaves l JOIN tops USING (grp) JOIN range(64) r(k) ON k < height
  LEFT JOIN tree t ON t.grp = l.grp AND t.lvl = k AND t.idx = xor(l.idx >> k, 1)
 UNION ALL SELECT l.grp, l.idx, o.height + k, (o.place >> k) & 1 = 1, f.h FROM leaves l JOIN tops o USING (grp) CROSS JOIN top JOIN range(64) r(k) ON k < top.height
  LEFT JOIN forest f ON f.lvl = k AND f.idx = xor(o.place >> k, 1)),
folded AS (SELECT grp, idx, 0 AS step, coalesce(claim, leaf) AS h FROM leaves
 UNION ALL SELECT s.grp, s.idx, s.step + 1, sha256(CASE WHEN s.h IS NULL THEN p.h WHEN at_left THEN s.h || p.h ELSE p.h || s.h END) FROM folded p JOIN steps s ON s.grp = p.grp AND s.idx = p.idx AND s.step = p.step),
ends AS (SELECT grp, idx, arg_max(h, step) AS folded_root FROM folded GROUP BY grp, idx),
proof AS (SELECT grp, idx, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY grp, idx)
SELECT doc_id, leaf, o.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN tops o USING (grp) CROSS JOIN top JOIN ends e ON e.grp = l.grp AND e.idx = l.idx LEFT JOIN proof p ON p.grp = l.grp AND p.idx = l.idx
"""


@query
def op12_hilbert_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 100 == 0)


SQL["op12_hilbert_hard_negatives"] = """
WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query
def op13_virtual_slot_shards(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shard(read(spark, d, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
