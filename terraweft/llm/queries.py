"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.llm import ann, chat, collocations, decontam, html_tree, mixing, negatives, ngram_join, pii, quality, substring, urls, warc
from terraweft.session import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"), size=5, percent=80)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_pseudonyms(docs, pii.session_key(spark))
    return found.select("doc_id", "text", F.size("_pii").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("_pii")), ",").alias("kinds"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10, factor=1.0)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.rendered(chat.folded(chat.events_of(rows)))
    done = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_tree.with_text(pages.select("page_id", "url", "html"), html_tree.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    rows = negatives.whole_numbers(vectors, 256)
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"), positives=5, negatives=10, least=30, most=90)


#: Host, path and verdict of the rules that op12 applies.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), rules)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), size=5, least=100, share=100, top=2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc_zstd": op5_warc_zstd,
    "op6_vantage_point_search": op6_vantage_point_search,
    "op8_chat_formatting": op8_chat_formatting,
    "op7_source_mixing": op7_source_mixing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filters": op12_url_filters,
    "op13_phrase_collocations": op13_phrase_collocations,
}

OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.e) = len(b.e)
), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE same) WHERE nth <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP12_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), p AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(rh, rp, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (SELECT k, max({'n': length(rh) + length(rp), 'h': length(rh), 'rule': rh || rp, 'verdict': verdict}) AS best FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (k)
"""

OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)
), s AS (SELECT lang, p, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM p
), e AS (
  SELECT lang, w AS g1, w || ' ' || lead(w, 1) OVER o AS g2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g3,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g4,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g5
  FROM s WINDOW o AS (PARTITION BY p ORDER BY i)
), f AS (
  SELECT lang, g1 AS phrase, 1 AS size, count(*) AS f FROM e GROUP BY 1, 2
  UNION ALL SELECT lang, g2, 2, count(*) FROM e WHERE g2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100
  UNION ALL SELECT lang, g3, 3, count(*) FROM e WHERE g3 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100
  UNION ALL SELECT lang, g4, 4, count(*) FROM e WHERE g4 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100
  UNION ALL SELECT lang, g5, 5, count(*) FROM e WHERE g5 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1
), h AS MATERIALIZED (SELECT lang, phrase, size, f, struct_pack(a := lang, b := phrase) AS at FROM f WHERE f >= 100
), c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM h WHERE size >= 2
), cuts AS (SELECT lang, phrase, w, f AS a, size, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM c, range(1, 5) AS r(k) WHERE k < size
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cuts.size, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN h x ON x.at = struct_pack(a := cuts.lang, b := head) JOIN h y ON y.at = struct_pack(a := cuts.lang, b := tail) JOIN n ON n.lang = cuts.lang
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, f FROM c, range(2, 5) AS r(m), range(1, 5) AS q(i) WHERE m < size AND i + m - 1 <= size) GROUP BY 1, 2
), kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, win)
), words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), low AS (SELECT h, min(doc_id) AS lowest FROM win GROUP BY h
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM win JOIN low USING (h) WHERE lowest < doc_id GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
    CASE WHEN g IS NULL THEN w ELSE list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(g, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS k
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

OP5_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to FROM m
"""

OP6_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS er, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(er) + length(et) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, concat(len(w), ' words: ', array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)
), e AS (SELECT i AS a, j AS b FROM l UNION ALL SELECT j, i FROM l
), reach(node, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen
), c AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(k, 0) AS n_links FROM c LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM e GROUP BY 1) USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', '20240601', CAST(doc_id AS VARCHAR), coalesce(text, ''))) AS tie FROM documents
), f AS (SELECT *, CAST(concat('0x', substr(tie, 30, 3)) AS BIGINT) AS fine FROM d
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), c AS (SELECT *, sum(cap) OVER before AS full_cap, sum(weight) OVER before AS full_weight, sum(weight) OVER () AS all_weight FROM w
  WINDOW before AS (ORDER BY cap * 1e0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (SELECT *, CAST(total - coalesce(full_cap, 0) AS BIGINT) / CAST(all_weight - coalesce(full_weight, 0) AS BIGINT) AS level FROM c
), x AS (SELECT *, (SELECT arg_min(level, cap * 1e0 / weight) FROM v WHERE level * weight <= cap) AS fixed FROM v
), t AS (SELECT source, source_size, total, least(cap * 1e0, coalesce(fixed * weight, cap * 1e0)) AS target, CAST(ceil(total / 64e0) AS BIGINT) AS seats FROM x
), q AS (SELECT source, n, row_number() OVER (ORDER BY target / (2 * n + 1) DESC, source NULLS LAST, n) AS rank, seats FROM (SELECT *, unnest(range(0, seats)) AS n FROM t WHERE target > 0)
), b AS (SELECT source, count(*) AS blocks FROM q WHERE rank <= seats GROUP BY source
), k AS (SELECT t.source, t.source_size, t.target, coalesce(blocks, 0) AS blocks, CAST(pow(2, least(12, greatest(0, ceil(log2(greatest(t.source_size, 1) / 400000e0))))) AS BIGINT) AS shards FROM t LEFT JOIN b ON b.source IS NOT DISTINCT FROM t.source
), g AS (SELECT f.doc_id, f.size, f.source, f.tie, k.source_size, k.target, k.blocks, f.fine % k.shards AS shard FROM f JOIN k ON k.source IS NOT DISTINCT FROM f.source
), h AS (SELECT source, blocks, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM g GROUP BY source, blocks, shard
), r AS (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * n + 1) DESC, shard, n) AS rank FROM (SELECT *, unnest(range(0, blocks)) AS n FROM h WHERE shard_size > 0)
), u AS (SELECT h.source, h.shard, h.shard_size, least(64 * count(r.rank), 3 * h.shard_size) AS quota FROM h LEFT JOIN r ON r.source IS NOT DISTINCT FROM h.source AND r.shard = h.shard AND r.rank <= r.blocks GROUP BY h.source, h.shard, h.shard_size
), o AS (SELECT g.*, u.shard_size, u.quota, sum(g.size) OVER (PARTITION BY g.source, g.shard ORDER BY g.tie, g.doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM g JOIN u ON u.source IS NOT DISTINCT FROM g.source AND u.shard = g.shard)
SELECT doc_id, size, source, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE quota // shard_size * size + greatest(0, least(size, quota % shard_size - (upto - size))) END AS BIGINT) AS taken FROM o
"""

OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[a-z/][^>]*(>|$)', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)) AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op7_source_mixing": OP7_SQL,
    "op10_html_extraction": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_phrase_collocations": OP13_SQL,
    "op6_vantage_point_search": OP6_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op5_warc_zstd": OP5_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
}
