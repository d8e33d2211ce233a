"""One query for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, langid, linefreq, manifest, ngram_join, packing, phrases, pii, quality, sharding, toxicity, vectors
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def _scored(out: DataFrame, mod: int, held: int, threshold: float) -> DataFrame:
    return out.select("doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _scored(quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"]), 4, 2, 0.7)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.assess(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"), pii.train())


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _scored(toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"]), 5, 0, 0.5)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), html_extract.train(), keep=["page_id", "url"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_copies(_table(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.build(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1,
        "op2_harmonic_packing": op2,
        "op3_positional_decontamination": op3,
        "op4_hash_tree_sharding": op4,
        "op5_cross_parsing_language": op5,
        "op6_compression_quality": op6,
        "op7_line_frequency": op7,
        "op8_crf_pii": op8,
        "op9_weak_supervision_toxicity": op9,
        "op10_graphical_html": op10,
        "op11_phrase_collocations": op11,
        "op12_cross_polytope_near_vectors": op12,
        "op13_merkle_manifest": op13,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT row, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT row, array_to_string(ws[i:i + 4], ' ') AS sh FROM i),
n AS (SELECT row, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.row AS x, b.row AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.row <> b.row GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.row = x JOIN n b ON b.row = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(d, m) AS (SELECT row, row FROM w UNION SELECT r.d, e.y FROM r JOIN e ON r.m = e.x),
k AS (SELECT d, min(w.doc_id) AS component_id FROM r JOIN w ON w.row = r.m GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id
FROM w LEFT JOIN n USING (row) JOIN k ON k.d = w.row
"""

OP3_SQL = rf"""
WITH dw AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM bw WHERE len(ws) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(ws[i:i + 12], ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT size FROM win),
di AS (SELECT row, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM dw, sizes WHERE len(ws) >= size),
dg AS (SELECT row, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM di),
m AS (SELECT row, i, dg.size, item_id FROM dg JOIN win ON dg.g = win.g AND dg.size = win.size),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM m)) GROUP BY 1),
it AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM m) GROUP BY 1),
tw AS (SELECT g, len(t) AS n, unnest(t) AS word FROM (SELECT DISTINCT g, list_distinct(string_split(g, ' ')) AS t FROM win)),
pos AS MATERIALIZED (SELECT row, p, word FROM (SELECT row, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM dw) WHERE word IN (SELECT word FROM tw)),
tf AS MATERIALIZED (SELECT g, n, word, df, row_number() OVER (PARTITION BY g ORDER BY df, word) AS r, count(*) OVER (PARTITION BY g) AS found FROM tw JOIN (SELECT word, count(*) AS df FROM pos GROUP BY 1) USING (word)),
seed AS (SELECT g, n, row, p FROM tf JOIN pos USING (word) WHERE r = 1 AND found = n),
two AS MATERIALIZED (SELECT DISTINCT seed.* FROM seed JOIN tf ON tf.g = seed.g AND tf.r = 2 JOIN pos ON pos.row = seed.row AND pos.word = tf.word AND pos.p BETWEEN seed.p - {decontam.SLOP} AND seed.p + {decontam.SLOP}),
near AS (SELECT g, row FROM seed WHERE n = 1 UNION SELECT g, row FROM two WHERE n = 2 UNION SELECT g, row FROM (SELECT two.g, two.n, two.row, two.p FROM two JOIN tf ON tf.g = two.g AND tf.r > 2
  JOIN pos ON pos.row = two.row AND pos.word = tf.word AND pos.p BETWEEN two.p - {decontam.SLOP} AND two.p + {decontam.SLOP} GROUP BY ALL HAVING count(DISTINCT tf.word) = two.n - 2)),
ni AS (SELECT row, count(DISTINCT item_id) AS n_near FROM near JOIN win USING (g) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM dw LEFT JOIN hit USING (row) LEFT JOIN it USING (row) LEFT JOIN ni USING (row)
"""

OP7_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT row, host, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT row, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
gg AS (SELECT row, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 3)) AS p FROM g JOIN gg USING (row, g)) GROUP BY 1),
norm AS (SELECT row, host, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
nl AS (SELECT row, host, line, count(*) AS times FROM norm WHERE line <> '' GROUP BY 1, 2, 3),
common AS (SELECT host, line FROM nl GROUP BY host, line HAVING count(*) > {linefreq.LIMIT}),
lost AS (SELECT row, sum(times)::BIGINT AS lines, sum(times * length(replace(line, ' ', '')))::BIGINT AS chars FROM nl JOIN common USING (host, line) GROUP BY 1),
b AS (SELECT row, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d),
j AS (SELECT b.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0)::BIGINT AS n_common_lines, coalesce(chars, 0)::BIGINT AS common_chars
  FROM b LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) LEFT JOIN lost USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - common_chars >= {linefreq.KEPT_SHARE} * word_chars AS kept, n_common_lines, common_chars
FROM j
"""

OP11_SQL = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM w),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS ks(k) WHERE len(ws) >= k) GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE k > 1 AND f >= {phrases.MIN_COUNT}),
x AS (SELECT lang, k, phrase, ws, a, unnest(range(1, k)) AS i FROM c),
s AS (SELECT x.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f)) AS score
  FROM x JOIN g l ON l.lang = x.lang AND l.phrase = array_to_string(ws[:i], ' ') JOIN g r ON r.lang = x.lang AND r.phrase = array_to_string(ws[i + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
lost AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN (SELECT lang, a, array_to_string(ws[j:j + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS j FROM c WHERE k = 3)) t USING (lang, phrase) WHERE b.k = 2 AND 100 * t.a >= {phrases.ABSORB} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b JOIN n USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM lost) QUALIFY rank <= {phrases.TOP}
"""

OP12_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT row, len(e) AS dim, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.row AS x, b.row AS y FROM u a JOIN u b ON a.dim = b.dim AND a.row <> b.row WHERE list_dot_product(a.e, b.e) >= {vectors.LIMIT}),
r(d, m) AS (SELECT row, row FROM v UNION SELECT r.d, l.y FROM r JOIN l ON r.m = l.x),
c AS (SELECT d, min(vec_id) AS component_id FROM r JOIN v ON v.row = r.m GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.d = v.row LEFT JOIN n ON n.x = v.row
"""

OP13_SQL = f"""
WITH RECURSIVE f AS MATERIALIZED (SELECT row_number() OVER () AS row, lang, doc_id, n_chars IS NOT NULL AND doc_id IS NOT NULL AS able,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
  n_chars, coalesce(strlen(text) || ':' || text, '-') AS back FROM documents),
cr AS (SELECT row, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length((doc_id::VARCHAR)) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS c FROM f WHERE doc_id IS NOT NULL),
l AS MATERIALIZED (SELECT f.row, lang, doc_id, sha256(front || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
  CASE WHEN n_chars IS NOT NULL AND xor(c, 4294967295) % {manifest.TAMPER_EVERY} = 0 THEN sha256(front || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || back) END AS changed FROM f LEFT JOIN cr ON cr.row = f.row),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lang, lvl, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM p UNION ALL SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
s AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, n, h) AS (SELECT 0, i, n, subroot FROM s UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
w AS MATERIALIZED (SELECT row, v.lvl, 0 AS tier, (p.i >> v.lvl) & 1 AS odd, coalesce(x.h, '') AS sib FROM p CROSS JOIN (SELECT unnest(range(0, 40)) AS lvl) v LEFT JOIN t x ON x.lang IS NOT DISTINCT FROM p.lang AND x.lvl = v.lvl AND x.i = xor(p.i >> v.lvl, 1) WHERE p.n > (1::BIGINT << v.lvl)
  UNION ALL SELECT row, v.lvl, 1, (s.i >> v.lvl) & 1, coalesce(x.h, '') FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT unnest(range(0, 40)) AS lvl) v LEFT JOIN u x ON x.lvl = v.lvl AND x.i = xor(s.i >> v.lvl, 1) WHERE s.n > (1::BIGINT << v.lvl)),
m AS MATERIALIZED (SELECT row, odd, sib, row_number() OVER (PARTITION BY row ORDER BY tier, lvl) AS step FROM w),
fold(row, step, h) AS (SELECT row, 0::BIGINT, coalesce(changed, leaf) FROM p UNION ALL SELECT fold.row, m.step, CASE WHEN m.odd = 1 THEN sha256(m.sib || fold.h) ELSE sha256(fold.h || m.sib) END FROM fold JOIN m ON m.row = fold.row AND m.step = fold.step + 1),
e AS (SELECT row, arg_max(h, step) AS folded FROM fold GROUP BY 1),
q AS (SELECT row, sha256(string_agg(sib, '' ORDER BY step)) AS proof FROM m GROUP BY 1)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN e USING (row) LEFT JOIN q USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op3_positional_decontamination": OP3_SQL, "op7_line_frequency": OP7_SQL, "op11_phrase_collocations": OP11_SQL, "op12_cross_polytope_near_vectors": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
