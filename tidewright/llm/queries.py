"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import (
    byte_bpe,
    fill_in_middle,
    fingerprints,
    jaccard_join,
    language,
    line_rules,
    lm_scores,
    packing,
    personal,
    phrases,
    resampling,
    sharding,
    token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{k:02d}" for k in range(64)]


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def sql_sketch(source: str) -> str:
    """Sketches of ``key, t`` rows of ``source``, as sorted lists."""
    return f"""
      SELECT key, CASE WHEN len(list_filter(h, lambda x: x < '{fingerprints.limit(fingerprints.SCALE)}')) > 0
        THEN list_sort(list_distinct(list_filter(h, lambda x: x < '{fingerprints.limit(fingerprints.SCALE)}')))
        WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END AS s
      FROM (SELECT key, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [md5(array_to_string(w, ' '))[1:16]]
        ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))[1:16]) END AS h
        FROM (SELECT key, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}))"""


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS nxt FROM d),
e AS (SELECT o.doc_id, o.n, o.nxt, substr(o.t, 1, o.n - o.n // 2) || substr(b.t, 1, o.n // 2) AS t FROM o JOIN d b ON b.doc_id = o.nxt),
own_in AS (SELECT doc_id AS key, t FROM d), own AS ({sql_sketch('own_in')}),
edit_in AS (SELECT doc_id AS key, t FROM e), edit AS ({sql_sketch('edit_in')}),
j AS (SELECT e.doc_id, e.n, e.t, a.s AS a, b.s AS b, c.s AS c, len(list_intersect(a.s, b.s)) AS ab, len(list_intersect(a.s, c.s)) AS ac
  FROM e JOIN own a ON a.key = e.doc_id JOIN edit b ON b.key = e.doc_id JOIN own c ON c.key = e.nxt)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(t) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) > 0 THEN ab / len(a) WHEN len(b) > 0 THEN 0.0 ELSE 1.0 END AS near_edited,
  CASE WHEN len(a) > 0 THEN ac / len(a) WHEN len(c) > 0 THEN 0.0 ELSE 1.0 END AS near_next,
  CASE WHEN len(a) + len(b) > 0 THEN ab / (len(a) + len(b) - ab) ELSE 1.0 END AS jaccard_edited,
  CASE WHEN len(a) + len(c) > 0 THEN ac / (len(a) + len(c) - ac) ELSE 1.0 END AS jaccard_next
FROM j
"""


@register("op1_fingerprints", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare(table(spark, folder, "documents"))


OP2_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root)
SELECT doc_id, min(root) AS class_id, (SELECT count(*) FROM l WHERE l.a = r.doc_id) AS n_links FROM r GROUP BY doc_id
"""


@register("op2_jaccard_join", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


OP3_SIZE = sharding.prime_from(100 * len(SHARDS))
#: One recursive step is one claim: the shard whose turn it is takes the first free slot of its order.
OP3_SQL = f"""
WITH RECURSIVE s AS (
  SELECT k, name, CAST('0x' || md5('start:' || name)[1:12] AS BIGINT) % {OP3_SIZE} AS start_at,
    CAST('0x' || md5('step:' || name)[1:12] AS BIGINT) % {OP3_SIZE - 1} + 1 AS step
  FROM (SELECT CAST(k AS INTEGER) AS k, format('shard-{{:02d}}', k) AS name FROM range({len(SHARDS)}) t(k))),
one AS (SELECT list(start_at ORDER BY k) AS starts, list(step ORDER BY k) AS steps FROM s),
claim AS (
  SELECT 0 AS n, list_transform(range({OP3_SIZE}), lambda x: -1) AS slots FROM one
  UNION ALL
  SELECT n + 1, list_concat(list_concat(slots[1:p], [n % {len(SHARDS)}]), slots[p + 2:])
  FROM (SELECT n, slots, list_filter(list_transform(range({OP3_SIZE}),
      lambda i: (starts[n % {len(SHARDS)} + 1] + i * steps[n % {len(SHARDS)} + 1]) % {OP3_SIZE}), lambda x: slots[x + 1] < 0)[1] AS p
    FROM claim, one WHERE n < {OP3_SIZE})),
filled AS (SELECT slots FROM claim WHERE n = {OP3_SIZE}),
slot AS (SELECT unnest(range({OP3_SIZE})) AS slot, unnest(slots) AS k FROM filled),
d AS (SELECT doc_id, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:12] AS BIGINT) % {OP3_SIZE} AS slot FROM documents)
SELECT d.doc_id, CAST(d.slot AS INTEGER) AS slot, s.name AS shard FROM d JOIN slot USING (slot) JOIN s USING (k)
"""


@register("op3_sharding", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents"), SHARDS)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
line AS (SELECT host, t, trim(regexp_replace(CASE WHEN length(regexp_replace(l, '[^\p{L}]', '', 'g')) > length(regexp_replace(l, '[^0-9]', '', 'g'))
      THEN regexp_replace(lower(l), '[0-9]+', '0', 'g') ELSE lower(l) END, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x,
    len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS nw
  FROM (SELECT host, t, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS l FROM (SELECT DISTINCT host, t FROM d))),
often AS (SELECT host, x, min(CAST('0x' || md5(t)[1:15] AS BIGINT)) AS holder FROM line GROUP BY host, x HAVING count(DISTINCT t) > 10),
gone AS (SELECT line.host, t, CAST(sum(nw) AS BIGINT) AS n, CAST(sum(nw) FILTER (CAST('0x' || md5(t)[1:15] AS BIGINT) <> holder) AS BIGINT) AS n_foreign
  FROM line JOIN often USING (host, x) GROUP BY 1, 2),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(w.t) - length(translate(w.t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(CASE WHEN gone.n * 100 > len(ws) * 50 THEN coalesce(gone.n_foreign, 0) ELSE gone.n END, 0) AS removed_words
  FROM w JOIN d USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone ON gone.host = d.host AND gone.t = d.t)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT removed_words * 100 > n_words * 50 AS kept
FROM s
"""


@register("op5_quality_rules", OP5_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(table(spark, folder, "documents"))


@register("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@register("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op10_personal_data")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return personal.report(table(spark, folder, "documents"))


@register("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


OP9_SQL = f"""
WITH g AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bool_and(coalesce(quality = 1 AND coalesce(toxic, 0) = 0, false))),
d AS (SELECT documents.doc_id, g.doc_id IS NOT NULL AS tgt, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents LEFT JOIN g USING (doc_id)),
t AS (SELECT doc_id, tgt, i, w[i] AS x FROM (SELECT doc_id, tgt, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS nb, count(*) FILTER (tgt) AS nt FROM t),
v AS (SELECT x, count(*) AS cb, count(*) FILTER (tgt) AS ct FROM t GROUP BY x HAVING count(*) >= {lm_scores.LEAST}),
s AS (SELECT count(*) AS sb, count(*) FILTER (tgt) AS st FROM d WHERE len(w) > 0),
unk AS (SELECT nb - coalesce((SELECT sum(cb) FROM v), 0) AS ub, nt - coalesce((SELECT sum(ct) FROM v), 0) AS ut, nb, nt, (SELECT count(*) FROM v) + 1 AS size FROM n),
k AS (SELECT t.doc_id, t.tgt, t.i, t.x, v.cb, v.ct FROM t LEFT JOIN v USING (x)),
p AS (SELECT a.doc_id, a.i, a.tgt, a.x AS y, a.cb AS cb, a.ct AS ct, b.x AS h, b.cb AS hb, b.ct AS ht, a.i = 1 AS first, a.cb IS NOT NULL AND (a.i = 1 OR b.cb IS NOT NULL) AS known
  FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.i = a.i - 1),
pc AS (SELECT first, coalesce(h, '') AS h, y, count(*) AS pb, count(*) FILTER (tgt) AS pt FROM p WHERE known GROUP BY ALL HAVING count(*) >= {lm_scores.LEAST}),
l AS (SELECT p.doc_id,
  -ln({lm_scores.MIX} * coalesce(pc.pb / greatest(CASE WHEN p.first THEN sb ELSE hb END, 1), 0) + (1 - {lm_scores.MIX}) * (coalesce(cb, ub) + 1) / (nb + size)) AS lb,
  -ln({lm_scores.MIX} * coalesce(pc.pt / greatest(CASE WHEN p.first THEN st ELSE ht END, 1), 0) + (1 - {lm_scores.MIX}) * (coalesce(ct, ut) + 1) / (nt + size)) AS lt
  FROM p CROSS JOIN unk CROSS JOIN s LEFT JOIN pc ON p.known AND pc.first = p.first AND pc.h = coalesce(p.h, '') AND pc.y = p.y)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(avg(lt) + 1e-10, 6) AS target_loss, round(avg(lb) + 1e-10, 6) AS background_loss, round(avg(lt) - avg(lb) + 1e-10, 6) AS difference
FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, d.w
"""


@register("op9_lm_scores", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    good = resampling.labels_of_good(table(spark, folder, "labels"))
    scored = lm_scores.score(table(spark, folder, "documents"), good)
    return scored.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("target_loss", "background_loss", "difference")})


OP11_SQL = r"""
WITH p AS (SELECT doc_id, lang, unnest(range(1, len(x) + 1)) AS piece, unnest(x) AS t FROM (SELECT doc_id, coalesce(lang, 'und') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS x FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
c1 AS (SELECT lang, x AS phrase, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY 1, 2),
c2 AS (SELECT lang, x AS phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w) GROUP BY 1, 2),
c3 AS (SELECT lang, x AS phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM w) GROUP BY 1, 2),
f AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
cand AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS v FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3) WHERE n >= 10),
inside AS (SELECT lang, unnest([v[1] || ' ' || v[2], v[2] || ' ' || v[3]]) AS phrase, a AS longer FROM cand WHERE len(v) = 3),
kept AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = cand.lang AND i.phrase = cand.phrase AND 100 * i.longer >= 50 * cand.a)),
cut AS (SELECT lang, phrase, a, v, unnest(range(1, len(v))) AS k FROM kept),
s AS (SELECT cut.lang, cut.phrase, a, k, x.n AS l, y.n AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(v[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(v[k + 1:], ' ')),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM c1 GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN total USING (lang) QUALIFY rank <= 2000
"""


@register("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
  CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM w),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""


@register("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, folder, "documents"))


@register("op13_token_files")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
