"""The registered queries of this package, thin over its operators, and the SQL that some of them equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, contamination, jaccard, langid, lines, mixing, quality, rulestats, secrets, sharding, substrings, toxicity, turns
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    return secrets.digest(ledger.scan(versions))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.digest(contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), n=10))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"), edits=2, least=20)
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept", 256).alias("kept_sha256"))


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.interleave(table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), k=5, percent=80)


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents"), k=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rulestats.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *rulestats.STATS, "base_failed", "kept", "anomaly")


def op11_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(*centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024.0, seed=3))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(turns.repair(turns.damage(table(spark, sf_dir, "conversations"))))


def op13_toxicity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_secret_ledger,
        op3_decontaminate,
        op4_language_id,
        op5_quality_votes,
        op6_line_dedup,
        op7_interleaved_shards,
        op8_recompression_dedup,
        op9_isolation_rules,
        op10_jaccard_join,
        op11_exponion_clusters,
        op12_turn_repair,
        op13_toxicity_filters,
    )
}

_U = "('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0"

ORACLE_SQL = {
    "op1_pareto_mix": rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, {_U.format(seed="mix")} AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1) AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM l),
c AS (SELECT source, length(bin(size)) - 1 AS cls, sum(size)::BIGINT AS words FROM base WHERE size > 0 GROUP BY ALL),
g AS (SELECT c.*, t.target, sqrt(sqrt(pow(2.0::DOUBLE, cls))) AS g FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, (target - coalesce(sum(words * 2.0::DOUBLE) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(g * words) OVER (PARTITION BY source ORDER BY cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g),
e AS (SELECT *, least(2.0::DOUBLE, g * coalesce(max(CASE WHEN level <= 2.0::DOUBLE / g THEN level END) OVER (PARTITION BY source), 'inf'::DOUBLE)) AS e FROM v),
p AS (SELECT *, floor(e + 1e-12)::BIGINT AS certain, greatest(0.0, e - floor(e + 1e-12)) AS p FROM e),
r AS (SELECT *, target - sum(certain * words) OVER (PARTITION BY source) AS rest FROM p),
j AS (SELECT b.doc_id, b.source, b.size, r.certain, r.p, r.rest, CASE WHEN r.p > 0 THEN u / (1 - u) / (r.p / (1 - r.p)) END AS rank
  FROM base b JOIN r ON b.source IS NOT DISTINCT FROM r.source AND b.size > 0 AND length(bin(b.size)) - 1 = r.cls),
o AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j),
n AS (SELECT doc_id, source, size, certain + CASE WHEN rank IS NOT NULL AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies FROM o
  UNION ALL SELECT doc_id, source, size, 0 FROM base WHERE size = 0),
k AS (SELECT n.doc_id, n.size, t.source_size, t.target, n.copies::BIGINT AS copies FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k""",
}


def _spans_sql(kind: str, nth: int, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return rf"""
{kind}_m AS (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM b),
{kind}_u AS (SELECT rid, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m WHERE len(m) > 0),
{kind}_s AS (SELECT rid, {nth} AS nth, '{kind}' AS kind, (sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS e, m FROM {kind}_u),
{kind} AS (SELECT rid, nth, kind, (e - length(m))::BIGINT AS s, e FROM {kind}_s WHERE {keep})"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEY = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
_ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    _spans_sql("assign", 0, _ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8"),
    _spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _spans_sql("hex", 2, "[0-9a-f]+", "length(m) >= 32"),
    _spans_sql("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    _spans_sql("github", 4, "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    _spans_sql("jwt", 5, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 40"),
]
ORACLE_SQL["op2_secret_ledger"] = f"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{",".join(_KINDS)},
a AS ({" UNION ALL ".join(f"SELECT * FROM {k}" for k in ("assign", "access", "hex", "pem", "github", "jwt"))}),
f AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 3) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM b LEFT JOIN f USING (rid)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE_SQL["op3_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT d.rid, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) s)),
h AS (SELECT p.rid, p.i, p.size, g.item_id FROM p JOIN g USING (size, gram)),
n AS (SELECT rid, count(*)::BIGINT AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS at FROM (SELECT DISTINCT rid, i, size FROM h)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id)::BIGINT AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""


def _lloyd_sql(rounds: int = 10) -> str:
    """The rounds written out, each by the distances of all vectors to all centroids."""
    near = """a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT v.rid, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY rid)"""
    move = """c{s} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM
  (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT a.c, unnest(v.v) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{r} a USING (rid)) GROUP BY c, i) GROUP BY c) n USING (c))"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), vec_id, v) - 1 AS c, v FROM v QUALIFY c < 8),
{",".join(steps)},
s AS (SELECT c, sum(d)::BIGINT AS cluster_inertia, (sum(sum(d)) OVER ())::BIGINT AS inertia FROM a{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, s.cluster_inertia, s.inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (rid) JOIN s ON s.c = a.c JOIN c{rounds} k ON k.c = a.c"""


ORACLE_SQL["op11_exponion_clusters"] = _lloyd_sql()

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: A path is its cost in nine digits and its audit, so that the least text is the cheapest, then ASCII-least.
_EDIT = "CASE WHEN {ok} THEN lpad((left({path}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({path}, 10) || '{letter}' END"
_edit = lambda path, cost, letter, ok="true": _EDIT.format(path=path, cost=cost, letter=letter, ok=ok)
_MAY = "NOT r.must_go"
_LATE = "CASE WHEN r.cut THEN 3 ELSE 0 END"
ORACLE_SQL["op12_turn_repair"] = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(k) + 1), lambda i: ('0x' || substr(hex(k), (2 * i - 1)::BIGINT, 2))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind FROM raw),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before, right(rtrim(text, {_BLANKS}), 1) AS tail
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS MATERIALIZED (SELECT *, left(role, 1) AS i, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, coalesce(fault = 'truncated', false) AS cut FROM placed),
n AS (SELECT conv, any_value(conv_id) AS conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
f AS (SELECT conv, 0::BIGINT AS pos, '000000000' AS s0, NULL::VARCHAR AS s, '000000003I' AS u, '000000006II' AS a FROM n
  UNION ALL SELECT conv, pos, s0, s, u1, least(a0, {_edit("u1", 3, "I")}) FROM (
    SELECT *, least(u0, {_edit("s0", 3, "I")}, {_edit("s", 3, "I")}, {_edit("a0", 3, "I")}) AS u1 FROM (
      SELECT f.conv, r.pos, {_edit("f.s0", 4, "D")} AS s0, least({_edit("f.s", 4, "D")}, {_edit("f.s0", _LATE, "K", _MAY + " AND r.i = 's'")}) AS s,
        least({_edit("f.u", 4, "D")}, {", ".join(_edit(f"f.{p}", _LATE + extra, x, _MAY + ok) for p in ("s0", "s", "a") for x, extra, ok in (("K", "", " AND r.i = 'u'"), ("R", " + 3", "")))}) AS u0,
        least({_edit("f.a", 4, "D")}, {_edit("f.u", _LATE, "K", _MAY + " AND r.i = 'a'")}, {_edit("f.u", _LATE + " + 3", "R", _MAY)}) AS a0
      FROM f JOIN r ON r.conv = f.conv AND r.pos = f.pos + 1))),
e AS (SELECT n.*, left(least(f.s0, f.a), 9)::BIGINT AS cost, substr(least(f.s0, f.a), 10) AS audit FROM n JOIN f ON f.conv = n.conv AND f.pos = n.n),
l AS (SELECT conv, j, substr(audit, j, 1) AS x, length(replace(left(audit, j), 'I', '')) AS pos FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS j FROM e)),
o AS (SELECT l.conv, l.j, x, r.role, CASE WHEN x = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY l.conv ORDER BY l.j) AS nth FROM l LEFT JOIN r ON r.conv = l.conv AND r.pos = l.pos WHERE x <> 'D'),
h AS (SELECT *, max(CASE WHEN nth = 1 AND x = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS head FROM o),
t AS (SELECT conv, string_agg(CASE WHEN x = 'K' THEN role WHEN (nth - 1 - head) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth) AS whole FROM h GROUP BY conv)
SELECT c.conv_id, coalesce(e.gaps, 0)::BIGINT AS gaps, coalesce(e.blank, 0)::BIGINT AS blank, coalesce(e.duplicate, 0)::BIGINT AS duplicate, coalesce(e.truncated, 0)::BIGINT AS truncated,
  coalesce(e.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv = e.conv"""
