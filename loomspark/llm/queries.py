"""The queries opN_<name> and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, toxicity
from .byte_bpe import encode_decode
from .elkan import elkan, with_inertia
from .exact_dedup import exact_dedup
from .mixing import mix_sizes
from .ngram_join import ngram_components
from .nn_descent import near_duplicates
from .scratch import bounded
from .shard_cuts import shard
from .suffix_dedup import remove_repeats
from .token_store import read_shards, tokenize_to_shards
from .turn_repair import damage, digests, repair

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sizes(documents(spark, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
w AS (SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS w, CAST(2.0 AS DOUBLE) * source_size AS cap FROM r),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS "full" FROM t),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source, h),
u AS (SELECT source, h, z, coalesce(sum(z) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT d.doc_id, d.size, f.source_size, f.target,
       CAST(d.size * (f."full" + CASE WHEN 2 * (f.target - f."full" * f.source_size - u.before) >= u.z THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.h = d.h
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op3_suffix_array_dedup"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
b AS (SELECT doc_id, k * 1000 AS base, substr(h, 2000 * k + 1, 2198) AS part FROM (SELECT doc_id, h, unnest(range(0, n // 1000 + 1)) AS k FROM t)),
w AS (SELECT doc_id, base + j AS pos, md5(substr(part, 2 * j + 1, 200)) AS w FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, length(part) // 2 - 99))) AS j FROM b WHERE length(part) >= 200)),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp FROM w WINDOW o AS (PARTITION BY w ORDER BY doc_id, pos)),
l AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER p + 100 OR lag(pos) OVER p IS NULL THEN 1 ELSE 0 END AS fresh FROM f WHERE (doc_id, pos) <> (fd, fp) WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l),
s AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS z FROM g GROUP BY doc_id, run),
c AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS last, CAST(sum(z - a) AS BIGINT) AS removed, count(*) AS spans FROM c JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(k.removed, 0) AS n_removed, coalesce(k.spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, '') || substr(t.h, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

#: (id, root) of a table links(a, b) with both directions, in DuckDB.
_REACHED = "reached(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other)"


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(documents(spark, sf_dir), n=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


ORACLE["op4_ngram_jaccard"] = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * common >= 85 * (m.n + o.n - common)),
{_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(other) AS root FROM reached GROUP BY id) USING (doc_id)
"""


def remainder(column: str, of: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(of))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, remainder("id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs, remainder("id", 4) != 2)
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _ = tokenize_to_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(spark, manifest).select(F.col("id").alias("doc_id"), "start", F.size("ids").cast("long").alias("n_tokens"), F.col("crc32").alias("ids_crc32"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) WINDOW g AS (PARTITION BY h)
"""


@query
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = near_duplicates(bounded(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE["op10_nn_descent"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95),
{_REACHED}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(root, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id) LEFT JOIN (SELECT id AS vec_id, min(other) AS root FROM reached GROUP BY id) USING (vec_id)
"""


@query
def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_inertia(*elkan(bounded(spark).read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: Rows (vec_id, d: squared distance and number of the nearest centroid of table c) and the centroids that follow, in DuckDB.
_NEAREST = """a{n} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min({{'d': CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c.c}}) AS near FROM v, c{n} c GROUP BY vec_id)"""
_MEANS = """s{n} AS (SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT near.c AS c, unnest(x) AS e, unnest(range(64)) AS i FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{n} GROUP BY c),
c{m} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (c))"""

ORACLE["op11_elkan"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
h AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v),
c0 AS MATERIALIZED (SELECT c, x FROM h WHERE c < 16),
{", ".join(_NEAREST.format(n=n) + ", " + _MEANS.format(n=n, m=n + 1) for n in range(3))}, {_NEAREST.format(n=3)}
SELECT vec_id, CAST(near.c AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = near.c
"""


#: crc32 of a list of bytes in DuckDB: a table made by the rule of the polynomial, and a fold over the bytes.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda z, e: xor(z >> 1, 3988292384 * (z & 1))) AS c FROM range(256) r(i)))"


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda z, e: xor(t[1 + (xor(z, e) & 255)], z >> 8)), 4294967295)"


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = bounded(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    report, repaired = repair(damage(talks), talks)
    found = digests(repaired).select(F.col("id").alias("of"), "sha256")
    out = report.join(found, report["id"].eqNullSafe(found["of"]), "left")
    return out.select(F.col("id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: A conversation is walked turn by turn; of each state the least (cost, audit, text) goes on. ``due`` is the state after the next turn by state.
ORACLE["op12_turn_repair"] = rf"""
WITH RECURSIVE {_CRC_TABLE}, due(q, z, name) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda e: CAST(unicode(e) AS BIGINT))")} % 20 AS k FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(conv_id || ':' || length(role) || ':' || role || text), copy) AS i, role[1] AS initial FROM e),
r AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM n),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
ins(q, z, c, a, o) AS (SELECT q, q, 0, '', '' FROM due UNION ALL SELECT ins.q, due.z, c + 5, a || 'I', o || chr(10) || due.name || ':' FROM ins JOIN due ON due.q = ins.z WHERE c < 15),
ed(x, c) AS (VALUES ('K', 0), ('R', 1), ('D', 2)),
w(conv_id, i, q, b) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} FROM f UNION ALL
  SELECT conv_id, i, q, min({{'c': c, 'a': a, 'o': o}}) FROM (
    SELECT w.conv_id, r.i, CASE WHEN ed.x = 'D' THEN ins.z WHEN ed.x = 'K' AND r.initial = 's' THEN 1 ELSE due.z END AS q, CAST(w.b.c + ins.c + ed.c + CASE WHEN ed.x <> 'D' AND r.fault = 't' THEN 5 ELSE 0 END AS BIGINT) AS c, w.b.a || ins.a || ed.x AS a,
      w.b.o || ins.o || CASE ed.x WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || due.name || ':' || r.text END AS o
    FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN due ON due.q = ins.z JOIN ed ON ed.x = 'D' OR (r.fault NOT IN ('b', 'd') AND (ed.x = 'R' OR r.initial = due.name[1] OR (ins.z = 0 AND r.initial = 's'))))
  GROUP BY conv_id, i, q),
l AS (SELECT w.conv_id, min({{'c': w.b.c + ins.c, 'a': w.b.a || ins.a, 'o': w.b.o || ins.o}}) AS b FROM w JOIN f ON f.conv_id = w.conv_id AND f.n = w.i JOIN ins ON ins.q = w.q WHERE ins.z IN (0, 3) GROUP BY w.conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.o[2:], '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) LEFT JOIN l USING (conv_id)
"""


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, _ = shard(documents(spark, sf_dir), 40)
    return cut.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE["op13_sharding"] = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, sha256(coalesce(text, '')) AS h,
  CAST({_crc("list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))")} AS BIGINT) AS text_crc32 FROM documents, crc),
g AS (SELECT h, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY h),
p AS MATERIALIZED (SELECT h, row_number() OVER (ORDER BY h) AS i, z, CAST(sum(z) OVER (ORDER BY h) AS BIGINT) AS p FROM g UNION ALL SELECT '', 0, 0, 0),
dp(s, i, m) AS (SELECT 1, i, p FROM p UNION ALL SELECT dp.s + 1, x.i, min(greatest(dp.m, x.p - y.p)) FROM dp JOIN p y ON y.i = dp.i JOIN p x ON x.i >= y.i WHERE dp.s < 40 GROUP BY dp.s, x.i),
c AS MATERIALIZED (SELECT m AS c, (SELECT max(p) FROM p) AS t FROM dp WHERE s = 40 ORDER BY i DESC LIMIT 1),
l(s, l) AS (SELECT 40, t FROM c UNION ALL SELECT l.s - 1, min(p.p) FROM l JOIN c ON true JOIN p ON p.p >= l.l - c.c WHERE l.s > 1 GROUP BY l.s),
f AS MATERIALIZED (SELECT * FROM l),
w(s, x) AS (SELECT 0, CAST(0 AS BIGINT) UNION ALL
  SELECT s + 1, greatest(CASE WHEN goal = a THEN a WHEN a = x THEN b WHEN b - x > c OR goal - a <= b - goal THEN a ELSE b END, l) FROM (
    SELECT w.s, w.x, c.c, f.l, w.x + (c.t - w.x) // (40 - w.s) AS goal, max(p.p) FILTER (p.p <= w.x + (c.t - w.x) // (40 - w.s)) AS a, coalesce(min(p.p) FILTER (p.p > w.x + (c.t - w.x) // (40 - w.s)), c.t) AS b
    FROM w JOIN c ON true JOIN f ON f.s = w.s + 1 JOIN p ON true WHERE w.s < 39 GROUP BY w.s, w.x, c.c, c.t, f.l)),
o AS (SELECT p.h, CAST(count(*) FILTER (w.s > 0 AND w.x <= p.p - p.z) AS INTEGER) AS shard FROM p, w WHERE p.i > 0 GROUP BY p.h)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM d JOIN o USING (h)
"""
