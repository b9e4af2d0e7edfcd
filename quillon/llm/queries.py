"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table
from . import bpe, exact, fim, html_text, lines, mixing, neardup, periodic, secret_scan, sharding, suffixes, topk, toxicity


def op6_grace_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.exact_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def vocabulary() -> str:
    """Path of the public tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.digests(table(spark, sf_dir, "documents"), vocabulary())
    return out.withColumnRenamed("key", "doc_id")


def op4_van_der_corput_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
v AS (
  SELECT *, CAST((rk - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
f AS (
  SELECT *, 3.0 * CAST(source_size AS DOUBLE) AS cap, sum(weight) OVER () AS weights,
    row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rk) AS fill,
    coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    coalesce(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used_weight
  FROM v),
l AS (SELECT *, (total - CAST(3 * used AS DOUBLE)) / (weights - used_weight) AS lev FROM f),
o AS (SELECT *, min(CASE WHEN cap >= lev * weight THEN fill END) OVER () AS open_at FROM l),
t AS (
  SELECT *, fill < coalesce(open_at, fill + 1) AS capped,
    max(CASE WHEN fill = open_at THEN lev END) OVER () AS final_level FROM o),
g AS (
  SELECT source, source_size, capped, CASE WHEN capped THEN cap ELSE final_level * weight END AS target,
    greatest(1, least(1024, CAST(floor(total / (3000 * (SELECT count(*) FROM s WHERE source_size > 0))) AS BIGINT))) AS words FROM t),
b AS (SELECT *, CAST(ceil(source_size / words) AS BIGINT) AS blocks FROM g),
m AS (
  SELECT *, CASE WHEN capped THEN 3 * blocks ELSE least(3 * blocks, CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) END AS slots FROM b),
k AS (
  SELECT *, slots // greatest(blocks, 1) AS passes, slots % greatest(blocks, 1) AS more FROM m),
e AS (
  SELECT *, more * (source_size // greatest(blocks, 1)) + least(more, source_size % greatest(blocks, 1)) AS reach FROM k),
p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS st FROM d)
SELECT p.doc_id, p.size, e.source_size, e.target,
  CAST(p.size * coalesce(e.passes, 0) + greatest(0, least(p.st + p.size, coalesce(e.reach, 0)) - p.st) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""


def op5_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Positions 0 to N stand between groups; ``ws[p + 1]`` are the bytes before position p. Lists, as N is small where SQL runs.
OP5_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS of_byte),
b AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
d AS (
  SELECT doc_id, sha256(bytes) AS digest, CAST(octet_length(bytes) + 8 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(bytes), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM b, crc),
g AS (SELECT digest, CAST(sum(size) AS BIGINT) AS weight FROM d GROUP BY digest),
c AS (
  SELECT digest, weight, CASE WHEN weight < 65536 THEN weight
    ELSE length(bin(weight)) * 8192 + (weight >> greatest(length(bin(weight)) - 13, 0)) END AS cls FROM g),
r AS (SELECT cls, count(*) AS n, sum(weight) AS total, sum(sum(weight)) OVER (ORDER BY cls) - sum(weight) AS before FROM c GROUP BY cls),
o AS (
  SELECT digest, row_number() OVER (ORDER BY cls, digest) - 1 AS p,
    before + ((row_number() OVER (PARTITION BY cls ORDER BY digest) - 1) * total) // n AS ahead
  FROM c JOIN r USING (cls)),
l AS (
  SELECT list_append(list(CAST(ahead AS BIGINT) ORDER BY p), (SELECT CAST(sum(weight) AS BIGINT) FROM c)) AS ws FROM o),
a AS (
  SELECT len(ws) - 1 AS stop, 24 AS shards FROM l
  UNION ALL
  SELECT stop - 1, shards - 1 FROM a, l WHERE shards > 1 AND stop > 0 AND (ws[stop + 1] - ws[stop]) * shards >= ws[stop + 1]),
e AS (SELECT min(stop) AS stop, min(shards) AS shards FROM a),
s AS (
  SELECT greatest((ws[stop + 1] + shards - 1) // shards, CASE WHEN stop > 0 THEN ws[stop + 1] - ws[stop] ELSE 0 END) AS low,
    ws[stop + 1] AS high, CAST(0 AS BIGINT) AS spot, 0 AS used FROM e, l
  UNION ALL
  SELECT CASE WHEN NOT fits AND used + 1 = shards THEN mid + 1 ELSE low END, CASE WHEN fits THEN mid ELSE high END,
    CASE WHEN fits OR used + 1 = shards THEN 0 ELSE next END, CASE WHEN fits OR used + 1 = shards THEN 0 ELSE used + 1 END
  FROM (
    SELECT *, next = stop AS fits FROM (
      SELECT low, high, used, stop, shards, (low + high) // 2 AS mid,
        least(stop, len(list_filter(ws, lambda x: x <= ws[spot + 1] + (low + high) // 2)) - 1) AS next
      FROM s, e, l WHERE low < high))),
k AS (SELECT max(low) AS cap FROM s),
f AS (
  SELECT 0 AS m, CAST(stop AS BIGINT) AS least_at FROM e
  UNION ALL
  SELECT m + 1, greatest(0, len(list_filter(ws, lambda x: x < greatest(0, ws[least_at + 1] - cap)))) FROM f, e, l, k WHERE m + 1 < shards),
t AS (
  SELECT 0 AS no, CAST(0 AS BIGINT) AS spot
  UNION ALL
  SELECT no + 1, least(stop, len(list_filter(ws, lambda x: x <= ws[spot + 1] + cap)) - 1, greatest(spot, least_at,
    CASE WHEN below >= stop OR ideal - ws[below + 1] <= ws[below + 2] - ideal THEN below ELSE below + 1 END))
  FROM (
    SELECT no, spot, ws, cap, stop, least_at, ideal, len(list_filter(ws, lambda x: x <= ideal)) - 1 AS below FROM (
      SELECT no, spot, ws, cap, stop, least_at, ws[stop + 1] * (no + 1) // shards AS ideal
      FROM t, e, l, k JOIN f ON true WHERE no + 1 < shards AND m = shards - no - 1))),
cuts AS (SELECT spot FROM t WHERE no > 0 UNION ALL SELECT stop FROM a WHERE stop < (SELECT len(ws) - 1 FROM l)),
h AS (SELECT digest, CAST((SELECT count(*) FROM cuts WHERE spot <= p) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws('/', CAST(doc_id AS VARCHAR), upper(digest))), 1, 3), doc_id NULLS FIRST, digest) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN h USING (digest)
"""


def op10_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.model_of(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select(F.col("key").alias("doc_id"), F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_block_tree_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: A plain account for pages whose text is one ``article`` without marked parts, as those of the tables are; the operator
#: never looks at it, and other pages are held against hand-written texts in the tests.
OP2_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?is)<article[^>]*>(.*?)</article>', 1) AS part FROM pages),
t AS (SELECT *, regexp_replace(regexp_replace(part, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|</?(a|abbr|b|code|em|i|small|span|strong|sub|sup|u)(\s[^>]*)?>', '', 'g'), '<[^>]+>', ' ', 'g') AS plain FROM a),
d AS (SELECT *, regexp_replace(replace(replace(replace(replace(replace(plain, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS decoded FROM t),
w AS (SELECT page_id, url, trim(regexp_replace(decoded, '[\t-\r\x1c-\x20\x85\p{Z}]+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM w
"""


def op1_lsh_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)
    kept = F.col("key").eqNullSafe(F.col("component"))
    return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM x JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * shared >= 85 * (za.n + zb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN z ON z.doc_id = c.doc_id
"""


def op8_unit_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.repeated_units(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), F.col("start").alias("start_offset"), F.col("end").alias("end_offset"), F.col("first_key").alias("first_doc_id"), F.col("first_start").alias("first_offset"), "copies")


#: A text is tiled by lines and line ends, a line by marks and what stands between them; offsets are sums of lengths.
OP8_SQL = r"""
WITH q AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\r\n]+|\r\n|\r|\n') AS x FROM q)),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS pos, regexp_full_match(piece, '[\r\n]+') AS ends FROM p),
l AS (SELECT doc_id, i, piece, pos, regexp_full_match(piece, 'SPACE*') AS blank FROM o WHERE NOT ends),
n AS (SELECT *, lag(i) OVER w AS prev, lag(blank) OVER w AS prev_blank FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, sum(CASE WHEN NOT blank AND NOT prev_blank AND i = prev + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM n),
t AS (SELECT doc_id, i, pos, unnest(x) AS piece, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, i, pos, regexp_extract_all(piece, '[.!?]+["'')\]]*|[^.!?]+') AS x FROM l)),
m AS (
  SELECT *, pos + sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(piece) AS a,
    CASE WHEN regexp_matches(piece, '^[.!?]+["'')\]]+$') THEN 1
      WHEN regexp_matches(piece, '^[.!?]') AND regexp_matches(coalesce(lead(piece) OVER (PARTITION BY doc_id, i ORDER BY j), ' '), '^SPACE') THEN 1 ELSE 0 END AS last
  FROM t),
c AS (SELECT *, sum(last) OVER (PARTITION BY doc_id, i ORDER BY j) - last AS sentence FROM m),
u AS (
  SELECT doc_id, pos AS a, piece AS raw FROM l
  UNION SELECT doc_id, min(a), string_agg(piece, '' ORDER BY j) FROM c GROUP BY doc_id, i, sentence
  UNION SELECT doc_id, a, substring(text, CAST(a AS BIGINT) + 1, CAST(z - a AS BIGINT)) FROM
    (SELECT doc_id, min(pos) AS a, max(pos + length(piece)) AS z FROM b WHERE NOT blank GROUP BY doc_id, block) JOIN q USING (doc_id)),
v AS (
  SELECT DISTINCT doc_id, CAST(a + length(regexp_extract(raw, '^SPACE*')) AS BIGINT) AS s, CAST(a + length(regexp_replace(raw, 'SPACE*$', '')) AS BIGINT) AS e,
    regexp_extract_all(lower(raw), 'OTHER+') AS words FROM u),
g AS (
  SELECT doc_id, s, e, count(*) OVER w AS copies, first_value(doc_id) OVER (w ORDER BY doc_id, s) AS first_doc_id, first_value(s) OVER (w ORDER BY doc_id, s) AS first_offset
  FROM (SELECT *, array_to_string(words, ' ') AS norm FROM v WHERE len(words) >= 8) WINDOW w AS (PARTITION BY norm))
SELECT doc_id, s AS start_offset, e AS end_offset, first_doc_id, first_offset, copies FROM g WHERE copies > 1 AND (doc_id, s) IS DISTINCT FROM (first_doc_id, first_offset)
""".replace("SPACE", r"[\t-\r\x1c-\x20\x85\p{Z}]").replace("OTHER", r"[^\t-\r\x1c-\x20\x85\p{Z}]")


def op3_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n_bytes FROM t),
w AS (SELECT doc_id, p, md5(b[p + 1:p + 100]) AS k FROM (SELECT doc_id, b, unnest(range(0, n_bytes - 99)) AS p FROM n WHERE n_bytes >= 100)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN p <= prev + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM s),
c AS (SELECT k.doc_id, string_agg(hex(b[from_ + 1:a]), '' ORDER BY a) AS kept, max(z) AS last, sum(z - a) AS n_removed, count(*) AS n_spans FROM k JOIN n USING (doc_id) GROUP BY k.doc_id)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN c.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(kept || CASE WHEN last < n_bytes THEN hex(b[last + 1:n_bytes]) ELSE '' END)) END AS kept_sha256
FROM n LEFT JOIN c ON c.doc_id = n.doc_id
"""


def op11_numpy_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"), seed=7)
    again = fim.restore(F.col("output"), F.col("form"))
    return out.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
l AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, list_transform(range(4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS r FROM d),
n AS (SELECT *, CAST(len(lines) AS BIGINT) AS n FROM l),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_crochemore_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.with_cycles(table(spark, sf_dir, "documents")))
    out = out.withColumn("top", periodic.longest_run(F.col("runs")))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long")
    return out.select(
        F.col("key").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *top, milli.alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs as islands of places whose words ``q`` apart are equal; the one stretch may have several such q, of which the least is its period.
OP12_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS of_byte),
d AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda c, x: xor(c >> 8, of_byte[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM documents, crc),
e AS (SELECT *, CAST(len(words) AS BIGINT) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + coalesce(g, 0) % 8) AS p FROM f),
t AS (SELECT no, doc_id, n, list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) AS words FROM p),
w AS (SELECT no, n, unnest(words) AS word, unnest(range(n)) AS i FROM t),
m AS (SELECT x.no, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.no = y.no AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT no, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY no, q ORDER BY i) AS island FROM m) GROUP BY no, q, island),
r AS (SELECT no, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY no, start, length),
o AS (
  SELECT no, count(*) AS n_runs, first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS top,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM r GROUP BY no),
x AS (SELECT DISTINCT no, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.no, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM w LEFT JOIN x ON x.no = w.no AND x.i = w.i WHERE x.i IS NULL GROUP BY w.no)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
  CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN o ON o.no = t.no LEFT JOIN k ON k.no = t.no
"""


def op13_layered_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind))
    counts = [of_kind(kind).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return out.select(F.col("key").alias("doc_id"), *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lsh_forest_near_dedup": op1_lsh_forest_near_dedup,
    "op2_block_tree_html": op2_block_tree_html,
    "op3_prefix_free_parsing": op3_prefix_free_parsing,
    "op4_van_der_corput_mixing": op4_van_der_corput_mixing,
    "op5_minimax_sharding": op5_minimax_sharding,
    "op6_grace_hash_dedup": op6_grace_hash_dedup,
    "op7_bpe_merge_rounds": op7_bpe_merge_rounds,
    "op8_unit_hash_dedup": op8_unit_hash_dedup,
    "op9_counterfactual_toxicity": op9_counterfactual_toxicity,
    "op10_ball_tree_top_k": op10_ball_tree_top_k,
    "op11_numpy_fill_in_middle": op11_numpy_fill_in_middle,
    "op12_crochemore_runs": op12_crochemore_runs,
    "op13_layered_secret_scan": op13_layered_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op1_lsh_forest_near_dedup": OP1_SQL, "op2_block_tree_html": OP2_SQL, "op3_prefix_free_parsing": OP3_SQL, "op4_van_der_corput_mixing": OP4_SQL, "op5_minimax_sharding": OP5_SQL, "op6_grace_hash_dedup": OP6_SQL, "op8_unit_hash_dedup": OP8_SQL, "op10_ball_tree_top_k": OP10_SQL, "op11_numpy_fill_in_middle": OP11_SQL, "op12_crochemore_runs": OP12_SQL}
