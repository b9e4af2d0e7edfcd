"""The queries of :mod:`quillon.plans.catalog` in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from ..sources.synthetic import VERDICTS, families


def h32(x: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {n})"


def fixed(x: str, scale: int) -> str:
    return f"CAST(floor(({x}) * {scale}e0 + 0.5e0) AS BIGINT)"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p for part in parts for p in ([part] if isinstance(part, str) else part)) + "\n"


VERDICT = "CASE WHEN toxic = 1 THEN 'TRUE_POSITIVE' WHEN quality = 0 THEN 'FALSE_POSITIVE' WHEN quality IS NOT NULL THEN 'BENIGN' END"
ALERTS = f"""nd AS (SELECT count(*) AS n_docs FROM documents),
alerts AS (SELECT 'EV' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS alert_id, event_id AS seq, ts, event_type || ' activity' AS alert_name,
  CASE WHEN value < 14.56 THEN 'low' WHEN value < 69.14 THEN 'medium' ELSE 'high' END AS severity, event_type AS category, event_type AS family,
  'host' || CAST(user_id % 80 AS VARCHAR) AS hostname, 'user' || CAST(user_id AS VARCHAR) AS username, '10.20.' || CAST(user_id % 8 AS VARCHAR) || '.' || CAST(event_id % 255 AS VARCHAR) AS source_ip,
  CAST(json_extract_string(props, '$.k') AS BIGINT) + 49152 AS source_port,
  CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 5 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 445 ELSE 5985 END END AS destination_port,
  CASE event_id % 3 WHEN 0 THEN 'detected' WHEN 1 THEN 'allowed' ELSE 'blocked' END AS action, {VERDICT} AS verdict
  FROM events JOIN nd ON true LEFT JOIN labels ON labels.doc_id = event_id % n_docs)"""


def time_split(rows: str, order: str, train: float = 0.7, both: float = 0.85, name: str = "sp") -> str:
    return f"""{name}_o AS (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS o, count(*) OVER () AS n FROM {rows}),
{name}_b AS (SELECT max(CASE WHEN o = CAST(floor(n * {train}e0) AS BIGINT) THEN {order} END) AS b1, max(CASE WHEN o = CAST(floor(n * {both}e0) AS BIGINT) THEN {order} END) AS b2 FROM {name}_o),
{name} AS (SELECT * EXCLUDE (o, n, b1, b2), CASE WHEN {order} < b1 THEN 'train' WHEN {order} < b2 THEN 'validation' ELSE 'test' END AS split FROM {name}_o JOIN {name}_b ON true)"""


DOCS = f"""docs0 AS (SELECT d.doc_id AS id, text, lang AS family, {VERDICT} AS verdict FROM documents d LEFT JOIN labels USING (doc_id)),
{time_split("docs0", "id", 0.7, 0.85, "docs")}"""


def cleaned(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(left(lower(coalesce({x}, '')), 16384), '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', ' ipaddr ', 'g'), '\b[0-9a-f]{{16,}}\b', ' hexvalue ', 'g'), '\d+', ' num ', 'g')"


def toks(x: str) -> str:
    return rf"list_filter(regexp_extract_all({cleaned(x)}, '[\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z_]{{2,}}'))"


def pairs(t: str) -> str:
    return f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def terms(rows: str, key: str, text: str, name: str = "tf") -> str:
    return f"""{name}_t AS (SELECT {key} AS id, {toks(text)} AS t FROM {rows}),
{name}_u AS (SELECT id, unnest(list_concat(t, {pairs("t")})) AS term FROM {name}_t),
{name} AS (SELECT id, term, count(*) AS tf FROM {name}_u GROUP BY id, term)"""


def idf(counts: str, n: str, name: str = "idf") -> str:
    return f"{name} AS (SELECT term, count(*) AS df, ln((1e0 + ({n})) / (1e0 + count(*))) + 1 AS idf FROM {counts} GROUP BY term)"


def norm(rows: str, name: str, scale: str = "1000000e0") -> str:
    """rows: id, pn, w."""
    return f"""{name}_s AS (SELECT id, pn, CAST(sum(w) AS BIGINT) AS w FROM {rows} GROUP BY id, pn),
{name} AS (SELECT id, pn, CAST(floor(w * {scale} / sqrt(CAST(sum(w * w) OVER (PARTITION BY id) AS DOUBLE)) + 0.5e0) AS BIGINT) AS v FROM {name}_s WHERE w <> 0)"""


WEIGHTS = f"""{terms("docs", "id", "text")},
tf_train AS (SELECT tf.* FROM tf JOIN docs USING (id) WHERE split = 'train'),
{idf("tf_train", "SELECT count(*) FROM docs WHERE split = 'train'")},
w AS (SELECT id, term, {fixed("(ln(CAST(tf AS DOUBLE)) + 1) * idf", 10000)} AS w FROM tf JOIN idf USING (term)),
wh AS (SELECT id, {h32("term", 256)} AS pn, w FROM w)"""
VECTORS = f"{DOCS},\n{WEIGHTS},\n{norm('wh', 'pnv')}"


def edges(inputs: int | str, units: int | str, fan_in: int, name: str = "ed", seed: int = 42) -> str:
    key = f"'{seed}|' || CAST(kc AS VARCHAR) || '|' || CAST(a AS VARCHAR)"
    return f"""{name} AS (SELECT pn, kc FROM (SELECT pn, kc, row_number() OVER (PARTITION BY kc ORDER BY a) AS n FROM
  (SELECT kc, pn, min(a) AS a FROM (SELECT kc, a, {h32(key, inputs)} AS pn FROM (SELECT unnest(range({units})) AS kc) k, range({4 * fan_in + 16}) t(a)) GROUP BY kc, pn)) WHERE n <= {fan_in})"""


def encoded(vectors: str, inputs: int, units: int, fan_in: int, k: int) -> str:
    return f"""{edges(inputs, units, fan_in)},
act AS (SELECT id, kc, CAST(sum(v) AS BIGINT) AS act FROM {vectors} JOIN ed USING (pn) GROUP BY id, kc),
fp AS (SELECT id, kc FROM (SELECT id, kc, row_number() OVER (PARTITION BY id ORDER BY act DESC, md5('tie|42|' || CAST(kc AS VARCHAR))) AS n FROM act WHERE act > 0) WHERE n <= {k})"""


PRINTS = f"{VECTORS},\n{encoded('pnv', 256, 512, 6, 16)},\nsz AS (SELECT docs.id, split, family, verdict, count(kc) AS n FROM docs LEFT JOIN fp ON fp.id = docs.id GROUP BY ALL)"
EMB = """emb_x AS (SELECT vec_id AS id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
emb AS (SELECT id, CASE WHEN x > 0 THEN i ELSE i + 64 END AS pn, CAST(floor(abs(CAST(x AS DOUBLE)) * 1e6 + 0.5e0) AS BIGINT) AS v FROM emb_x WHERE x <> 0),
embv AS (SELECT * FROM emb WHERE v > 0)"""
BIP = "bip AS (SELECT l_partkey AS pn, l_suppkey AS kc, CAST(l_quantity AS BIGINT) AS w FROM lineitem WHERE CAST(l_quantity AS BIGINT) >= 1),\nbips AS (SELECT pn, kc, CAST(sum(w) AS BIGINT) AS w FROM bip GROUP BY pn, kc)"
GRAPH = """ge AS (SELECT l_partkey AS src, l_suppkey + 1000000000 AS dst, CAST(count(*) AS BIGINT) AS w FROM lineitem GROUP BY ALL),
nodes AS (SELECT p_partkey AS node, p_brand AS class FROM part UNION ALL SELECT s_suppkey + 1000000000, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
tr AS (SELECT src, dst, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY src) AS p FROM ge)"""


def overlap(metric: str) -> str:
    return {
        "jaccard": "CAST(x AS DOUBLE) / (na + nb - x)",
        "cosine": "CAST(x AS DOUBLE) / sqrt(CAST(na * nb AS DOUBLE))",
        "hamming": "1e0 - CAST(na + nb - 2 * x AS DOUBLE) / 512",
    }[metric]


def knn(queries: str, refs: str, k: int, metric: str = "jaccard", skip_self: bool = False, name: str = "nn") -> str:
    """queries, refs: conditions on sz; all pairs with similarity 0 where nothing is shared."""
    return f"""{name}_q AS (SELECT id, n FROM sz WHERE {queries}),
{name}_r AS (SELECT id, n FROM sz WHERE {refs}),
{name}_i AS (SELECT a.id AS q, b.id AS r, count(*) AS x FROM fp a JOIN {name}_q USING (id) JOIN fp b ON a.kc = b.kc JOIN {name}_r ON {name}_r.id = b.id GROUP BY a.id, b.id),
{name}_p AS (SELECT qq.id AS query, rr.id AS ref, qq.n AS na, rr.n AS nb, coalesce(x, 0) AS x FROM {name}_q qq JOIN {name}_r rr ON {"qq.id <> rr.id" if skip_self else "true"} LEFT JOIN {name}_i ON q = qq.id AND r = rr.id),
{name}_s AS (SELECT query, ref, CASE WHEN na > 0 AND nb > 0 THEN {overlap(metric)} ELSE 0e0 END AS similarity FROM {name}_p),
{name} AS (SELECT query, ref, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ref) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {k})"""


def emb_knn(k: int, queries: str, refs: str, skip_self: bool, name: str) -> str:
    return f"""{name}_d AS (SELECT a.id AS query, b.id AS ref, CAST(sum(a.v * b.v) AS DOUBLE) AS dot FROM embv a JOIN embv b USING (pn) GROUP BY a.id, b.id),
{name}_n AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM embv GROUP BY id),
{name}_s AS (SELECT q.id AS query, r.id AS ref, least(1e0, greatest(0e0, coalesce(dot / (qn.norm * rn.norm), 0e0))) AS similarity
  FROM ids q JOIN ids r ON q.split = '{queries}' AND r.split = '{refs}' {"AND q.id <> r.id" if skip_self else ""} LEFT JOIN {name}_d d ON d.query = q.id AND d.ref = r.id LEFT JOIN {name}_n qn ON qn.id = q.id LEFT JOIN {name}_n rn ON rn.id = r.id),
{name} AS (SELECT query, ref, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ref) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {k})"""


IDS = f"ids0 AS (SELECT vec_id AS id FROM embeddings),\n{time_split('ids0', 'id', 0.7, 0.85, 'ids')}"
KNOWN = "split = '{}' AND family <> 'es'"
NOVEL = f"""{PRINTS},
{knn(KNOWN.format('train'), KNOWN.format('train'), 1, skip_self=True, name='loo')},
lim AS (SELECT quantile_cont(1 - similarity, 0.99) AS t FROM loo),
{knn("split = 'test'", KNOWN.format('train'), 1, name='sc')},
scored AS (SELECT query, ref AS nearest, 1 - similarity AS novelty, (1 - similarity) > t AS is_novel FROM sc JOIN lim ON true)"""
TRUTH = f"{NOVEL},\ntruth AS (SELECT scored.*, family = 'es' AS truth FROM scored JOIN docs ON docs.id = query)"
SIX = "round({0}, 6) AS {1}"


def six(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0e0)"


def leaders(sets: str, percents: str, metric: str = "jaccard") -> str:
    """sets: id (and n) of rows in fp, or with cosine of vectors in tv; every threshold's leader clustering by a walk in row order."""
    links = {
        "jaccard": f"""sx AS (SELECT a.id AS early, b.id AS late, count(*) AS x FROM fp a JOIN so sa ON sa.id = a.id JOIN fp b ON a.kc = b.kc AND a.id < b.id JOIN so sb ON sb.id = b.id GROUP BY a.id, b.id),
se AS (SELECT percent, early, late, CAST(x AS DOUBLE) / (sa.n + sb.n - x) AS similarity FROM sx JOIN so sa ON sa.id = early JOIN so sb ON sb.id = late JOIN lv ON 100 * x >= percent * (sa.n + sb.n - x))""",
        "cosine": "se AS (SELECT percent, early, late, similarity FROM links JOIN lv ON similarity >= percent / 100e0)",
    }[metric]
    return f"""lv AS (SELECT unnest([{percents}]) AS percent),
so AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM {sets}),
{links},
nbr AS (SELECT percent, late, list(early) AS near FROM se GROUP BY percent, late),
walk AS (SELECT percent, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ex FROM lv
  UNION ALL SELECT walk.percent, so.i, CASE WHEN list_has_any(walk.ex, coalesce(near, [])) THEN walk.ex ELSE list_append(walk.ex, so.id) END
  FROM walk JOIN so ON so.i = walk.i + 1 LEFT JOIN nbr ON nbr.percent = walk.percent AND nbr.late = so.id),
exm AS (SELECT percent, unnest(ex) AS id FROM walk WHERE i = (SELECT count(*) FROM so)),
mem AS (SELECT percent, late AS id, early AS leader FROM (SELECT se.*, row_number() OVER (PARTITION BY se.percent, late ORDER BY similarity DESC, early) AS n FROM se JOIN exm ON exm.percent = se.percent AND exm.id = early) WHERE n = 1),
led AS (SELECT lv.percent, so.id, CASE WHEN exm.id IS NOT NULL THEN so.id ELSE mem.leader END AS leader FROM so JOIN lv ON true LEFT JOIN exm ON exm.percent = lv.percent AND exm.id = so.id LEFT JOIN mem ON mem.percent = lv.percent AND mem.id = so.id)"""


#: tf-idf of documents over the most frequent terms of train, and pairs of a cosine of 0.5 or more.
TERM_VECTORS = f"""voc AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term) - 1 AS pn FROM tf_train GROUP BY term QUALIFY pn < 4096),
wv AS (SELECT id, pn, w FROM w JOIN voc USING (term)),
{norm("wv", "tv")},
tn AS (SELECT id, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM tv GROUP BY id)"""
LINKS = f"""{DOCS},
{WEIGHTS},
{TERM_VECTORS},
td AS (SELECT a.id AS early, b.id AS late, CAST(sum(a.v * b.v) AS DOUBLE) AS dot FROM tv a JOIN tv b ON a.pn = b.pn AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT early, late, dot / (a.norm * b.norm) AS similarity FROM td JOIN tn a ON a.id = early JOIN tn b ON b.id = late WHERE dot / (a.norm * b.norm) >= 0.5e0)"""


CLUSTERS = f"""cells AS (SELECT percent, leader, family, count(*) AS n FROM led JOIN docs USING (id) GROUP BY ALL),
cl AS (SELECT percent, leader, sum(n) AS size, max(n) AS top, sum(n * (n - 1) / 2) AS same, count(*) AS kinds FROM cells GROUP BY ALL),
cm AS (SELECT percent, CAST(sum(size) AS BIGINT) AS n_rows, count(*) AS clusters, sum(top) AS pure, CAST(sum(size * (size - 1) / 2) AS BIGINT) AS pairs, CAST(sum(same) AS BIGINT) AS same, sum(CASE WHEN kinds > 1 THEN 1 ELSE 0 END) AS mixed FROM cl GROUP BY percent),
cr AS (SELECT percent, n_rows, clusters, 1 - {ratio('clusters', 'n_rows')} AS reduction, {ratio('pure', 'n_rows')} AS purity, pairs - same AS false_pairs, pairs, {ratio('pairs - same', 'pairs')} AS false_merge_rate, {ratio('mixed', 'clusters')} AS mixed_rate FROM cm)"""
CLUSTER_COLS = "n_rows, clusters, round(reduction, 6) AS reduction, round(purity, 6) AS purity, false_pairs, pairs, round(false_merge_rate, 6) AS false_merge_rate, round(mixed_rate, 6) AS mixed_rate"
VOTES = f"""{PRINTS},
{knn("split = 'test'", "split = 'train' AND verdict IS NOT NULL", 5, 'cosine')},
vd AS (SELECT query, verdict AS label, greatest(1 - similarity, 0e0) AS d FROM nn JOIN docs ON docs.id = ref),
vx AS (SELECT *, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS exact FROM vd),
vs AS (SELECT query, label, sum(CASE WHEN exact = 1 THEN CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END ELSE 1 / d END) AS v FROM vx GROUP BY query, label),
vote AS (SELECT query, label, v / sum(v) OVER (PARTITION BY query) AS p FROM vs)"""
PREDICTED = f"""{VOTES},
pr AS (SELECT query, arg_min(label, (-p, label)) AS predicted, docs.verdict AS actual FROM vote JOIN docs ON docs.id = query WHERE docs.verdict IS NOT NULL GROUP BY query, docs.verdict),
lab AS (SELECT actual AS label FROM pr UNION SELECT predicted FROM pr),
conf AS (SELECT a.label AS actual, b.label AS predicted, count(query) AS n FROM lab a JOIN lab b ON true LEFT JOIN pr ON pr.actual = a.label AND pr.predicted = b.label GROUP BY ALL),
rep0 AS (SELECT label, sum(CASE WHEN actual = label THEN n ELSE 0 END) AS support, sum(CASE WHEN actual = label AND predicted = label THEN n ELSE 0 END) AS tp, sum(CASE WHEN predicted = label THEN n ELSE 0 END) AS claimed FROM lab JOIN conf ON true GROUP BY label),
rep1 AS (SELECT label, {ratio('tp', 'claimed')} AS precision, {ratio('tp', 'support')} AS recall, CAST(support AS BIGINT) AS support FROM rep0),
rep AS (SELECT label, precision, recall, {ratio('2 * precision * recall', 'precision + recall')} AS f1, support FROM rep1)"""
#: Neighbours' verdicts by both representations, their confusion by scope, and the reports.
SCOPES = f"""{PRINTS},
{TERM_VECTORS},
{knn("split = 'test' AND verdict IS NOT NULL", "split = 'train' AND verdict IS NOT NULL AND family <> 'es'", 5, "cosine", name="nf")},
vdot AS (SELECT a.id AS q, b.id AS r, CAST(sum(a.v * b.v) AS DOUBLE) AS dot FROM tv a JOIN nf_q ON nf_q.id = a.id JOIN tv b ON a.pn = b.pn JOIN nf_r ON nf_r.id = b.id GROUP BY a.id, b.id),
vsim AS (SELECT nf_q.id AS query, nf_r.id AS ref, least(1e0, coalesce(dot / (x.norm * y.norm), 0e0)) AS similarity FROM nf_q JOIN nf_r ON true LEFT JOIN vdot ON q = nf_q.id AND r = nf_r.id LEFT JOIN tn x ON x.id = nf_q.id LEFT JOIN tn y ON y.id = nf_r.id),
near AS (SELECT 'fingerprint' AS representation, query, ref, similarity FROM nf UNION ALL SELECT 'vector', query, ref, similarity FROM vsim QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, ref) <= 5),
sd AS (SELECT representation, query, verdict AS label, greatest(1 - similarity, 0e0) AS d FROM near JOIN docs ON docs.id = ref),
sx2 AS (SELECT *, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY representation, query) AS exact FROM sd),
sv AS (SELECT representation, query, label, sum(CASE WHEN exact = 1 THEN CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END ELSE 1 / d END) AS v FROM sx2 GROUP BY representation, query, label),
sp2 AS (SELECT representation, query, arg_min(label, (-v, label)) AS predicted FROM sv GROUP BY representation, query),
sr AS (SELECT representation, predicted, verdict AS actual, unnest(['all', CASE WHEN family = 'es' THEN 'unseen' ELSE 'known' END]) AS scope FROM sp2 JOIN docs ON docs.id = query),
sl AS (SELECT representation, scope, actual AS label FROM sr UNION SELECT representation, scope, predicted FROM sr),
sc2 AS (SELECT sl.representation, sl.scope, label, count(*) FILTER (actual = label) AS support, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS claimed FROM sl JOIN sr ON sr.representation = sl.representation AND sr.scope = sl.scope GROUP BY ALL),
sq AS (SELECT *, {ratio("tp", "claimed")} AS precision, {ratio("tp", "support")} AS recall FROM sc2),
sf AS (SELECT *, {ratio("2 * precision * recall", "precision + recall")} AS f1 FROM sq)"""
OVR = f"""{PREDICTED},
cls AS (SELECT unnest(['TRUE_POSITIVE', 'FALSE_POSITIVE', 'BENIGN']) AS label),
ovr AS (SELECT cls.label, coalesce(round(vote.p, 9), 0e0) AS score, CASE WHEN actual = cls.label THEN 1 ELSE 0 END AS truth FROM pr JOIN cls ON true LEFT JOIN vote ON vote.query = pr.query AND vote.label = cls.label)"""


def auroc(rows: str, by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {key}sum(p * (below + q / 2e0)) / nullif(CAST(sum(p) * sum(q) AS DOUBLE), 0) AS auroc FROM
  (SELECT *, coalesce(sum(q) OVER ({'PARTITION BY ' + by if by else ''} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
  (SELECT {key}score, sum(truth) AS p, sum(1 - truth) AS q FROM {rows} GROUP BY {key}score)) {group})"""


def ap(rows: str, by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {key}CASE WHEN sum(p) > 0 AND sum(n) > sum(p) THEN sum(p * tp / CAST(al AS DOUBLE)) / sum(p) END AS ap FROM
  (SELECT *, sum(p) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS al FROM
  (SELECT {key}score, sum(truth) AS p, count(*) AS n FROM {rows} GROUP BY {key}score)) {group})"""


def diffused(steps: int) -> str:
    out = ["s0 AS (SELECT node, 1e0 AS a FROM nodes WHERE class = 'Brand#2')"]
    for i in range(steps):
        out.append(f"""s{i + 1} AS (SELECT coalesce(s.node, f.node) AS node, 0.9e0 * ((1 - 0.8e0) * coalesce(a, 0e0) + 0.8e0 * coalesce(inflow, 0e0)) AS a
  FROM s{i} s FULL OUTER JOIN (SELECT dst AS node, sum(p * a) AS inflow FROM tr JOIN s{i} ON src = node GROUP BY dst) f ON s.node = f.node)""")
    return ",\n".join(out)


CATEGORY_ROWS = """cat AS (SELECT seq AS id, unnest([{'f': 'severity', 'x': severity, 'w': 10000}, {'f': 'category', 'x': category, 'w': 10000}, {'f': 'action', 'x': action, 'w': 10000},
  {'f': 'hostname', 'x': hostname, 'w': 1500}, {'f': 'username', 'x': username, 'w': 1500}, {'f': 'source_ip', 'x': source_ip, 'w': 1500}]) AS p FROM alerts),
catt AS (SELECT id, p.f || '=' || left(lower(coalesce(p.x, '')), 512) AS token, CAST(p.w AS BIGINT) AS w FROM cat WHERE coalesce(p.x, '') <> '')"""
CATEGORY_BLOCK = f"{CATEGORY_ROWS},\ncath AS (SELECT id, {h32('token', 2048)} AS pn, w FROM catt),\n{norm('cath', 'catv', '700000e0')}"


def port(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 65535 THEN ln(1e0 + {x}) / ln(65536e0) ELSE 0e0 END"


def port_ok(x: str) -> str:
    return f"coalesce({x} BETWEEN 0 AND 65535, false)"


def cycle(x: str, n: int, f: str) -> str:
    return f"({f}(CAST({x} AS DOUBLE) * {6.283185307179586 / n!r}) + 1) / 2"


NUMERIC = [port("source_port"), port("destination_port"), f"CASE WHEN {port_ok('source_port')} THEN 1e0 ELSE 0e0 END", f"CASE WHEN {port_ok('destination_port')} THEN 1e0 ELSE 0e0 END",
           cycle("hour(ts)", 24, "sin"), cycle("hour(ts)", 24, "cos"), cycle("(isodow(ts) - 1)", 7, "sin"), cycle("(isodow(ts) - 1)", 7, "cos")]
NUMERIC_BLOCK = "num0 AS (SELECT seq AS id, unnest([" + ", ".join(f"{{'pn': {i}, 'x': {fixed(x, 1000000)}}}" for i, x in enumerate(NUMERIC)) + "]) AS s FROM alerts),\nnumv AS (SELECT id, s.pn AS pn, CAST(floor(s.x * 0.2e0 + 0.5e0) AS BIGINT) AS v FROM num0 WHERE s.x <> 0)"
TEXT_BLOCK = f"""{terms("alerts", "seq", "alert_name", "atf")},
{idf("atf", "SELECT count(*) FROM alerts", "aidf")},
avoc AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS rk FROM (SELECT term, sum(tf) AS n FROM atf GROUP BY term) ORDER BY n DESC, term LIMIT 2040),
aw AS (SELECT id, rk AS pn, {fixed("(ln(CAST(tf AS DOUBLE)) + 1) * idf", 10000)} AS w FROM atf JOIN aidf USING (term) JOIN avoc USING (term)),
{norm("aw", "atv")}"""
FULL_VECTOR = f"{ALERTS},\n{CATEGORY_BLOCK},\n{NUMERIC_BLOCK},\n{TEXT_BLOCK},\nall3 AS (SELECT id, pn, v AS w FROM catv UNION ALL SELECT id, pn + 2048, v FROM atv UNION ALL SELECT id, pn + 4088, v FROM numv),\n{norm('all3', 'pnv')}"
NO_TEXT = f"{ALERTS},\n{CATEGORY_BLOCK},\n{NUMERIC_BLOCK},\nall3 AS (SELECT id, pn, v AS w FROM catv UNION ALL SELECT id, pn + 4088, v FROM numv),\n{norm('all3', 'pnv')}"
POSITION = "pos AS (SELECT vec_id, CAST(printf('%.4f', CAST(embedding[1] AS DOUBLE)) AS DOUBLE) AS x, CAST(printf('%.4f', CAST(embedding[2] AS DOUBLE)) AS DOUBLE) AS y, CAST(printf('%.4f', CAST(embedding[3] AS DOUBLE)) AS DOUBLE) AS z FROM embeddings)"
BRIDGE = f"""np AS (SELECT count(*) AS n FROM part),
br AS (SELECT f, pn FROM (SELECT f, pn, row_number() OVER (PARTITION BY f ORDER BY a) AS k FROM (SELECT f, pn, min(a) AS a FROM (SELECT f, a, CAST('0x' || substr(md5('42|' || CAST(f AS VARCHAR) || '|' || CAST(a AS VARCHAR)), 1, 8) AS BIGINT) % n AS pn FROM range(128) k(f), range(24) t(a), np) GROUP BY f, pn)) WHERE k <= 2)"""
BRIDGED = f"{EMB},\n{BIP},\n{BRIDGE},\nbw AS (SELECT id, br.pn, v // 2 AS w FROM embv JOIN br ON f = embv.pn),\n{norm('bw', 'bv')},\nbact AS (SELECT id, kc, CAST(sum(v * w) AS BIGINT) AS act FROM bv JOIN bips USING (pn) GROUP BY id, kc)"
FEEDBACK = "fb AS (SELECT event_id AS seq, event_id % (SELECT count(*) FROM documents) AS id, CASE WHEN event_type = 'error' THEN 'TRUE_POSITIVE' ELSE 'BENIGN' END AS verdict FROM events WHERE event_type IN ('click', 'error'))"
ALERT_SPLIT = f"{ALERTS},\n{time_split('alerts', 'ts', name='sa')},\nun AS (SELECT sa.*, family NOT IN (SELECT family FROM sa WHERE split = 'train' AND family <> 'signup') AS is_unseen FROM sa)"


def synthetic(seed: int = 42) -> str:
    draw = lambda field, n: h32(f"'{seed}|{field}|' || CAST(id AS VARCHAR)", n)
    kinds = families()
    rows = ", ".join("(" + ", ".join([str(i), *(str(x) if isinstance(x, int) else f"'{x}'" for x in f)]) + ")" for i, f in enumerate(kinds))
    some = lambda x, field: f"CASE WHEN {draw('missing ' + field, 1000)} >= 35 THEN {x} END AS {field}"
    pick = lambda values, at: f"list_extract([{', '.join(repr(v) for v in values)}], CAST({at} + 1 AS BIGINT))"
    return f"""WITH fam(k, family, process, port, category, words, technique, usual) AS (VALUES {rows}),
r AS (SELECT id, id >= (SELECT CAST(floor(count(*) * 0.85e0) AS BIGINT) FROM events) AND {draw("unseen", 1000)} < 300 AS is_unseen FROM (SELECT event_id AS id FROM events)),
s AS (SELECT r.*, fam.*, usual = 'TRUE_POSITIVE' AS yes FROM r JOIN fam ON k = CASE WHEN is_unseen THEN {len(kinds) - 1} ELSE {draw("family", len(kinds) - 1)} END),
c AS (SELECT *, CAST((k + {draw("crew", 3)}) % 4 AS VARCHAR) AS crew, {draw("person", 30)} AS person, CAST({draw("machine", 20)} AS VARCHAR) AS machine FROM s)
SELECT CAST(epoch(TIMESTAMP '2026-01-01 00:00:00') AS BIGINT) + id * 420 + {draw("second", 180)} AS second, 'Q' || lpad(CAST(id AS VARCHAR), 8, '0') AS alert_id, upper(category[1]) || category[2:] || ' signal' AS alert_name,
  {pick(("low", "medium", "high"), f"least(2, {draw('severity', 3)} + CASE WHEN yes THEN 1 ELSE 0 END)")} AS severity, process || '-' || crew || '-' || machine AS hostname,
  {some(f"CASE WHEN {draw('robot', 5)} = 0 THEN 'robot.' || process ELSE 'crew' || crew || '.' || CAST(person AS VARCHAR) END", "username")},
  '172.20.' || crew || '.' || CAST(person + 10 AS VARCHAR) AS source_ip, {some(f"32768 + {draw('port', 28000)}", "source_port")},
  CAST(CASE WHEN {draw('odd_port', 10)} < 8 THEN port ELSE 1024 + {draw('other_port', 500)} END AS INTEGER) AS destination_port,
  {some(f"process || ': ' || words || ', case ' || CAST({draw('case', 40)} AS VARCHAR)", "process_command_line")},
  CASE WHEN yes AND {draw('action', 2)} = 0 THEN 'blocked' WHEN {draw('action', 4)} < 3 THEN 'detected' ELSE 'allowed' END AS action,
  CASE WHEN {draw("noise", 1000)} < 70 THEN {pick(VERDICTS, draw("verdict", 3))} ELSE usual END AS verdict, family, is_unseen FROM c"""


#: A projection drawn for the given numbers of parts and orders.
PROJECTION = edges("(SELECT count(*) FROM part)", "(SELECT count(*) FROM orders)", 8)
#: The thresholds of a sweep.
FIFTY = ", ".join(map(str, range(50, 100)))


def calibrated() -> str:
    """The best threshold of the whole fingerprints, of their lower half and of the vectors, side by side."""
    rank = "row_number() OVER (ORDER BY false_merge_rate <= 0.01e0 DESC, CASE WHEN false_merge_rate <= 0.01e0 THEN reduction END DESC NULLS LAST, CASE WHEN false_merge_rate > 0.01e0 THEN false_merge_rate END ASC NULLS LAST, percent DESC)"
    pick = f"SELECT percent, clusters, false_merge_rate, CASE WHEN false_merge_rate <= 0.01e0 THEN 'within_budget' ELSE 'budget_not_met' END AS status FROM (SELECT *, {rank} AS k FROM cr) WHERE k = 1"
    whole = ctes(PRINTS, leaders("sz", "60, 75"), CLUSTERS) + pick
    lower = PRINTS.replace("fp AS (", "fp0 AS (").replace("sz AS (", "fp AS (SELECT * FROM fp0 WHERE kc < 256),\nsz AS (")
    half = ctes(lower, leaders("sz", "60, 75"), CLUSTERS) + pick
    vector = ctes(LINKS, leaders("docs", "60, 75", "cosine"), CLUSTERS) + pick
    return f"SELECT 'whole' AS representation, 'jaccard' AS metric, * FROM ({whole}) UNION ALL SELECT 'half', 'jaccard', * FROM ({half}) UNION ALL SELECT 'vector', 'cosine', * FROM ({vector})"


SQL: dict[str, str] = {
    "dup_alert_ids": ctes(ALERTS) + "SELECT username || '/' || category AS alert_id, count(*) AS n FROM alerts GROUP BY 1 HAVING count(*) > 1",
    "verdict_normalize": ctes(ALERTS) + "SELECT upper(trim('  ' || lower(verdict) || ' ')) AS verdict, count(*) AS n FROM alerts GROUP BY 1",
    "chrono_split": ctes(time_split("events", "ts")) + "SELECT event_id, split FROM sp",
    "chrono_split_ties": ctes(time_split("lineitem", "l_shipdate", 0.65, 0.85)) + "SELECT split, count(*) AS n, CAST(min(l_shipdate) AS DATE) - DATE '1970-01-01' AS first_day, CAST(max(l_shipdate) AS DATE) - DATE '1970-01-01' AS last_day FROM sp GROUP BY split",
    "split_summary": ctes(ALERT_SPLIT) + "SELECT split, verdict, family, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM sa GROUP BY ALL",
    "heldout_leak": ctes(ALERT_SPLIT) + "SELECT family, split, count(*) AS n FROM sa WHERE family = 'signup' AND split <> 'test' GROUP BY ALL",
    "unseen_flag": ctes(ALERT_SPLIT) + "SELECT split, family, is_unseen, count(*) AS n FROM un GROUP BY ALL",
    "alert_catalog": ctes(ALERT_SPLIT) + "SELECT seq, alert_id, alert_name AS name, family, coalesce(verdict, 'UNKNOWN') AS verdict, is_unseen FROM un",
    "alert_catalog_filter": ctes(ALERT_SPLIT) + "SELECT alert_id, coalesce(verdict, 'UNKNOWN') AS verdict FROM un WHERE is_unseen",
    "alert_lookup": ctes(ALERTS) + "SELECT alert_id, seq, family, severity FROM alerts WHERE alert_id = 'EV0000007'",
    "labelled_filter": ctes(ALERTS) + "SELECT verdict, count(*) AS n, min(seq) AS first_seq FROM alerts WHERE verdict IS NOT NULL GROUP BY 1",
    "family_counts": "SELECT event_type AS family, count(*) AS n FROM events GROUP BY 1",
    "verdict_counts": ctes(ALERTS) + "SELECT coalesce(verdict, 'UNKNOWN') AS verdict, count(*) AS n FROM alerts GROUP BY 1",
    "class_codes": ctes(GRAPH) + "SELECT coalesce(class, 'unclassified') AS class, CAST(dense_rank() OVER (ORDER BY coalesce(class, 'unclassified')) - 1 AS INTEGER) AS code, count(*) AS n FROM nodes GROUP BY 1",
    "regex_class_select": r"SELECT p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, 'widget\b') THEN 'widgets' ELSE 'rings' END AS class FROM part WHERE regexp_matches(p_name || ' ' || p_type, 'widget\b|\bring\b')",
    "bipartite_edges": ctes(BIP) + "SELECT pn, kc, CAST(sum(w) AS BIGINT) AS w FROM bip JOIN part ON p_partkey = pn AND p_size <= 25 JOIN supplier ON s_suppkey = kc AND s_acctbal > 0 WHERE w >= 5 GROUP BY ALL",
    "json_record_normalize": "SELECT event_id, 0 AS pos, 1 AS fields, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS type FROM events UNION ALL SELECT event_id, 1, 2, NULL, event_type FROM events",
    "synthetic_alerts": synthetic(),
    "clean_text": f"SELECT doc_id, md5({cleaned('text')}) AS cleaned_md5 FROM documents",
    "tokens_unigram": f"SELECT token, count(*) AS n FROM (SELECT unnest({toks('text')}) AS token FROM documents) GROUP BY token",
    "tokens_bigram": f"SELECT bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({pairs('t')}) AS bigram FROM (SELECT doc_id, {toks('text')} AS t FROM documents)) GROUP BY bigram",
    "vocab_topk": ctes(DOCS, terms("(SELECT * FROM docs WHERE split = 'train')", "id", "text")) + "SELECT term, CAST(sum(tf) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY sum(tf) DESC, term) - 1 AS INTEGER) AS rank FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 2040",
    "idf_smooth": ctes(DOCS, terms("(SELECT * FROM docs WHERE split = 'train')", "id", "text"), idf("tf", "SELECT count(*) FROM docs WHERE split = 'train'")) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_l2": ctes(VECTORS) + "SELECT id, pn, v FROM pnv",
    "categorical_hash": ctes(ALERTS, CATEGORY_ROWS) + f"SELECT token, {h32('token', 2048)} AS slot, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM catt GROUP BY token",
    "categorical_block": ctes(ALERTS, CATEGORY_BLOCK) + "SELECT id, pn, v FROM catv",
    "port_features": ctes(ALERTS) + f"SELECT seq, round({port('source_port')}, 6) AS src, round({port('destination_port')}, 6) AS dst, {port_ok('source_port')} AS src_ok, {port_ok('destination_port')} AS dst_ok FROM alerts",
    "cyclic_time": f"SELECT event_id AS seq, round({NUMERIC[4]}, 6) AS hour_sin, round({NUMERIC[5]}, 6) AS hour_cos, round({NUMERIC[6]}, 6) AS day_sin, round({NUMERIC[7]}, 6) AS day_cos FROM events",
    "pn_vector": ctes(FULL_VECTOR) + "SELECT id, pn, v FROM pnv WHERE v <> 0",
    "ablation_without_text": ctes(NO_TEXT) + "SELECT id, pn, v FROM pnv WHERE v <> 0",
    "position_parse": ctes(POSITION) + "SELECT vec_id, x, y, z FROM pos",
    "position_normalize": ctes(POSITION, "lim AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM pos)", "sc AS (SELECT *, greatest(hx - lx, hy - ly, hz - lz) / 230.0 AS s FROM lim)") + "SELECT vec_id, round((x - (lx + hx) / 2) / s, 6) AS x, round(-1 * (y - (ly + hy) / 2) / s, 6) AS y, round(-1 * (z - (lz + hz) / 2) / s, 6) AS z FROM pos JOIN sc ON true",
    "first_position": "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1",
    "projection_edges": ctes(PROJECTION) + "SELECT pn, kc FROM ed",
    "kc_fanin": ctes(PROJECTION) + "SELECT inputs, distinct_inputs, count(*) AS units FROM (SELECT kc, count(*) AS inputs, count(DISTINCT pn) AS distinct_inputs FROM ed GROUP BY kc) GROUP BY ALL",
    "degree_signature": ctes(BIP, "de AS (SELECT DISTINCT pn, kc FROM bip)", "dg AS (SELECT 'pn' AS side, pn AS node, count(*) AS degree FROM de GROUP BY pn UNION ALL SELECT 'kc', kc, count(*) FROM de GROUP BY kc)") + "SELECT side, degree, count(*) AS nodes FROM dg GROUP BY ALL",
    "edge_sample": "SELECT src, dst FROM (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem) ORDER BY md5('42|' || CAST(src AS VARCHAR) || '|' || CAST(dst AS VARCHAR)), src, dst LIMIT 18000",
    "kc_activation": ctes(EMB, encoded("embv", 128, 512, 6, 16)) + "SELECT id, kc, act FROM act",
    "fingerprint_embeddings": ctes(EMB, encoded("embv", 128, 512, 6, 16)) + "SELECT id, kc FROM fp",
    "fingerprint_alerts": ctes(FULL_VECTOR, "pnz AS (SELECT * FROM pnv WHERE v <> 0)", encoded("pnz", 4096, 8192, 8, 64)) + "SELECT id, kc FROM fp",
    "fingerprint_documents": ctes(PRINTS) + "SELECT id, kc FROM fp",
    "empty_fingerprint": ctes(PRINTS) + "SELECT id FROM sz WHERE n = 0",
    "activation_histogram": ctes(EMB, encoded("embv", 128, 512, 6, 16)) + "SELECT CAST(floor(CAST(act AS DOUBLE) / (SELECT max(act) FROM act) * 59) AS BIGINT) AS bin, count(*) AS n FROM act WHERE act > 0 GROUP BY 1",
    "sparsity_stats": ctes(PRINTS) + "SELECT count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS nnz, min(n) AS least, max(n) AS most, CAST(sum(n) * 5 + 4 * (count(*) + 1) AS BIGINT) AS csr_bytes FROM sz",
    "projection_binary": ctes(BIP) + "SELECT pn, kc, 1e0 AS w FROM bips",
    "projection_synapse": ctes(BIP) + "SELECT pn, kc, CAST(w AS DOUBLE) AS w FROM bips",
    "projection_colnorm": ctes(BIP) + "SELECT pn, kc, round(CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY kc), 6) AS w FROM bips",
    "bridge_activation": ctes(BRIDGED) + "SELECT id, kc, act FROM bact",
    "bridge_fingerprint": ctes(BRIDGED) + "SELECT id, kc FROM (SELECT id, kc, row_number() OVER (PARTITION BY id ORDER BY act DESC, md5('tie|42|' || CAST(kc AS VARCHAR))) AS n FROM bact WHERE act > 0) WHERE n <= 16",
    "effective_connectivity": ctes(BIP, BRIDGE) + "SELECT f, kc, CAST(sum(w) AS BIGINT) AS w FROM br JOIN bips USING (pn) GROUP BY f, kc",
    "rewire_swaps": ctes(BIP) + "SELECT count(*) AS edges, CAST(2 * count(*) AS INTEGER) AS asked, true AS completed, true AS reached, true AS mostly_moved, true AS degrees_kept, true AS weights_kept FROM bips",
    "rewire_degree_check": ctes(BIP) + "SELECT 'pn' AS side, pn AS node, count(*) AS degree FROM bips GROUP BY pn UNION ALL SELECT 'kc', kc, count(*) FROM bips GROUP BY kc",
    "jaccard_pairs": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 1)) + "SELECT query AS a, ref AS b, round(similarity, 6) AS similarity FROM nn_s WHERE similarity >= 0.2e0",
    "binary_cosine_pairs": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 1, "cosine")) + "SELECT query AS a, ref AS b, round(similarity, 6) AS similarity FROM nn_s WHERE similarity >= 0.3e0",
    "hamming_pairs": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 5, "hamming")) + "SELECT query, rank, ref, round(similarity, 6) AS similarity FROM nn",
    "knn_jaccard": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 10)) + "SELECT query, rank, ref, round(similarity, 6) AS similarity FROM nn",
    "knn_cosine": ctes(IDS, EMB, emb_knn(10, "test", "train", False, "en")) + "SELECT query, rank, ref, round(similarity, 6) AS similarity FROM en",
    "loo_nearest": ctes(PRINTS, knn("split = 'train'", "split = 'train'", 1, skip_self=True)) + "SELECT query, ref, round(similarity, 6) AS similarity FROM nn",
    "retrieve_with_metadata": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 5)) + "SELECT ref, query, rank, round(similarity, 6) AS similarity, family AS ref_family, verdict AS ref_verdict FROM nn JOIN docs ON docs.id = ref",
    "retrieval_predictions": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 10)) + "SELECT query, rank, ref, round(similarity, 6) AS similarity, r.verdict AS historical_verdict, q.family = r.family AS same_family FROM nn JOIN docs r ON r.id = ref JOIN docs q ON q.id = query",
    "retrieval_metrics": ctes(PRINTS, knn("split = 'test'", "split = 'train'", 10), "rl AS (SELECT query, rank, CASE WHEN q.family = r.family THEN 1 ELSE 0 END AS rel FROM nn JOIN docs r ON r.id = ref JOIN docs q ON q.id = query)",
        "rh AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM rl)",
        "pq AS (SELECT query, sum(rel) AS hit, count(*) AS ek, sum(rel * hits / CAST(rank AS DOUBLE)) AS ap, sum(rel / log2(rank + 1e0)) AS dcg, max(CASE WHEN rel = 1 THEN 1e0 / rank END) AS rr FROM rh GROUP BY query)",
        "tq AS (SELECT d.id AS query, (SELECT count(*) FROM docs t WHERE t.split = 'train' AND t.family = d.family) AS total FROM docs d WHERE split = 'test')",
        "fq AS (SELECT pq.*, total, (SELECT sum(1 / log2(i + 1e0)) FROM range(1, 11) r(i) WHERE i <= least(total, ek)) AS ideal FROM pq JOIN tq USING (query))")
        + "SELECT round(avg(hit / CAST(ek AS DOUBLE)) FILTER (total > 0), 6) AS precision, round(avg(hit / CAST(total AS DOUBLE)) FILTER (total > 0), 6) AS recall, round(avg(ap / least(total, ek)) FILTER (total > 0), 6) AS map, round(avg(dcg / ideal) FILTER (total > 0), 6) AS ndcg, round(avg(coalesce(rr, 0e0)) FILTER (total > 0), 6) AS mrr, count(*) FILTER (total > 0) AS queries, count(*) FILTER (total = 0) AS excluded FROM fq",
    "knn_vote": ctes(VOTES.replace("left(lower(coalesce(text, '')), 16384)", "lower(coalesce(text, ''))")) + "SELECT query, label, round(p, 6) AS p FROM vote",
    "novelty_threshold": ctes(NOVEL) + "SELECT round(t, 6) AS threshold FROM lim",
    "novelty_scores": ctes(NOVEL) + "SELECT query, nearest, round(novelty, 6) AS novelty, is_novel FROM scored",
    "validation_flag_rate": ctes(NOVEL, knn(KNOWN.format("validation"), KNOWN.format("train"), 1, name="va")) + "SELECT round(avg(CASE WHEN (1 - similarity) > t THEN 1e0 ELSE 0e0 END), 6) AS flag_rate, count(*) AS n FROM va JOIN lim ON true",
    "novelty_metrics": ctes(TRUTH) + "SELECT round(count(*) FILTER (truth AND is_novel) / nullif(CAST(count(*) FILTER (truth) AS DOUBLE), 0), 6) AS tpr, round(count(*) FILTER (NOT truth AND is_novel) / nullif(CAST(count(*) FILTER (NOT truth) AS DOUBLE), 0), 6) AS fpr, round(count(*) FILTER (truth AND is_novel) / nullif(CAST(count(*) FILTER (is_novel) AS DOUBLE), 0), 6) AS precision, count(*) FILTER (truth) AS n_unseen, count(*) FILTER (NOT truth) AS n_known, round(avg(novelty) FILTER (truth), 6) AS mean_unseen, round(avg(novelty) FILTER (NOT truth), 6) AS mean_known FROM truth",
    "novelty_auroc": ctes(TRUTH, "ts AS (SELECT novelty AS score, CAST(truth AS INTEGER) AS truth FROM truth)") + f"SELECT round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM {auroc('ts', '')} a JOIN {ap('ts', '')} b ON true",
    "lof_scores": ctes(IDS, EMB, emb_knn(35, "test", "train", False, "eq"), emb_knn(35, "train", "train", True, "er"),
        "kd AS (SELECT query AS ref, max(1 - similarity) AS kd FROM er GROUP BY query)",
        "ld AS (SELECT query AS ref, 1e0 / (avg(greatest(kd, 1 - similarity)) + 1e-10) AS lrd FROM er JOIN kd USING (ref) GROUP BY query)",
        "lq AS (SELECT query, 1e0 / (avg(greatest(kd, 1 - similarity)) + 1e-10) AS lrd FROM eq JOIN kd USING (ref) GROUP BY query)",
        "lr AS (SELECT query, avg(lrd) AS around FROM eq JOIN ld USING (ref) GROUP BY query)") + "SELECT query, round(around / lrd, 6) AS lof FROM lr JOIN lq USING (query)",
    "dedup_leader": ctes(PRINTS, leaders("sz", "75")) + "SELECT id, leader FROM led",
    "dedup_documents": ctes(PRINTS, "szt AS (SELECT * FROM sz WHERE split = 'test')", leaders("szt", "50")) + "SELECT leader, count(*) AS size, min(id) AS first_id, max(id) AS last_id FROM led GROUP BY leader",
    "dedup_sweep": ctes(PRINTS, leaders("sz", FIFTY), CLUSTERS) + f"SELECT percent, {CLUSTER_COLS} FROM cr",
    "dedup_select": ctes(PRINTS, leaders("sz", FIFTY), CLUSTERS) + f"SELECT percent, {CLUSTER_COLS}, CASE WHEN cr.false_merge_rate <= 0.01e0 THEN 'within_budget' ELSE 'budget_not_met' END AS status FROM cr ORDER BY cr.false_merge_rate <= 0.01e0 DESC, CASE WHEN cr.false_merge_rate <= 0.01e0 THEN cr.reduction END DESC NULLS LAST, CASE WHEN cr.false_merge_rate > 0.01e0 THEN cr.false_merge_rate END ASC NULLS LAST, percent DESC LIMIT 1",
    "dedup_leader_cosine": ctes(LINKS, leaders("docs", "75", "cosine")) + "SELECT id, leader FROM led",
    "cosine_links": ctes(LINKS) + "SELECT early, late, round(similarity, 6) AS similarity FROM links WHERE similarity >= 0.75e0",
    "dedup_calibrate": f"SELECT representation, metric, percent, clusters, round(false_merge_rate, 6) AS false_merge_rate, status FROM ({calibrated()})",
    "threshold_resolve": f"SELECT w.representation, CAST(coalesce(c.percent / 100e0, 0.75e0) AS DOUBLE) AS threshold, CASE WHEN c.percent IS NULL THEN 'fallback' ELSE 'calibrated' END AS source FROM (SELECT unnest(['half', 'whole', 'vector', 'other']) AS representation) w LEFT JOIN (SELECT * FROM ({calibrated()}) WHERE status = 'within_budget') c USING (representation)",
    "cluster_metrics": ctes(PRINTS, leaders("sz", "75"), CLUSTERS) + f"SELECT {CLUSTER_COLS} FROM cr",
    "confusion": ctes(PREDICTED) + "SELECT actual, predicted, n FROM conf",
    "class_report": ctes(PREDICTED) + f"SELECT label, {six('precision', 'recall', 'f1')}, support FROM rep",
    "macro_report": ctes(PREDICTED) + f"SELECT round({ratio('sum(recall * support)', 'sum(support)')}, 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round({ratio('sum(precision * support)', 'sum(support)')}, 6) AS weighted_precision, round({ratio('sum(f1 * support)', 'sum(support)')}, 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM rep",
    "verdict_scopes": ctes(SCOPES) + f"SELECT representation, scope, round({ratio('sum(recall * support)', 'sum(support)')}, 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round({ratio('sum(precision * support)', 'sum(support)')}, 6) AS weighted_precision, round({ratio('sum(f1 * support)', 'sum(support)')}, 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM sf GROUP BY representation, scope",
    "ovr_auc": ctes(OVR) + f"SELECT label, round(auroc, 6) AS auroc FROM {auroc('ovr', 'label')}",
    "ovr_ap": ctes(OVR) + f"SELECT label, round(ap, 6) AS ap FROM {ap('ovr', 'label')}",
    "online_reason_counts": f"SELECT 'g' || CAST(conv_id // 16 AS VARCHAR) AS learner, role AS label, CASE WHEN len({toks('text')}) = 0 THEN 'empty' WHEN role = 'system' THEN 'no_reward' ELSE 'applied' END AS reason, count(*) AS n FROM conversations GROUP BY ALL",
    "user_sessions": "WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, sum(CASE WHEN t - prev <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM e)) SELECT user_id, min(t) AS start, max(t) + 1800000000 AS \"end\", count(*) AS n FROM g GROUP BY user_id, s",
    "graph_adjacency": ctes(GRAPH) + "SELECT src, dst, w FROM ge",
    "graph_transition": ctes(GRAPH) + "SELECT src, dst, round(p, 6) AS p FROM tr",
    "graph_summary": ctes(GRAPH) + "SELECT count(*) AS pairs, CAST(sum(w) AS BIGINT) AS total, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM ge",
    "edge_endpoint_check": ctes(GRAPH) + "SELECT node FROM (SELECT src AS node FROM ge UNION SELECT dst FROM ge) WHERE node NOT IN (SELECT node FROM nodes WHERE class <> 'Brand#2')",
    "node_attributes": ctes(GRAPH) + "SELECT node, class, count(dst) AS targets, CAST(coalesce(sum(w), 0) AS BIGINT) AS weight FROM nodes LEFT JOIN ge ON src = node GROUP BY ALL",
    "node_lookup": ctes(GRAPH) + "SELECT node, class FROM nodes WHERE node = 17",
    "diffusion_1": ctes(GRAPH, diffused(1)) + "SELECT node, round(a, 6) AS a FROM s1",
    "diffusion_3": ctes(GRAPH, diffused(3)) + "SELECT node, round(a, 6) AS a FROM s3",
    "pulse_frame": ctes(GRAPH, diffused(3)) + "SELECT count(*) FILTER (a > 1e-8) AS active, round(sum(a), 6) AS mass, round(max(a), 6) AS peak FROM s3",
    "pulse_top": ctes(GRAPH, diffused(3)) + "SELECT node, round(a, 6) AS a FROM s3 WHERE round(a, 6) > 1e-8 ORDER BY 2 DESC, node LIMIT 8",
    "mass_decay": ctes(GRAPH, diffused(3)) + " UNION ALL ".join(f"SELECT {i} AS step, round(sum(a), 6) AS mass FROM s{i}" for i in range(4)),
    "memory_append": ctes(DOCS) + "SELECT split, CASE WHEN split <> 'test' THEN verdict END AS verdict, count(*) AS n FROM docs GROUP BY ALL",
    "feedback_current": ctes(DOCS, FEEDBACK) + "SELECT docs.id, coalesce(arg_max(fb.verdict, fb.seq), docs.verdict) AS verdict FROM docs LEFT JOIN fb ON fb.id = docs.id GROUP BY docs.id, docs.verdict",
    "feedback_audit": ctes(DOCS, FEEDBACK) + "SELECT seq, fb.id, coalesce(lag(fb.verdict) OVER (PARTITION BY fb.id ORDER BY seq), docs.verdict) AS previous, fb.verdict FROM fb JOIN docs ON docs.id = fb.id",
    "trace_pn": ctes(VECTORS) + "SELECT id, pn, v FROM pnv WHERE id = 17",
    "trace_edges": ctes(PRINTS) + "SELECT pnv.id, pnv.pn, ed.kc, v FROM pnv JOIN ed ON ed.pn = pnv.pn JOIN fp ON fp.id = pnv.id AND fp.kc = ed.kc WHERE pnv.id = 17",
    "inspect": ctes(NOVEL, knn("split = 'test'", KNOWN.format("train"), 5)) + "SELECT sz.id, CAST(sz.n AS INTEGER) AS n_active, string_agg(CAST(ref AS VARCHAR) || ':' || printf('%.6f', similarity), ',' ORDER BY rank) AS matches, round(1 - max(similarity), 6) AS novelty, (1 - max(similarity)) > max(t) AS is_novel FROM nn JOIN sz ON sz.id = query JOIN lim ON true GROUP BY sz.id, sz.n",
    "seed_summary": ctes(PRINTS) + "SELECT family, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, count(*) AS n FROM sz GROUP BY family",
}
