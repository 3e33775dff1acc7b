"""Queries over documents, pages and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import contamination as N
from ..operators import dedup as D
from ..operators import lengths as L
from ..operators import pii as X
from ..operators import similar as M
from ..operators import splits as S
from ..operators import trace as TR
from ..operators.graph import erase, stored
from .base import literal, sql_grams, sql_hash, sql_index, sql_words, table
from .catalog import add

STEP_NAMES = [n for n, _ in T.STEPS]


def _index(spark, sf):
    return D.index(table(spark, sf, "documents"), "doc_id", "source", "lang")


def _keys(s, d):
    """The index without texts: its narrow rows are read twice, so they are kept rather than made twice."""
    return _index(s, d).drop("text", "transforms").persist()


SQL_INDEX = f"WITH i AS (SELECT source AS source_id, doc_id AS record_id, lang AS content_type, c9 AS text, sha256(c9) AS sha FROM ({sql_index('documents', 'text', 'doc_id, source, lang')}))"
SQL_EXACT = SQL_INDEX + """,
g AS (SELECT content_type, sha, count(*) AS n, min({'s': source_id, 'r': record_id}) AS m FROM i WHERE text <> '' GROUP BY ALL HAVING count(*) > 1),
e AS (SELECT i.*, n, m.r AS rep, CASE WHEN n IS NOT NULL THEN 'exact:' || i.content_type || ':' || substr(i.sha, 1, 16) END AS cluster_id FROM i LEFT JOIN g USING (content_type, sha))"""

# --- index and exact duplicates
add("exact_dups", lambda s, d: D.exact(_keys(s, d)).select("source_id", "record_id", "content_type", "cluster_id", "cluster_size", F.col("representative.record_id").alias("representative_id"), F.coalesce(F.col("representative.record_id") == F.col("record_id"), F.lit(True)).alias("keep")),
    SQL_EXACT + " SELECT source_id, record_id, content_type, cluster_id, n AS cluster_size, rep AS representative_id, coalesce(rep = record_id, true) AS keep FROM e")


def _exact_summary(s, d):
    e = D.exact(_keys(s, d))
    drop = F.count_if(F.col("cluster_size").isNotNull() & (F.col("representative.record_id") != F.col("record_id")))
    return e.groupBy("source_id").agg(F.count("*").alias("records"), F.count("cluster_size").alias("clustered"), drop.alias("marked"), (drop / F.count("*")).alias("rate"))


add("exact_summary", _exact_summary, SQL_EXACT + " SELECT source_id, count(*) AS records, count(n) AS clustered, count_if(n IS NOT NULL AND rep <> record_id) AS marked, count_if(n IS NOT NULL AND rep <> record_id) / count(*) AS rate FROM e GROUP BY ALL")
add("stage_cube", lambda s, d: D.exact(_keys(s, d)).cube("source_id", "content_type").agg(F.count("*").alias("records"), F.count("cluster_id").alias("clustered")),
    SQL_EXACT + " SELECT source_id, content_type, count(*) AS records, count(cluster_id) AS clustered FROM e GROUP BY CUBE (source_id, content_type)")

NOISE = "concat(text, ' ', chr(9), chr(13), chr(10), chr(10), chr(10), chr(10), 'x', chr(160), 'y', chr(8203), chr(7), '  z ')"
NOISE_SPARK = NOISE.replace("chr(160)", "decode(unhex('C2A0'), 'UTF-8')").replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')")


def _noise(s, d):
    x = T.canonical(table(s, d, "documents").withColumn("noisy", F.expr(NOISE_SPARK)), "noisy", "clean")
    return x.select("doc_id", F.sha2("clean", 256).alias("sha"), F.length("clean").cast("long").alias("n"), F.array_join("transforms", ",").alias("transforms"))


_names = " || ".join(f"CASE WHEN c{i} <> c{i + 1} THEN '{n},' ELSE '' END" for i, n in enumerate(STEP_NAMES))
add("canonicalize_noise", _noise, f"SELECT doc_id, sha256(c9) AS sha, length(c9) AS n, rtrim({_names}, ',') AS transforms FROM ({sql_index('documents', NOISE, 'doc_id')})")
add("transform_counts", lambda s, d: _noise(s, d).select(F.explode(F.split("transforms", ",")).alias("transform")).groupBy("transform").agg(F.count("*").alias("n")),
    f"SELECT transform, count(*) AS n FROM (SELECT unnest(string_split(rtrim({_names}, ','), ',')) AS transform FROM ({sql_index('documents', NOISE, 'doc_id')})) GROUP BY ALL")

# --- digests, hashes, samples, splits
add("records_digest_by_source", lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), H.records_digest(F.sha2("text", 256)).alias("digest")),
    "SELECT source, count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS digest FROM documents GROUP BY ALL")
add("id_set_digest", lambda s, d: table(s, d, "documents").groupBy("lang").agg(H.id_set_digest(F.col("doc_id").cast("string")).alias("digest")),
    "SELECT lang, sha256(string_agg(DISTINCT CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY ALL")
add("checkpoint_digest", lambda s, d: table(s, d, "pages").groupBy(F.substring_index("url", ":", 1).alias("scheme")).agg(H.paths_digest(F.col("url"), F.sha2("html", 256)).alias("digest")),
    "SELECT split_part(url, ':', 1) AS scheme, sha256(string_agg(url || ' ' || sha256(html), chr(10) ORDER BY url || ' ' || sha256(html))) AS digest FROM pages GROUP BY ALL")
add("stable_bucket", lambda s, d: table(s, d, "documents").select("doc_id", H.stable_int(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 1 << 62).alias("h"), H.stable_int(F.col("doc_id").cast("string"), 3).alias("b")),
    f"SELECT doc_id, {sql_hash(chr(39) + 'seed' + chr(39) + ' || doc_id', 1 << 62)} AS h, {sql_hash('CAST(doc_id AS VARCHAR)', 3)} AS b FROM documents")
add("hash_sample_n", lambda s, d: S.hash_sample(table(s, d, "documents"), "doc_id", 100, "s1:").select("doc_id", "lang"),
    f"SELECT doc_id, lang FROM documents ORDER BY {sql_hash(chr(39) + 's1:' + chr(39) + ' || doc_id', 1 << 62)}, doc_id LIMIT 100")
add("hash_sample_by_stratum", lambda s, d: S.hash_sample(table(s, d, "documents"), "doc_id", 5, "s2:", ["source"]).select("source", "doc_id"),
    f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {sql_hash(chr(39) + 's2:' + chr(39) + ' || doc_id', 1 << 62)}, doc_id) <= 5")


def _split(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return S.temporal_split(o, "o_orderkey", "day", F.col("o_orderstatus") != "P", "2000-01-01", ("1997", "1998"), "t:", 500)


SQL_SPLIT = f"""WITH o AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
p AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN day IS NULL THEN 'no_date' WHEN day >= '2000-01-01' THEN 'post' WHEN substr(day, 1, 4) IN ('1997', '1998') THEN 'pre' ELSE 'other' END AS period FROM o),
n AS (SELECT least(count_if(period = 'post'), count_if(period = 'pre'), 500) AS n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY {sql_hash(chr(39) + 't:' + chr(39) + ' || o_orderkey', 1 << 62)}, o_orderkey) AS k FROM p),
sp AS (SELECT o_orderkey, period, CASE WHEN period IN ('post', 'pre') AND k <= (SELECT n FROM n) THEN 'eval_' || period WHEN period IN ('excluded', 'no_date') THEN 'excluded' WHEN period = 'post' THEN 'unused' ELSE 'train' END AS split FROM r)"""
add("orders_temporal_split", lambda s, d: _split(s, d).select("o_orderkey", "period", "split"), SQL_SPLIT + " SELECT * FROM sp")
add("split_counts", lambda s, d: _split(s, d).groupBy("period", "split").agg(F.count("*").alias("n")), SQL_SPLIT + " SELECT period, split, count(*) AS n FROM sp GROUP BY ALL")
add("split_integrity", lambda s, d: S.integrity(_split(s, d), "o_orderkey").agg(F.count("*").alias("broken")), SQL_SPLIT + " SELECT count(*) AS broken FROM (SELECT o_orderkey FROM sp GROUP BY ALL HAVING count(DISTINCT split) > 1)")
add("stratified_quota", lambda s, d: S.quotas(table(s, d, "documents").groupBy("source").count(), "source", 333).select("source", F.col("count").alias("n"), "quota"),
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY ALL),
q AS (SELECT *, CAST(round_even(333 * n / (SELECT sum(n) FROM c), 0) AS BIGINT) AS q, row_number() OVER (ORDER BY source DESC) AS last FROM c)
SELECT source, n, CASE WHEN last = 1 THEN CAST(333 - (SELECT sum(q) FROM q WHERE last > 1) AS BIGINT) ELSE q END AS quota FROM q""")
add("token_budget_prefix", lambda s, d: S.budget_prefix(table(s, d, "documents"), "doc_id", "n_chars", 100_000, "b:", ["lang"]).select("lang", "doc_id", "running"),
    f"""SELECT lang, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(n_chars) OVER w AS running, row_number() OVER w AS k FROM documents
WINDOW w AS (PARTITION BY lang ORDER BY {sql_hash(chr(39) + 'b:' + chr(39) + ' || doc_id', 1 << 62)}, doc_id ROWS UNBOUNDED PRECEDING)) WHERE running <= 100000 OR k = 1""")


def _subset(s, d):
    docs = table(s, d, "documents").select("doc_id")
    big, small = S.hash_sample(docs, "doc_id", 200, "e:"), S.hash_sample(docs, "doc_id", 50, "e:")
    ids = lambda x: H.id_set_digest(x.cast("string"))
    return small.agg(ids(F.col("doc_id")).alias("small")).crossJoin(big.intersect(small).agg(ids(F.col("doc_id")).alias("common"))).crossJoin(small.exceptAll(big).agg(F.count("*").alias("outside")))  # three one-row aggregates


_h = sql_hash("'e:' || doc_id", 1 << 62)
_dig = "sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)))"
add("equal_budget_subset_proof", _subset, f"WITH b AS (SELECT doc_id FROM documents ORDER BY {_h}, doc_id LIMIT 200), a AS (SELECT doc_id FROM documents ORDER BY {_h}, doc_id LIMIT 50) SELECT (SELECT {_dig} FROM a) AS small, (SELECT {_dig} FROM a WHERE doc_id IN (FROM b)) AS common, (SELECT count(*) FROM a WHERE doc_id NOT IN (FROM b)) AS outside")
TEMPLATES = ["Classify: {input}", "Read this text.\n{input}\nAnswer as {{\"id\": ...}}", "{input}\n---\nWhich one?"]
_tpl = "CASE {h} WHEN 0 THEN 'Classify: ' || text WHEN 1 THEN 'Read this text.' || chr(10) || text || chr(10) || 'Answer as {{\"id\": ...}}' ELSE text || chr(10) || '---' || chr(10) || 'Which one?' END".replace("{{", "{").replace("}}", "}").replace("{h}", sql_hash("'tpl:' || doc_id", 3))
add("template_choice", lambda s, d: table(s, d, "documents").select("doc_id", H.template_of(F.col("doc_id").cast("string"), TEMPLATES, F.col("text")).alias("prompt")), f"SELECT doc_id, {_tpl} AS prompt FROM documents")


# --- conversations and pages
def _replies(s, d):
    c = table(s, d, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prole"), F.col("text").alias("prompt"))
    j = c.where("role = 'assistant'").join(p, ["conv_id", "turn"], "left")
    reason = F.when(~F.col("prole").eqNullSafe("user"), "no_prompter_parent").when((F.length("prompt") < 8) | (F.length("text") < 8), "too_short")
    return j.withColumn("reason", reason)


SQL_REPLIES = """WITH j AS (SELECT a.conv_id, a.turn, a.text AS response, p.text AS prompt, CASE WHEN p.role IS DISTINCT FROM 'user' THEN 'no_prompter_parent' WHEN length(p.text) < 8 OR length(a.text) < 8 THEN 'too_short' END AS reason
FROM conversations a LEFT JOIN conversations p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 WHERE a.role = 'assistant')"""
add("reply_pairs", lambda s, d: _replies(s, d).where("reason is null").select("conv_id", "turn", "prompt", F.col("text").alias("response")), SQL_REPLIES + " SELECT conv_id, turn, prompt, response FROM j WHERE reason IS NULL")
add("reply_skip_reasons", lambda s, d: _replies(s, d).groupBy(F.coalesce("reason", F.lit("pairs")).alias("reason")).agg(F.count("*").alias("n")), SQL_REPLIES + " SELECT coalesce(reason, 'pairs') AS reason, count(*) AS n FROM j GROUP BY ALL")
add("html_text_extract", lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.sha2(F.btrim(F.regexp_replace(F.regexp_replace("html", "(?is)<(?:script|style).*?</(?:script|style)>|<[^>]*>", " "), "[ \t\r\n]+", " "), F.lit(" ")), 256).alias("sha")),
    "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, sha256(trim(regexp_replace(regexp_replace(html, '(?is)<(?:script|style).*?</(?:script|style)>|<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS sha FROM pages")

# --- secrets and personal data
_found = " UNION ALL ".join(f"SELECT doc_id, source, '{t}' AS type, '{c}' AS category, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS value FROM documents" for t, c, p in X.TYPES)
add("pii_findings_by_type", lambda s, d: X.counts(X.findings(table(s, d, "documents"), ["doc_id", "source"]), ["category", "type"]), f"SELECT category, type, count(*) AS findings, count(DISTINCT sha256(value)) AS unique_values FROM ({_found}) GROUP BY ALL")
add("pii_by_source", lambda s, d: X.findings(table(s, d, "documents"), ["doc_id", "source"]).groupBy("source").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("records")), f"SELECT source, count(*) AS findings, count(DISTINCT doc_id) AS records FROM ({_found}) GROUP BY ALL")
add("redact_texts", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("sha"), F.length(X.redact(F.col("text"))).cast("long").alias("n")))
_red = "text"
for _t, _c, _p in X.TYPES:
    if _c == "secret":
        _red = f"regexp_replace({_red}, '{_p.replace(chr(39), chr(39) * 2)}', '{X.MARKER}', 'g')"
add("redact_secrets", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(reduce(lambda c, t: F.regexp_replace(c, t[2], X.MARKER) if t[1] == "secret" else c, X.TYPES, F.col("text")), 256).alias("sha")), f"SELECT doc_id, sha256({_red}) AS sha FROM documents")


# --- near duplicates
def _shingled(s, d):
    return _index(s, d).select(F.col("record_id").alias("key"), "content_type", T.shingles(T.words(F.col("text"))).alias("s"))


def _hashed(s, d):
    x = _shingled(s, d).where(F.size("s") > 0).withColumn("h", D.shingle_hashes(F.col("s")))
    return D.with_signature(x, "h")


def _sets(s, d):
    return D.shingle_sets(_index(s, d).withColumnRenamed("record_id", "key"), "key", "text", "content_type")  # only sets of one type meet


def _roots(s, d):
    return D.similar_roots(_sets(s, d).where("content_type is not null"), "key", "s", 0.75)


SQL_SHINGLES = SQL_INDEX + f", w AS (SELECT record_id AS key, content_type, {sql_words('text')} AS w FROM i), sh AS (SELECT key, content_type, list_distinct({sql_grams('w', 5, 8)}) AS s FROM w)"
SQL_PAIRS = SQL_SHINGLES + """, inv AS (SELECT key, content_type, len(s) AS n, unnest(s) AS g FROM sh), c AS (SELECT x.key AS a, y.key AS b, count(*) AS m, any_value(x.n) AS na, any_value(y.n) AS nb FROM inv x JOIN inv y ON x.g = y.g AND x.content_type = y.content_type AND x.key < y.key GROUP BY ALL),
p AS (SELECT a, b, m / (na + nb - m) AS jaccard FROM c)"""
add("shingle_counts", lambda s, d: _shingled(s, d).select("key", F.size("s").cast("long").alias("n")), SQL_SHINGLES + " SELECT key, len(s) AS n FROM sh")
add("near_clusters", lambda s, d: _roots(s, d)[0],
    SQL_PAIRS.replace("WITH i AS", "WITH RECURSIVE i AS") + """, e AS (SELECT a, b FROM p WHERE jaccard >= 0.75 UNION SELECT b, a FROM p WHERE jaccard >= 0.75),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), m AS (SELECT node, min(reach) AS root FROM r GROUP BY ALL) SELECT node, root FROM m WHERE node <> root""")


def _near(s, d):
    roots, p = _roots(s, d)
    return D.near_decisions(table(s, d, "documents").select(F.col("doc_id").alias("key")), roots, p, 0.75)


add("near_decisions", lambda s, d: _near(s, d).select("key", "representative", "cluster_id", "role", "similarity"))
SQL_ROOTS = SQL_EXACT.replace("WITH i AS", "WITH RECURSIVE i AS").replace(", e AS", ", ex AS").replace("\ne AS", "\nex AS") + SQL_PAIRS[len(SQL_INDEX):] + """, e AS (SELECT a, b FROM p WHERE jaccard >= 0.75 UNION SELECT b, a FROM p WHERE jaccard >= 0.75),
r(node, reach) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), m AS (SELECT node, min(reach) AS root FROM r GROUP BY ALL)"""
add("merged_decisions", lambda s, d: D.merged(_keys(s, d), _near(s, d)).select("source_id", "record_id", "content_type", "dedup_stage", "representative_id", "dedup_keep"),
    SQL_ROOTS + """ SELECT source_id, record_id, content_type, CASE WHEN n IS NOT NULL THEN 'exact' WHEN root IS NOT NULL THEN 'near' ELSE 'unique' END AS dedup_stage,
coalesce(rep, root, record_id) AS representative_id, coalesce(rep, root, record_id) = record_id AS dedup_keep FROM ex LEFT JOIN m ON m.node = record_id""")


def _sweep(s, d):
    members, pairs = M.similar(_sets(s, d), "key", "s", 0.6)
    sizes = table(s, d, "documents").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("x"))
    return D.swept(M.weighed(members, pairs, sizes, 20), [0.6, 0.7, 0.75, 0.8, 0.9])


add("threshold_sweep", _sweep, SQL_SHINGLES + """, u AS (SELECT *, min(key) OVER (PARTITION BY content_type, list_sort(s)) AS rep FROM sh WHERE len(s) > 0), inv AS (SELECT key, content_type, len(s) AS n, unnest(s) AS g FROM u),
c AS (SELECT x.key AS a, y.key AS b, count(*) AS m, any_value(x.n) AS na, any_value(y.n) AS nb FROM inv x JOIN inv y ON x.g = y.g AND x.content_type = y.content_type AND x.key < y.key GROUP BY ALL), p AS (SELECT a, b, m / (na + nb - m) AS jaccard FROM c UNION ALL SELECT x.key, y.key, 1.0 FROM u x JOIN u y ON x.rep = y.rep AND x.key < y.key WHERE x.content_type IS NULL),
l AS (SELECT p.*, abs(x.n_chars - y.n_chars) <= 20 AS y FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE jaccard >= 0.6),
t AS (SELECT unnest([0.6, 0.7, 0.75, 0.8, 0.9])::DOUBLE AS threshold), g AS (SELECT threshold, count_if(jaccard >= threshold AND y) AS tp, count_if(jaccard >= threshold AND NOT y) AS fp, count_if(jaccard < threshold AND y) AS fn FROM l, t GROUP BY ALL)
SELECT threshold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM g""")
add("minhash_signatures", lambda s, d: _hashed(s, d).select("key", F.sha2(F.array_join(F.transform("signature", lambda x: x.cast("string")), ","), 256).alias("sha")))


def _lsh(s, d):
    sets = lambda: M.hashed(_shingled(s, d).where("content_type is not null"), "key", "s")
    words = F.sort_array(F.transform("s", lambda g: F.xxhash64(g)))
    x = _hashed(s, d).where("key is not null and content_type is not null").withColumn("w", words)
    x = stored(x.select(F.col("key").alias("k"), F.struct("content_type", M.digest("w").alias("h")).alias("h"), F.size("s").alias("n"), "content_type", D.buckets(*D.bands_rows(0.72)).alias("bands")))
    members = M.classes(x.select("k", "h", "n"))
    banded = M.leads(x, members).select(F.col("k").alias("key"), "content_type", F.posexplode("bands").alias("band", "bucket"))
    p = stored(D.lsh_pairs(banded.withColumn("bucket", F.xxhash64("bucket", "content_type")).drop("content_type")))
    erase(x)
    return M.expanded(members, M.compared(p, sets()))


add("lsh_pairs", _lsh)

# --- contamination
_docs = lambda s, d: table(s, d, "documents").select("doc_id", "text")
_bench = lambda s, d: table(s, d, "benchmark")
add("ngram_index_size", lambda s, d: N.gram_index(_docs(s, d), "text", 13).agg(F.count("*").alias("n")), f"SELECT count(DISTINCT g) AS n FROM (SELECT unnest({sql_grams('w', 13)}) AS g FROM (SELECT {sql_words('text')} AS w FROM documents))")


def _sql_cover(n: int) -> str:
    return f"""t{n} AS (SELECT DISTINCT unnest({sql_grams('w', n)}) AS g FROM (SELECT {sql_words('text')} AS w FROM documents)),
b{n} AS (SELECT item_id, unnest({sql_grams('w', n)}) AS g, unnest(range(1, len(w) - {n} + 2)) AS pos FROM (SELECT item_id, {sql_words('text')} AS w FROM benchmark) WHERE len(w) >= {n}),
k{n} AS (SELECT item_id, count(*) AS n_grams, count(t{n}.g) AS n_hit, arg_min(b{n}.g, pos) FILTER (t{n}.g IS NOT NULL) AS first_hit FROM b{n} LEFT JOIN t{n} USING (g) GROUP BY ALL),
c{n} AS (SELECT item_id, coalesce(n_grams, 0) AS n_grams, coalesce(n_hit, 0) AS n_hit, coalesce(n_hit / n_grams, 0.0) AS coverage, first_hit FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN k{n} USING (item_id))"""


for _n in (8, 13):
    add(f"ngram_coverage_{_n}", lambda s, d, n=_n: N.coverage(_bench(s, d), _docs(s, d), "item_id", "text", n), f"WITH {_sql_cover(_n)} SELECT * FROM c{_n}")
SQL_NEAREST = f"""ws AS (SELECT doc_id, {sql_words('text')} AS w FROM documents), sd AS (SELECT doc_id, list_distinct({sql_grams('w', 5, 8)}) AS s FROM ws),
wb AS (SELECT item_id, {sql_words('text')} AS w FROM benchmark), sb AS (SELECT item_id, list_distinct({sql_grams('w', 5, 8)}) AS s FROM wb),
id AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sd), ib AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM sb),
jc AS (SELECT item_id, doc_id, count(*) / (any_value(ib.n) + any_value(id.n) - count(*)) AS j FROM ib JOIN id USING (g) GROUP BY item_id, doc_id),
nn AS (SELECT item_id, doc_id AS nearest, j AS jaccard FROM jc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) = 1)"""
_nearest = lambda s, d: N.nearest(_bench(s, d), _docs(s, d), "item_id", "doc_id", "text")
add("nearest_train_doc", _nearest, f"WITH {SQL_NEAREST} SELECT item_id, nearest, coalesce(jaccard, 0.0) AS jaccard FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN nn USING (item_id)")


def _verdicts(s, d):
    c = {n: N.coverage(_bench(s, d), _docs(s, d), "item_id", "text", n).select("item_id", F.col("coverage").alias(f"coverage_{n}")) for n in (8, 13)}
    j = _nearest(s, d).join(c[8], "item_id").join(c[13], "item_id")
    return j.select("item_id", N.verdict(F.col("jaccard")).alias("verdict"), (F.col("coverage_13") > 0).alias("any_13"), (F.col("coverage_8") > 0).alias("any_8"), (F.col("coverage_13") > 0.5).alias("over_half"))


add("contamination_verdicts", _verdicts, f"WITH {_sql_cover(8)}, {_sql_cover(13)}, {SQL_NEAREST} SELECT item_id, CASE WHEN coalesce(jaccard, 0) >= 0.75 THEN 'removed' ELSE 'kept' END AS verdict, c13.coverage > 0 AS any_13, c8.coverage > 0 AS any_8, c13.coverage > 0.5 AS over_half FROM c8 JOIN c13 USING (item_id) LEFT JOIN nn USING (item_id)")


def _rank_sql(src: str, v: str, q: float, by: str = "") -> str:
    return f"(SELECT {v} FROM (SELECT {v}, row_number() OVER (ORDER BY {v}) AS k_, count(*) OVER () AS c_ FROM {src}) WHERE k_ = round_even({q} * (c_ - 1), 0) + 1)"


def _quart(s, d):
    x = table(s, d, "documents").select("doc_id", "n_chars")
    q = N.nearest_rank(x, "n_chars", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return x.crossJoin(F.broadcast(q)).select("doc_id", N.quartile(F.col("n_chars"), F.col("q25"), F.col("q50"), F.col("q75")).alias("quartile"))  # q: one row


add("length_quartiles", _quart, f"WITH q AS (SELECT {_rank_sql('documents', 'n_chars', 0.25)} AS a, {_rank_sql('documents', 'n_chars', 0.5)} AS b, {_rank_sql('documents', 'n_chars', 0.75)} AS c) SELECT doc_id, CASE WHEN n_chars <= a THEN 1 WHEN n_chars <= b THEN 2 WHEN n_chars <= c THEN 3 ELSE 4 END AS quartile FROM documents, q")
add("coverage_hist", lambda s, d: N.coverage(_bench(s, d), _docs(s, d), "item_id", "text", 8).groupBy(N.histogram(F.col("coverage"), [0, 0.25, 0.5, 0.75, 1]).alias("bin")).agg(F.count("*").alias("n")),
    f"WITH {_sql_cover(8)} SELECT CASE WHEN coverage < 0.25 THEN '[0,0.25)' WHEN coverage < 0.5 THEN '[0.25,0.5)' WHEN coverage < 0.75 THEN '[0.5,0.75)' ELSE '[0.75,1)' END AS bin, count(*) AS n FROM c8 GROUP BY ALL")
add("source_tvd", lambda s, d: N.tvd(table(s, d, "documents").where("lang = 'en'"), table(s, d, "documents").where("lang <> 'en'"), "source"),
    """WITH x AS (SELECT source, count_if(lang = 'en') AS x, count_if(lang <> 'en') AS y FROM documents GROUP BY ALL), t AS (SELECT greatest(sum(x), 1) AS sx, greatest(sum(y), 1) AS sy FROM x)
SELECT CAST(sum(abs(x * sy - y * sx)) AS DOUBLE) / CAST(2 * any_value(sx) * any_value(sy) AS DOUBLE) AS tvd FROM x, t""")

# --- lengths and packing
_len = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_lens = lambda s, d: table(s, d, "documents").select("doc_id", "lang", "source", F.size(T.words(F.col("text"))).cast("long").alias("n"))
add("greedy_pack", lambda s, d: L.greedy_pack(_lens(s, d), ["lang"], "doc_id", "n").select("lang", "examples", "sequences", "tokens", "truncated", "padding"),
    f"""WITH RECURSIVE l AS (SELECT lang, {_len} AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
f(lang, k, bins, cur, used, cut) AS (SELECT DISTINCT lang, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM l
UNION ALL SELECT l.lang, l.k, bins + (cur + least(n, 4096) > 4096)::BIGINT, CASE WHEN cur + least(n, 4096) > 4096 THEN least(n, 4096) ELSE cur + least(n, 4096) END, used + least(n, 4096), cut + (n > 4096)::BIGINT FROM f JOIN l ON l.lang = f.lang AND l.k = f.k + 1)
SELECT lang, max(k) AS examples, arg_max(bins + (cur > 0)::BIGINT, k) AS sequences, arg_max(used, k) AS tokens, arg_max(cut, k) AS truncated, 1.0 - arg_max(used, k) / arg_max((bins + (cur > 0)::BIGINT) * 4096, k) AS padding FROM f GROUP BY ALL""")
add("length_profile", lambda s, d: L.profile(_lens(s, d), ["lang"], "n"),
    f"""WITH l AS (SELECT lang, {_len} AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n) AS k, count(*) OVER (PARTITION BY lang) AS c FROM l)
SELECT lang, min(n) FILTER (k = round_even(0.5 * (c - 1), 0) + 1) AS p50, min(n) FILTER (k = round_even(0.9 * (c - 1), 0) + 1) AS p90, min(n) FILTER (k = round_even(0.99 * (c - 1), 0) + 1) AS p99, count(*) AS n, max(n) AS longest,
count_if(n > 512) / count(*) AS over_512, count_if(n > 1024) / count(*) AS over_1024, count_if(n > 2048) / count(*) AS over_2048, count_if(n > 4096) / count(*) AS over_4096 FROM r GROUP BY ALL""")
add("strata_zero_low_high", lambda s, d: L.strata(N.coverage(_bench(s, d), _docs(s, d), "item_id", "text", 8), "coverage").select("item_id", "stratum"),
    f"WITH {_sql_cover(8)}, pos AS (SELECT coverage FROM c8 WHERE coverage > 0), m AS (SELECT {_rank_sql('pos', 'coverage', 0.5)} AS m) SELECT item_id, CASE WHEN coverage = 0 THEN 'zero' WHEN coverage <= m THEN 'low' ELSE 'high' END AS stratum FROM c8, m")


def _terciles(s, d):
    x = L.terciles(_lens(s, d), "n")
    return x.groupBy("lang", "tercile").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))


add("lang_x_tercile", _terciles, f"WITH l AS (SELECT lang, {_len} AS n FROM documents), q AS (SELECT {_rank_sql('l', 'n', 1 / 3)} AS a, {_rank_sql('l', 'n', 2 / 3)} AS b) SELECT lang, CASE WHEN n <= a THEN 1 WHEN n <= b THEN 2 ELSE 3 END AS tercile, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM l, q GROUP BY ALL")
add("output_length_tail", lambda s, d: L.tail(_lens(s, d), ["lang"], "n"),
    f"""WITH l AS (SELECT lang, {_len} AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY lang) AS c FROM l)
SELECT lang, max(n) FILTER (k = c // 2) AS median, max(n) FILTER (k = least(c - 1, c * 99 // 100)) AS p99, CAST(sum(n) FILTER (k >= c * 99 // 100) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS top_share FROM r GROUP BY ALL""")
add("equal_steps", lambda s, d: L.schedule(L.greedy_pack(_lens(s, d), ["lang"], "doc_id", "n"), ["lang"]).select("lang", "sequences", F.col("steps").cast("long").alias("steps"), F.col("leftover").cast("long").alias("leftover")))
add("corruption_flags", lambda s, d: table(s, d, "documents").select("doc_id", T.bad_char_ratio(F.col("text")).alias("bad_ratio"), T.longest_repeat("text").alias("repeat_words"), F.size(T.words(F.col("text"))).alias("n_words")).select("doc_id", "bad_ratio", "repeat_words", ((F.col("bad_ratio") > 0.02) | ((F.col("n_words") >= 20) & (F.col("repeat_words") > F.greatest(F.lit(8), F.col("n_words") / 2))) | (F.col("n_words") < 1)).alias("corrupted")))
NUMBERS = "('0'), ('3'), ('3.0'), ('2'), ('1'), ('10')"
add("untraceable_numbers", lambda s, d: TR.untraced(table(s, d, "documents"), literal(s, NUMBERS, "literal"), "doc_id", "text", "literal").groupBy("doc_id").agg(F.count("*").alias("n")))
