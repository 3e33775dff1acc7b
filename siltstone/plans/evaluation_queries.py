"""Queries over labels, events, business tables and small literal tables: entities, scoring, statistics, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import lengths as L
from ..operators import lineage as LN
from ..operators import scoring as V
from ..operators import stats as B
from ..operators import trace as TR
from ..sources import readers as RD
from .base import literal, literal_sql, sql_hash, table
from .catalog import add


def add_literal(name: str, rows: str, columns: str, query, sql: str) -> None:
    """A query over a literal table ``t``."""
    add(name, lambda s, d: query(literal(s, rows, columns)), f"WITH t AS {literal_sql(rows, columns)} {sql}")


# --- entities: customers and suppliers of a nation as two sources of one entity
def _sources(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("entity"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), F.array(F.col("c_mktsegment")).alias("labels"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("ordinal"))
    u = table(s, d, "supplier").select(F.col("s_nationkey").alias("entity"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("record_id"), F.array(F.lit("BUILDING")).alias("labels"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("ordinal"))
    return E.paired(E.last_per_entity(c, "entity", "ordinal"), E.last_per_entity(u, "entity", "ordinal"), "entity", ("customer", "supplier"))


def _conflicts(s, d):
    return _sources(s, d).withColumns({"relation": E.set_relation(F.col("left.labels"), F.col("right.labels")), "score_conflict": E.score_conflict(F.col("left.score"), F.col("right.score"))})


SQL_ENTITIES = """WITH c AS (SELECT c_nationkey AS entity, arg_max('c' || c_custkey, c_custkey) AS r, arg_max(c_mktsegment, c_custkey) AS l, arg_max(c_acctbal, c_custkey) AS b FROM customer WHERE c_nationkey IS NOT NULL GROUP BY ALL),
u AS (SELECT s_nationkey AS entity, arg_max('s' || s_suppkey, s_suppkey) AS r, 'BUILDING' AS l, arg_max(s_acctbal, s_suppkey) AS b FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY ALL),
e AS (SELECT coalesce(c.entity, u.entity) AS entity, concat_ws(',', CASE WHEN c.r IS NOT NULL THEN 'customer' END, CASE WHEN u.r IS NOT NULL THEN 'supplier' END) AS sources, concat_ws(',', c.r, u.r) AS record_ids,
CASE WHEN c.r IS NULL OR u.r IS NULL THEN 'present_in_one_source_only' WHEN c.l <> u.l THEN 'disjoint' END AS relation, coalesce(abs(c.b - u.b) > 0.05, false) AS score_conflict, c.r IS NOT NULL AND u.r IS NOT NULL AS multi FROM c FULL JOIN u ON c.entity = u.entity)"""
add("entity_full_outer", lambda s, d: _sources(s, d).select("entity", F.array_join("sources", ",").alias("sources"), F.array_join("record_ids", ",").alias("record_ids")), SQL_ENTITIES + " SELECT entity, sources, record_ids FROM e")
add("entity_conflicts", lambda s, d: _conflicts(s, d).select("entity", "relation", "score_conflict"), SQL_ENTITIES + " SELECT entity, relation, score_conflict FROM e")
add("entity_conflict_counts", lambda s, d: E.conflict_counts(_conflicts(s, d), "relation", "score_conflict"), SQL_ENTITIES + " SELECT count(*) AS entities, count_if(multi) AS multi_source, count_if(NOT multi) AS single_source, count_if(multi AND relation IS NOT NULL) AS set_conflicts, count_if(multi AND score_conflict) AS score_conflicts, count_if(multi AND (relation IS NOT NULL OR score_conflict)) AS with_conflicts FROM e")

LABELS = "('a','PUBLISHED','CWE-1','CWE-1',false),('b','PUBLISHED','CWE-1,CWE-2','CWE-2,CWE-1',false),('c','PUBLISHED','CWE-1,CWE-2','CWE-2',false),('d','PUBLISHED','CWE-1','CWE-2',false),('e','PUBLISHED','CWE-1','',false),('f','PUBLISHED','CWE-1,CWE-3','',false),('g','PUBLISHED','','CWE-5',false),('h','PUBLISHED','','CWE-5,CWE-6',false),('i','PUBLISHED','','',true),('j','PUBLISHED','','',false),('k','REJECTED','CWE-1','CWE-1',false),('l',NULL,'','CWE-9',false)"
_set = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
add_literal("label_buckets", LABELS, "k, state, x, y, p", lambda t: t.select("k", E.resolve_label(F.col("state"), _set("x"), _set("y"), F.col("p")).alias("r")).select("k", "r.bucket", "r.label", "r.relation"),
    """, z AS (SELECT k, state, p, list_sort(list_filter(string_split(x, ','), lambda v: v <> '')) AS a, list_sort(list_filter(string_split(y, ','), lambda v: v <> '')) AS b FROM t)
SELECT k, CASE WHEN state IS DISTINCT FROM 'PUBLISHED' THEN 'rejected' WHEN len(a) > 0 AND len(b) > 0 THEN CASE WHEN a = b THEN CASE WHEN len(a) = 1 THEN 'agreed' ELSE 'multi_cwe' END ELSE 'contested' END WHEN len(a) = 1 THEN 'cna' WHEN len(a) > 1 THEN 'multi_cwe' WHEN len(b) = 1 THEN 'nvd' WHEN len(b) > 1 THEN 'multi_cwe' WHEN p THEN 'placeholder' ELSE 'none' END AS bucket,
CASE WHEN state IS DISTINCT FROM 'PUBLISHED' THEN NULL WHEN a = b AND len(a) = 1 THEN a[1] WHEN len(a) = 1 AND len(b) = 0 THEN a[1] WHEN len(a) = 0 AND len(b) = 1 THEN b[1] END AS label,
CASE WHEN state IS DISTINCT FROM 'PUBLISHED' THEN NULL WHEN len(a) > 0 AND len(b) > 0 THEN CASE WHEN a = b THEN CASE WHEN len(a) = 1 THEN 'equal' ELSE 'equal_multi' END WHEN len(list_intersect(a, b)) > 0 THEN 'partial_overlap' ELSE 'disjoint' END WHEN len(a) = 1 THEN 'cna_only' WHEN len(a) > 1 THEN 'cna_only_multi' WHEN len(b) = 1 THEN 'nvd_only' WHEN len(b) > 1 THEN 'nvd_only_multi' WHEN p THEN 'placeholder_only' END AS relation FROM z""")
GUARD = "('1','c1','representative','near','A','train'),('2','c1','member','near','B','train'),('3','c1','member','near','A','train'),('4','c2','representative','near','A','eval_post'),('5','c2','member','near','B','train'),('6','c3','representative','near',NULL,'train'),('7','c3','member','near','B','train'),('8','c1','member','exact','B','train'),('9','c1','member','near',NULL,'train')"
add_literal("guard_outcomes", GUARD, "k, cluster, role, stage, label, split", lambda t: E.guard(t).groupBy("outcome").agg(F.count("*").alias("n")),
    ", r AS (SELECT cluster, label AS rl, split AS rs FROM t WHERE role = 'representative') SELECT CASE WHEN rl IS NULL THEN 'representative_unlabelled' WHEN label = rl THEN 'same_label' WHEN starts_with(rs, 'eval') THEN 'representative_in_eval' ELSE 'readmitted' END AS outcome, count(*) AS n FROM t LEFT JOIN r USING (cluster) WHERE stage = 'near' AND role = 'member' AND label IS NOT NULL GROUP BY ALL")
add("top_contested", lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment", "o_orderpriority").limit(15),
    "SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 15")


def _excluded(s, d):
    o = table(s, d, "lineitem")
    reason = F.when(F.col("l_quantity") < 5, "too_few").when(F.col("l_discount") > 0.08, "discounted").when(F.col("l_tax") == 0, "untaxed")
    return E.exclusions(o.withColumn("reason", reason), "l_returnflag", "reason")


add("exclusion_matrix", _excluded, "SELECT l_returnflag, reason, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_quantity < 5 THEN 'too_few' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_tax = 0 THEN 'untaxed' END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY l_returnflag, reason")
VERS = "('a','acme','box','1,2','text'),('b','','','','text'),('c','acme','n/a','1','text'),('d','acme','box','','text'),('e','acme','box','1','  ')"
add_literal("extraction_reasons", VERS, "k, vendor, product, versions, descr", lambda t: t.withColumn("aff", F.when(F.col("vendor") != "", F.array(F.struct("vendor", "product", _set("versions").alias("versions"))))).select("k", F.coalesce(E.extraction_reason(F.col("aff"), F.col("descr")), F.lit("target")).alias("reason")),
    "SELECT k, CASE WHEN vendor = '' THEN 'no_product' WHEN lower(product) IN ('', 'n/a') THEN 'vendor_or_product_missing' WHEN versions = '' THEN 'no_versions' WHEN trim(descr) = '' THEN 'empty_description' ELSE 'target' END AS reason FROM t")
DESCR = "('a','de','x','en-US','y'),('b',NULL,'x','en','y'),('c','fr','x','es','y'),('d','en','','de','z'),('e','en','',NULL,'')"
add_literal("description_pick", DESCR, "k, l1, v1, l2, v2", lambda t: t.select("k", E.description(F.array(F.struct(F.col("l1").alias("lang"), F.col("v1").alias("value")), F.struct(F.col("l2").alias("lang"), F.col("v2").alias("value")))).alias("description")),
    "SELECT k, coalesce(CASE WHEN starts_with(coalesce(l1, 'en'), 'en') THEN nullif(v1, '') END, CASE WHEN starts_with(coalesce(l2, 'en'), 'en') THEN nullif(v2, '') END, nullif(v1, ''), nullif(v2, ''), '') AS description FROM t")
TECH = "('T1',1,true,false,'old'),('T1',2,false,false,'new'),('T2',3,false,false,'see [Tool](https://attack.mitre.org/software/S1) and https://attack.mitre.org/x (Citation: A 2020)'),('T3',4,false,true,'x'),('M1',5,false,false,'y'),('T4',6,NULL,NULL,'plain')"
add_literal("technique_table", TECH, "technique_id, ordinal, revoked, deprecated, description", lambda t: E.technique_table(t).withColumns(E.without_links(F.col("description"))).select("technique_id", "clean", "links", "citations"),
    """, f AS (SELECT * FROM t WHERE starts_with(technique_id, 'T') QUALIFY row_number() OVER (PARTITION BY technique_id ORDER BY ordinal) = 1), g AS (SELECT *, regexp_replace(description, '\\[([^\\]]*)\\]\\(https?://attack\\.mitre\\.org[^)]*\\)', '\\1', 'g') AS d1 FROM f WHERE NOT coalesce(revoked, false) AND NOT coalesce(deprecated, false)), h AS (SELECT *, regexp_replace(d1, 'https?://attack\\.mitre\\.org\\S*', '', 'g') AS d2 FROM g)
SELECT technique_id, regexp_replace(d2, '\\(Citation: [^)]*\\)', '', 'g') AS clean, len(regexp_extract_all(description, '\\[([^\\]]*)\\]\\(https?://attack\\.mitre\\.org[^)]*\\)')) + len(regexp_extract_all(d1, 'https?://attack\\.mitre\\.org\\S*')) AS links, len(regexp_extract_all(d2, '\\(Citation: [^)]*\\)')) AS citations FROM h""")
add("snapshot_cutoff", lambda s, d: RD.up_to(table(s, d, "events").withColumn("m", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "m", "2024-01-15T00:00:00Z").groupBy("event_type").agg(F.count("*").alias("n")),
    "SELECT event_type, count(*) AS n FROM events WHERE coalesce(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '') <= '2024-01-15T00:00:00' GROUP BY ALL")
add_literal("weakness_ids", "('CWE-79 and cwe-20, CWE-79'),('none'),('xCWE-1y')", "v", lambda t: t.select("v", F.array_join(T.weakness_ids(F.col("v")), ",").alias("ids")), "SELECT v, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(v, '(?i)CWE-[0-9]+'), lambda x: upper(x)))), ',') AS ids FROM t")

# --- scoring
OUTPUTS = """('a','{"cwe_id": "CWE-79"}','CWE-79'),('b','```json\n{"cwe_id": "cwe-79 "}\n```','CWE-79'),('c','no json','CWE-1'),('d','{"cwe_id": 5}','CWE-5'),('e','{"cwe_id": "CWE-1", "x": 1}','CWE-1'),('f','```\n{"cwe_id": "CWE-2"}','CWE-2')"""


def _scored(t):
    clean = T.unfenced(F.col("o"))
    return t.select("k", V.parse_flags(F.col("o"))["parsed"].alias("parsed"), V.parse_flags(F.col("o"), "cwe_id")["schema_valid"].alias("schema_valid"), V.exact_id(F.try_variant_get(F.try_parse_json(clean), "$.cwe_id", "string"), F.col("y")).alias("correct"))


add("schema_validity", lambda s, d: _scored(literal(s, OUTPUTS.replace("\n", "\\n"), "k, o, y")))
_ms = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


def _vectors(s):
    v = s.range(1).select(F.lit("CVSS:3.1").alias("vector"))
    for m, vs in _ms.items():
        v = v.select(F.explode(F.array(*(F.concat("vector", F.lit(f"/{m}:{x}")) for x in vs))).alias("vector"))
    return v


_case = lambda m, w: "CASE " + " ".join(f"WHEN vector LIKE '%/{m}:{k}%' THEN {v}::DOUBLE" for k, v in w.items()) + " END"
_all = "SELECT 'CVSS:3.1' || " + " || ".join(f"'/{m}:' || {m.lower()}_" for m in _ms) + " AS vector FROM " + ", ".join(f"(SELECT unnest({list(v)}) AS {m.lower()}_)" for m, v in _ms.items())
add("cvss_base_score", lambda s, d: _vectors(s).select("vector", V.cvss31(F.col("vector")).alias("score")),
    f"""WITH v AS ({_all}), w AS (SELECT vector, vector LIKE '%/S:C%' AS ch, {_case('AV', V.AV)} AS av, {_case('AC', V.AC)} AS ac, {_case('PR', V.PR_UNCHANGED)} AS pu, {_case('PR', V.PR_CHANGED)} AS pc, {_case('UI', V.UI)} AS ui, {_case('C', V.CIA)} AS c, {_case('I', V.CIA)} AS i, {_case('A', V.CIA)} AS a FROM v),
x AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM w), y AS (SELECT *, CASE WHEN ch THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS imp, 8.22::DOUBLE * av * ac * CASE WHEN ch THEN pc ELSE pu END * ui AS ex FROM x),
z AS (SELECT *, CAST(round_even(least(CASE WHEN ch THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END * (imp + ex), 10.0::DOUBLE) * 100000, 0) AS BIGINT) AS n FROM y) SELECT vector, CASE WHEN imp <= 0 THEN 0.0::DOUBLE WHEN n % 10000 = 0 THEN n / 100000.0::DOUBLE ELSE (n // 10000 + 1) / 10.0::DOUBLE END AS score FROM z""")
PRF = "('a','1.0,2.0','1.0,2.0'),('b','1.0','1.0,3.0'),('c','','4'),('d',' X ','x'),('e','9','')"
add_literal("extraction_prf", PRF, "k, p, y", lambda t: (lambda v: v.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))(t.select(*(c.cast("long").alias(n) for n, c in V.extraction(F.split("p", ","), F.split("y", ",")).items()))).withColumns(V.prf(F.col("tp"), F.col("fp"), F.col("fn"))),
    """, s AS (SELECT list_distinct(list_filter(list_transform(string_split(p, ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS p, list_distinct(list_filter(list_transform(string_split(y, ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS y FROM t),
c AS (SELECT CAST(sum(len(list_intersect(p, y))) AS BIGINT) AS tp, CAST(sum(len(p) - len(list_intersect(p, y))) AS BIGINT) AS fp, CAST(sum(len(y) - len(list_intersect(p, y))) AS BIGINT) AS fn FROM s) SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""")
LETTERS = "('a','The answer is B.','B'),('b','apple','A'),('c','(C)','C'),('d','maybe','D'),('e','d','D'),('f','','A')"
add_literal("letter_accuracy", LETTERS, "k, o, y", lambda t: t.select("k", T.letter(F.col("o")).alias("letter"), F.coalesce(T.letter(F.col("o")) == F.col("y"), F.lit(False)).alias("correct")),
    ", z AS (SELECT k, y, coalesce(nullif(regexp_extract(upper(trim(o)), '\\b([ABCD])\\b', 1), ''), CASE WHEN left(upper(trim(o)), 1) IN ('A', 'B', 'C', 'D') THEN left(upper(trim(o)), 1) END) AS letter FROM t) SELECT k, letter, coalesce(letter = y, false) AS correct FROM z")
SHAPES = """('{"a": "b"}'),('```json {"a": "b"}'),('{"a": {"b": 1}}'),('x {"a": 1}'),('plain')"""
add_literal("shape_counts", SHAPES, "v", lambda t: t.groupBy(T.shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n")),
    """SELECT CASE WHEN regexp_matches(v, '^\\{\\s*"[^"]*"\\s*:\\s*"[^"]*"\\s*\\}$') THEN 'bare JSON object, one key' WHEN starts_with(v, '```') THEN 'markdown fence around the JSON' WHEN length(v) - length(replace(v, '{', '')) > 1 THEN 'more than one JSON object' WHEN contains(v, chr(10)) THEN 'multi-line, JSON plus other text' ELSE 'single line, not a bare object' END AS shape, count(*) AS n FROM t GROUP BY ALL""")

# --- flags: two "runs" over the labelled documents
add("score_rates", lambda s, d: V.rates(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select("lang", (F.col("quality") == 1).alias("f"), (F.col("toxic") == 0).alias("v")), ["lang"], "f", "v"),
    "SELECT lang, count(*) AS n, count_if(quality = 1) AS k, count_if(quality = 1) / count(*) AS rate, count_if(toxic = 0) AS n_valid, count_if(quality = 1 AND toxic = 0) / count_if(toxic = 0) AS rate_valid FROM labels JOIN documents USING (doc_id) GROUP BY ALL")


def _flags(s, d):
    from ..functions.hashing import stable_int

    f = lambda seed: stable_int(F.concat(F.lit(seed), F.col("doc_id").cast("string")), 10) < 7
    return table(s, d, "documents").select("doc_id", "lang", "source", f("a").alias("a"), (f("a") | f("b")).alias("b"))


SQL_FLAGS = f"WITH f AS (SELECT doc_id, lang, source, {sql_hash(chr(39) + 'a' + chr(39) + ' || doc_id', 10)} < 7 AS a, {sql_hash(chr(39) + 'a' + chr(39) + ' || doc_id', 10)} < 7 OR {sql_hash(chr(39) + 'b' + chr(39) + ' || doc_id', 10)} < 7 AS b FROM documents)"
SQL_DISC = SQL_FLAGS + ", m AS (SELECT source, count(*) AS paired, count_if(a AND NOT b) AS a_only, count_if(NOT a AND b) AS b_only, count_if(a <> b) AS discordant FROM f GROUP BY ALL)"
add("mcnemar_counts", lambda s, d: B.discordance(_flags(s, d), ["source"], "a", "b"), SQL_DISC + " SELECT * FROM m")
add("mcnemar_tests", lambda s, d: B.holm(B.mcnemar(B.discordance(_flags(s, d), ["source"], "a", "b")).withColumn("family", F.lit("all")), ["family"], "p", "source").select("source", "method", "p", "adjusted"))
add("boot_ci", lambda s, d: B.with_ci(_flags(s, d), ["lang"], "doc_id", "a"))
add("paired_difference", lambda s, d: B.paired_difference(_flags(s, d), ["lang"], "doc_id", "a", "b"))
add("self_compare", lambda s, d: B.discordance(_flags(s, d).withColumn("c", F.col("a")), ["lang"], "a", "c"), SQL_FLAGS + " SELECT lang, count(*) AS paired, 0::BIGINT AS a_only, 0::BIGINT AS b_only, 0::BIGINT AS discordant FROM f GROUP BY ALL")
PVALUES = "('x','a',0.01),('x','b',0.04),('x','c',0.03),('x','d',0.005),('x','e',NULL),('y','a',0.5),('y','b',0.5)"
add_literal("holm_adjust", PVALUES, "fam, k, p0", lambda t: B.holm(t.select("fam", "k", F.col("p0").cast("double").alias("p")), ["fam"], "p", "k"),
    """, r AS (SELECT fam, k, p0::DOUBLE AS p, row_number() OVER (PARTITION BY fam ORDER BY p0, k) - 1 AS i, count(*) OVER (PARTITION BY fam) AS m FROM t WHERE p0 IS NOT NULL)
SELECT fam, k, p, max(least(1.0::DOUBLE, (m - i) * p)) OVER (PARTITION BY fam ORDER BY p, k ROWS UNBOUNDED PRECEDING) AS adjusted FROM r UNION ALL SELECT fam, k, NULL, NULL FROM t WHERE p0 IS NULL""")
add("mdd", lambda s, d: _flags(s, d).groupBy("lang").agg(F.count("*").alias("n"), (F.count_if("a") / F.count("*")).alias("rate")).withColumn("mdd", B.mdd(F.col("rate"), F.col("n"))),
    SQL_FLAGS + f", r AS (SELECT lang, count(*) AS n, count_if(a) / count(*) AS rate FROM f GROUP BY ALL) SELECT lang, n, rate, {B.Z_ALPHA + B.Z_POWER!r}::DOUBLE * sqrt(greatest(2 * rate * (1 - rate), 1e-12::DOUBLE) / n) AS mdd FROM r")
add("boundary_refusal", lambda s, d: _flags(s, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if("b").alias("k")).select("source", TR.near_boundary(F.col("k") / F.col("n"), F.col("n")).alias("refused")),
    SQL_FLAGS + ", r AS (SELECT source, count(*) AS n, count_if(b) / count(*) AS p FROM f GROUP BY ALL) SELECT source, p - 3 * sqrt(p * (1 - p) / n) <= 0 OR p + 3 * sqrt(p * (1 - p) / n) >= 1 AS refused FROM r")
add("label_reweight", lambda s, d: B.reweighted(_flags(s, d).where("a"), _flags(s, d).where("not a").withColumn("f", F.col("b")), "lang", "f").select(F.round("accuracy", 9).alias("accuracy"), "covered"),
    SQL_FLAGS + ", x AS (SELECT lang, count(*) AS w FROM f WHERE a GROUP BY ALL), y AS (SELECT lang, count(*) AS n, count_if(b) AS k FROM f WHERE NOT a GROUP BY ALL) SELECT round(sum(CASE WHEN n IS NOT NULL THEN w * k / n END) / sum(CASE WHEN n IS NOT NULL THEN w END), 9) AS accuracy, CAST(sum(CASE WHEN n IS NOT NULL THEN w END) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS covered FROM x LEFT JOIN y USING (lang)")
add("matched_controls", lambda s, d: B.matched_controls(*(table(s, d, "documents").join(_flags(s, d).select("doc_id", "b"), "doc_id").where(c).select("lang", "source", "doc_id", "n_chars") for c in ("not b", "b")), ["lang", "source"], "doc_id", "n_chars"))
add("group_collapse", lambda s, d: V.collapse(table(s, d, "events").select("event_type", F.col("event_id").alias("pos"), F.floor(F.col("value") / 50).cast("long").alias("reward")), [], "pos", "reward").select("group", "n", "collapsed"),
    "SELECT event_id // 8 AS \"group\", count(*) AS n, min(floor(value / 50)) = max(floor(value / 50)) AS collapsed FROM events GROUP BY ALL")


def _deciles(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    x = table(s, d, "events").withColumn("k", F.row_number().over(w.orderBy("event_id"))).withColumn("c", F.count("*").over(w))
    n = F.greatest(F.floor(F.col("c") / 10), F.lit(1))
    cents = F.rint(F.col("value") * 100).cast("long")
    return x.groupBy("event_type").agg((F.sum(F.when(F.col("k") <= n, cents)) / F.max(n)).alias("first_mean"), (F.sum(F.when(F.col("k") > F.col("c") - n, cents)) / F.max(n)).alias("last_mean"))


add("decile_means", _deciles, "WITH x AS (SELECT event_type, CAST(round_even(value * 100, 0) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, CAST(sum(v) FILTER (k <= greatest(c // 10, 1)) AS BIGINT) / max(greatest(c // 10, 1)) AS first_mean, CAST(sum(v) FILTER (k > c - greatest(c // 10, 1)) AS BIGINT) / max(greatest(c // 10, 1)) AS last_mean FROM x GROUP BY ALL")
add("set_overlap", lambda s, d: _flags(s, d).where("a").select("doc_id").intersect(_flags(s, d).where("b").select("doc_id")).agg(F.count("*").alias("both")), SQL_FLAGS + " SELECT count(*) AS both FROM f WHERE a AND b")


def _diff(s, d):
    x = table(s, d, "documents").select("doc_id", F.col("text").alias("o"))
    y = x.join(_flags(s, d).select("doc_id", "a", "b"), "doc_id").where("b").select("doc_id", F.when(F.col("a"), F.col("o")).otherwise(F.upper("o")).alias("o"))
    return B.run_diff(x, y, ["doc_id"], "o").select("doc_id", F.col("right").isNull().alias("missing"))


add("run_diff", _diff, SQL_FLAGS + ", x AS (SELECT doc_id, text AS o FROM documents), y AS (SELECT doc_id, CASE WHEN a THEN o ELSE upper(o) END AS p FROM x JOIN f USING (doc_id) WHERE b) SELECT doc_id, p IS NULL AS missing FROM x LEFT JOIN y USING (doc_id) WHERE p IS DISTINCT FROM o")
add("determinism_matrix", lambda s, d: table(s, d, "conversations").groupBy("role", "turn").agg(F.count("*").alias("n"), F.count_distinct("text").alias("distinct_texts")), "SELECT role, turn, count(*) AS n, count(DISTINCT text) AS distinct_texts FROM conversations GROUP BY ALL")
VERDICTS = "('a',0.1,0.01,'a is better'),('b',-0.1,0.2,'b is better'),('c',0.2,0.01,'no difference detected'),('d',0.0,0.9,'no difference detected')"
add_literal("verdict_conflicts", VERDICTS, "k, diff, p, v", lambda t: B.contradictions(t, "v", "p").select("k"), "SELECT k FROM t WHERE (v LIKE '% is better' AND p >= 0.05) OR (v NOT LIKE '% is better' AND p < 0.05)")
add_literal("paired_verdicts", VERDICTS, "k, diff, p, v", lambda t: t.select("k", B.paired_verdict(F.col("diff").cast("double"), F.col("p").cast("double")).alias("verdict")), "SELECT k, CASE WHEN p >= 0.05 THEN 'no difference detected' WHEN diff > 0 THEN 'a is better' WHEN diff < 0 THEN 'b is better' ELSE 'no difference detected' END AS verdict FROM t")
SEEDS = "('x','p',0.1,'a is better',0.2,'a is better'),('x','q',-0.1,'b is better',0.1,'a is better'),('y','p',0.0,'no difference detected',0.1,'a is better')"
add_literal("seed_agreement", SEEDS, "g, k, d1, v1, d2, v2", lambda t: TR.agreement(t.select("g", "k", F.col("d1").alias("d"), F.col("v1").alias("v")), t.select("g", "k", F.col("d2").alias("d"), F.col("v2").alias("v")), ["g", "k"], "d", "v").select("g", "k", "same_sign", "same_verdict", "conflict"),
    "SELECT g, k, sign(d1) = sign(d2) AS same_sign, v1 = v2 AS same_verdict, v1 LIKE '% is better' AND v2 LIKE '% is better' AND sign(d1) <> sign(d2) AS conflict FROM t")

# --- lineage, manifests, licences, gates
LINEAGE = "('s1','r1','free','0000000000000000000000000000000000000000000000000000000000000000'),('','r2','free','0'),('s3',NULL,'other','ABC'),('s4','r4',NULL,NULL)"
add_literal("lineage_violations", LINEAGE, "source_id, record_id, redistribution_status, content_sha256", lambda t: t.select("source_id", F.array_join(LN.violations(t, {"redistribution_status": ["free", "restricted"]}, ["source_id", "record_id", "redistribution_status", "content_sha256"]), ",").alias("problems")),
    """SELECT source_id, concat_ws(',', CASE WHEN source_id IS NULL THEN 'null:source_id' END, CASE WHEN trim(source_id) = '' THEN 'blank:source_id' END, CASE WHEN record_id IS NULL THEN 'null:record_id' END, CASE WHEN trim(record_id) = '' THEN 'blank:record_id' END,
CASE WHEN redistribution_status IS NULL THEN 'null:redistribution_status' END, CASE WHEN trim(redistribution_status) = '' THEN 'blank:redistribution_status' END, CASE WHEN redistribution_status NOT IN ('free', 'restricted') THEN 'unknown:redistribution_status' END,
CASE WHEN content_sha256 IS NULL THEN 'null:content_sha256' END, CASE WHEN trim(content_sha256) = '' THEN 'blank:content_sha256' END, CASE WHEN NOT regexp_matches(content_sha256, '^[0-9a-f]{64}$') THEN 'malformed:content_sha256' END) AS problems FROM t""")
add("manifest_aggregates", lambda s, d: LN.manifest(table(s, d, "documents").join(table(s, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("e")), "doc_id", "left"), ["source"], "e", F.col("lang") == "fr"),
    "SELECT source, count(*) AS records, count(toxic) AS entity_present, count(*) - count(toxic) AS entity_missing, count_if(lang <> 'fr') AS identifiable, count(toxic) / count(*) AS coverage, count(toxic) / count_if(lang <> 'fr') AS coverage_identifiable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
add("manifest_mismatch", lambda s, d: LN.manifest_problems(*(table(s, d, "pages").where(c).select(F.col("url").alias("path"), F.sha2(x, 256).alias("sha256")).distinct() for c, x in ((F.col("page_id") != 3, F.col("html")), (F.col("page_id") != 5, F.when(F.col("page_id") == 7, "changed").otherwise(F.col("html")))))),
    """WITH a AS (SELECT DISTINCT url AS path, sha256(html) AS x FROM pages WHERE page_id <> 3), b AS (SELECT DISTINCT url AS path, sha256(CASE WHEN page_id = 7 THEN 'changed' ELSE html END) AS y FROM pages WHERE page_id <> 5)
SELECT path, CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'unexpected' ELSE 'digest differs' END AS problem FROM a FULL JOIN b USING (path) WHERE x IS DISTINCT FROM y""")
LICENSES = "('a','You may copy and redistribute.',true,true),('b','Commercial use is allowed. Not for redistribution.',true,true),('c','Noncommercial only; share alike.',true,true),('d','silent',true,false)"
add_literal("license_audit", LICENSES, "k, text, redist, comm", lambda t: LN.license_audit(t, "text", {"redistribution": "redist", "commercial": "comm"}).select("k", "redistribution_problem", "commercial_problem"),
    "SELECT k, " + ", ".join(f"CASE WHEN {c} AND NOT regexp_matches(text, '{LN.EVIDENCE[p][0]}') THEN 'no evidence' WHEN {c} AND regexp_matches(text, '{LN.EVIDENCE[p][1]}') THEN 'denied' END AS {p}_problem" for p, c in (("redistribution", "redist"), ("commercial", "comm"))) + " FROM t")
GATES = "('env','pass'),('gpu','warn'),('net','fail'),('disk',NULL)"
add_literal("gate_summary", GATES, "k, status", lambda t: TR.gate(t.select("k"), t.where("status is not null"), "k", "status").agg(F.count("*").alias("required"), F.count_if("met").alias("met"), F.every("met").alias("passed")), "SELECT count(*) AS required, count_if(status IN ('pass', 'warn')) AS met, bool_and(coalesce(status IN ('pass', 'warn'), false)) AS passed FROM t")
FIGURES = "('a','1,234'),('b','5'),('c','7')"
add_literal("changed_figures", FIGURES, "k, v", lambda t: TR.changed(t, t.where("k <> 'c'").withColumn("v", F.when(F.col("k") == "b", "6").otherwise(F.col("v"))), "k", "v"), "SELECT k, v AS recorded, CASE k WHEN 'b' THEN '6' END AS now FROM t WHERE k <> 'a'")
add("events_by_json_key", lambda s, d: table(s, d, "events").groupBy(TR.resolve(F.col("props"), ["k"]).cast("long").alias("k")).agg(F.count("*").alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
add("remaining_context", lambda s, d: table(s, d, "documents").select("doc_id", L.remaining_context(2048, F.col("n_chars")).cast("long").alias("left")), "SELECT doc_id, greatest(1, 2048 - n_chars - 8) AS \"left\" FROM documents")
