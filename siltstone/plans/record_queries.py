"""Queries of record building, guards and gates, over inputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contamination as N
from ..operators import records as R
from ..operators import splits as S
from .base import sql_hash, table
from .catalog import add

# --- text and metric choice
_sql_lines = lambda *cs: "array_to_string(list_filter([" + ", ".join(cs) + "], lambda x: x IS NOT NULL AND x <> ''), chr(10))"
_lead = ["CASE WHEN p_partkey % 2 = 0 THEN p_name END", "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END", "CASE WHEN p_partkey % 5 = 0 THEN p_type END"]
add("record_text", lambda s, d: table(s, d, "part").select("p_partkey", R.text_of([F.expr(c) for c in _lead], [F.col("p_brand"), F.col("p_type")]).alias("text")),
    f"SELECT p_partkey, CASE WHEN {_sql_lines(*_lead)} <> '' THEN {_sql_lines(*_lead)} ELSE {_sql_lines('p_brand', 'p_type')} END AS text FROM part")
add("primary_metric", lambda s, d: R.primary_metric(table(s, d, "lineitem").withColumn("kind", F.when(F.col("l_returnflag") == "R", "Primary").otherwise("Secondary")), "l_orderkey", "kind", "l_linenumber", ["l_extendedprice", "l_partkey"]),
    """SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'Primary' ELSE 'Secondary' END AS picked, l_extendedprice, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Primary' ELSE 'Secondary' END, l_extendedprice, l_partkey) = 1""")
add("complete_targets", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy(F.coalesce(R.first_reason([("no_metric", F.col("quality").isNull()), ("incomplete_or_empty", F.col("toxic").isNull() | (F.coalesce(F.trim("text"), F.lit("")) == ""))]), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN quality IS NULL THEN 'no_metric' WHEN toxic IS NULL OR coalesce(trim(text), '') = '' THEN 'incomplete_or_empty' ELSE 'kept' END AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")

# --- replies and choices
_flags = {"deleted": "conv_id % 11 = 0 AND turn % 4 = 1", "review": "(conv_id + turn) % 13 <> 0", "synthetic": "conv_id % 17 = 0", "lang": "CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'xx' END", "prole": "CASE role WHEN 'user' THEN 'prompter' ELSE role END"}


def _replay(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role", "text", *(F.expr(e).alias(n) for n, e in _flags.items()))
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("prole").alias("pr"), F.col("text").alias("pt"), F.col("deleted").alias("pd"), F.col("synthetic").alias("ps"))
    j = c.where("role = 'assistant'").join(p, ["conv_id", "turn"], "left")
    reason = R.replay_reason({k: F.col(k) for k in ("deleted", "review", "synthetic", "lang", "text")}, {"role": F.col("pr"), "text": F.col("pt"), "deleted": F.col("pd"), "synthetic": F.col("ps")}, ["en", "es"])
    return j.withColumn("reason", F.coalesce(reason, F.lit("pairs")))


add("replay_reasons", lambda s, d: _replay(s, d).groupBy("reason").agg(F.count("*").alias("n")),
    f"""WITH c AS (SELECT conv_id, turn, role, text, {', '.join(f'{e} AS {n}' for n, e in _flags.items())} FROM conversations),
j AS (SELECT a.*, p.prole AS pr, p.text AS pt, p.deleted AS pd, p.synthetic AS ps FROM c a LEFT JOIN c p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 WHERE a.role = 'assistant')
SELECT CASE WHEN deleted THEN 'deleted' WHEN NOT review THEN 'failed_review' WHEN synthetic THEN 'synthetic_model_generated' WHEN NOT coalesce(lang IN ('en', 'es'), false) THEN 'language' WHEN pr IS DISTINCT FROM 'prompter' THEN 'no_prompter_parent'
WHEN coalesce(ps, false) OR coalesce(pd, false) THEN 'parent_synthetic_or_deleted' WHEN length(coalesce(pt, '')) < 8 OR length(coalesce(text, '')) < 8 THEN 'too_short' ELSE 'pairs' END AS reason, count(*) AS n FROM j GROUP BY ALL""")
add("choice_items", lambda s, d: table(s, d, "documents").select("doc_id", R.choice(F.split("text", ","), F.col("doc_id") % 6 - 1).alias("answer")),
    "SELECT doc_id, CASE WHEN len(string_split(text, ',')) = 4 AND doc_id % 6 - 1 BETWEEN 0 AND 3 THEN string_split(text, ',')[doc_id % 6] END AS answer FROM documents")

# --- two sources of one entity
_day = lambda c: F.date_format(c, "yyyy-MM-dd")


def _two(s, d):
    o = table(s, d, "orders")
    main = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"), F.when(F.col("o_orderkey") % 3 != 0, _day("o_orderdate")).alias("date"))
    other = table(s, d, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(_day("l_shipdate")).alias("date"))
    decided = o.where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 2 == 0).alias("keep"), F.lit("near").alias("stage"))
    return R.two_sources(main, other, decided, "k")


add("two_source_table", _two, """WITH m AS (SELECT o_orderkey AS k, o_orderstatus AS state, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS md FROM orders WHERE o_orderkey % 7 <> 0),
o AS (SELECT l_orderkey AS k, min(strftime(l_shipdate, '%Y-%m-%d')) AS od FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL), x AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS keep, 'near' AS stage FROM orders WHERE o_orderpriority LIKE '1%')
SELECT coalesce(m.k, o.k) AS k, m.state, coalesce(md, od) AS date, CASE WHEN m.k IS NULL THEN true ELSE coalesce(keep, true) END AS keep, CASE WHEN m.k IS NULL THEN 'none' ELSE coalesce(stage, 'none') END AS stage
FROM m FULL JOIN o ON m.k = o.k LEFT JOIN x ON x.k = coalesce(m.k, o.k)""")

# --- scores by field
_VALUES = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}
_vector = lambda shift: "concat('CVSS:3.1', " + ", ".join(f"'/{m}:', substr('{v}', CAST((doc_id + {shift.format(i=i + 2)}) % {len(v)} AS INT) + 1, 1)" for i, (m, v) in enumerate(_VALUES.items())) + ")"
_target, _pred = _vector("0"), "concat(' ', lower(" + _vector("CASE WHEN doc_id % {i} = 0 THEN 1 ELSE 0 END") + "))"


def _fields(s, d):
    return table(s, d, "documents").select("doc_id", *(c.alias(n) for n, c in R.vector_fields(F.expr(_pred), F.expr(_target)).items()))


_same = {m: f"substr('{v}', CAST((doc_id + CASE WHEN doc_id % {i + 2} = 0 THEN 1 ELSE 0 END) % {len(v)} AS INT) + 1, 1) = substr('{v}', CAST(doc_id % {len(v)} AS INT) + 1, 1)" for i, (m, v) in enumerate(_VALUES.items())}
_all = " AND ".join(_same.values())
add("vector_fields", _fields, f"SELECT doc_id, {', '.join(f'{e} AS {m}' for m, e in _same.items())}, {_all} AS all_fields, {_all} AS vector FROM documents")
add("vector_field_rates", lambda s, d: _fields(s, d).agg(*(F.count_if(F.col(c)).alias(c) for c in [*_VALUES, "all_fields", "vector"])), f"SELECT {', '.join(f'count_if({e}) AS {m}' for m, e in _same.items())}, count_if({_all}) AS all_fields, count_if({_all}) AS vector FROM documents")

# --- guards
_kind = "CASE WHEN page_id % 13 = 0 THEN 'dir' ELSE 'file' END"
_digest = "CASE WHEN page_id % 26 = 0 THEN NULL WHEN page_id % 7 = 0 THEN upper({h}) WHEN page_id % 11 = 0 THEN substr({h}, 1, 63) WHEN page_id % 17 = 0 THEN NULL WHEN page_id % 19 = 0 THEN {u} ELSE {h} END"
add("manifest_problems", lambda s, d: table(s, d, "pages").select("page_id", R.digest_problem(F.expr(_kind), F.expr(_digest.format(h="sha2(html, 256)", u="sha2(url, 256)")), F.sha2("html", 256)).alias("problem")).where("problem is not null"),
    f"""WITH p AS (SELECT page_id, {_kind} AS kind, {_digest.format(h='sha256(html)', u='sha256(url)')} AS digest, sha256(html) AS found FROM pages)
SELECT * FROM (SELECT page_id, CASE WHEN kind = 'dir' AND digest IS NOT NULL THEN 'directory_with_digest' WHEN kind = 'file' AND digest IS NULL THEN 'no_digest' WHEN kind = 'file' AND NOT regexp_full_match(digest, '[0-9a-f]{{64}}') THEN 'malformed_digest' WHEN kind = 'file' AND digest <> found THEN 'other_bytes' END AS problem FROM p) WHERE problem IS NOT NULL""")
add("stale_outputs", lambda s, d: table(s, d, "pages").select("page_id").join(table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti"),
    "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IS NOT NULL)")
add("failed_runs_with_manifest", lambda s, d: table(s, d, "events").where("event_type = 'error'").select("user_id").distinct().join(table(s, d, "events").where("event_type = 'purchase'").select("user_id").distinct(), "user_id").agg(F.count("*").alias("broken")),
    "SELECT count(*) AS broken FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') WHERE user_id IS NOT NULL")
add("self_test_rates", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("executed"), F.count_if(F.col("value") > 5).alias("matched"), (F.count_if(F.col("value") > 5) / F.count("*")).alias("rate")),
    "SELECT event_type, count(*) AS n, count_if(value > 0) AS executed, count_if(value > 5) AS matched, count_if(value > 5) / count(*) AS rate FROM events GROUP BY ALL")
add("run_gate", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.every(F.col("event_type") != "error").alias("complete"), (F.count_distinct("event_type") > 1).alias("differs")).groupBy("complete", "differs").agg(F.count("*").alias("runs")),
    "SELECT complete, differs, count(*) AS runs FROM (SELECT user_id, bool_and(event_type <> 'error') AS complete, count(DISTINCT event_type) > 1 AS differs FROM events GROUP BY ALL) GROUP BY ALL")

# --- classes and scans
RULES = [("secret", "password"), ("mail", "@"), ("link", "http"), ("license", "license")]
add("error_classes", lambda s, d: table(s, d, "documents").groupBy(F.coalesce(R.first_reason([(n, F.lower("text").contains(x)) for n, x in RULES]), F.lit("other")).alias("class")).agg(F.count("*").alias("n")),
    f"SELECT CASE {' '.join(f'''WHEN contains(lower(text), '{x}') THEN '{n}' ''' for n, x in RULES)} ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY ALL")
add("log_hits", lambda s, d: table(s, d, "pages").select("page_id", F.col("html").contains("<script").alias("script"), F.size(F.regexp_extract_all("html", F.lit("<a [^>]*href="), F.lit(0))).cast("long").alias("links")).where("script or links > 0"),
    "SELECT * FROM (SELECT page_id, contains(html, '<script') AS script, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages) WHERE script OR links > 0")
add("license_counts", lambda s, d: table(s, d, "documents").select("source", F.regexp_extract("text", r"(?i)\b(apache license|mit license|gpl|mpl)\b", 1).alias("l")).groupBy("source").agg(F.count_if(F.col("l") != "").alias("resolved"), F.count_if(F.col("l") == "").alias("unresolved"), F.count_if(R.copyleft(F.col("l"))).alias("copyleft")),
    r"SELECT source, count_if(l <> '') AS resolved, count_if(l = '') AS unresolved, count_if(upper(l) LIKE '%GPL%' OR upper(l) LIKE '%MPL%') AS copyleft FROM (SELECT source, regexp_extract(text, '(?i)\b(apache license|mit license|gpl|mpl)\b', 1) AS l FROM documents) GROUP BY ALL")

# --- samples, strata and gaps
_band = "CASE WHEN n_chars < 200 THEN 'a' WHEN n_chars < 500 THEN 'b' WHEN n_chars < 1000 THEN 'c' WHEN n_chars < 2000 THEN 'd' WHEN n_chars < 4000 THEN 'e' ELSE 'f' END"
add("band_sample", lambda s, d: S.hash_sample(table(s, d, "documents").withColumn("band", F.expr(_band)), "doc_id", 35, "band:", ["band"]).select("band", "doc_id"),
    f"SELECT {_band} AS band, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {_band} ORDER BY {sql_hash(chr(39) + 'band:' + chr(39) + ' || doc_id', 1 << 62)}, doc_id) <= 35")
add("first_writer", lambda s, d: R.first_writer(table(s, d, "conversations").where("role <> 'system'"), "conv_id", F.struct(F.when(F.col("role") == "assistant", 0).otherwise(1), "turn", "text"), "text"),
    "SELECT conv_id, text FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn, text) = 1")
add("partner_flags", lambda s, d: table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ":in").otherwise(":tg")).alias("key")).withColumn("entity", R.partner(F.col("key"))).join(table(s, d, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("entity"), F.lit(True).alias("hit")).distinct(), "entity", "left").select("key", F.coalesce("hit", F.lit(False)).alias("partner")),
    "SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ':in' ELSE ':tg' END AS key, doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AS partner FROM documents")
add("rebuilt_targets", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.concat(F.lit("Classify: "), "text"), 256).alias("a"), F.sha2(F.concat(F.lit("Classify: "), F.when(F.col("doc_id") % 50 == 0, F.upper("text")).otherwise(F.col("text"))), 256).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ")),
    "SELECT count(*) AS n, count_if(doc_id % 50 = 0 AND sha256('Classify: ' || text) <> sha256('Classify: ' || upper(text))) AS differ FROM documents")
add("decoding_gaps", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), ((F.sum("quality") - F.sum("toxic")) / F.count("*")).alias("gap")),
    "SELECT source, count(*) AS n, (sum(quality) - sum(toxic)) / count(*) AS gap FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
add("flag_discordance", lambda s, d: R.discordance(table(s, d, "labels").where("quality is not null and toxic is not null"), F.col("quality") == 1, F.col("toxic") == 1),
    "SELECT count_if(quality = 1 AND toxic <> 1) AS only_a, count_if(quality <> 1 AND toxic = 1) AS only_b, count(*) AS n, 100 * (count_if(quality = 1 AND toxic <> 1) + count_if(quality <> 1 AND toxic = 1)) / count(*) AS percent FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")


def _policy(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("source", F.coalesce("toxic", F.lit(0)).alias("t"))
    return N.tvd(x, x.where("t = 0"), "source")


add("policy_tvd", _policy, """WITH x AS (SELECT source, count(*) AS x, count_if(coalesce(toxic, 0) = 0) AS y FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL), t AS (SELECT greatest(sum(x), 1) AS sx, greatest(sum(y), 1) AS sy FROM x)
SELECT CAST(sum(abs(x * sy - y * sx)) AS DOUBLE) / CAST(2 * any_value(sx) * any_value(sy) AS DOUBLE) AS tvd FROM x, t""")
add("sorted_scan", lambda s, d: S.first_sorted(table(s, d, "documents"), "lang", "doc_id", 20).select("lang", "doc_id"), "SELECT lang, doc_id FROM documents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20")
