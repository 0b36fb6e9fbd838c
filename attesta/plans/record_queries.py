"""Queries on regions, records, jobs and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import islands, lifecycle, metrics, relational
from ..sources import testdata as T
from ..sources.testdata import PROGRESS_SQL, REGIONS_SQL, SPANS_SQL, table
from ..streaming import protocol
from .registry import query

_STATES = [("semantic", metrics.SEMANTIC), ("candidate", metrics.CANDIDATE), ("verdict", metrics.VERDICT)]
_COUNTS = ", ".join(f"count(*) FILTER ({c} = '{v}') AS {c}_{v}" for c, values in _STATES for v in values)


@query(f"""WITH {REGIONS_SQL} SELECT page, CASE WHEN grouping(page) = 1 THEN 'all' ELSE 'page' END AS scope, count(*) AS regions, {_COUNTS} FROM regions GROUP BY GROUPING SETS ((page), ())""")
def d01_d02_state_histograms(spark, sf_dir):
    return metrics.histograms(T.regions(spark, sf_dir))


@query(f"""WITH {REGIONS_SQL}, p AS (SELECT page, count(*) AS total, count(*) FILTER (verdict = 'contradicted') AS c, count(*) FILTER (verdict = 'non_verifiable') AS v FROM regions GROUP BY page)
SELECT page, CASE WHEN c > 0 THEN 'contradicted' WHEN total = 0 OR v = total THEN 'non_verifiable' WHEN v > 0 THEN 'partially_conformant' ELSE 'conformant_within_scope' END AS verdict FROM p""")
def d23_document_verdicts(spark, sf_dir):
    p = T.regions(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "contradicted").alias("c"), F.count_if(F.col("verdict") == "non_verifiable").alias("v"))
    return p.select("page", metrics.document_verdict(F.col("c"), F.col("v"), F.col("n")).alias("verdict"))


@query(f"""WITH {REGIONS_SQL} SELECT page, count(*) = count(*) FILTER (verdict = 'contradicted') + count(*) FILTER (verdict = 'non_verifiable') + count(*) FILTER (verdict = 'conformant_within_scope') AS consistent,
  count(region_id) = count(DISTINCT region_id) AS unique_ids FROM regions GROUP BY page""")
def d22_d25_cross_checks(spark, sf_dir):
    v = [F.count_if(F.col("verdict") == x) for x in metrics.VERDICT]
    return T.regions(spark, sf_dir).groupBy("page").agg((F.count(F.lit(1)) == v[0] + v[1] + v[2]).alias("consistent"), (F.count("region_id") == F.count_distinct("region_id")).alias("unique_ids"))


@query(f"""WITH {REGIONS_SQL}, c AS (SELECT page, count(*) FILTER (verdict = 'conformant_within_scope') AS a, count(*) FILTER (semantic = 'ambiguous') AS r, count(*) FILTER (semantic = 'conflicting' AND candidate = 'missing') AS f FROM regions GROUP BY page)
SELECT page, a + r + f AS targets, CASE WHEN f > 3 THEN 'failed' WHEN a > 0 THEN 'corrected' WHEN r > 0 THEN 'rejected' ELSE 'not_required' END AS status FROM c""")
def d21_d24_correction_status(spark, sf_dir):
    c = T.regions(spark, sf_dir).groupBy("page").agg(
        F.count_if(F.col("verdict") == "conformant_within_scope").alias("a"), F.count_if(F.col("semantic") == "ambiguous").alias("r"),
        F.count_if((F.col("semantic") == "conflicting") & (F.col("candidate") == "missing")).alias("f"),
    )
    return c.select("page", (F.col("a") + F.col("r") + F.col("f")).alias("targets"), metrics.correction_status(F.col("a"), F.col("r"), F.greatest(F.col("f") - 3, F.lit(0))).alias("status"))


@query(f"""WITH {REGIONS_SQL}, c AS (SELECT page, avg(CASE WHEN verdict = 'contradicted' THEN 0.0 ELSE 1.0 END) AS recall, avg(CASE WHEN semantic = 'conflicting' THEN 0.0 ELSE 1.0 END) AS coverage FROM regions WHERE page IS NOT NULL GROUP BY page),
g AS (SELECT bool_or(page % 3 = 0 AND page % 2 = 0) AS any_ok, bool_or(page % 3 = 0 AND page % 2 = 0 AND recall < 0.5) AS r, bool_or(page % 3 = 0 AND page % 2 = 0 AND coverage < 0.1) AS v FROM c)
SELECT list_filter([CASE WHEN NOT coalesce(any_ok, false) THEN 'no_representative_corpus' END, CASE WHEN r THEN 'recall_below_threshold' END, CASE WHEN v THEN 'coverage_below_threshold' END], lambda x: x IS NOT NULL) AS reasons,
  coalesce(any_ok, false) AND NOT r AND NOT v AS passed FROM g""")
def d19_d20_gate(spark, sf_dir):
    c = T.regions(spark, sf_dir).where("page IS NOT NULL").groupBy("page").agg(F.avg(F.when(F.col("verdict") == "contradicted", 0.0).otherwise(1.0)).alias("recall"), F.avg(F.when(F.col("semantic") == "conflicting", 0.0).otherwise(1.0)).alias("coverage"))
    c = c.withColumns({"exhaustive": F.col("page") % 3 == 0, "representative": F.col("page") % 2 == 0})
    return metrics.gate(c, {"recall": 0.5, "coverage": 0.1})


@query(f"""WITH {REGIONS_SQL}, t AS (SELECT page, count(*) AS n FROM regions GROUP BY page) SELECT page, n, CASE WHEN n = 0 THEN 0.0 ELSE round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) END AS share FROM t""")
def d28_d18_page_shares(spark, sf_dir):
    t = T.regions(spark, sf_dir).groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    return t.join(F.broadcast(t.agg(F.sum("n").alias("__all")))).select("page", "n", metrics.ratio(F.col("n"), F.col("__all")).alias("share"))


@query(f"""WITH {REGIONS_SQL} SELECT page, count(*) FILTER (semantic = 'established' AND candidate = 'matching') AS "both", count(*) FILTER (semantic = 'established' AND candidate <> 'matching') AS only_a,
  count(*) FILTER (semantic <> 'established' AND candidate = 'matching') AS only_b, count(*) FILTER (semantic <> 'established' AND candidate <> 'matching') AS neither FROM regions GROUP BY page""")
def c40_contingency(spark, sf_dir):
    return metrics.contingency(T.regions(spark, sf_dir), ["page"], F.col("semantic") == "established", F.col("candidate") == "matching")


@query(f"""WITH {REGIONS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY page NULLS LAST, region_id) AS k FROM regions) SELECT k, page, region_id FROM r WHERE k <= 100""")
def f01_f03_report_order(spark, sf_dir):
    top = T.regions(spark, sf_dir).select("page", "region_id").orderBy(F.asc_nulls_last("page"), "region_id").limit(100)
    return top.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("page"), "region_id")).cast("long"))


@query(f"""WITH {SPANS_SQL}, c AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM c)
SELECT doc_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY doc_id, g""")
def e06_overlap_islands(spark, sf_dir):
    return islands.overlap_islands(T.spans(spark, sf_dir), ["doc_id"])


@query(f"""WITH {SPANS_SQL}, c AS (SELECT doc_id, start, "end", lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end") AS was FROM spans)
SELECT doc_id, bool_and(coalesce(was + 1 < start, true) AND start <= "end") AS disjoint FROM c GROUP BY doc_id""")
def e17_disjoint_ranges(spark, sf_dir):
    return islands.disjoint_ranges(T.spans(spark, sf_dir), ["doc_id"], "start", "end")


@query(f"""WITH {SPANS_SQL}, s AS (SELECT doc_id, start, "end", start % 7 - 3 AS delta FROM spans)
SELECT doc_id, start, delta, CAST(coalesce(sum(delta) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""")
def e19_running_offsets(spark, sf_dir):
    rows = T.spans(spark, sf_dir).withColumn("delta", F.col("start") % 7 - 3).select("doc_id", "start", "delta")
    return islands.running_offsets(rows, ["doc_id"], "start", "delta")


@query(f"""WITH {SPANS_SQL}, s AS (SELECT doc_id, start AS id, start, "end" FROM spans WHERE start % 5 = 0), e AS (SELECT doc_id, start AS e_start, least("end", start + 4) AS e_end, start % 3 - 1 AS delta FROM spans WHERE start % 7 = 0),
m AS (SELECT s.doc_id, s.id, s.start, s."end", coalesce(sum(delta) FILTER (e_end <= start), 0) AS by_, coalesce(bool_or(e_end > start AND e_start < "end"), false) AS hit FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.e_start < s."end" GROUP BY ALL)
SELECT doc_id, id, CASE WHEN NOT hit THEN CAST(start + by_ AS BIGINT) END AS new_start, CASE WHEN NOT hit THEN CAST("end" + by_ AS BIGINT) END AS new_end FROM m""")
def c14_c32_mapped_spans(spark, sf_dir):
    spans = T.spans(spark, sf_dir)
    some = spans.where("start % 5 = 0").select("doc_id", F.col("start").alias("id"), "start", "end")
    edits = spans.where("start % 7 = 0").select("doc_id", F.col("start").alias("e_start"), F.least("end", F.col("start") + 4).alias("e_end"), (F.col("start") % 3 - 1).alias("delta"))
    return relational.mapped_spans(some, edits, "doc_id")


_WAS = "lag({c}) OVER (PARTITION BY stream ORDER BY ts, event_id)"


@query(f"""WITH {PROGRESS_SQL}, l AS (SELECT *, {_WAS.format(c="phase")} AS wp, {_WAS.format(c="completed")} AS wc, {_WAS.format(c="total")} AS wt FROM progress)
SELECT stream, event_id, CASE WHEN completed < 0 OR completed > total THEN 'completed_out_of_range' WHEN wp > phase THEN 'phase_regressed' WHEN wp = phase AND wt <> total THEN 'total_changed' WHEN wp = phase AND wc > completed THEN 'completed_regressed' END AS reason FROM l""")
def e13_progress_violations(spark, sf_dir):
    return islands.progress_violations(T.progress(spark, sf_dir), ["stream"], ["ts", "event_id"]).select("stream", "event_id", "reason")


@query(f"""WITH {PROGRESS_SQL}, b AS (SELECT *, CAST(least(floor(completed * 5 / total), 5) AS INTEGER) AS bucket FROM progress), l AS (SELECT *, {_WAS.format(c="bucket")} AS wb FROM b)
SELECT stream, event_id, bucket FROM l WHERE wb IS NULL OR wb <> bucket""")
def e14_i28_bucket_changes(spark, sf_dir):
    bucket = G.progress_bucket(F.col("completed"), F.col("total"), 5)
    return islands.bucket_changes(T.progress(spark, sf_dir), ["stream"], ["ts", "event_id"], bucket).select("stream", "event_id", "bucket")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def e15_e16_latest_attempts(spark, sf_dir):
    return islands.latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "text")


@query("""SELECT c.conv_id, p AS turn, NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = p AND x.role = 'assistant') AS blank
FROM (SELECT conv_id, unnest(range(1, max(turn) + 1)) AS p FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING max(turn) >= 1) c""")
def e20_c29_filled_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant' AND turn >= 1").withColumn("last", F.col("turn"))
    return islands.filled(rows, ["conv_id"], "turn", "last")


@query("""WITH RECURSIVE chain AS (
  SELECT conv_id * 100 + turn AS id, conv_id * 100 + turn - 1 AS ancestor, 1 AS distance FROM conversations WHERE turn > 0
  UNION ALL SELECT c.id, c.ancestor - 1, c.distance + 1 FROM chain c JOIN conversations a ON a.conv_id * 100 + a.turn = c.ancestor WHERE a.turn > 0)
SELECT id, ancestor, distance FROM chain""")
def c28_f05_attempt_history(spark, sf_dir):
    key = F.col("conv_id") * 100 + F.col("turn")
    return lifecycle.attempt_history(table(spark, sf_dir, "conversations").select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent_id")))


@query("SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 5 MINUTE AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def c27_j12_orphaned_records(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed").alias("status"), F.col("o_orderdate").alias("updated_at"))
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct()
    return lifecycle.orphaned(records, jobs, F.expr("TIMESTAMP '1998-01-01'")).select("id")


@query("SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus IN ('P', 'O') AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def c24_c25_j14_failed_active(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("job_id"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'completed' END").alias("status"))
    failures = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    return lifecycle.failed_while_active(records, failures).select("id")


@query("""WITH r AS (SELECT o_orderkey AS id, 'k' || o_orderkey AS job_key FROM orders WHERE o_orderstatus = 'P'),
j AS (SELECT l_orderkey * 10 + min(l_linenumber) AS job_id, CASE WHEN l_orderkey % 2 = 0 THEN 'k' || l_orderkey END AS job_key, l_orderkey AS named FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey)
SELECT r.id, coalesce(a.job_id, b.job_id) AS job_id, CASE WHEN coalesce(a.job_id, b.job_id) IS NOT NULL THEN 'adopt' ELSE 'fail' END AS action FROM r LEFT JOIN j a ON a.job_key = r.job_key LEFT JOIN j b ON b.named = r.id""")
def c26_j13_adopted_jobs(spark, sf_dir):
    records = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), "o_orderkey").alias("job_key"), F.lit("staging").alias("status"), F.col("o_orderdate").alias("updated_at"))
    jobs = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg((F.col("l_orderkey") * 10 + F.min("l_linenumber")).alias("job_id"))
    jobs = jobs.select("job_id", F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("k"), "l_orderkey")).alias("job_key"), F.concat(F.lit('["gid://app/Record/'), "l_orderkey", F.lit('"]')).alias("arguments"))
    return lifecycle.adopt(records, jobs, F.expr("TIMESTAMP '2030-01-01'"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_custkey AS job, CASE WHEN o_orderkey % 11 = 0 THEN '2.0' ELSE '2.1' END AS contract,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_custkey + 1 END END AS claim FROM orders),
c AS (SELECT *, CASE WHEN claim IS NULL OR status NOT IN ('queued', 'running') THEN 'keep' WHEN contract <> '2.1' THEN 'obsolete' WHEN status = 'queued' THEN 'start' WHEN job = claim THEN 'interrupted' ELSE 'keep' END AS k FROM r)
SELECT id, CASE k WHEN 'start' THEN 'running' WHEN 'obsolete' THEN 'failed' WHEN 'interrupted' THEN 'failed' ELSE status END AS status, CASE k WHEN 'start' THEN claim ELSE job END AS job_id, contract,
  CASE WHEN k IN ('obsolete', 'interrupted') THEN k END AS code, k <> 'keep' AS changed FROM c""")
def j08_j11_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'queued' WHEN 'O' THEN 'running' ELSE 'completed' END").alias("status"), F.col("o_custkey").alias("job_id"),
        F.when(F.col("o_orderkey") % 11 == 0, "2.0").otherwise("2.1").alias("contract"),
    )
    claims = rows.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("job_id")).otherwise(F.col("job_id") + 1).alias("job_id"))
    return lifecycle.transition(rows, claims, "2.1")


@query("""WITH l AS (SELECT conv_id AS parent, max(turn) AS version, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id)
SELECT parent, version + 1 AS version, 'queued' AS status FROM l WHERE role <> 'assistant'""")
def j15_j16_retries(spark, sf_dir):
    last = islands.latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return lifecycle.retry(last.select(F.col("conv_id").alias("parent"), F.col("turn").alias("version"), F.when(F.col("role") == "assistant", "completed").otherwise("failed").alias("status")))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def c21_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey + 50 AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def c30_g10_set_difference(spark, sf_dir):
    return relational.set_difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 50).alias("k")), "k")


@query("""WITH e AS (SELECT p_name || p_partkey AS name, sha256(p_type) AS sha FROM part WHERE p_partkey % 5 <> 0), a AS (SELECT p_name || p_partkey AS name, sha256(CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END) AS sha FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(e.name, a.name) AS name, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'added' WHEN a.sha <> e.sha THEN 'changed' ELSE 'same' END AS state FROM e FULL JOIN a ON a.name = e.name""")
def g10_g11_file_differences(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", "p_partkey"))
    expected = part.where("p_partkey % 5 <> 0").select("name", F.sha2("p_type", 256).alias("sha"))
    actual = part.where("p_partkey % 7 <> 0").select("name", F.sha2(F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_type")), 256).alias("sha"))
    return relational.file_differences(expected, actual)


@query("""WITH n AS (SELECT user_id % 40 AS page, event_id % 500 AS ref FROM events WHERE event_type = 'click'), i AS (SELECT DISTINCT event_id % 500 AS ref, user_id % 40 AS page FROM events WHERE event_type = 'view'),
a AS (SELECT ref, count(*) AS n FROM n GROUP BY ref), h AS (SELECT ref, page, count(*) AS n FROM n GROUP BY ref, page)
SELECT i.ref, i.page, CASE WHEN a.n IS NULL THEN 'missing' WHEN a.n > 1 THEN 'duplicated' WHEN h.n IS NULL THEN 'wrong_page' ELSE 'matched' END AS status FROM i LEFT JOIN a ON a.ref = i.ref LEFT JOIN h ON h.ref = i.ref AND h.page = i.page""")
def c12_c42_h56_link_status(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("page"), (F.col("event_id") % 500).alias("ref"), "event_type", "event_id")
    return relational.link_status(events.where("event_type = 'click'"), events.where("event_type = 'view'").select("ref", "page").distinct(), "ref")


@query("""WITH a AS (SELECT p_type AS t, p_partkey AS l, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_type AS t, p_partkey AS r, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1)
SELECT a.t, a.l, b.r FROM a JOIN b ON a.t = b.t AND a.k = b.k""")
def c18_kth_occurrences(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = lambda odd, name: part.where(f"p_partkey % 2 = {odd}").select(F.col("p_type").alias("t"), F.col("p_partkey").alias(name))
    return relational.kth_occurrences(side(0, "l"), side(1, "r"), "t", "l", "r")


@query("""WITH s AS (SELECT l_orderkey * 10 + min(l_linenumber) AS id, l_partkey AS p, l_suppkey AS s FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey), x AS (SELECT p_partkey AS p, p_size AS s, p_partkey * 3 AS v FROM part),
e AS (SELECT p, s, count(*) AS n, min(v) AS v FROM x GROUP BY p, s), q AS (SELECT p, count(*) AS n, min(v) AS v FROM (SELECT p, v FROM x WHERE p % 3 <> 0) GROUP BY p),
c AS (SELECT s.id, CASE WHEN e.n = 1 THEN e.v WHEN e.n IS NULL AND q.n = 1 THEN q.v END AS v, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'ambiguous' WHEN q.n = 1 THEN 'positional' WHEN q.n > 1 THEN 'ambiguous' ELSE 'missing' END AS st FROM s LEFT JOIN e ON e.p = s.p AND e.s = s.s LEFT JOIN q ON q.p = s.p)
SELECT id, v, CASE WHEN v IS NOT NULL AND count(v) OVER (PARTITION BY v) > 1 THEN 'reused' ELSE st END AS state FROM c""")
def c08_c09_unique_match(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.min("l_linenumber").alias("n")).select((F.col("l_orderkey") * 10 + F.col("n")).alias("id"), "p", "s")
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("s"), (F.col("p_partkey") * 3).alias("v"))
    return relational.unique_match(rows, ["id"], x, ["p", "s"], x.where("p % 3 <> 0").drop("s"), ["p"], "v")


@query("""WITH t AS (SELECT p_type, p_size, count(DISTINCT p_brand) AS b, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_size, n, b > 1 AS reused FROM t""")
def c44_f06_cross_reuse(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("p_brand") > 1).alias("reused"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def c23_d29_duplicate_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT role, list_sort(list(DISTINCT conv_id)) AS ids FROM conversations GROUP BY role")
def d26_d09_sorted_ids(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) SELECT conv_id, turn, s <= 1500 AS admitted FROM r""")
def a33_j02_admitted(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return protocol.admitted(rows, ["conv_id"], "turn", "n", 1500).select("conv_id", "turn", "admitted")


_SEQ = "SELECT CAST(user_id AS VARCHAR) AS stream, event_id AS seq FROM events"


def protocol_events(spark, sf_dir):
    """Events of each user as a protocol stream: progress, artifacts, and a result as the last."""
    last = F.max("event_id").over(Window.partitionBy("user_id"))
    events = table(spark, sf_dir, "events").withColumn("last", last)
    number = (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) - 1).cast("int")
    kind = F.when((F.col("event_id") == F.col("last")) | (F.col("event_id") % 97 == 0), "result").when(F.col("event_type").isin("click", "view"), "artifact").when(F.col("event_type") == "signup", "progress").when(F.col("event_id") % 53 == 0, "unknown").otherwise("progress")
    return events.select(
        F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("name"),
        F.when(F.col("event_id") % 41 == 0, number + 1).otherwise(number).alias("sequence"), F.length("props").cast("long").alias("bytes"),
        F.floor(F.col("event_id") / 2500).cast("int").alias("phase"), F.col("event_id").alias("completed"), F.lit(1_000_000_000).cast("long").alias("total"),
    )


@query()
def j01_j03_protocol(spark, sf_dir):
    return protocol.validate(protocol_events(spark, sf_dir), 400)
