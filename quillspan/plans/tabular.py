"""Queries on intervals, sequences, frames and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import align, cleaning, frames as fr, intervals as iv, metrics, sequence as sq
from quillspan.plans import views
from quillspan.plans.views import FRAMES_SQL, PRED_SQL, STEP, TRUTH_SQL
from quillspan.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


# ---- intervals -------------------------------------------------------------------------------

@query(f"""WITH {TRUTH_SQL}, {PRED_SQL} SELECT t.name AS truth_name, p.name AS pred_name, count(*) AS n, round(sum(least(t.stop_s, p.stop_s) - greatest(t.start_s, p.start_s)), 3) AS overlap_s
FROM truth t JOIN pred p ON t.recording_id = p.recording_id AND least(t.stop_s, p.stop_s) - greatest(t.start_s, p.start_s) > 1e-9::DOUBLE GROUP BY ALL""")
def interval_overlap(spark, d) -> DataFrame:
    both = iv.overlap_join(views.truth(spark, d), views.pred(spark, d))
    return both.groupBy(F.col("l_name").alias("truth_name"), F.col("r_name").alias("pred_name")).agg(F.count("*").alias("n"), F.round(F.sum("overlap_s"), 3).alias("overlap_s"))


@query(f"""WITH {TRUTH_SQL}, {PRED_SQL} SELECT t.recording_id, t.event_id AS segment, count(*) AS n FROM truth t JOIN pred p ON t.recording_id = p.recording_id
WHERE least(t.stop_s, p.stop_s) - greatest(t.start_s, p.start_s) >= 2e-2::DOUBLE AND least(t.stop_s, p.stop_s) - greatest(t.start_s, p.start_s) >= 12e-2::DOUBLE * (p.stop_s - p.start_s) GROUP BY ALL""")
def significant_overlap(spark, d) -> DataFrame:
    both = iv.overlap_join(views.truth(spark, d), views.pred(spark, d)).where("overlap_s >= 2e-2D and overlap_s >= 12e-2D * (r_stop_s - r_start_s)")
    return both.groupBy(F.col("l_recording_id").alias("recording_id"), F.col("l_event_id").alias("segment")).agg(F.count("*").alias("n"))


IOU_SQL = f"""{TRUTH_SQL}, {PRED_SQL}, q AS (SELECT t.recording_id, t.name, t.event_id AS i, p.event_id AS j, (least(t.stop_s, p.stop_s) - greatest(t.start_s, p.start_s)) / (greatest(t.stop_s, p.stop_s) - least(t.start_s, p.start_s)) AS iou
FROM truth t JOIN pred p ON t.recording_id = p.recording_id AND t.name = p.name AND least(t.stop_s, p.stop_s) - greatest(t.start_s, p.start_s) > 0), pairs AS (SELECT * FROM q WHERE iou >= 0.25)"""


@query(f"WITH {IOU_SQL} SELECT recording_id, name, i, j, round(iou, 6) AS iou FROM pairs")
def iou_pairs(spark, d) -> DataFrame:
    return iv.iou_pairs(views.truth(spark, d), views.pred(spark, d)).select("recording_id", "name", "i", "j", r6("iou"))


GREEDY_SQL = f"""{IOU_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id, name ORDER BY iou DESC, i, j) AS rn FROM pairs),
g AS (SELECT recording_id, name, i, j, iou, rn, [i] AS ui, [j] AS uj, true AS ok FROM o WHERE rn = 1
  UNION ALL SELECT o.recording_id, o.name, o.i, o.j, o.iou, o.rn,
    CASE WHEN list_contains(g.ui, o.i) OR list_contains(g.uj, o.j) THEN g.ui ELSE list_append(g.ui, o.i) END,
    CASE WHEN list_contains(g.ui, o.i) OR list_contains(g.uj, o.j) THEN g.uj ELSE list_append(g.uj, o.j) END,
    NOT (list_contains(g.ui, o.i) OR list_contains(g.uj, o.j))
  FROM g JOIN o ON o.recording_id = g.recording_id AND o.name = g.name AND o.rn = g.rn + 1), matched AS (SELECT recording_id, name, i, j, iou FROM g WHERE ok)"""


def _matched(spark, d) -> DataFrame:
    return iv.matched(views.truth(spark, d), views.pred(spark, d))


@query(f"WITH RECURSIVE {GREEDY_SQL} SELECT recording_id, name, i, j, round(iou, 6) AS iou FROM matched")
def greedy_match(spark, d) -> DataFrame:
    return _matched(spark, d).select("recording_id", "name", "i", "j", r6("iou"))


PRF_SQL = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE WHEN {micro} THEN 0 WHEN fn = 0 THEN 1 ELSE 0 END AS p0, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE WHEN {micro} THEN 0 ELSE 1 END AS r0"""
DETECT_SQL = f"""{GREEDY_SQL}, c AS (SELECT name AS label, count(*) AS nt FROM truth GROUP BY ALL), e AS (SELECT name AS label, count(*) AS np FROM pred GROUP BY ALL), m AS (SELECT name AS label, count(*) AS tp FROM matched GROUP BY ALL),
k AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(nt, 0) - coalesce(tp, 0) AS fn FROM c FULL JOIN e USING (label) LEFT JOIN m USING (label)),
u AS (SELECT *, {PRF_SQL.format(micro="false")} FROM k UNION ALL SELECT *, {PRF_SQL.format(micro="true")} FROM (SELECT '__micro__', sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k))"""


@query(f"""WITH RECURSIVE {DETECT_SQL} SELECT label, tp, fp, fn, round(p0, 6) AS precision, round(r0, 6) AS recall, round(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END, 6) AS f1 FROM u""")
def detection_prf(spark, d) -> DataFrame:
    """Per-class and micro precision, recall and F1 of the greedy one-to-one match."""
    count = lambda df, c, sign: df.groupBy(F.col("name").alias("label")).agg(F.count("*").alias("n")).select("label", F.lit(c).alias("what"), (F.col("n") * sign).alias("n"))
    parts = count(views.truth(spark, d), "t", 1).union(count(views.pred(spark, d), "p", 1)).union(count(_matched(spark, d), "m", 1))
    n = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0))
    per = parts.groupBy("label").agg(n("m").alias("tp"), (n("p") - n("m")).alias("fp"), (n("t") - n("m")).alias("fn"))
    return metrics.with_total(per)


@query(f"""WITH {TRUTH_SQL}, {PRED_SQL}, s AS (SELECT * FROM pred) SELECT recording_id, event_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.recording_id = t.recording_id AND least(t.stop_s, s.stop_s) - greatest(t.start_s, s.start_s) > 1e-9::DOUBLE)""")
def orphans(spark, d) -> DataFrame:
    """Events without any overlapping prediction."""
    return iv.overlap_join(views.truth(spark, d), views.pred(spark, d), how="left_anti").select("recording_id", "event_id")


def _times(df: DataFrame) -> DataFrame:
    return df.select("recording_id", F.col("event_id").alias("id"), F.col("start_s").alias("t"))


def _near_sql(name: str, left: str, right: str) -> str:
    """Nearest right event of each left one by whole seconds, the lowest id of equal ones, then the closest left event of each right one."""
    return f"""{name}0 AS (SELECT a.recording_id, a.event_id AS id, arg_min(b.event_id, struct_pack(d := floor(abs(b.start_s - a.start_s)), i := b.event_id)) AS near_id, min(floor(abs(b.start_s - a.start_s))) AS dist
FROM {left} a JOIN {right} b ON a.recording_id = b.recording_id GROUP BY ALL), {name} AS (SELECT * FROM {name}0 WHERE dist <= 5000),
{name}1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, near_id ORDER BY dist, id) AS rn FROM {name}) WHERE rn = 1)"""


@query(f"WITH {TRUTH_SQL}, {PRED_SQL}, {_near_sql('near', 'truth', 'pred')} SELECT recording_id, id, near_id, dist FROM near")
def nearest_match(spark, d) -> DataFrame:
    return iv.nearest(_times(views.truth(spark, d)), _times(views.pred(spark, d)), 5000.0).select("recording_id", "id", "near_id", "dist")


@query(f"""WITH {TRUTH_SQL}, {PRED_SQL}, whole AS (SELECT recording_id, event_id, floor(start_s / 3600) AS start_s FROM truth), told AS (SELECT recording_id, event_id, floor(start_s / 3600) AS start_s FROM pred),
{_near_sql('near', 'whole', 'told').replace('5000', '2')} SELECT recording_id, id, near_id, dist FROM near1""")
def nearest_ties(spark, d) -> DataFrame:
    """One-to-one matches of events by the hour, where equal times and equal distances are many."""
    hour = lambda df: _times(df).withColumn("t", F.floor(F.col("t") / 3600).cast("double"))
    near = iv.nearest(hour(views.truth(spark, d)), hour(views.pred(spark, d)), 2.0, width=24.0)
    return iv.one_to_one(near).select("recording_id", "id", "near_id", "dist")


@query(f"""WITH {TRUTH_SQL}, {PRED_SQL}, {_near_sql('pt', 'pred', 'truth')}, {_near_sql('tp', 'truth', 'pred')},
k AS (SELECT (SELECT count(*) FROM pt1) AS tp, (SELECT count(*) FROM pred) - (SELECT count(*) FROM pt1) AS fp, (SELECT count(*) FROM truth) - (SELECT count(*) FROM tp1) AS fn),
r AS (SELECT *, CASE WHEN fp = 0 THEN 1 ELSE tp / (tp + fp)::DOUBLE END AS p0, CASE WHEN fn = 0 THEN 1 ELSE tp / (tp + fn)::DOUBLE END AS r0 FROM k)
SELECT tp, fp, fn, round(p0, 6) AS precision, round(r0, 6) AS recall, round(CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END, 6) AS f1 FROM r""")
def event_prf(spark, d) -> DataFrame:
    """Event precision and recall within a tolerance; 1 where nothing is wrong."""
    return iv.event_scores(_times(views.truth(spark, d)), _times(views.pred(spark, d)), 5000.0)


@query(f"WITH {TRUTH_SQL} SELECT recording_id, event_id FROM truth WHERE start_s BETWEEN 100000 AND 500000 AND stop_s BETWEEN 100000 AND 500000")
def range_filter_strict(spark, d) -> DataFrame:
    return views.truth(spark, d).where(iv.in_range(100000.0, 500000.0)).select("recording_id", "event_id")


@query(f"WITH {TRUTH_SQL} SELECT recording_id, event_id FROM truth WHERE start_s BETWEEN 100000 AND 500000 OR stop_s BETWEEN 100000 AND 500000")
def range_filter_loose(spark, d) -> DataFrame:
    return views.truth(spark, d).where(iv.in_range(100000.0, 500000.0, strict=False)).select("recording_id", "event_id")


@query(f"WITH {TRUTH_SQL} SELECT recording_id, event_id FROM truth WHERE NOT (start_s >= 0 AND stop_s >= 0 AND start_s <= 500000 AND stop_s <= 500000)")
def range_delete(spark, d) -> DataFrame:
    return views.truth(spark, d).where(~iv.in_range(None, 500000.0)).select("recording_id", "event_id")


@query(f"WITH {TRUTH_SQL} SELECT recording_id, event_id, round(stop_s - start_s, 6) AS duration_s FROM truth WHERE stop_s - start_s >= 9000")
def min_duration(spark, d) -> DataFrame:
    return views.truth(spark, d).withColumn("duration_s", F.col("stop_s") - F.col("start_s")).where("duration_s >= 9000").select("recording_id", "event_id", r6("duration_s"))


@query("SELECT event_id, lower(trim(' ' || upper(event_type) || ' ')) AS name, replace(event_type || '_proposals', '_proposals', '') AS stripped FROM events WHERE event_type IS DISTINCT FROM 'error'")
def clean_labels(spark, d) -> DataFrame:
    raw = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("name"), F.concat("event_type", F.lit("_proposals")).alias("raw"), "event_type")
    return raw.where(~F.col("event_type").eqNullSafe("error")).select("event_id", F.lower(F.trim("name")).alias("name"), F.replace("raw", F.lit("_proposals"), F.lit("")).alias("stripped"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' WHEN 'signup' THEN 'start' ELSE event_type END AS name, event_type IN ('click', 'view', 'signup') AS changed FROM events""")
def recode_labels(spark, d) -> DataFrame:
    """Exact-match recoding in one pass: results are not recoded again."""
    from quillspan.functions.labels import recode

    new = recode(F.col("event_type"), {"click": "view", "view": "click", "signup": "start"})
    return table(spark, d, "events").select("event_id", new.alias("name"), (new != F.col("event_type")).alias("changed"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '://([^/?#.]+)\.', 1), '') AS key, nullif(regexp_extract(url, '/([0-9]+)\.html', 1), '') AS item, regexp_replace(CASE WHEN starts_with(url, 'http://www.') AND ltrim(substr(url, 12)) <> '' THEN ltrim(substr(url, 12)) ELSE url END, '[\\/:*?"<>|]', '_', 'g') AS core FROM pages""")
def extract_key(spark, d) -> DataFrame:
    from quillspan.functions.labels import file_core, group_of

    return table(spark, d, "pages").select("page_id", group_of("url", r"://([^/?#.]+)\.").alias("key"), group_of("url", r"/([0-9]+)\.html").alias("item"), file_core("url", "http://www.").alias("core"))


@query(f"WITH {TRUTH_SQL} SELECT event_id, trunc(start_s * 44100)::BIGINT AS first, trunc(stop_s * 44100 + 1)::BIGINT AS after, trunc(stop_s * 44100)::BIGINT - trunc(start_s * 44100)::BIGINT AS n FROM truth")
def sample_index(spark, d) -> DataFrame:
    from quillspan.functions.labels import to_sample

    return views.truth(spark, d).select("event_id", to_sample("start_s", 44100).alias("first"), to_sample("stop_s", 44100, plus=1).alias("after"), (to_sample("stop_s", 44100) - to_sample("start_s", 44100)).alias("n"))


@query(f"""WITH {TRUTH_SQL}, x AS (SELECT name, recording_id, event_id, CASE WHEN name = 'view' THEN start_s ELSE stop_s END AS stop_s, start_s FROM truth)
SELECT name, CASE WHEN arg_min(stop_s = start_s, event_id) THEN 'event' ELSE 'segment' END AS category, count(*) AS n FROM x GROUP BY name""")
def class_info(spark, d) -> DataFrame:
    """Names with their category: events have no length in their first row."""
    x = views.truth(spark, d).withColumn("stop_s", F.when(F.col("name") == "view", F.col("start_s")).otherwise(F.col("stop_s")))
    point = F.min_by(F.col("stop_s") == F.col("start_s"), "event_id")
    return x.groupBy("name").agg(F.when(point, "event").otherwise("segment").alias("category"), F.count("*").alias("n"))


@query(f"""WITH {TRUTH_SQL}, g AS (SELECT *, start_s - lag(start_s) OVER w AS b, lead(start_s) OVER w - start_s AS a, row_number() OVER w AS rn FROM truth WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, event_id))
SELECT recording_id, event_id FROM g WHERE rn = 1 OR NOT ((coalesce(b, 'infinity') > 40000 AND coalesce(a, 'infinity') > 40000) OR coalesce(b, 'infinity') < 2000 OR coalesce(a, 'infinity') < 2000)""")
def interval_filter(spark, d) -> DataFrame:
    rows = views.truth(spark, d).select("recording_id", F.col("event_id").alias("id"), F.col("start_s").alias("t"))
    return iv.isolated_filter(rows, 2000.0, 40000.0).select("recording_id", F.col("id").alias("event_id"))


@query("""WITH a AS (SELECT source AS recording_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), b AS (SELECT d.source AS recording_id, quality, row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id) AS rn FROM labels l JOIN documents d USING (doc_id)),
z AS (SELECT recording_id, arg_max(quality, rn) AS q FROM b GROUP BY 1) SELECT doc_id, coalesce(b.quality, z.q) AS quality FROM a LEFT JOIN b USING (recording_id, rn) LEFT JOIN z USING (recording_id)""")
def zip_join_pad(spark, d) -> DataFrame:
    """Labels joined by position within a source, the last one repeated where they run out."""
    docs = table(spark, d, "documents").select(F.col("source").alias("recording_id"), "doc_id")
    labels = table(spark, d, "labels").join(docs, "doc_id").select("recording_id", "doc_id", "quality")
    return iv.zip_padded(docs, labels, "doc_id", "doc_id", "quality").select("doc_id", "quality")


@query("""WITH f AS (SELECT doc_id % 300 AS core, source || '/' || doc_id AS path, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END AS priority FROM documents),
n AS (SELECT DISTINCT doc_id % 300 AS core FROM documents), j AS (SELECT core, path, priority, min(priority) OVER (PARTITION BY core) AS p FROM n LEFT JOIN f USING (core))
SELECT core, min(path) AS path, min(priority) AS priority, count(path) > 1 AS ambiguous FROM j WHERE priority IS NULL OR priority = p GROUP BY core""")
def file_pairing(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    found = docs.select((F.col("doc_id") % 300).alias("core"), F.concat_ws("/", "source", "doc_id").alias("path"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2).alias("priority"))
    return iv.paired(docs.select((F.col("doc_id") % 300).alias("core")).distinct(), found)


@query("""SELECT doc_id AS core, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS state FROM documents d FULL JOIN labels l USING (doc_id)""")
def file_sides(spark, d) -> DataFrame:
    """File names on both sides or one, as in the reports of a directory comparison."""
    left = table(spark, d, "documents").select(F.col("doc_id").alias("core"))
    return iv.both_sides(left, table(spark, d, "labels").select(F.col("doc_id").alias("core")), "core")


@query(f"""WITH RECURSIVE {TRUTH_SQL}, {PRED_SQL}, s AS (SELECT recording_id, event_id AS unit_id, start_s AS ts, stop_s AS te FROM truth),
m AS (SELECT recording_id, name, start_s AS ms, stop_s AS me, event_id AS o FROM pred),
j AS (SELECT s.*, name, ms, me, o, least(te, me) - greatest(ts, ms) AS ov, greatest(abs(ms - ts), abs(me - te)) AS db, abs(ms - ts) AS ds FROM s JOIN m USING (recording_id)),
a AS (SELECT recording_id, unit_id, ts, te, list(name ORDER BY ms, o) FILTER (ov >= 2e-2::DOUBLE AND ov >= 12e-2::DOUBLE * (me - ms)) AS strong, list(name ORDER BY ms, o) FILTER (ov > -1e-9::DOUBLE) AS touch,
  min(db) AS db, arg_min(name, struct_pack(a := db, b := ms, c := o)) AS nb, min(ds) AS ds, arg_min(name, struct_pack(a := ds, b := ms, c := o)) AS ns FROM j GROUP BY ALL)
SELECT s.recording_id, s.unit_id, CASE WHEN len(strong) >= 2 THEN strong[1] WHEN db <= 0.2 THEN nb WHEN ds <= 0.2 THEN ns WHEN len(touch) > 0 THEN touch[1] ELSE '' END AS label,
  CASE WHEN len(strong) >= 2 THEN 'merged' WHEN db <= 0.2 THEN 'both' WHEN ds <= 0.2 THEN 'start' WHEN len(touch) > 0 THEN 'overlap' ELSE 'none' END AS rule,
  CASE WHEN len(strong) >= 2 THEN len(strong) - 1 ELSE 0 END AS n_missed FROM s LEFT JOIN a USING (recording_id, unit_id)""")
def label_align(spark, d) -> DataFrame:
    """Labels by the cascade for every segment; the remark's count is compared for merged segments."""
    seg = views.truth(spark, d).select("recording_id", F.col("event_id").alias("unit_id"), "start_s", "stop_s")
    out = align.align_labels(seg, views.pred(spark, d).withColumn("ord", F.col("event_id")))
    return out.select("recording_id", "unit_id", "label", "rule", F.when(F.col("rule") == "merged", align.missed_in(F.col("remark"))).otherwise(0).alias("n_missed"))


@query(f"""WITH {TRUTH_SQL}, x AS (SELECT recording_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'miss a b' WHEN event_id % 5 = 1 THEN 'less x' ELSE '' END AS remark FROM truth),
c AS (SELECT recording_id, count(*) AS m, sum(CASE WHEN remark LIKE 'miss%' THEN 2 WHEN remark LIKE 'less%' THEN 1 ELSE 0 END) AS r, count(*) FILTER (event_id % 10 = 3) AS e, count(*) FILTER (event_id % 20 = 7) AS o FROM x GROUP BY recording_id),
u AS (SELECT * FROM c UNION ALL SELECT NULL, sum(m), sum(r), sum(e), sum(o) FROM c)
SELECT recording_id, m::BIGINT AS n_manual, r::BIGINT AS n_remark, e::BIGINT AS n_empty, o::BIGINT AS n_orphan, (r + e + o)::BIGINT AS n_missed, round((r + e + o) / m::DOUBLE, 6) AS ratio FROM u""")
def align_stats(spark, d) -> DataFrame:
    """Missed-syllable statistics with a grand total row."""
    x = views.truth(spark, d).withColumn("remark", F.when(F.col("event_id") % 5 == 0, "miss a b").when(F.col("event_id") % 5 == 1, "less x").otherwise(""))
    return align.alignment_stats(x, x, x.where("event_id % 20 = 7"), x.where("event_id % 10 = 3"))


# ---- sequences -------------------------------------------------------------------------------

RUNS_SQL = f"""{TRUTH_SQL}, f AS (SELECT *, CASE WHEN name = lag(name) OVER w THEN 0 ELSE 1 END AS f FROM truth WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY recording_id ORDER BY start_s, event_id) AS run FROM f), runs AS (SELECT recording_id, run, any_value(name) AS name, count(*) AS n FROM s GROUP BY ALL)"""


def _runs(spark, d) -> DataFrame:
    return sq.run_array(sq.runs(views.truth(spark, d), ["recording_id"], ["start_s", "event_id"]), ["recording_id"])


@query(f"WITH {RUNS_SQL} SELECT recording_id, string_agg(name || '(' || n || ')', '-' ORDER BY run) AS pattern FROM runs GROUP BY recording_id")
def rle_pattern(spark, d) -> DataFrame:
    return _runs(spark, d).select("recording_id", sq.pattern(F.col("rs")).alias("pattern"))


@query(f"""WITH RECURSIVE {RUNS_SQL}, p AS (SELECT *, lead(name) OVER (PARTITION BY recording_id ORDER BY run) AS nx FROM runs), q AS (SELECT *, (name, nx) IN (('click', 'view'), ('view', 'error')) AS pair FROM p),
w AS (SELECT recording_id, run, name, nx, n, pair, pair AS used, false AS skipped FROM q WHERE run = 1 UNION ALL
  SELECT q.recording_id, q.run, q.name, q.nx, q.n, q.pair, (q.pair AND NOT w.used), w.used FROM w JOIN q ON q.recording_id = w.recording_id AND q.run = w.run + 1)
SELECT recording_id, string_agg(CASE WHEN used THEN '(' || name || '-' || nx || ')(1)' ELSE name || '(' || n || ')' END, '-' ORDER BY run) AS pattern FROM w WHERE NOT skipped GROUP BY recording_id""")
def pair_compress(spark, d) -> DataFrame:
    return _runs(spark, d).select("recording_id", sq.merged_pairs(F.col("rs"), [("click", "view"), ("view", "error")]).alias("pattern"))


NEXT_SQL = f"{TRUTH_SQL}, nx AS (SELECT *, lead(name) OVER w AS next_name, lead(start_s) OVER w - stop_s AS gap_s FROM truth WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, event_id))"


def _next(spark, d) -> DataFrame:
    return sq.with_next(views.truth(spark, d), ["recording_id"], ["start_s", "event_id"])


@query(f"WITH {NEXT_SQL} SELECT CASE WHEN recording_id % 2 = 0 THEN 'Young' ELSE 'Old' END AS age, name, next_name, count(*) AS n, round(avg(gap_s), 6) AS mean_gap FROM nx WHERE gap_s >= 0 GROUP BY ALL")
def transitions(spark, d) -> DataFrame:
    age = F.when(F.col("recording_id") % 2 == 0, "Young").otherwise("Old")
    return _next(spark, d).where("gap_s >= 0").groupBy(age.alias("age"), "name", "next_name").agg(F.count("*").alias("n"), F.round(F.avg("gap_s"), 6).alias("mean_gap"))


@query(f"WITH {NEXT_SQL} SELECT name, count(*) AS n, round(avg(gap_s), 6) AS mean_gap FROM nx WHERE gap_s >= 0 AND name = next_name GROUP BY ALL")
def repeat_gaps(spark, d) -> DataFrame:
    return _next(spark, d).where("gap_s >= 0 and name = next_name").groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("gap_s"), 6).alias("mean_gap"))


@query(f"WITH {TRUTH_SQL} SELECT recording_id, round(max(stop_s) - min(start_s), 6) AS length_s, count(*) AS n, count(DISTINCT name) AS n_names, round(avg(stop_s - start_s), 6) AS mean_s FROM truth GROUP BY 1")
def song_summary(spark, d) -> DataFrame:
    return views.truth(spark, d).groupBy("recording_id").agg(F.round(F.max("stop_s") - F.min("start_s"), 6).alias("length_s"), F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.round(F.avg(F.col("stop_s") - F.col("start_s")), 6).alias("mean_s"))


@query(f"""WITH {TRUTH_SQL} SELECT name, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max
FROM (SELECT name, stop_s - start_s AS x FROM truth) GROUP BY name""")
def syllable_describe(spark, d) -> DataFrame:
    return sq.described(views.truth(spark, d).withColumn("x", F.col("stop_s") - F.col("start_s")), ["name"], "x")


@query(f"""WITH {TRUTH_SQL} SELECT name, round(avg(stop_s - start_s) FILTER (recording_id % 2 = 1), 6) AS old_mean, round(avg(stop_s - start_s) FILTER (recording_id % 2 = 0), 6) AS young_mean,
round(avg(stop_s - start_s) FILTER (recording_id % 2 = 1) - avg(stop_s - start_s) FILTER (recording_id % 2 = 0), 6) AS difference FROM truth GROUP BY name""")
def age_mean_difference(spark, d) -> DataFrame:
    x, old = F.col("stop_s") - F.col("start_s"), F.col("recording_id") % 2 == 1
    a, b = F.avg(F.when(old, x)), F.avg(F.when(~old, x))
    return views.truth(spark, d).groupBy("name").agg(F.round(a, 6).alias("old_mean"), F.round(b, 6).alias("young_mean"), F.round(a - b, 6).alias("difference"))


@query(f"""WITH {TRUTH_SQL}, g AS (SELECT recording_id // 2 AS pair, list(DISTINCT name) FILTER (recording_id % 2 = 1) AS o, list(DISTINCT name) FILTER (recording_id % 2 = 0) AS y FROM truth GROUP BY 1)
SELECT pair, array_to_string(list_sort(list_filter(coalesce(o, []), lambda x: NOT list_contains(coalesce(y, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(y, []), lambda x: NOT list_contains(coalesce(o, []), x))), ',') AS missing FROM g""")
def age_set_difference(spark, d) -> DataFrame:
    """Labels that one age group of a pair has and the other lacks."""
    old = F.col("recording_id") % 2 == 1
    g = views.truth(spark, d).groupBy(F.floor(F.col("recording_id") / 2).alias("pair")).agg(F.collect_set(F.when(old, F.col("name"))).alias("o"), F.collect_set(F.when(~old, F.col("name"))).alias("y"))
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return g.select("pair", text("o", "y").alias("added"), text("y", "o").alias("missing"))


EDIT_SQL = """WITH c AS (SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'A' WHEN 'system' THEN 'S' WHEN 'tool' THEN 'T' WHEN 'user' THEN 'U' ELSE '?' END, '' ORDER BY turn, text) AS s FROM conversations GROUP BY 1),
p AS (SELECT c.conv_id, c.s, e.s AS nx FROM c JOIN c e ON e.conv_id = c.conv_id + 1) SELECT conv_id, levenshtein(s, nx) AS distance, round(levenshtein(s, nx) / len(s)::DOUBLE, 6) AS rate FROM p"""


@query(EDIT_SQL)
def edit_distance(spark, d) -> DataFrame:
    """Edit distance over whole labels between neighbouring conversations, and the error rate."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))), lambda x: x["role"]).alias("names"))
    coded = rows.select("conv_id", sq.as_letters(F.col("names"), ["assistant", "system", "tool", "user"]).alias("s"))
    both = coded.join(coded.select((F.col("conv_id") - 1).alias("conv_id"), F.col("s").alias("nx")), "conv_id")
    return both.select("conv_id", F.levenshtein("s", "nx").alias("distance"), F.round(sq.error_rate(F.col("s"), F.col("nx")), 6).alias("rate"))


@query("""SELECT event_type AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS unit_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events GROUP BY 1""")
def label_encode(spark, d) -> DataFrame:
    """Class counts, ordinals by frequency, and codes in alphabetical order."""
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return n.select("name", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "name")) - 1).alias("unit_id"), (F.dense_rank().over(Window.orderBy("name")) - 1).alias("code"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2), t AS (SELECT 'all' AS kind, NULL AS user_id, event_type, sum(n)::BIGINT AS n, NULL AS mean FROM n GROUP BY event_type)
SELECT 'user' AS kind, user_id, event_type, n, mean FROM n UNION ALL SELECT * FROM t""")
def append_summary(spark, d) -> DataFrame:
    """Group rows with appended summary rows, columns missing on one side left null."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return n.withColumn("kind", F.lit("user")).unionByName(n.groupBy("event_type").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("all")), allowMissingColumns=True).select("kind", "user_id", "event_type", "n", "mean")


NAN_SQL = f"""{TRUTH_SQL}, holes AS (SELECT recording_id, event_id, CASE WHEN name = 'error' THEN 'NaN'::DOUBLE ELSE start_s END AS start_s, CASE WHEN name IN ('error', 'view') AND recording_id % 2 = 0 THEN 'NaN'::DOUBLE WHEN name = 'click' THEN 'infinity'::DOUBLE WHEN name = 'signup' THEN NULL ELSE stop_s END AS stop_s,
CASE WHEN name = 'view' THEN -1 WHEN name = 'error' THEN NULL ELSE recording_id % 3 END AS channel FROM truth)"""


def _holes(spark, d) -> DataFrame:
    """Events with missing and infinite times and marked channels."""
    nan, name = F.lit(float("nan")), F.col("name")
    start = F.when(name == "error", nan).otherwise(F.col("start_s"))
    stop = F.when(name.isin("error", "view") & (F.col("recording_id") % 2 == 0), nan).when(name == "click", float("inf")).when(name != "signup", F.col("stop_s"))
    channel = F.when(name == "view", -1).when(name != "error", F.col("recording_id") % 3)
    return views.truth(spark, d).select("recording_id", "event_id", start.alias("start_s"), stop.alias("stop_s"), channel.alias("channel"))


@query(f"WITH {NAN_SQL} SELECT event_id, channel FROM holes WHERE channel IS DISTINCT FROM -1")
def without_channel(spark, d) -> DataFrame:
    """Rows whose fifth column is not the mark of no channel."""
    return cleaning.without_value(_holes(spark, d), 4, -1).select("event_id", "channel")


@query(f"WITH {NAN_SQL}, m AS (SELECT event_id, start_s IS NULL OR isnan(start_s) AS a, stop_s IS NULL OR isnan(stop_s) AS b FROM holes) SELECT event_id, NOT (a OR b) AS whole FROM m WHERE NOT (a AND b)")
def without_missing(spark, d) -> DataFrame:
    """Rows in which not all times are missing, marked where none is."""
    rows = _holes(spark, d)
    whole = cleaning.without_missing(rows, ["start_s", "stop_s"]).select("event_id", F.lit(True).alias("whole"))
    return cleaning.without_missing(rows, ["start_s", "stop_s"], "all").select("event_id").join(whole, "event_id", "left").select("event_id", F.coalesce("whole", F.lit(False)).alias("whole"))


@query(f"WITH {NAN_SQL} SELECT channel, count(*) AS n, round(avg(stop_s), 6) AS mean_stop FROM holes WHERE isfinite(stop_s) AND isfinite(start_s) GROUP BY 1")
def finite_only(spark, d) -> DataFrame:
    rows = _holes(spark, d).where(cleaning.finite("stop_s") & cleaning.finite("start_s"))
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("stop_s"), 6).alias("mean_stop"))


@query(f"WITH {TRUTH_SQL}, r AS (SELECT recording_id, event_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, event_id) - 1 AS k FROM truth) SELECT recording_id, event_id FROM r WHERE k % 7 = 0")
def every_nth(spark, d) -> DataFrame:
    return cleaning.every_nth(views.truth(spark, d), ["recording_id"], ["start_s", "event_id"], 7).select("recording_id", "event_id")


@query(f"""WITH {TRUTH_SQL}, x AS (SELECT CASE WHEN recording_id % 2 = 0 THEN 'Young' ELSE 'Old' END AS age, name, stop_s - start_s AS x, CASE WHEN name <> 'click' OR recording_id % 2 = 0 THEN 500 + event_id % 300 END AS f0 FROM truth),
a AS (SELECT age, name, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM x GROUP BY ALL), b AS (SELECT age, name, round(avg(f0), 6) AS f0_mean FROM x WHERE f0 IS NOT NULL GROUP BY ALL)
SELECT age, name, n, mean, std, f0_mean FROM a LEFT JOIN b USING (age, name)""")
def pitch_by_group(spark, d) -> DataFrame:
    """Duration statistics of each age and name with the mean pitch beside them, where one was measured."""
    age = F.when(F.col("recording_id") % 2 == 0, "Young").otherwise("Old")
    x = views.truth(spark, d).select("recording_id", age.alias("age"), "name", (F.col("stop_s") - F.col("start_s")).alias("x"), "event_id")
    pitch = x.where((F.col("name") != "click") | (F.col("recording_id") % 2 == 0)).select("age", "name", (500 + F.col("event_id") % 300).alias("f0_hz"))
    return sq.with_pitch(sq.described(x, ["age", "name"], "x"), pitch, ["age", "name"]).select("age", "name", "n", "mean", "std", "f0_mean")


@query(f"""WITH {TRUTH_SQL}, s AS (SELECT recording_id, CASE WHEN recording_id % 2 = 0 THEN 'Young' ELSE 'Old' END AS age, max(stop_s) - min(start_s) AS l FROM truth GROUP BY 1), m AS (SELECT avg(l) FILTER (age = 'Old') AS o, avg(l) FILTER (age = 'Young') AS y FROM s)
SELECT age, recording_id::VARCHAR AS file, round(l, 3) AS song_length FROM s UNION ALL SELECT 'Old', 'Average', round(o, 3) FROM m UNION ALL SELECT 'Young', 'Average', round(y, 3) FROM m UNION ALL SELECT 'Diff(Young-Old)', 'Average_Song_Length_Diff', round(y - o, 3) FROM m""")
def age_report(spark, d) -> DataFrame:
    """Song lengths with the groups' averages and their difference below them."""
    age = F.when(F.col("recording_id") % 2 == 0, "Young").otherwise("Old")
    songs = views.truth(spark, d).groupBy("recording_id", age.alias("age")).agg((F.max("stop_s") - F.min("start_s")).alias("song_length"))
    return sq.age_report(songs.select("age", F.col("recording_id").cast("string").alias("file"), "song_length"))


# ---- frames ----------------------------------------------------------------------------------

@query(f"""WITH {TRUTH_SQL}, x AS (SELECT DISTINCT recording_id, name, unnest(range(trunc(start_s / 600)::BIGINT, trunc(stop_s / 600 + 1)::BIGINT)) AS frame FROM truth) SELECT recording_id, name, count(*) AS n, min(frame) AS lo, max(frame) AS hi FROM x GROUP BY ALL""")
def rasterise(spark, d) -> DataFrame:
    return fr.raster(views.truth(spark, d), STEP).groupBy("recording_id", "name").agg(F.count("*").alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi"))


STAB_SQL = f"""{TRUTH_SQL}, {PRED_SQL}, e AS (SELECT recording_id, max(stop_s) AS t FROM (SELECT recording_id, stop_s FROM truth UNION ALL SELECT recording_id, stop_s FROM pred) GROUP BY 1),
sp AS (SELECT recording_id, unnest(range(greatest(ceil((CASE WHEN t > 0 THEN t ELSE 1 END) / 600 - 0.5), 0)::BIGINT)) AS frame FROM e),
st AS (SELECT recording_id, frame, arg_max(name, struct_pack(a := start_s, b := event_id)) AS name FROM (SELECT recording_id, name, start_s, event_id, unnest(range(greatest(ceil(start_s / 600 - 0.5)::BIGINT, 0), ceil(stop_s / 600 - 0.5)::BIGINT)) AS frame FROM truth) GROUP BY 1, 2),
pt AS (SELECT recording_id, frame, arg_max(name, struct_pack(a := start_s, b := event_id)) AS name FROM (SELECT recording_id, name, start_s, event_id, unnest(range(greatest(ceil(start_s / 600 - 0.5)::BIGINT, 0), ceil(stop_s / 600 - 0.5)::BIGINT)) AS frame FROM pred) GROUP BY 1, 2),
fl AS (SELECT recording_id, frame, coalesce(st.name, '__SIL__') AS t, coalesce(pt.name, '__SIL__') AS p FROM sp LEFT JOIN st USING (recording_id, frame) LEFT JOIN pt USING (recording_id, frame)), cm AS (SELECT t, p, count(*) AS n FROM fl GROUP BY ALL)"""


def _pieces(spark, d) -> DataFrame:
    return fr.pieces({"t": views.truth(spark, d), "p": views.pred(spark, d)}, STEP)


@query(f"WITH {STAB_SQL} SELECT recording_id, t AS name, count(*) AS n, sum(frame)::BIGINT AS total FROM fl GROUP BY ALL")
def stab_join(spark, d) -> DataFrame:
    frames = ((2 * F.col("first") + F.col("n") - 1) * F.col("n") / 2).cast("long")  # the sum of a piece's frame numbers
    return _pieces(spark, d).groupBy("recording_id", F.col("t").alias("name")).agg(F.sum("n").alias("n"), F.sum(frames).alias("total"))


@query(f"WITH {STAB_SQL}, l AS (SELECT t AS x FROM cm UNION SELECT p FROM cm) SELECT a.x AS t, b.x AS p, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN cm ON cm.t = a.x AND cm.p = b.x")
def frame_confusion(spark, d) -> DataFrame:
    return metrics.dense_confusion(metrics.confusion(_pieces(spark, d), weight="n"))


FRAME_PRF_SQL = f"""{STAB_SQL}, l AS (SELECT t AS label FROM cm UNION SELECT p FROM cm), k AS (SELECT label, coalesce((SELECT sum(n) FROM cm WHERE t = label AND p = label), 0)::BIGINT AS tp, coalesce((SELECT sum(n) FROM cm WHERE p = label AND t <> label), 0)::BIGINT AS fp, coalesce((SELECT sum(n) FROM cm WHERE t = label AND p <> label), 0)::BIGINT AS fn FROM l),
u AS (SELECT *, {PRF_SQL.format(micro="false")} FROM k), v AS (SELECT label, tp, fp, fn, tp + fn AS support, round(p0, 6) AS precision, round(r0, 6) AS recall, round(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END, 6) AS f1 FROM u)"""


@query(f"WITH {FRAME_PRF_SQL} SELECT * FROM v")
def frame_prf(spark, d) -> DataFrame:
    return metrics.prf(metrics.from_confusion(metrics.confusion(_pieces(spark, d), weight="n")))


@query(f"WITH {FRAME_PRF_SQL} SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1) FILTER (label <> '__SIL__'), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM v")
def frame_summary(spark, d) -> DataFrame:
    return metrics.summary(frame_prf(spark, d), exclude=fr.SILENCE)


ISLE_SQL = f"""{TRUTH_SQL}, {FRAMES_SQL}, g AS (SELECT recording_id, name, frame, frame - row_number() OVER (PARTITION BY recording_id, name ORDER BY frame) AS k FROM frames),
isles AS (SELECT recording_id, name, min(frame) AS first, max(frame) AS last, count(*) AS n FROM g GROUP BY recording_id, name, k), edges AS (SELECT recording_id, min(frame) AS lo, max(frame) AS hi FROM frames GROUP BY 1)"""
KEYS = ["recording_id", "name"]


def _isles(spark, d) -> tuple[DataFrame, DataFrame]:
    f = views.frames(spark, d)
    return fr.islands(f, KEYS), f.groupBy("recording_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))


@query(f"WITH {ISLE_SQL} SELECT recording_id, name, first, last, n FROM isles")
def islands(spark, d) -> DataFrame:
    return _isles(spark, d)[0].select(*KEYS, "first", "last", "n")


def _bridge_sql(test: str, edge: str) -> str:
    return f"""WITH {ISLE_SQL}, t AS (SELECT i.*, {edge} AS touch FROM isles i JOIN edges USING (recording_id)), h AS (SELECT *, CASE WHEN first - lag(last) OVER w - 1 {test} AND NOT touch AND NOT lag(touch) OVER w THEN 0 ELSE 1 END AS f FROM t WINDOW w AS (PARTITION BY recording_id, name ORDER BY first)),
s AS (SELECT *, sum(f) OVER (PARTITION BY recording_id, name ORDER BY first) AS k FROM h) SELECT recording_id, name, min(first) AS first, max(last) AS last, max(last) - min(first) + 1 AS n FROM s GROUP BY recording_id, name, k"""


@query(_bridge_sql("< 8", "first <= lo OR last >= hi"))
def fill_gaps(spark, d) -> DataFrame:
    runs, edges = _isles(spark, d)
    joined = edges.join(runs.select(*KEYS).distinct(), "recording_id")
    return fr.bridged(runs, KEYS, 8, False, joined).select(*KEYS, "first", "last", "n")


@query(_bridge_sql("<= 8", "false"))
def bridge_gaps(spark, d) -> DataFrame:
    return fr.bridged(_isles(spark, d)[0], KEYS, 8, True).select(*KEYS, "first", "last", "n")


@query(f"WITH {ISLE_SQL} SELECT recording_id, name, first, last, n FROM isles JOIN edges USING (recording_id) WHERE n >= 6 OR first <= lo OR last >= hi")
def remove_short(spark, d) -> DataFrame:
    runs, edges = _isles(spark, d)
    return fr.long_enough(runs, ["recording_id"], 6, edges).select(*KEYS, "first", "last", "n")


@query(f"WITH {ISLE_SQL} SELECT recording_id, name, round(first * 600::DOUBLE, 6) AS start_s, round(last * 600::DOUBLE, 6) AS stop_s, round((last + 1) * 600::DOUBLE, 6) AS after_s FROM isles")
def runs_to_segments(spark, d) -> DataFrame:
    out = fr.seconds(_isles(spark, d)[0], 1 / 600.0)
    return out.select(*KEYS, r6("start_s"), r6("stop_s"), F.round((F.col("last") + 1) * 600.0, 6).alias("after_s"))


@query(f"""WITH {TRUTH_SQL}, {FRAMES_SQL}, s AS (SELECT recording_id, event_id AS span_id, floor(start_s / 600)::BIGINT AS first, floor(stop_s / 600)::BIGINT + 40 AS last FROM truth),
v AS (SELECT recording_id, span_id, name, count(*) AS n FROM s JOIN frames USING (recording_id) WHERE frame >= first AND frame < greatest(first + 1, last) GROUP BY ALL)
SELECT recording_id, span_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, span_id ORDER BY n DESC, name) AS r FROM v) WHERE r = 1""")
def majority_label(spark, d) -> DataFrame:
    """A label for every interval."""
    s = views.truth(spark, d).select("recording_id", F.col("event_id").alias("span_id"), F.floor(F.col("start_s") / 600).alias("first"), (F.floor(F.col("stop_s") / 600) + 40).alias("last"))
    return fr.majority(views.frames(spark, d), s, ["recording_id"])


PROB_SQL = """x AS (SELECT user_id AS recording_id, event_id // 5 AS frame, dense_rank() OVER (ORDER BY event_type) - 1 AS idx, sum(value) AS v FROM events GROUP BY user_id, event_id // 5, event_type), y AS (SELECT *, CASE WHEN sum(v) OVER (PARTITION BY frame) = 0 THEN 1 / 5::DOUBLE ELSE v / sum(v) OVER (PARTITION BY frame) END AS p0 FROM (SELECT frame, idx, sum(CASE WHEN frame % 97 = 0 THEN 0 ELSE v END) AS v FROM x GROUP BY ALL)),
probs AS (SELECT frame, idx, round(p0, 9) AS p FROM y)"""


def _probs(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("frame"), "event_type", "value")
    code = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
    idx = F.element_at(F.create_map(*(F.lit(x) for kv in code.items() for x in kv)), F.col("event_type"))
    v = e.groupBy("frame", idx.alias("idx")).agg(F.sum(F.when(F.col("frame") % 97 == 0, 0.0).otherwise(F.col("value"))).alias("v"))
    return fr.normalised(v, ["frame"], "v", 5).withColumn("p", F.round("p", 9))


@query(f"WITH {PROB_SQL} SELECT frame, idx, round(p, 6) AS p FROM probs")
def normalise_probs(spark, d) -> DataFrame:
    return _probs(spark, d).select("frame", "idx", r6("p"))


@query(f"WITH {PROB_SQL} SELECT frame, arg_max(idx, struct_pack(a := p, b := -idx)) AS label, max(p) >= 0.5 AS active FROM probs GROUP BY 1")
def prob_to_label(spark, d) -> DataFrame:
    p = _probs(spark, d)
    return fr.best_class(p, ["frame"]).join(p.groupBy("frame").agg((F.max("p") >= 0.5).alias("active")), "frame")


@query(f"WITH {PROB_SQL} SELECT frame, coalesce(min(CASE WHEN p > 0.3 THEN idx END), 0) AS label FROM probs GROUP BY 1")
def prob_threshold(spark, d) -> DataFrame:
    return fr.first_above(_probs(spark, d), ["frame"], 0.3)


@query("SELECT event_type AS name, count(*) AS n, round(sum(count(*)) OVER () / count(*), 6) AS weight FROM events GROUP BY 1")
def class_weights(spark, d) -> DataFrame:
    return fr.class_weights(table(spark, d, "events"), "event_type").select(F.col("event_type").alias("name"), "n", r6("weight"))


@query()
def peaks(spark, d) -> DataFrame:
    """Maxima of each signal, at least five samples apart."""
    return sq.peaks(views.samples(spark, d), ["recording_id"], "n", "x", 0.05, 5).select("recording_id", "n", r6("x"))


@query("""SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL""")
def label_confusion(spark, d) -> DataFrame:
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")
