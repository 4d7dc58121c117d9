"""Registered queries over the given tables and the SQL that checks them.

Users stand for tracks, their events in time order for beats, ``value`` for loudness; an
embedding is a quantum's vector, its label the track and vec_id the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions import columns as C
from strophe.operators import beatgrids, cache, checks, contracts, corrections, escape, evidence, folds, frames, graph, grids, hierarchy, hybrid, joins, neighbours, resample, segments, settings, summaries, timeline, tracker, walk
from strophe.plans.tables import settled
from strophe.sources import audio, exports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_BEATS = """b AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 1e6 AS start,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS which FROM events)"""
_QUANTA = """q AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS which, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT label, count(*) AS n FROM q GROUP BY label)"""
_RAW = _QUANTA + """,
p AS (SELECT a.label, a.which AS src, b.which AS dst, 50 * list_distance(a.v, b.v) AS distance FROM q a JOIN q b ON a.label = b.label
  AND a.which % 4 = b.which % 4 AND a.which <> b.which WHERE 50 * list_distance(a.v, b.v) < 80)"""
#: Structural marks of every pair: j the jump, sh short, sp same place in the bar, ch section change, bo boundary,
#: ga reach gain, lo short local risk, lp local loop risk, p0 penalty, b0 bonus, ev evidence.
_SCORED = _RAW + """,
sx AS (SELECT p.*, n, abs(dst - src) AS j, src // 4 AS sb, dst // 4 AS db FROM p JOIN s USING (label)),
sf AS (SELECT *, j < 16 AS sh, src % 4 = dst % 4 AS sp, sb // 8 <> db // 8 AS ch, sb % 8 IN (0, 7) OR db % 8 IN (0, 7) AS bo, j >= greatest(16, floor(n / 2)) AS ga FROM sx),
sg AS (SELECT *, sh AND NOT ch AND NOT bo AND NOT ga AS lo FROM sf),
sh_ AS (SELECT *, lo AND (sb // 4 = db // 4 OR sb // 8 = db // 8) AS lp FROM sg),
si AS (SELECT *, CASE WHEN j < 4 THEN 35 WHEN sh THEN 18 ELSE 0 END + CASE WHEN sp THEN 0 WHEN sh THEN 18 ELSE 8 END + CASE WHEN sb % 4 <> db % 4 AND sh THEN 8 ELSE 0 END
    + CASE WHEN lo THEN 28 ELSE 0 END + CASE WHEN lp THEN 18 ELSE 0 END AS p0,
  CASE WHEN NOT sh AND j >= 32 THEN 12 ELSE 0 END + CASE WHEN sp AND sh THEN 4 WHEN sp THEN 8 ELSE 0 END + CASE WHEN sb % 4 = db % 4 THEN 3 ELSE 0 END + CASE WHEN sb % 8 = db % 8 THEN 3 ELSE 0 END
    + CASE WHEN sb % 16 = db % 16 AND j >= 32 THEN 3 ELSE 0 END + CASE WHEN ch THEN 12 ELSE 0 END + CASE WHEN bo THEN 8 ELSE 0 END + CASE WHEN ga THEN 8 ELSE 0 END + CASE WHEN distance <= 8 THEN 4 ELSE 0 END AS b0,
  (ch OR bo OR ga) AND sp AND NOT lp AS ev FROM sh_),
sc AS (SELECT *, greatest(0, p0 - least(p0, b0)) AS penalty, distance + greatest(0, p0 - least(p0, b0)) AS score,
  (j < 4 AND NOT (ev AND distance <= 8)) OR (j >= 4 AND sh AND lo AND NOT ev) AS rejected FROM si)"""
_PAIRS = _SCORED + """,
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY distance, penalty, lp, lo, j DESC, dst) AS rank FROM sc
  WHERE NOT rejected AND EXISTS (SELECT 1 FROM p y WHERE y.label = sc.label AND y.src = sc.src + 1 AND y.dst = sc.dst + 1)) WHERE rank <= 4)"""
_EDGES = _PAIRS + """,
c AS (SELECT label, x, count(*) AS c FROM (SELECT label, src, min(distance) AS d FROM k GROUP BY label, src), (SELECT unnest(range(10, 80, 5)) AS x) WHERE d <= x GROUP BY label, x),
t AS (SELECT s.label, coalesce(min(x), 80) AS reported, coalesce(min(x), 75) AS applied FROM s LEFT JOIN c ON c.label = s.label AND c.c >= s.n / 6 GROUP BY s.label),
e AS (SELECT label, src, dst, distance, score, ch, bo, lo, lp FROM k JOIN t USING (label) WHERE distance <= applied)"""
_STEP = _EDGES + """,
m AS (SELECT q.label, q.which, least(q.which, min(d.dst)) AS m FROM q LEFT JOIN e d ON d.label = q.label AND d.src >= q.which GROUP BY q.label, q.which),
w AS (SELECT label, which, which AS pos FROM q UNION SELECT w.label, w.which, m.m FROM w JOIN m ON m.label = w.label AND m.which = w.pos),
r AS (SELECT label, which, n, min(pos) AS earliest, n - min(pos) AS reach FROM w JOIN s USING (label) GROUP BY label, which, n)"""
_LAST = _STEP + """,
u AS (SELECT r.*, (reach - (n - which)) * 100.0 / n AS share FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.label = r.label AND e.src = r.which)),
l AS (SELECT s.label, coalesce(max(which) FILTER (share >= 50 AND share > 0), arg_max(which, {'share': share, 'which': which}) FILTER (share > 0), 0) AS last
  FROM s LEFT JOIN u USING (label) GROUP BY s.label)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", C.seconds("ts").alias("start"))
    return timeline.navigation(rows, "user_id", ["start", "event_id"], "start")


def quanta(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = timeline.navigation(rows.withColumn("at", F.col("vec_id").cast("double")), "label", ["vec_id"], "at")
    return rows.withColumn("index_in_parent", F.col("which") % 4)


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def similarity_graph(spark, sf_dir: str):
    """quanta, sizes, neighbours, thresholds and edges of the embeddings."""
    q = quanta(spark, sf_dir)
    n = sizes(q)
    found = neighbours.nearest(q, n, "label", "v", 50.0, 80.0, 4)
    scored = graph.structural_score(found, n, "label")
    near = settled(graph.top_neighbours(scored, "label", 4), "neighbours")
    thresholds = settled(graph.threshold_sweep(near, n, "label"), "thresholds")
    return q, n, near, thresholds, graph.edges_at_threshold(near, thresholds, "label")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in names})


@query(f"""WITH {_BEATS} SELECT event_id, which, CASE WHEN which > 0 THEN which - 1 END AS prev,
  CASE WHEN lead(start) OVER w IS NOT NULL THEN which + 1 END AS next,
  round(coalesce(CASE WHEN lead(start) OVER w - start > 0 THEN lead(start) OVER w - start END, CASE WHEN start - lag(start) OVER w > 0 THEN start - lag(start) OVER w END, 0.5), 6) AS duration
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)""")
def quantum_navigation(spark, sf_dir):
    return rounded(beats(spark, sf_dir).select("event_id", "which", "prev", "next", "duration"), "duration")


def purchase_spans(rows: DataFrame) -> DataFrame:
    """Spans from one purchase of a user to the next, the last one open for an hour."""
    own = timeline.navigation(rows.where("event_type = 'purchase'").select("user_id", "event_id", "start"), "user_id", ["start", "event_id"], "start", 3600.0)
    end = F.coalesce(F.lead("start").over(timeline.Window.partitionBy("user_id").orderBy("which")), F.col("start") + 3600.0)
    return own.select("user_id", "which", "start", end.alias("end"))


_SPANS = """p AS (SELECT user_id, row_number() OVER w - 1 AS pw, start AS ps, coalesce(lead(start) OVER w, start + 3600.0) AS pe FROM b
  WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id))"""


@query(f"""WITH {_BEATS}, {_SPANS} SELECT event_id, pw AS parent, CASE WHEN pw IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY b.user_id, pw ORDER BY start, which) - 1 END AS index_in_parent
  FROM b LEFT JOIN p ON b.user_id = p.user_id AND start >= ps AND start < pe""")
def containment_join(spark, sf_dir):
    rows = beats(spark, sf_dir)
    return joins.containment(rows.select("user_id", "event_id", "start", "which"), purchase_spans(rows), "user_id").select("event_id", "parent", "index_in_parent")


@query(f"""WITH {_BEATS} SELECT l.event_id, (SELECT min(r.event_id) FROM b r WHERE r.user_id = l.user_id AND r.event_type = 'click' AND r.start =
  (SELECT min(x.start) FROM b x WHERE x.user_id = l.user_id AND x.event_type = 'click' AND x.start >= l.start)) AS next_click FROM b l WHERE l.event_type = 'purchase'""")
def asof_forward(spark, sf_dir):
    rows = beats(spark, sf_dir).select("user_id", "event_id", "start", "event_type")
    left, right = (rows.where(F.col("event_type") == x).drop("event_type") for x in ("purchase", "click"))
    return joins.asof_forward(left, right, "user_id", "event_id", "next_click").select("event_id", "next_click")


@query(f"""WITH {_BEATS}, {_SPANS}, g AS (SELECT user_id, which, start AS ss, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY which), start + 1.0) AS se FROM b),
  o AS (SELECT p.user_id, pw, which FROM p JOIN g ON p.user_id = g.user_id AND se >= ps AND ss <= pe),
  c AS (SELECT user_id, pw, coalesce(max(last) OVER (PARTITION BY user_id ORDER BY pw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor
        FROM (SELECT user_id, pw, max(which) AS last FROM o GROUP BY user_id, pw))
  SELECT user_id, pw AS quantum, which AS segment FROM o JOIN c USING (user_id, pw) WHERE which >= cursor""")
def cursor_overlap_join(spark, sf_dir):
    rows = beats(spark, sf_dir)
    ahead = F.lead("start").over(timeline.Window.partitionBy("user_id").orderBy("which"))
    segments = rows.withColumn("end", F.coalesce(ahead, F.col("start") + 1.0)).select("user_id", "which", "start", "end")
    return joins.cursor_overlap(purchase_spans(rows), segments, "user_id")


@query(f"""WITH {_BEATS}, x AS (SELECT l.event_id, r.which, abs(l.start - r.start) AS g FROM b l JOIN b r ON l.user_id = r.user_id AND l.event_type = 'error' AND r.event_type = 'view'),
  y AS (SELECT event_id, arg_min(which, {{'g': g, 'which': which}}) AS w, min(g) AS g FROM x GROUP BY event_id)
  SELECT b.event_id, CASE WHEN g <= 36000 THEN w END AS nearest, CASE WHEN g <= 36000 THEN round(g, 6) END AS gap FROM b LEFT JOIN y USING (event_id) WHERE event_type = 'error'""")
def nearest_within_tolerance(spark, sf_dir):
    rows = beats(spark, sf_dir).select("user_id", "event_id", "start", "which", "event_type")
    left, right = (rows.where(F.col("event_type") == x).drop("event_type") for x in ("error", "view"))
    return rounded(joins.nearest_within(left, right, "user_id", 36_000.0).select("event_id", "nearest", "gap"), "gap")


@query(f"""WITH {_BEATS}, {_SPANS}, d AS (SELECT user_id, CAST(floor(start / 86400) AS BIGINT) AS win, floor(start / 86400) * 86400 AS ws FROM b GROUP BY ALL),
  o AS (SELECT p.user_id, pw, win, least(pe, ws + 86400) - greatest(ps, ws) AS v FROM p JOIN d ON p.user_id = d.user_id AND least(pe, ws + 86400) - greatest(ps, ws) > 0)
  SELECT user_id, pw AS span, arg_min(win, {{'v': -v, 'w': win}}) AS "window", round(max(v), 6) AS overlap FROM o GROUP BY user_id, pw""")
def best_overlap_window(spark, sf_dir):
    rows = beats(spark, sf_dir)
    day = F.floor(F.col("start") / 86400)
    days = rows.select("user_id", day.alias("which"), (day * 86400.0).alias("start"), (day * 86400.0 + 86400.0).alias("end")).distinct()
    return rounded(joins.best_overlap(purchase_spans(rows), days, "user_id"), "overlap")


@query(f"""WITH {_BEATS}, {_SPANS}, t AS (SELECT user_id, max(pw) AS top FROM p GROUP BY user_id),
  x AS (SELECT b.event_id, b.user_id, b.start, max(pw) AS pw, arg_max(pe, pw) AS pe FROM b LEFT JOIN p ON p.user_id = b.user_id AND ps <= b.start GROUP BY ALL)
  SELECT event_id, coalesce(CASE WHEN start < pe OR pw = top THEN pw END, 0) AS beat FROM x LEFT JOIN t USING (user_id)""")
def point_lookup(spark, sf_dir):
    rows = beats(spark, sf_dir)
    return joins.point_lookup(rows.select("user_id", "event_id", F.col("start").alias("at")), purchase_spans(rows), "user_id").select("event_id", "beat")


@query(f"WITH {_BEATS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY which ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM b")
def moving_average(spark, sf_dir):
    return rounded(timeline.moving_average(beats(spark, sf_dir), "user_id", "which", "value", 2, "mean").select("event_id", "mean"), "mean")


@query(f"""WITH {_BEATS}, o AS (SELECT *, greatest(value, 0) AS a FROM b),
  d AS (SELECT *, greatest(a - avg(a) OVER (PARTITION BY user_id ORDER BY which ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING), 0) AS c FROM o),
  e AS (SELECT *, avg(c) OVER (PARTITION BY user_id ORDER BY which ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS f FROM d)
  SELECT event_id, round(CASE WHEN max(f) OVER (PARTITION BY user_id) > 0 THEN f / max(f) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS odf FROM e""")
def onset_detection(spark, sf_dir):
    return rounded(timeline.onset_detection(beats(spark, sf_dir), "user_id", "which", "value").select("event_id", "odf"), "odf")


@query(f"""WITH {_BEATS} SELECT event_id, value FROM (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY which))
  WHERE value >= p AND value > n AND value >= 1""")
def local_peaks(spark, sf_dir):
    return timeline.local_peaks(beats(spark, sf_dir), "user_id", "which", "value", 1.0).select("event_id", "value")


@query(f"""WITH {_BEATS}, l AS (SELECT user_id, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.75, 0) AS INT) + 1] AS t FROM b GROUP BY user_id)
  SELECT event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY which ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM b) JOIN l USING (user_id) WHERE value = m AND value >= t""")
def window_peaks(spark, sf_dir):
    return timeline.window_peaks(beats(spark, sf_dir), "user_id", "which", "value").select("event_id", "value")


@query(f"WITH {_BEATS} SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY which ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median FROM b")
def windowed_median(spark, sf_dir):
    return rounded(timeline.windowed_median(beats(spark, sf_dir), "user_id", "which", "value", 2, "median").select("event_id", "median"), "median")


@query(f"""WITH {_QUANTA}, x AS (SELECT vec_id, label, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM q)
  SELECT vec_id, dim, round((x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-4), 6) AS z FROM x WINDOW w AS (PARTITION BY label, dim)""")
def zscore_dimensions(spark, sf_dir):
    dims = timeline.exploded(quanta(spark, sf_dir), ["vec_id", "label"], "v")
    return rounded(dims.select("vec_id", F.col("dim").cast("long").alias("dim"), timeline.zscore(dims, ["label", "dim"], "x").alias("z")), "z")


@query(f"""WITH {_BEATS} SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS share
  FROM b WINDOW w AS (PARTITION BY user_id)""")
def min_max_normalise(spark, sf_dir):
    return rounded(beats(spark, sf_dir).select("event_id", timeline.min_max("user_id", "value").alias("share")), "share")


@query(f"""WITH {_QUANTA}, x AS (SELECT label, which, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM q),
  z AS (SELECT label, which, dim, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-4) AS z FROM x WINDOW w AS (PARTITION BY label, dim)),
  d AS (SELECT label, which, sqrt(coalesce(avg(d * d), 0)) AS raw FROM (SELECT *, z - lag(z) OVER (PARTITION BY label, dim ORDER BY which) AS d FROM z) GROUP BY label, which)
  SELECT label, which, round(avg(raw) OVER (PARTITION BY label ORDER BY which ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS novelty FROM d""")
def frame_novelty(spark, sf_dir):
    return rounded(timeline.frame_novelty(quanta(spark, sf_dir), "label", "which", "v"), "novelty")


@query("""WITH h AS (SELECT event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 / 3600) AS BIGINT) AS hour, sum(value) AS x FROM events GROUP BY ALL)
  SELECT event_type, lag, round(r, 6) AS r, n, round(r * exp(-0.5 * pow(log2(60.0 * 2 / lag / 120.0), 2)), 6) AS weighted FROM
  (SELECT a.event_type, b.hour - a.hour AS lag, avg(a.x * b.x) AS r, count(*) AS n FROM h a JOIN h b ON a.event_type = b.event_type AND b.hour - a.hour BETWEEN 1 AND 48 GROUP BY a.event_type, b.hour - a.hour)""")
def autocorrelation_tempo(spark, sf_dir):
    rows = beats(spark, sf_dir).groupBy("event_type", F.floor(F.col("start") / 3600).alias("hour")).agg(F.sum("value").alias("x"))
    found = timeline.autocorrelation(rows, "event_type", "hour", "x", 1, 48)
    found = found.withColumn("weighted", F.col("r") * timeline.tempo_weight(F.col("lag"), 2.0))
    return rounded(found.withColumn("lag", F.col("lag").cast("long")), "r", "weighted")


@query(f"""WITH {_BEATS} SELECT user_id, w AS "window", count(*) AS n, round(avg(value), 8) AS mean FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM b) b, (SELECT unnest(range(0, (SELECT count(*) // 16 + 1 FROM events))) AS w)
  WHERE which >= w * 16 AND which < w * 16 + 32 AND w * 16 + 12 <= n GROUP BY user_id, w""")
def hopping_windows(spark, sf_dir):
    rows = timeline.hopping_windows(beats(spark, sf_dir), "user_id", "which")
    return rows.groupBy("user_id", F.col("window").cast("long").alias("window")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))


@query(f"WITH {_PAIRS} SELECT label, src, dst, round(distance, 6) AS distance, rank FROM k")
def knn_topk(spark, sf_dir):
    near = similarity_graph(spark, sf_dir)[2].select("label", "src", "dst", "distance", F.col("rank").cast("long").alias("rank"))
    return rounded(near, "distance")


@query(f"WITH {_EDGES} SELECT label, src, dst, round(distance, 6) AS distance, CAST(reported AS BIGINT) AS reported, CAST(applied AS BIGINT) AS applied FROM e JOIN t USING (label)")
def adaptive_threshold(spark, sf_dir):
    _, _, _, thresholds, edges = similarity_graph(spark, sf_dir)
    out = edges.select("label", "src", "dst", "distance").join(thresholds, "label").withColumns({x: F.col(x).cast("long") for x in ("reported", "applied")})
    return rounded(out, "distance")


@query(f"""WITH {_QUANTA}, p AS (SELECT a.label, a.which AS src, b.which AS dst, 50 * list_distance(a.v, b.v) AS distance FROM q a JOIN q b ON a.label = b.label AND a.which % 4 = b.which % 4 AND a.which <> b.which
    WHERE 50 * list_distance(a.v, b.v) <= 70)
  SELECT p.label, p.src, p.dst, round(p.distance, 6) AS distance FROM p JOIN p x ON x.label = p.label AND x.src = p.src + 1 AND x.dst = p.dst + 1 JOIN p y ON y.label = p.label AND y.src = p.src + 2 AND y.dst = p.dst + 2""")
def look_ahead_gate(spark, sf_dir):
    return rounded(neighbours.all_pairs(quanta(spark, sf_dir), "label", "v", 50.0, 80.0, depth=3, applied=70.0), "distance")


@query(f"""WITH {_SCORED} SELECT label, src, dst, CAST(b0 AS DOUBLE) AS bonus, CAST(penalty AS DOUBLE) AS penalty, round(score, 6) AS score, CASE WHEN rejected THEN 'rejected' ELSE 'accepted' END AS decision,
  array_to_string(list_filter([CASE WHEN j < 4 THEN 'very-short-jump' END, CASE WHEN j >= 4 AND sh THEN 'short-jump' END, CASE WHEN NOT sh AND j >= 32 THEN 'long-jump' END, CASE WHEN NOT sh AND j < 32 THEN 'medium-jump' END,
    CASE WHEN sp THEN 'same-bar-phase' ELSE 'bar-phase-mismatch' END, CASE WHEN sb % 4 = db % 4 THEN 'same-phrase4-phase' WHEN sh THEN 'phrase4-phase-mismatch' END, CASE WHEN sb % 8 = db % 8 THEN 'same-phrase8-phase' END,
    CASE WHEN sb % 16 = db % 16 AND j >= 32 THEN 'same-phrase16-phase' END, CASE WHEN ch THEN 'section-change' END, CASE WHEN bo THEN 'structural-boundary' END, CASE WHEN ga THEN 'reach-gain' END,
    CASE WHEN lo THEN 'short-local-risk' END, CASE WHEN lp THEN 'local-loop-risk' END, CASE WHEN distance <= 8 THEN 'exceptional-acoustic-match' END,
    CASE WHEN rejected AND j < 4 THEN 'rejected-very-short-local' WHEN rejected THEN 'rejected-short-local' END], lambda y: y IS NOT NULL), ',') AS reasons FROM sc""")
def structural_score(spark, sf_dir):
    q = quanta(spark, sf_dir).withColumn("n", F.count("*").over(timeline.Window.partitionBy("label")))
    scored = graph.structural_score(neighbours.all_pairs(q, "label", "v", 50.0, 80.0, keep=("n",)), None, "label", separator=",")
    return rounded(scored.select("label", "src", "dst", "bonus", "penalty", "score", "decision", "reasons"), "score")


@query(f"WITH {_PAIRS} SELECT label, src, dst, round(score, 6) AS score, row_number() OVER (PARTITION BY label, src ORDER BY score, distance, j DESC, dst) AS score_rank FROM k")
def score_order(spark, sf_dir):
    out = graph.by_score(similarity_graph(spark, sf_dir)[2], "label").withColumn("score_rank", F.col("score_rank").cast("long"))
    return rounded(out.select("label", "src", "dst", "score", "score_rank"), "score")


@query(f"""WITH {_PAIRS} SELECT label, src, dst, round(distance, 6) AS distance, round((src - dst) * 100.0 / n, 6) AS percent FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (src - dst) * 100.0 / n DESC, distance, score, dst, src) AS i FROM k WHERE dst < src AND distance < 78) WHERE i = 1""")
def best_backward(spark, sf_dir):
    _, n, near, _, _ = similarity_graph(spark, sf_dir)
    return rounded(graph.best_backward(near, n, "label", 78.0), "distance", "percent")


@query(f"WITH {_EDGES} SELECT e.label, e.src, e.dst, EXISTS (SELECT 1 FROM events v WHERE v.user_id % 10 = e.label AND v.event_id % 50 = e.src) AS deleted FROM e")
def delete_edges(spark, sf_dir):
    edges = similarity_graph(spark, sf_dir)[4]
    marks = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("label"), (F.col("event_id") % 50).alias("src")).distinct()
    listed = edges.join(marks, ["label", "src"], "left_semi")
    return graph.delete_edges(edges, listed, "label").select("label", "src", "dst", "deleted")


@query(f"WITH {_EDGES} SELECT label, src, list(dst ORDER BY distance, dst) AS out FROM e GROUP BY label, src")
def adjacency(spark, sf_dir):
    return graph.adjacency(similarity_graph(spark, sf_dir)[4], "label").select("label", "src", F.transform("out", lambda x: x["dst"]).alias("out"))


@query(f"WITH RECURSIVE {_STEP} SELECT label, which, n, earliest, reach FROM r")
def reachability(spark, sf_dir):
    q, _, _, _, edges = similarity_graph(spark, sf_dir)
    return graph.reachability(q, edges, "label")


_TARGET = """mk AS (SELECT s.label, n, least(floor(n * 0.25), n - 1) AS mark, least(floor(n * 0.55), n - 1) AS cap, min(dst) AS first, min(dst) FILTER (src >= least(floor(n * 0.66), n - 1)) AS late
  FROM s LEFT JOIN (SELECT * FROM e WHERE dst < src) b ON b.label = s.label GROUP BY s.label, n),
tg AS (SELECT label, CAST(CASE WHEN first IS NULL THEN mark ELSE least(greatest(mark, first, CASE WHEN late IS NULL THEN first ELSE least(late, cap) END), n - 1) END AS BIGINT) AS target FROM mk),
y AS (SELECT label, target AS p, 0 AS k FROM tg UNION ALL
  SELECT y.label, (SELECT max(src) FROM e WHERE e.label = y.label AND e.dst <= y.p), k + 1 FROM y WHERE (SELECT max(src) FROM e WHERE e.label = y.label AND e.dst <= y.p) > y.p),
hp AS (SELECT q.label, q.which, CAST(min(k) AS BIGINT) AS hops FROM q LEFT JOIN y ON y.label = q.label AND q.which <= y.p GROUP BY q.label, q.which)"""


@query(f"WITH RECURSIVE {_EDGES}, {_TARGET} SELECT label, target FROM tg")
def early_target(spark, sf_dir):
    _, n, _, _, edges = similarity_graph(spark, sf_dir)
    return graph.early_target(edges, n, "label")


@query(f"WITH RECURSIVE {_EDGES}, {_TARGET} SELECT label, which, hops FROM hp")
def hop_cost(spark, sf_dir):
    q, n, _, _, edges = similarity_graph(spark, sf_dir)
    out = graph.hop_cost(q, edges, graph.early_target(edges, n, "label"), "label")
    return out.withColumn("hops", F.col("hops").cast("long"))


def _routed(spark, sf_dir):
    q, n, near, thresholds, edges = similarity_graph(spark, sf_dir)
    reach = settled(graph.reachability(q, edges, "label"), "reach")
    return q, n, edges, reach, graph.last_branch_point(reach, edges, "label")


@query(f"WITH RECURSIVE {_LAST} SELECT label, last FROM l")
def last_branch_point(spark, sf_dir):
    return _routed(spark, sf_dir)[4]


@query(f"""WITH RECURSIVE {_LAST} SELECT e.label, e.src, e.dst, round(e.distance, 6) AS distance FROM e JOIN l USING (label) WHERE src = 0 OR src = last
  OR NOT EXISTS (SELECT 1 FROM e x WHERE x.label = e.label AND x.src = e.src - 1 AND x.dst - x.src = e.dst - e.src)""")
def sequential_filter(spark, sf_dir):
    _, _, edges, _, last = _routed(spark, sf_dir)
    return rounded(graph.sequential_filter(edges, last, "label").select("label", "src", "dst", "distance"), "distance")


@query(f"WITH RECURSIVE {_LAST} SELECT label, src, dst, round(distance, 6) AS distance FROM e JOIN l USING (label) WHERE src >= last OR dst < last")
def bad_branch_filter(spark, sf_dir):
    _, _, edges, _, last = _routed(spark, sf_dir)
    return rounded(graph.bad_branch_filter(edges, last, "label").select("label", "src", "dst", "distance"), "distance")


_PRUNED = """z AS (SELECT *, abs(dst - src) < 16 AND NOT ch AND (lo OR lp OR src // 32 = dst // 32) AS loc FROM e JOIN s USING (label)),
d AS (SELECT label, src, dst, distance, n, loc AND count(*) OVER c >= 2 AND (NOT bool_or(bo) OVER c
    OR row_number() OVER (PARTITION BY label, src // 32, dst // 32, loc ORDER BY score, abs(dst - src) DESC, dst, src) > 1) AS deleted FROM z WINDOW c AS (PARTITION BY label, src // 32, dst // 32, loc))"""


@query(f"WITH {_EDGES}, {_PRUNED} SELECT label, src, dst, round(distance, 6) AS distance, deleted FROM d")
def cluster_prune(spark, sf_dir):
    _, _, _, _, edges = similarity_graph(spark, sf_dir)
    return rounded(graph.prune_clusters(edges, "label"), "distance").select("label", "src", "dst", "distance", "deleted")


@query(f"""WITH {_EDGES}, {_PRUNED} SELECT label, count_if(NOT deleted) AS active, count_if(deleted) AS deleted, count_if(NOT deleted AND abs(dst - src) < 16) AS short,
  count_if(NOT deleted AND abs(dst - src) < 4) AS very_short, round(coalesce(max((src - dst) * 100.0 / n) FILTER (NOT deleted), 0), 6) AS longest_back FROM d GROUP BY label""")
def branch_counts(spark, sf_dir):
    _, n, _, _, edges = similarity_graph(spark, sf_dir)
    pruned = graph.prune_clusters(edges, "label")
    return rounded(graph.branch_counts(pruned.join(n, "label"), "label"), "longest_back")


_LATE = """
  z AS (SELECT e.label, src, dst, distance, hops, earliest, r.n, target, src - dst AS back, greatest(1, floor(r.n / 5)) AS lng, least(floor(r.n * 0.66), r.n - 1) AS lo66, least(floor(r.n * 0.8), r.n - 1) AS lo80
    FROM e JOIN r ON r.label = e.label AND r.which = e.dst JOIN hp ON hp.label = e.label AND hp.which = e.dst JOIN tg ON tg.label = e.label WHERE dst < src AND hops IS NOT NULL),
  o AS (SELECT *, CASE WHEN src >= greatest(lo66, lo80) THEN 0 ELSE 1 END AS range FROM (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY hops, earliest, distance, back DESC) AS i FROM z) WHERE i = 1 AND src >= lo66),
  ru AS (SELECT unnest([1, 2, 3]) AS tier, unnest([1.0, 0.5, 0.25]) AS share, unnest([1, 2, 1]) AS floor_),
  ca AS (SELECT o.*, tier, 2 * tier + range AS g, greatest(floor_, floor(lng * share)) AS need FROM o, ru WHERE hops <= tier AND earliest <= target AND back >= greatest(floor_, floor(lng * share))
    UNION ALL SELECT o.*, 4, 8, 0 FROM o WHERE hops = 0),
  fi AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hops, earliest, distance, back DESC, src DESC) AS q FROM (SELECT *, min(g) OVER (PARTITION BY label) AS gm FROM ca) WHERE g = gm),
  be AS (SELECT label, hops AS bh, earliest AS bea, back AS bb, src AS bs FROM fi WHERE q = 1),
  la AS (SELECT fi.*, bh, bb, bs, row_number() OVER (PARTITION BY label ORDER BY src DESC) AS v FROM fi JOIN be USING (label) WHERE q = 1 OR tier < 4 AND hops <= bh + 1 AND earliest <= bea + greatest(4, floor(n * 0.02))
    AND back >= greatest(need, floor(bb * 0.6)) AND (hops <= bh OR dst <= floor(n * 0.5))),
  ch AS (SELECT *, bool_or(v = 1 AND abs(src - bs) <= 4 AND hops > bh AND back < bb * 0.8) OVER (PARTITION BY label) AS home FROM la),
  an AS (SELECT * FROM ch WHERE CASE WHEN home THEN q = 1 ELSE v = 1 END)"""


@query(f"""WITH RECURSIVE {_STEP}, {_TARGET}, {_LATE} SELECT label, src, dst, round(distance, 6) AS distance, hops, CAST(tier AS BIGINT) AS tier FROM an""")
def late_anchor(spark, sf_dir):
    q, n, edges, reach, _ = _routed(spark, sf_dir)
    targets = settled(graph.early_target(edges, n, "label"), "targets")
    costs = graph.hop_cost(q, edges, targets, "label")
    out = graph.late_anchor(edges, reach, costs, targets, "label")
    return rounded(out.withColumns({x: F.col(x).cast("long") for x in ("hops", "tier")}), "distance")


@query(f"""WITH RECURSIVE {_STEP}, {_TARGET}, {_LATE},
  li AS (SELECT s.label, s.n, t.applied, CASE WHEN coalesce(max(src - dst), 0) * 100.0 / s.n >= 50 THEN 55 ELSE 65 END AS lim, least(floor(s.n * 0.66), s.n - 1) AS p66, least(floor(s.n * 0.8), s.n - 1) AS p80
    FROM s JOIN t ON t.label = s.label LEFT JOIN (SELECT * FROM e WHERE dst < src) b ON b.label = s.label GROUP BY s.label, s.n, t.applied),
  fr AS (SELECT k.label, k.src, k.dst, k.distance, hops, earliest, CASE WHEN k.src >= p80 THEN 1 ELSE 3 END AS stage FROM k JOIN li ON li.label = k.label AND k.src >= p66 AND k.distance < lim AND k.distance > applied
    JOIN r ON r.label = k.label AND r.which = k.dst JOIN hp ON hp.label = k.label AND hp.which = k.dst WHERE k.dst < k.src AND hops IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.label = k.label AND e.src = k.src AND e.dst = k.dst)),
  ro AS (SELECT an.label, src, dst, distance, hops, earliest, CASE WHEN src >= p80 THEN 0 ELSE 2 END AS stage FROM an JOIN li USING (label) UNION ALL SELECT * FROM fr),
  pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY stage, hops, earliest, distance, src - dst DESC, src DESC) AS i FROM ro) WHERE i = 1),
  lg AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.label ORDER BY src - dst DESC, distance, score, dst, src) AS i FROM k JOIN li ON li.label = k.label WHERE dst < src AND distance < lim) WHERE i = 1)
  SELECT li.label, CASE stage WHEN 0 THEN 'existing-preferred-anchor' WHEN 1 THEN 'inserted-preferred-anchor' WHEN 2 THEN 'existing-fallback-anchor' WHEN 3 THEN 'inserted-fallback-anchor' ELSE 'legacy-fallback' END AS decision,
    CASE WHEN stage IS NULL THEN lg.src ELSE pk.src END AS src, CASE WHEN stage IS NULL THEN lg.dst ELSE pk.dst END AS dst, round(CASE WHEN stage IS NULL THEN lg.distance ELSE pk.distance END, 6) AS distance,
    hops, earliest, CASE WHEN stage IS NULL THEN coalesce(lg.distance > applied, false) ELSE stage IN (1, 3) END AS inserted FROM li LEFT JOIN pk ON pk.label = li.label LEFT JOIN lg ON lg.label = li.label""")
def anchor_routing(spark, sf_dir):
    q, n, near, thresholds, edges = similarity_graph(spark, sf_dir)
    edges = settled(edges, "edges")
    reach = settled(graph.reachability(q, edges, "label"), "reach")
    targets = settled(graph.early_target(edges, n, "label"), "targets")
    costs = settled(graph.hop_cost(q, edges, targets, "label"), "costs")
    out = graph.anchor_routing(near, edges, reach, costs, targets, graph.anchor_limits(edges, n, thresholds, "label"), "label")
    return rounded(out.withColumn("hops", F.col("hops").cast("long")), "distance")


@query(f"""WITH {_EDGES} SELECT label, src, dst, round(1 / (1 + distance), 6) AS weight, round(sum(1 / (1 + distance)) OVER (PARTITION BY label, src ORDER BY distance, dst) / sum(1 / (1 + distance)) OVER (PARTITION BY label, src), 6) AS cdf FROM e""")
def weighted_choice_cdf(spark, sf_dir):
    edges = similarity_graph(spark, sf_dir)[4]
    return rounded(graph.choice_cdf(edges, "label").select("label", "src", "dst", "weight", "cdf"), "weight", "cdf")


@query(f"""WITH {_QUANTA}, o AS (SELECT unnest(range(-4, 4)) AS o), c AS (SELECT a.o AS x, b.o AS y, sign((a.o + 0.5) * (b.o + 0.5)) * exp(-((a.o + 0.5) * (a.o + 0.5) + (b.o + 0.5) * (b.o + 0.5)) / 8.0) AS k FROM o a, o b)
  SELECT q.label, q.which, round(greatest(0, sum(k * list_cosine_similarity(i.v, j.v))), 6) AS novelty FROM q, c JOIN q i ON i.label = q.label AND i.which = q.which + x JOIN q j ON j.label = q.label AND j.which = q.which + y GROUP BY q.label, q.which""")
def self_similarity_novelty(spark, sf_dir):
    return rounded(graph.self_similarity_novelty(quanta(spark, sf_dir), "label", "v"), "novelty")


@query("""SELECT l_suppkey, arg_max(x, {'n': n, 'x': x}) AS mode, max(n) AS n FROM (SELECT l_suppkey, l_linenumber AS x, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def mode_tiebreak(spark, sf_dir):
    return summaries.mode(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count_if(value >= 10) AS n_above, "
       + ", ".join(f"list_sort(list(value))[CAST(round_even((count(*) - 1) * {p / 100}, 0) AS INT) + 1] AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM events GROUP BY event_type")
def activation_summary(spark, sf_dir):
    return rounded(summaries.activation_summary(table(spark, sf_dir, "events"), "event_type", "value", 10.0), "mean")


@query(f"WITH {_QUANTA} SELECT label, dim, round(median(x), 6) AS median FROM (SELECT label, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM q) GROUP BY label, dim")
def vector_median(spark, sf_dir):
    return rounded(summaries.vector_median(quanta(spark, sf_dir), "label", "v").withColumn("dim", F.col("dim").cast("long")), "median")


_GRID = f"""{_BEATS}, g AS (SELECT user_id, lead(start) OVER (PARTITION BY user_id ORDER BY which) - start AS g FROM b),
  a AS (SELECT user_id, count(*) AS n, median(g) FILTER (g > 0) AS m, stddev_pop(g) AS s, avg(g) AS v FROM g GROUP BY user_id),
  f AS (SELECT user_id, any_value(n) AS n, any_value(m) AS m, any_value(s) AS s, any_value(v) AS v, median(abs(g - m)) AS mad, count_if(g > 1.65 * m) AS n_gaps, count_if(g < 0.45 * m) AS n_duplicates FROM g JOIN a USING (user_id) GROUP BY user_id)"""


@query(f"WITH {_GRID} SELECT user_id, n, round(m, 6) AS median_interval, round(60 / m, 6) AS bpm, round(s / m, 6) AS std_ratio, round(s / v, 6) AS cv, round(mad, 6) AS mad, n_gaps, n_duplicates FROM f")
def interval_quality(spark, sf_dir):
    return rounded(summaries.grid_quality(beats(spark, sf_dir), "user_id"), "median_interval", "bpm", "std_ratio", "cv", "mad")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS names FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM
  (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 3 GROUP BY user_id""")
def top_names(spark, sf_dir):
    out = summaries.histogram_names(table(spark, sf_dir, "events"), "user_id", "event_type", 3)
    return out.select("user_id", F.array_join("names", ",").alias("names"))


@query("""WITH x AS (SELECT event_id, least(greatest(value / 100, 0.65), 0.95) AS s FROM events)
  SELECT event_id, least(greatest(round_even(CASE WHEN s <= 0.86 THEN 95 + (s - 0.78) / 0.08 * -15 ELSE 80 + (s - 0.86) / 0.06 * -10 END, 0), 1), 100) AS threshold FROM x""")
def similarity_threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.similarity_threshold(F.col("value") / 100).alias("threshold"))


@query("""WITH k AS (SELECT doc_id, sha256(concat_ws('|', doc_id, n_chars, lang)) AS analysis_key FROM documents), b AS (SELECT k.doc_id, analysis_key, sha256(concat_ws('|', analysis_key, source)) AS branch_key FROM k JOIN documents d ON d.doc_id = k.doc_id)
  SELECT doc_id, analysis_key, branch_key, sha256(concat_ws('|', branch_key, doc_id % 7)) AS runtime_key FROM b""")
def cache_key(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source", (F.col("doc_id") % 7).alias("option"))
    return cache.cache_keys(rows, ["doc_id", "n_chars"], ["lang"], ["source"], ["option"]).select("doc_id", "analysis_key", "branch_key", "runtime_key")


@query(f"""WITH {_BEATS} SELECT event_id, CASE WHEN pt IS DISTINCT FROM event_type THEN 'Analysis' WHEN floor(pv / 10) IS DISTINCT FROM floor(value / 10) THEN 'Branches' WHEN pv IS DISTINCT FROM value THEN 'RuntimeOnly' ELSE 'None' END AS impact
  FROM (SELECT *, lag(event_type) OVER w AS pt, lag(value) OVER w AS pv FROM b WINDOW w AS (PARTITION BY user_id ORDER BY which))""")
def impact_class(spark, sf_dir):
    w = timeline.Window.partitionBy("user_id").orderBy("which")
    own = F.struct("event_type", F.floor(F.col("value") / 10).alias("tens"), "value")
    rows = beats(spark, sf_dir).withColumn("new", own).withColumn("old", F.lag("new").over(w))
    return rows.select("event_id", cache.change_impact("old", "new", ["event_type"], ["tens"], ["value"]).alias("impact"))


@query("""WITH r AS (SELECT conv_id, turn, lower(role) AS k, row_number() OVER (PARTITION BY lower(role), conv_id ORDER BY turn DESC) AS i FROM conversations)
  SELECT conv_id, k AS role, turn FROM r WHERE i = 1""")
def latest_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.lower("role").alias("role"), "turn").distinct()
    return cache.latest(rows, F.col("role"), [F.desc("turn")], group="conv_id", n=100)


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS i FROM events),
  n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS j FROM r WHERE i = 1) SELECT user_id, event_type, event_id FROM n WHERE j <= 3""")
def recents_topn(spark, sf_dir):
    return cache.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), F.lower("event_type"), [F.desc("event_id")], 3, "user_id")


@query("""SELECT page_id, CASE WHEN s = '' THEN 'local-audio' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1))),
  '[\\s\\pZ\\-_.]+', '-', 'g'), '[^\\pL\\p{Nd}\\-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def title_slug(spark, sf_dir):
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", C.slug(title).alias("slug"))


@query("""SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN '$.k missing' WHEN CAST(json_extract(props, '$.k') AS BIGINT) >= 50 THEN '$.k over 49' END AS violation
  FROM events WHERE json_extract(props, '$.k') IS NULL OR CAST(json_extract(props, '$.k') AS BIGINT) >= 50""")
def contract_violations(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    broken = F.when(k.isNull(), "$.k missing").when(k >= 50, "$.k over 49")
    return table(spark, sf_dir, "events").select("event_id", broken.alias("violation")).where("violation is not null")


@query()
def greedy_suppression(spark, sf_dir):
    rows = beats(spark, sf_dir).select("user_id", "event_id", "start", "value")
    return folds.greedy_suppression(rows, "user_id", "start", "value", 40_000.0)


@query()
def segment_filter(spark, sf_dir):
    rows = quanta(spark, sf_dir).select("label", "which", "duration", (F.pmod(F.col("which"), F.lit(5)) / 10.0).alias("confidence"), F.col("v").alias("timbre"))
    return folds.segment_filter(rows, "label").drop("timbre")


@query()
def grid_agreement(spark, sf_dir):
    rows = beats(spark, sf_dir)
    left, right = (rows.where(F.col("event_type") == x).select("user_id", "start") for x in ("view", "click"))
    return folds.greedy_match(left, right, "user_id", 20_000.0)


@query()
def beat_path(spark, sf_dir):
    return folds.beat_path(beats(spark, sf_dir), "user_id", "start", "value", 40_000.0, 10.0)


@query()
def walk_simulation(spark, sf_dir):
    q, _, _, _, edges = similarity_graph(spark, sf_dir)
    return walk.simulate(q.select("label", "which", F.lit(0.5).alias("duration")), edges, "label", 200)


FRAME, HOP, RATE = 16, 8, 22_050.0

_FRAMES = _BEATS + """,
n AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id),
f AS (SELECT user_id, unnest(range(CASE WHEN n <= 16 THEN 1 ELSE 1 + CAST(ceil((n - 16) / 8.0) AS BIGINT) END)) AS frame FROM n),
x AS (SELECT user_id, frame, which - 8 * frame AS i, value AS x FROM f JOIN b USING (user_id) WHERE which BETWEEN 8 * frame AND 8 * frame + 15),
m AS (SELECT user_id, frame, dim, sqrt(power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * cos(2 * pi() * i * dim / 16)), 2)
  + power(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * sin(2 * pi() * i * dim / 16)), 2)) AS x
  FROM x, (SELECT unnest(range(9)) AS dim) GROUP BY user_id, frame, dim)"""


def framed(spark, sf_dir: str) -> DataFrame:
    return frames.cut(beats(spark, sf_dir).select("user_id", "which", "value"), "user_id", "which", "value", FRAME, HOP)


def spectra(spark, sf_dir: str) -> DataFrame:
    return framed(spark, sf_dir).select("user_id", "frame", frames.magnitudes("samples").alias("spectrum"))


@query(f"WITH {_FRAMES} SELECT user_id, frame, round(sqrt(sum(x * x) / 16), 6) AS rms FROM x GROUP BY user_id, frame")
def frame_rms(spark, sf_dir):
    return framed(spark, sf_dir).select("user_id", "frame", F.round(frames.rms(F.col("samples")), 6).alias("rms"))


@query(f"""WITH {_FRAMES},
t AS (SELECT user_id, frame, sum(x) AS t FROM m GROUP BY user_id, frame),
s AS (SELECT m.user_id, m.frame, dim, CASE WHEN t > 1e-12 THEN x / t ELSE 0 END AS x FROM m JOIN t ON m.user_id = t.user_id AND m.frame = t.frame),
g AS (SELECT user_id, frame, sum(g) AS g FROM (SELECT user_id, frame, greatest(x - coalesce(lag(x) OVER (PARTITION BY user_id, dim ORDER BY frame), x), 0) AS g FROM s) GROUP BY user_id, frame)
SELECT user_id, frame, round(CASE WHEN max(g) OVER (PARTITION BY user_id) > 0 THEN g / max(g) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS flux FROM g""")
def spectral_flux(spark, sf_dir):
    return frames.spectral_flux(spectra(spark, sf_dir), "user_id").select("user_id", "frame", F.round("flux", 6).alias("flux"))


@query(f"""WITH {_FRAMES},
h AS (SELECT *, median(x) OVER (PARTITION BY user_id, dim ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h,
  median(x) OVER (PARTITION BY user_id, frame ORDER BY dim ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) / 4 AS p FROM m)
SELECT user_id, frame, CAST(dim AS INTEGER) AS dim, round(x * h / (h + p + 1e-12), 6) AS harmonic, round(x * p / (h + p + 1e-12), 6) AS percussive FROM h""")
def harmonic_separation(spark, sf_dir):
    out = frames.separate(spectra(spark, sf_dir), "user_id")
    return out.select("user_id", "frame", "dim", F.round("harmonic", 6).alias("harmonic"), F.round("percussive", 6).alias("percussive"))


_SPLIT = _FRAMES + """,
h AS (SELECT *, median(x) OVER (PARTITION BY user_id, dim ORDER BY frame ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h,
  median(x) OVER (PARTITION BY user_id, frame ORDER BY dim ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) / 4 AS p FROM m),
z AS (SELECT user_id, frame, dim, x, x * h / (h + p + 1e-12) AS har, x * p / (h + p + 1e-12) AS per FROM h)"""


def _flux_sql(part: str) -> str:
    return f"""(SELECT user_id, frame, CASE WHEN max(g) OVER (PARTITION BY user_id) > 0 THEN g / max(g) OVER (PARTITION BY user_id) ELSE 0 END AS v FROM
    (SELECT user_id, frame, sum(g) AS g FROM (SELECT user_id, frame, greatest(x - coalesce(lag(x) OVER (PARTITION BY user_id, dim ORDER BY frame), x), 0) AS g FROM
    (SELECT user_id, frame, dim, CASE WHEN sum({part}) OVER (PARTITION BY user_id, frame) > 1e-12 THEN {part} / sum({part}) OVER (PARTITION BY user_id, frame) ELSE 0 END AS x FROM z)) GROUP BY user_id, frame))"""


def _rms_sql(part: str) -> str:
    return f"(SELECT user_id, frame, CASE WHEN max(r) OVER (PARTITION BY user_id) > 0 THEN r / max(r) OVER (PARTITION BY user_id) ELSE r END AS v FROM (SELECT user_id, frame, sqrt(sum({part} * {part}) / 9) AS r FROM z GROUP BY user_id, frame))"


@query(f"""WITH {_SPLIT} SELECT hf.user_id, hf.frame, round(hf.v, 5) AS harmonic_flux, round(hr.v, 5) AS harmonic_rms, round(pf.v, 5) AS percussive_flux, round(pr.v, 5) AS percussive_rms FROM {_flux_sql("har")} hf
  JOIN {_rms_sql("har")} hr USING (user_id, frame) JOIN {_flux_sql("per")} pf USING (user_id, frame) JOIN {_rms_sql("per")} pr USING (user_id, frame)""")
def part_features(spark, sf_dir):
    out = frames.part_features(frames.separated(spectra(spark, sf_dir), "user_id"), "user_id", RATE, FRAME)
    return out.select("user_id", "frame", *(F.round(x, 5).alias(x) for x in ("harmonic_flux", "harmonic_rms", "percussive_flux", "percussive_rms")))


@query(f"""WITH {_SPLIT} SELECT user_id, round(CASE WHEN sum(x * x) > 1e-12 THEN sum(har * har) / sum(x * x) ELSE 0 END, 6) AS harmonic_ratio,
  round(CASE WHEN sum(x * x) > 1e-12 THEN sum(per * per) / sum(x * x) ELSE 0 END, 6) AS percussive_ratio FROM z GROUP BY user_id""")
def energy_ratios(spark, sf_dir):
    return rounded(frames.energy_ratios(frames.separated(spectra(spark, sf_dir), "user_id"), "user_id"), "harmonic_ratio", "percussive_ratio")


@query()
def onset_envelope(spark, sf_dir):
    return frames.onset_envelope(spectra(spark, sf_dir), "user_id", RATE, FRAME).select("user_id", "frame", F.round("onset", 6).alias("onset"))


@query()
def frame_chroma(spark, sf_dir):
    return frames.chroma(spectra(spark, sf_dir), "user_id", RATE, FRAME).select("user_id", "frame", F.transform("chroma", lambda x: F.round(x, 6)).alias("chroma"))


@query()
def frame_cepstrum(spark, sf_dir):
    rows = spectra(spark, sf_dir).withColumn("cepstrum", frames.cepstrum(RATE, FRAME)("spectrum"))
    return frames.with_deltas(rows, "user_id", "cepstrum").select("user_id", "frame", F.transform("cepstrum", lambda x: F.round(x, 6)).alias("cepstrum"))


def confident(spark, sf_dir: str) -> DataFrame:
    """Beats with a confidence, a loudness and peaks."""
    columns = {"confidence": F.least(F.col("value") / 100, F.lit(1.0)), "loudness": F.col("event_id") % 7 / 7, "peak": F.col("event_type") == "purchase"}
    return beats(spark, sf_dir).withColumns(columns)


_CONFIDENT = _BEATS + """,
d AS (SELECT *, least(value / 100, 1) AS confidence, coalesce(lead(start) OVER w - start, start - lag(start) OVER w, 0.5) AS duration FROM b WINDOW w AS (PARTITION BY user_id ORDER BY which))"""


@query(f"""WITH {_CONFIDENT} SELECT user_id, (which - 1) // 4 AS bar, round(arg_min(start, which), 6) AS start, round(greatest(0, arg_max(start + duration, which) - arg_min(start, which)), 6) AS duration,
  round(avg(confidence), 6) AS confidence FROM d WHERE which >= 1 GROUP BY user_id, (which - 1) // 4""")
def bars(spark, sf_dir):
    return rounded(hierarchy.bars(confident(spark, sf_dir), "user_id", 4, F.lit(1)), "start", "duration", "confidence")


@query(f"""WITH {_CONFIDENT} SELECT user_id, 2 * which + k AS which, round(start + k * (duration / 2), 6) AS start, round(duration / 2, 6) AS duration, round(confidence, 6) AS confidence
  FROM d, (SELECT unnest([0, 1]) AS k)""")
def tatums(spark, sf_dir):
    return rounded(hierarchy.tatums(confident(spark, sf_dir), "user_id"), "start", "duration", "confidence")


@query(f"""WITH {_CONFIDENT},
  a AS (SELECT user_id, least(greatest(confidence * 0.75 + event_id % 7 / 7 * 0.25, 0), 1) AS accent, which % 4 AS phase, which // 16 AS phrase, lead(start, 4) OVER w - start AS gap,
    bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY which ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, event_type = 'purchase' AS peak FROM d WINDOW w AS (PARTITION BY user_id ORDER BY which)),
  o AS (SELECT user_id, phase, count(*) AS n, sum(accent) AS s, stddev_pop(gap) AS sd, avg(gap) AS gap, count_if(near) AS hits, bool_or(peak) AS peak FROM a GROUP BY user_id, phase),
  x AS (SELECT user_id, phase, phrase, avg(accent) AS x FROM a GROUP BY user_id, phase, phrase HAVING count(*) = 4),
  c AS (SELECT user_id, phase, avg(change) AS change FROM (SELECT user_id, phase, abs(x - lag(x) OVER (PARTITION BY user_id, phase ORDER BY phrase)) AS change FROM x) GROUP BY user_id, phase),
  t AS (SELECT user_id, sum(n) AS n, sum(s) AS s, bool_or(peak) AS peak FROM o GROUP BY user_id),
  s AS (SELECT user_id, phase, t.n AS total, 0.35 * least(greatest(0.5 + o.s / o.n - CASE WHEN t.n > o.n THEN (t.s - o.s) / (t.n - o.n) ELSE 0 END, 0), 1)
    + 0.20 * CASE WHEN o.n < 3 OR gap IS NULL THEN 0 ELSE least(greatest(1 - sd / greatest(1e-6, gap) / 0.08, 0), 1) END
    + 0.20 * CASE WHEN o.n < 8 OR change IS NULL THEN 0.5 ELSE least(greatest(0.5 + change, 0), 1) END
    + 0.25 * CASE WHEN t.peak THEN least(2 * hits / o.n, 1) ELSE 0.5 END AS score FROM o JOIN t USING (user_id) LEFT JOIN c USING (user_id, phase)),
  f AS (SELECT user_id, any_value(total) AS total, arg_max(phase, {{'score': score, 'm': -phase}}) AS phase, max(score) AS top, max(score) FILTER (phase = 0) AS first FROM s GROUP BY user_id)
  SELECT user_id, CASE WHEN total >= 16 AND top >= first + 0.05 THEN phase ELSE 0 END AS phase, round(CASE WHEN total >= 16 AND top >= first + 0.05 THEN top ELSE first END, 6) AS score, round(first, 6) AS first_score FROM f""")
def bar_phase(spark, sf_dir):
    return rounded(hierarchy.bar_phase(confident(spark, sf_dir), "user_id"), "score", "first_score")


@query(f"""WITH {_CONFIDENT}, r AS (SELECT user_id, which // 4 AS bar, arg_min(start, which) AS start FROM d GROUP BY user_id, which // 4),
  z AS (SELECT user_id, max(start + duration) AS whole, CASE WHEN max(start + duration) >= 2500000 THEN 3 ELSE 2 END AS step, max(which // 4) + 1 AS bars FROM d GROUP BY user_id),
  f AS (SELECT user_id, bar, start, whole, lead(start) OVER (PARTITION BY user_id ORDER BY bar) AS nx FROM r JOIN z USING (user_id) WHERE whole > 60 AND bars >= 4 AND bar % step = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bar) - 1 AS which FROM (SELECT *, greatest(0, coalesce(nx, whole) - start) AS duration FROM f) WHERE duration >= 150000 OR nx IS NULL),
  m AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM k WHERE which < 4),
  y AS (SELECT user_id, which, start, CASE WHEN which = n - 1 AND start + duration < whole THEN whole - start ELSE duration END AS duration FROM m WHERE n >= 2)
  SELECT user_id, which, round(start, 6) AS start, round(duration, 6) AS duration FROM y UNION ALL SELECT user_id, 0, 0.0, round(whole, 6) FROM z WHERE whole > 0 AND user_id NOT IN (SELECT user_id FROM y)""")
def fixed_sections(spark, sf_dir):
    rows = confident(spark, sf_dir)
    ends = rows.groupBy("user_id").agg(F.max(F.col("start") + F.col("duration")).alias("duration"))
    return rounded(hierarchy.sections(hierarchy.bars(rows, "user_id"), ends, "user_id", 2, 3, 2_500_000.0, 60.0, 150_000.0, 4), "start", "duration")


_LAGS = """h AS (SELECT event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6 / 3600) AS BIGINT) AS hour, sum(value) AS x FROM events GROUP BY ALL),
p AS (SELECT a.event_type, b.hour - a.hour AS lag, avg(a.x * b.x) * exp(-0.5 * pow(log2(60.0 * 12 / (b.hour - a.hour) / 200.0), 2)) AS score
  FROM h a JOIN h b ON a.event_type = b.event_type AND b.hour - a.hour BETWEEN 1 AND 48 GROUP BY a.event_type, b.hour - a.hour)"""


def lag_scores(spark, sf_dir: str) -> DataFrame:
    rows = beats(spark, sf_dir).groupBy("event_type", F.floor(F.col("start") / 3600).alias("hour")).agg(F.sum("value").alias("x"))
    found = timeline.autocorrelation(rows, "event_type", "hour", "x", 1, 48)
    return found.select("event_type", F.col("lag").cast("long").alias("lag"), (F.col("r") * timeline.tempo_weight(F.col("lag"), 12.0, 200.0)).alias("score"))


@query(f"""WITH {_LAGS}, m AS (SELECT event_type, arg_max(lag, {{'score': score, 'm': -lag}}) AS lag, max(score) AS score FROM p GROUP BY event_type),
  x AS (SELECT m.event_type, m.lag, 720.0 / m.lag AS bpm, 360.0 / m.lag AS slow, m.score, p.score AS other FROM m LEFT JOIN p ON p.event_type = m.event_type AND p.lag = 2 * m.lag),
  y AS (SELECT *, coalesce(bpm >= 170 AND slow BETWEEN 75 AND 135 AND other >= score * CASE WHEN slow BETWEEN 90 AND 120 THEN 0.45 ELSE 0.6 END, false) AS halved FROM x)
  SELECT event_type, CASE WHEN halved THEN 2 * lag ELSE lag END AS lag, round(720.0 / CASE WHEN halved THEN 2 * lag ELSE lag END, 6) AS bpm, halved FROM y""")
def half_time_tempo(spark, sf_dir):
    return rounded(hierarchy.half_time(lag_scores(spark, sf_dir), "event_type", 12.0), "bpm")


@query(f"""WITH {_LAGS}, c AS (SELECT *, 720.0 / lag AS bpm FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, lag) AS i FROM p) WHERE i <= 3),
  t AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest(['autocorrelation', 'half-time', 'double-time', 'three-quarter', 'four-third']) AS origin, unnest(['primary', 'half', 'double', 'three-quarter', 'four-third']) AS harmonic, unnest([1.0::DOUBLE, 0.5, 2.0, 0.75, 4.0::DOUBLE / 3.0]) AS f),
  x AS (SELECT event_type, bpm * f AS bpm, CASE WHEN k = 0 THEN lag ELSE greatest(1, CAST(round_even(lag * bpm / (bpm * f), 0) AS BIGINT)) END AS lag, score * CASE WHEN k = 0 THEN 1.0 ELSE 0.92 END AS score, origin, harmonic, k FROM c, t WHERE k = 0 OR bpm * f BETWEEN 60 AND 200),
  y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, round_even(bpm, 3) ORDER BY score DESC, k, lag) AS i FROM x) WHERE i = 1)
  SELECT event_type, rank, round(bpm, 6) AS bpm, lag, round(score, 6) AS score, origin, harmonic FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, k, lag) AS rank FROM y) WHERE rank <= 5""")
def harmonic_tempos(spark, sf_dir):
    best = F.row_number().over(timeline.Window.partitionBy("event_type").orderBy(F.desc("score"), "lag"))
    top = lag_scores(spark, sf_dir).withColumn("_i", best).where("_i <= 3").withColumn("bpm", 720.0 / F.col("lag"))
    return rounded(hierarchy.harmonic_tempos(top, "event_type", 5), "bpm", "score")


def _top(*names: str) -> str:
    return ", ".join(f"greatest(1e-9, list_sort(list({x}))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1]) AS t_{x}" for x in names)


def _scaled(*names: str) -> str:
    return ", ".join(f"least(greatest({x} / t_{x}, 0), 1) AS {x}" for x in names)


_FIRST, _SECOND = ("onset", "flux", "rms_delta", "mfcc_delta", "chroma_delta"), ("novelty", "low", "mid", "high")


@query(f"""WITH {_QUANTA},
  d AS (SELECT label, which, abs(v[26]) AS onset, abs(v[27]) AS flux, coalesce(greatest(0, abs(v[28]) - lag(abs(v[28])) OVER w), 0) AS rms_delta,
    coalesce(list_distance(v[1:13], lag(v[1:13]) OVER w), 0) AS mfcc_delta, coalesce(list_distance(v[14:25], lag(v[14:25]) OVER w), 0) AS chroma_delta FROM q WINDOW w AS (PARTITION BY label ORDER BY which)),
  p AS (SELECT label, {_top(*_FIRST)} FROM d GROUP BY label), n AS (SELECT label, which, {_scaled(*_FIRST)} FROM d JOIN p USING (label)),
  g AS (SELECT *, (mfcc_delta + chroma_delta + rms_delta) / 3 AS novelty, avg(flux) OVER (PARTITION BY label ORDER BY which ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS low,
    avg((flux + mfcc_delta) / 2) OVER (PARTITION BY label ORDER BY which ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mid, greatest(0, onset - 0.35 * flux) AS high FROM n),
  r AS (SELECT label, {_top(*_SECOND)} FROM g GROUP BY label), o AS (SELECT label, which, onset, rms_delta, mfcc_delta, chroma_delta, {_scaled(*_SECOND)} FROM g JOIN r USING (label))
  SELECT label, which, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, round(novelty, 6) AS novelty,
    round(least(0.35 * onset + 0.20 * low + 0.15 * mid + 0.10 * rms_delta + 0.10 * mfcc_delta + 0.05 * chroma_delta + 0.05 * novelty, 1), 6) AS evidence FROM o""")
def composite_evidence(spark, sf_dir):
    at = {x: F.abs(F.element_at("v", k)) for x, k in (("onset", 26), ("flux", 27), ("rms", 28))}
    rows = quanta(spark, sf_dir).select("label", "which", *[c.alias(x) for x, c in at.items()], F.slice("v", 1, 13).alias("mfcc"), F.slice("v", 14, 12).alias("chroma"))
    return rounded(evidence.composite(rows, "label", "which").select("label", "which", "low", "mid", "high", "novelty", "evidence"), "low", "mid", "high", "novelty", "evidence")


_PARTS = (*_FIRST, "percussive_onset", "percussive_flux", "percussive_rms_delta", "harmonic_onset")
_MIX = {"onset": "(0.5 * onset + percussive_onset + 0.25 * harmonic_onset) / 1.75", "flux": "(0.5 * flux + percussive_flux + 0.25 * harmonic_onset) / 1.75"}


@query(f"""WITH {_QUANTA},
  d AS (SELECT label, which, abs(v[26]) AS onset, abs(v[27]) AS flux, coalesce(greatest(0, abs(v[28]) - lag(abs(v[28])) OVER w), 0) AS rms_delta,
    coalesce(list_distance(v[1:13], lag(v[1:13]) OVER w), 0) AS mfcc_delta, coalesce(list_distance(v[14:25], lag(v[14:25]) OVER w), 0) AS chroma_delta,
    abs(v[29]) AS percussive_onset, abs(v[30]) AS percussive_flux, coalesce(greatest(0, abs(v[31]) - lag(abs(v[31])) OVER w), 0) AS percussive_rms_delta, abs(v[32]) AS harmonic_onset FROM q WINDOW w AS (PARTITION BY label ORDER BY which)),
  p AS (SELECT label, {_top(*_PARTS)} FROM d GROUP BY label), n0 AS (SELECT label, which, {_scaled(*_PARTS)} FROM d JOIN p USING (label)),
  n1 AS (SELECT * REPLACE ({_MIX["onset"]} AS onset, {_MIX["flux"]} AS flux) FROM n0),
  p1 AS (SELECT label, {_top("onset", "flux")} FROM n1 GROUP BY label), n AS (SELECT n1.* REPLACE (least(onset / t_onset, 1) AS onset, least(flux / t_flux, 1) AS flux) FROM n1 JOIN p1 USING (label)),
  g AS (SELECT *, (mfcc_delta + chroma_delta + rms_delta) / 3 AS novelty, avg((flux + percussive_flux) / 2) OVER (PARTITION BY label ORDER BY which ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS low,
    avg((flux + mfcc_delta) / 2) OVER (PARTITION BY label ORDER BY which ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mid, greatest(0, onset - 0.35 * flux) AS high FROM n),
  r AS (SELECT label, {_top(*_SECOND)} FROM g GROUP BY label), o AS (SELECT label, which, onset, rms_delta, percussive_rms_delta, mfcc_delta, chroma_delta, {_scaled(*_SECOND)} FROM g JOIN r USING (label))
  SELECT label, which, round(onset, 6) AS onset, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high,
    round(least(0.35 * onset + 0.20 * low + 0.15 * mid + 0.10 * greatest(rms_delta, percussive_rms_delta) + 0.10 * mfcc_delta + 0.05 * chroma_delta + 0.05 * novelty, 1), 6) AS evidence FROM o""")
def part_evidence(spark, sf_dir):
    at = {x: F.abs(F.element_at("v", k)) for x, k in (("onset", 26), ("flux", 27), ("rms", 28), ("percussive_onset", 29), ("percussive_flux", 30), ("percussive_rms", 31), ("harmonic_onset", 32))}
    rows = quanta(spark, sf_dir).select("label", "which", *[c.alias(x) for x, c in at.items()], F.slice("v", 1, 13).alias("mfcc"), F.slice("v", 14, 12).alias("chroma"))
    out = evidence.composite(rows, "label", "which", {"full": 0.5, "percussive": 1.0, "harmonic": 0.25})
    return rounded(out.select("label", "which", "onset", "low", "mid", "high", "evidence"), "onset", "low", "mid", "high", "evidence")


_WAY = "src || ':' || dst || ':' || CASE WHEN dst < src THEN 'backward' ELSE 'forward' END, ',' ORDER BY src, dst"


@query(f"""WITH {_EDGES}, x AS (SELECT label, count(*) AS n_candidates, string_agg({_WAY}) AS candidates FROM k GROUP BY label),
  y AS (SELECT label, count(*) AS n_active, string_agg({_WAY}) AS active FROM e GROUP BY label)
  SELECT label, active, candidates, coalesce(n_active, 0) AS n_active, n_candidates FROM x LEFT JOIN y USING (label)""")
def branch_documents(spark, sf_dir):
    _, _, near, _, edges = similarity_graph(spark, sf_dir)
    text = {x: F.array_join(F.transform(x, lambda b: F.concat_ws(":", b["from_beat"], b["to_beat"], b["direction"])), ",") for x in ("active", "candidates")}
    return exports.branch_documents(edges, near, "label").withColumns(text)


@query(f"WITH {_BEATS} SELECT user_id, count(*) AS n_beats, CAST(ceil(count(*) / 4) AS BIGINT) AS n_bars, 2 * count(*) AS n_tatums FROM b GROUP BY user_id")
def track_summary(spark, sf_dir):
    rows = confident(spark, sf_dir)
    return exports.summary({"beats": rows, "bars": hierarchy.bars(rows, "user_id"), "tatums": hierarchy.tatums(rows, "user_id")}, "user_id")


@query(f"""WITH {_EDGES}, x AS (SELECT label, src * 100000 + dst AS id, src, dst, greatest(0.15, least(1, CASE WHEN distance <= 0 THEN 1 ELSE 1 / (1 + distance) END)) AS quality FROM e),
  y AS (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY quality DESC, dst, id) <= 2 AS highlighted, row_number() OVER (PARTITION BY label ORDER BY quality DESC, id) AS r FROM x)
  SELECT label, id, src, dst, round(quality, 6) AS quality, highlighted, round(src / n * (2 * pi()) - pi() / 2, 6) AS src_angle, round(dst / n * (2 * pi()) - pi() / 2, 6) AS dst_angle FROM y JOIN s USING (label) WHERE r <= 40""")
def graph_layout(spark, sf_dir):
    _, n, _, _, edges = similarity_graph(spark, sf_dir)
    drawn = graph.layout(edges.select("label", (F.col("src").cast("long") * 100_000 + F.col("dst")).alias("id"), "src", "dst", "distance"), n, "label", 40, 2)
    return rounded(drawn.drop("distance"), "quality", "src_angle", "dst_angle")


def two_grids(spark, sf_dir: str):
    """Two grids of a user, with 40,000 seconds taken for one."""
    rows = beats(spark, sf_dir).select("user_id", (F.col("start") / 40_000).alias("start"), "event_type")
    return rows.where("event_type <> 'click'").drop("event_type"), rows.where("event_type <> 'view'").drop("event_type")


@query()
def grid_alignment(spark, sf_dir):
    left, right = two_grids(spark, sf_dir)
    windows = settled(grids.compared_windows(left, right, "user_id"), "windows")
    return rounded(grids.alignment(left, right, windows, "user_id"), "count_ratio", "zero_f1", "best_f1")


@query()
def weak_windows(spark, sf_dir):
    out = grids.weak_windows(grids.compared_windows(*two_grids(spark, sf_dir), "user_id"))
    return rounded(out.drop("reference", "candidate").withColumn("reasons", F.array_join("reasons", ",")), "start", "end", "zero_f1", "best_f1", "weakness", "strength", "readiness")


@query()
def shadow_comparison(spark, sf_dir):
    out = grids.shadow_comparison(*two_grids(spark, sf_dir), "user_id")
    return rounded(out, *[x for x in out.columns if x != "user_id"])


@query()
def agreement_confidence(spark, sf_dir):
    left, right = two_grids(spark, sf_dir)
    windows = settled(grids.compared_windows(left, right, "user_id"), "windows")
    out = grids.agreement_confidence(grids.alignment(left, right, windows, "user_id"), grids.window_confidence(windows), "user_id")
    return rounded(out, "score", "high_ratio")


@query()
def window_correction(spark, sf_dir):
    left, right = two_grids(spark, sf_dir)
    windows = settled(grids.weak_windows(grids.compared_windows(left, right, "user_id")), "windows")
    out = grids.corrected(left, right, windows, "user_id")
    return out.select("user_id", "n_reference", "n_windows", F.coalesce(F.size("corrected"), F.lit(0)).alias("n_corrected"), "reason")


_SETS = """m AS (SELECT event_id AS id, event_id % 3 AS a, event_id % 5 AS b, event_id % 7 AS c, event_id % 11 AS d, event_id % 13 AS e, event_id % 17 AS f, event_id % 19 AS g, event_id % 23 AS h, value FROM events),
st AS (SELECT id, CASE WHEN h > 1 THEN 100 WHEN h = 1 THEN 0 END AS legacy_count, CASE WHEN g > 0 THEN g <> 1 END AS advisor_plausible, CASE WHEN f = 0 THEN 'odd' END AS advisor_rejection, f = 1 AS advisor_dense,
  CASE WHEN e > 0 THEN 70 + 5 * e END AS corrected_count, d = 0 AS dense, d <> 1 AS plausible, CASE WHEN id % 2 = 0 THEN 'corrected-interval-cv-too-high' END AS rejection, 100 + value AS bpm, 0.2 + 0.02 * c AS median_gap, 3 + 0.2 * b AS density,
  CASE WHEN f <> 2 THEN f <> 3 END AS created, a AS accepted, g = 2 AS modifies, g = 3 AS applies, CASE WHEN h = 5 THEN 'claimed' ELSE 'not-evaluated' END AS claim, CASE WHEN id % 4 = 0 THEN 'no-correction-windows-accepted' END AS correction_reason, CASE WHEN g <> 4 THEN a + b END AS planned FROM m),
rs AS (SELECT *, CASE WHEN legacy_count IS NULL THEN 'legacy-candidate-missing' WHEN corrected_count IS NULL THEN 'corrected-experimental-candidate-missing' WHEN created IS NULL THEN 'weak-window-corrections-missing' WHEN planned IS NULL THEN 'weak-window-correction-plan-missing'
  WHEN NOT created THEN 'corrected-candidate-not-created' WHEN accepted < 1 THEN 'accepted-correction-window-count-too-low' WHEN modifies THEN 'hbg07-should-modify-final-grid-unsafe' WHEN applies THEN 'hbg07-should-apply-correction-unsafe'
  WHEN claim <> 'not-evaluated' THEN 'external-benchmark-claim-status-not-evaluated' WHEN planned < 1 THEN 'plan-accepted-correction-window-count-too-low' WHEN dense THEN 'corrected-candidate-dense-grid' WHEN NOT plausible THEN coalesce(rejection, 'corrected-candidate-implausible')
  WHEN bpm > 210 THEN 'corrected-bpm-too-high' WHEN median_gap < 0.22 THEN 'corrected-median-interval-too-low' WHEN density > 4.5 THEN 'corrected-beat-density-too-high' WHEN legacy_count = 0 THEN 'legacy-beat-count-zero'
  WHEN abs(corrected_count / legacy_count - 1) > 0.35 THEN 'corrected-vs-legacy-count-ratio-out-of-range' END AS reason FROM st),
kd AS (SELECT *, CASE WHEN reason IS NULL THEN 'None' WHEN advisor_plausible IS NULL THEN 'AdvisorUnavailable' WHEN advisor_rejection IS NOT NULL OR advisor_dense OR NOT advisor_plausible THEN 'AdvisorRejected'
  WHEN corrected_count IS NULL AND created IS NULL THEN 'CorrectionDiagnosticsMissing' WHEN corrected_count IS NULL AND correction_reason IS NOT NULL THEN 'NoCorrectionWindowsAccepted'
  WHEN corrected_count IS NULL AND (reason LIKE 'corrected-exp%' OR created) THEN 'CorrectedCandidateMissing' WHEN corrected_count IS NULL THEN 'CorrectedCandidateNotCreated'
  WHEN reason LIKE '%dense%' THEN 'CorrectedCandidateDense' WHEN reason LIKE '%count-ratio%' THEN 'CorrectedCandidateCountRatioOutOfRange' WHEN regexp_matches(reason, 'implausible|beat-count-zero|bpm|median-interval|density') THEN 'CorrectedCandidateImplausible'
  WHEN regexp_matches(reason, 'unsafe|accepted-correction-window-count-too-low') THEN 'CorrectedCandidateUnsafe' ELSE 'Unknown' END AS category FROM rs)"""


@query(f"""WITH {_SETS} SELECT id, CASE WHEN reason IS NULL THEN 'selected-corrected-experimental' ELSE 'fallback-to-legacy' END AS status,
  CASE WHEN reason IS NULL THEN 'SelectedCorrectedExperimental' WHEN corrected_count IS NULL THEN 'NotAvailable' ELSE 'FallbackToLegacy' END AS decision,
  CASE WHEN reason IS NULL THEN 'corrected-experimental' WHEN legacy_count IS NOT NULL THEN 'legacy' END AS source, reason, category,
  starts_with(category, 'CorrectedCandidate') OR category IN ('NoCorrectionWindowsAccepted', 'WeakWindowsNotReady') AS safe_noop,
  category IN ('RuntimeFailure', 'AdvisorUnavailable', 'AdvisorRejected', 'CorrectionDiagnosticsMissing') AS failure FROM kd""")
def hybrid_choice(spark, sf_dir):
    at = {x: F.col("event_id") % n for x, n in zip("abcdefgh", (3, 5, 7, 11, 13, 17, 19, 23), strict=True)}
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value", *[c.alias(x) for x, c in at.items()])
    sets = rows.selectExpr(
        "id", "if(h > 0, if(h > 1, 100, 0), null) AS legacy_count", "if(g > 0, g <> 1, null) AS advisor_plausible", "if(f = 0, 'odd', null) AS advisor_rejection", "f = 1 AS advisor_dense",
        "if(e > 0, 70 + 5 * e, null) AS corrected_count", "d = 0 AS dense", "d <> 1 AS plausible", "if(id % 2 = 0, 'corrected-interval-cv-too-high', null) AS rejection", "100 + value AS bpm",
        "0.2 + 0.02 * c AS median_gap", "3 + 0.2 * b AS density", "if(f <> 2, f <> 3, null) AS created", "a AS accepted", "g = 2 AS modifies", "g = 3 AS applies", "if(h = 5, 'claimed', 'not-evaluated') AS claim",
        "if(id % 4 = 0, 'no-correction-windows-accepted', null) AS correction_reason", "'built' AS correction_status", "if(g <> 4, a + b, null) AS planned",
    )
    return hybrid.hybrid_choice(sets, "id", "balanced-probe")


#: Days squeezed into beats: a hundred thousand seconds count as one.
SQUEEZE = 100_000.0


def paced(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Beats (every event but purchases) and downbeats (purchases) at the pace of music."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (C.seconds("ts") / SQUEEZE).alias("start"))
    grid = timeline.navigation(rows.where("event_type <> 'purchase'"), "user_id", ["start", "event_id"], "start").withColumn("confidence", F.col("value") / 100)
    return grid, rows.where("event_type = 'purchase'").select("user_id", "event_id", "start")


_PACED = """ev AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 1e6 / 100000 AS start FROM events),
b AS (SELECT *, row_number() OVER w - 1 AS which, lead(start) OVER w AS nx, coalesce(CASE WHEN lead(start) OVER w > start THEN lead(start) OVER w - start END, CASE WHEN start > lag(start) OVER w THEN start - lag(start) OVER w END, 0.5) AS duration,
  least(greatest(value / 100, 0), 1) AS confidence FROM ev WHERE event_type <> 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)),
d AS (SELECT user_id, event_id, start AS t FROM ev WHERE event_type = 'purchase'),
iv AS (SELECT user_id, coalesce(median(nx - start) FILTER (nx > start), 0.5) AS iv, count(*) AS n, min(start) AS s0, max(start) + greatest(arg_max(duration, which), coalesce(median(nx - start) FILTER (nx > start), 0.5)) AS s1 FROM b GROUP BY user_id),
nr AS (SELECT d.user_id, d.event_id, d.t, arg_min(which, {'g': abs(b.start - t), 'w': which}) AS which, min(abs(b.start - t)) AS g FROM d JOIN b ON b.user_id = d.user_id GROUP BY d.user_id, d.event_id, d.t)"""


@query(f"""WITH {_PACED}, m AS (SELECT DISTINCT user_id, which FROM nr JOIN iv USING (user_id) WHERE t >= s0 AND t <= s1 AND g <= greatest(0.08, least(0.18, 0.3 * iv))),
  sp AS (SELECT user_id, which, n, row_number() OVER w - 1 AS bar, coalesce(lead(which) OVER w, least(n, which + 4)) AS stop FROM m JOIN iv USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY which)),
  z AS (SELECT sp.*, b.start, b.duration AS own, CASE WHEN stop < n THEN e.start - b.start ELSE e.start + e.duration - b.start END AS raw FROM sp JOIN b ON b.user_id = sp.user_id AND b.which = sp.which
    JOIN b e ON e.user_id = sp.user_id AND e.which = CASE WHEN stop < n THEN stop ELSE least(n, sp.which + 4) - 1 END)
  SELECT z.user_id, bar, round(z.start, 6) AS start, round(greatest(1e-6, CASE WHEN stop < n OR raw > 0 THEN raw ELSE own END), 6) AS duration,
    round((SELECT avg(confidence) FROM b c WHERE c.user_id = z.user_id AND c.which >= z.which AND c.which < greatest(z.which + 1, stop)), 8) AS confidence FROM z""")
def bars_from_downbeats(spark, sf_dir):
    grid, down = paced(spark, sf_dir)
    out = hierarchy.bars_from_downbeats(grid, down, "user_id").withColumn("bar", F.col("bar").cast("long"))
    return rounded(out, "start", "duration").withColumn("confidence", F.round("confidence", 8))


@query(f"WITH {_PACED} SELECT DISTINCT nr.user_id, nr.which, round(b.start, 6) AS start FROM nr JOIN b ON b.user_id = nr.user_id AND b.which = nr.which WHERE g <= 0.18")
def snapped_downbeats(spark, sf_dir):
    grid, down = paced(spark, sf_dir)
    return rounded(hierarchy.snapped_downbeats(grid, down, "user_id"), "start")


@query(f"""WITH {_PACED}, m AS (SELECT DISTINCT user_id, which FROM nr WHERE g <= 0.18), g AS (SELECT user_id, lead(which) OVER (PARTITION BY user_id ORDER BY which) - which AS g FROM m),
  c AS (SELECT user_id, arg_min(g, {{'n': -n, 'a': abs(g - 4), 'g': g}}) AS best FROM (SELECT user_id, g, count(*) AS n FROM g WHERE g IN (3, 4, 6) GROUP BY ALL) GROUP BY user_id),
  u AS (SELECT user_id, list_sort(list(g))[count(*) // 2 + 1] AS mid FROM g WHERE g > 1 GROUP BY user_id)
  SELECT user_id, CAST(coalesce(best, CASE WHEN mid IS NULL THEN 4 WHEN mid <= 3 THEN 3 WHEN mid <= 5 THEN 4 ELSE 6 END) AS BIGINT) AS meter FROM (SELECT DISTINCT user_id FROM m) LEFT JOIN c USING (user_id) LEFT JOIN u USING (user_id)""")
def meter(spark, sf_dir):
    grid, down = paced(spark, sf_dir)
    return hierarchy.meter(hierarchy.snapped_downbeats(grid, down, "user_id"), "user_id")


@query(f"""WITH {_PACED}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM nr), y AS (SELECT *, coalesce(t <= lag(t) OVER (PARTITION BY user_id ORDER BY place), false) AS fall FROM x),
  z AS (SELECT user_id, count(*) AS n, bool_or(fall) AS fall, max(g) AS mx FROM y GROUP BY user_id)
  SELECT user_id, n, CASE WHEN fall OR mx > 1.2 THEN 0 ELSE n END AS kept, round(mx, 6) AS max_distance, CASE WHEN fall THEN 'downbeats-not-strictly-increasing' WHEN mx > 1.2 THEN 'downbeat-not-aligned-to-beat' END AS reason FROM z""")
def sane_downbeats(spark, sf_dir):
    grid, down = paced(spark, sf_dir)
    return rounded(hierarchy.sane_downbeats(grid, down.withColumn("place", F.col("event_id")), "user_id", 1.2), "max_distance")


@query(f"WITH {_BEATS} SELECT event_id, round(sin(2 * pi() * (which % 4) / 4), 6) + 0 AS bar_sin, round(cos(2 * pi() * (which % 4) / 4), 6) + 0 AS bar_cos FROM b")
def bar_position(spark, sf_dir):
    out = hierarchy.bar_position(beats(spark, sf_dir))
    return out.select("event_id", (F.round("bar_sin", 6) + 0).alias("bar_sin"), (F.round("bar_cos", 6) + 0).alias("bar_cos"))


_PEAK = _BEATS + """, x AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS nx, max(value) OVER (PARTITION BY user_id) AS top, count(*) OVER (PARTITION BY user_id) AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY which))"""


@query(f"WITH {_PEAK} SELECT event_id, value FROM x WHERE top > 1e-9 AND value >= 0.15 * top AND (n = 1 OR value >= p AND value > nx OR nx IS NULL AND value > p)")
def candidate_peaks(spark, sf_dir):
    return timeline.candidate_peaks(beats(spark, sf_dir), "user_id", "which", "value").select("event_id", "value")


@query(f"WITH {_PEAK} SELECT event_id, value FROM x WHERE value >= 1 AND (p IS NULL OR value >= p) AND (nx IS NULL OR value >= nx)")
def plateau_peaks(spark, sf_dir):
    return timeline.plateau_peaks(beats(spark, sf_dir), "user_id", "which", "value", 1.0).select("event_id", "value")


@query(f"""WITH {_PEAK}, y AS (SELECT user_id, which - lag(which) OVER (PARTITION BY user_id ORDER BY which) AS g FROM x WHERE top > 1e-9 AND value >= 0.5 * top AND (p IS NULL OR value >= p) AND (nx IS NULL OR value > nx))
  SELECT u.user_id, CASE WHEN count(y.user_id) >= 3 THEN round(avg(g) FILTER (g BETWEEN 6 AND 12), 6) END AS period FROM (SELECT DISTINCT user_id FROM b) u LEFT JOIN y USING (user_id) GROUP BY u.user_id""")
def refined_period(spark, sf_dir):
    return rounded(timeline.refined_period(beats(spark, sf_dir), "user_id", "which", "value", 8.0), "period")


@query(f"""WITH {_BEATS}, f AS (SELECT DISTINCT user_id, which AS frame FROM b WHERE event_type = 'click' AND which * 0.02 <= 1.0)
  SELECT f.user_id, frame, round(CAST(frame * 0.02 AS DOUBLE), 6) AS time, round(least(1, greatest(0, (SELECT max(value) FROM b x WHERE x.user_id = f.user_id AND x.which BETWEEN frame - 2 AND frame + 2)) / greatest(1e-9, (SELECT max(value) FROM b y WHERE y.user_id = f.user_id))), 6) AS confidence FROM f""")
def frame_times(spark, sf_dir):
    rows = beats(spark, sf_dir)
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("which").alias("frame"))
    lengths = rows.select("user_id").distinct().withColumn("duration", F.lit(1.0))
    return rounded(timeline.frame_times(clicks, rows.withColumn("frame", F.col("which")), lengths, "user_id", "value", 0.02), "time", "confidence")


@query(f"WITH {_BEATS}, s AS (SELECT user_id, max(start) / 100000 AS d FROM b GROUP BY user_id) SELECT user_id, which, round(CAST(which * 0.5 AS DOUBLE), 6) AS start, CAST(0.35 AS DOUBLE) AS confidence FROM (SELECT user_id, unnest(range(0, CAST(floor(d / 0.5) AS BIGINT) + 1)) AS which FROM s WHERE d > 0)")
def regular_grid(spark, sf_dir):
    lengths = beats(spark, sf_dir).groupBy("user_id").agg((F.max("start") / SQUEEZE).alias("duration"))
    return rounded(timeline.regular_grid(lengths, "user_id"), "start")


def feature_frames(spark, sf_dir: str) -> DataFrame:
    """Events as frames of a track, with vectors made from their values."""
    rows = beats(spark, sf_dir).withColumn("frame", F.col("which"))
    return rows.select("user_id", "frame", F.col("value").alias("rms"), F.array(F.col("value"), F.col("event_id") % 7.0).alias("timbre"), F.array(F.col("value") / 2, F.col("event_id") % 5.0, F.lit(1.0)).alias("pitches"), (F.col("value") / 100).alias("novelty"), F.least(F.lit(1.0), F.col("value") / 100).alias("onset"))


@query(f"""WITH {_BEATS}, n AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id), s AS (SELECT user_id, n, unnest(range(0, CAST(ceil(n / 5.0) AS BIGINT))) AS which FROM n),
  f AS (SELECT s.user_id, s.which, b.which AS frame, value, event_id % 7 AS y FROM s JOIN b ON b.user_id = s.user_id AND b.which BETWEEN least(n - 1, s.which * 5) AND least(n - 1, s.which * 5 + 7))
  SELECT user_id, which, round(median(value), 6) AS a, round(median(y), 6) AS b, round(arg_min(value, frame), 6) AS first, round(max(value), 6) AS top, round(avg(value), 6) AS mean FROM f GROUP BY user_id, which""")
def beat_features(spark, sf_dir):
    rows = feature_frames(spark, sf_dir)
    grid = rows.where("frame % 5 = 0").select("user_id", (F.col("frame") / 5).cast("long").alias("which"), (F.col("frame") / 5 * 0.25).alias("start"), F.lit(0.375).alias("duration"))
    out = summaries.beat_features(grid, rows, "user_id", "timbre", "rms", 20.0)
    return rounded(out.select("user_id", "which", F.col("timbre")[0].alias("a"), F.col("timbre")[1].alias("b"), F.col("loudness")[0].alias("first"), F.col("loudness")[1].alias("top"), F.col("loudness")[2].alias("mean")), "a", "b", "first", "top", "mean")


@query(f"""WITH {_BEATS}, f AS (SELECT user_id, which // 22 AS segment, which AS frame, value, event_id % 7 AS y, value / 2 AS h, event_id % 5 AS i, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM b),
  g AS (SELECT user_id, segment, min(frame) AS f0, max(frame) AS f1, arg_min(value, frame) AS v0, max(value) AS top, arg_max(frame, {{'v': value, 'f': -frame}}) AS ft, avg(value) AS ta, avg(y) AS tb, avg(h) AS pa, avg(i) AS pb, any_value(lo) AS lo, any_value(hi) AS hi FROM f GROUP BY user_id, segment)
  SELECT user_id, segment, round(CAST(f0 * 0.01 AS DOUBLE), 6) AS start, round(CAST((f1 - f0) * 0.01 + 0.02 AS DOUBLE), 6) AS duration, round(CASE WHEN segment = 0 THEN 0.5 WHEN hi > lo THEN (v0 - lo) / (hi - lo) ELSE 0 END, 6) AS confidence, round(v0, 6) AS loudness_start, round(top, 6) AS loudness_max, round(CAST((ft - f0) * 0.01 AS DOUBLE), 6) AS loudness_max_time,
    round(ta, 6) AS timbre_a, round(tb, 6) AS timbre_b, round(pa / greatest(pa, pb, 1), 6) AS pitch_a, round(1 / greatest(pa, pb, 1), 6) AS pitch_c FROM g""")
def temporal_segments(spark, sf_dir):
    rows = feature_frames(spark, sf_dir)
    return flat_segments(segments.segments(rows, segments.temporal_boundaries(rows, "user_id", 0.01, 0.02), "user_id", 0.01, 0.02))


def flat_segments(out: DataFrame) -> DataFrame:
    vectors = {"timbre_a": F.col("timbre")[0], "timbre_b": F.col("timbre")[1], "pitch_a": F.col("pitches")[0], "pitch_c": F.col("pitches")[2]}
    names = ["start", "duration", "confidence", "loudness_start", "loudness_max", "loudness_max_time", *vectors]
    return rounded(out.withColumns(vectors).withColumn("segment", F.col("segment").cast("long")).select("user_id", "segment", *names), *names)


@query()
def novelty_segments(spark, sf_dir):
    rows = feature_frames(spark, sf_dir)
    found = segments.novelty_boundaries(rows, "user_id", 0.02).where("mode = 'novelty'")
    return flat_segments(segments.segments(rows, found, "user_id", 0.02, 0.04))


@query()
def boundary_ratio(spark, sf_dir):
    rows = feature_frames(spark, sf_dir)
    return rounded(segments.boundary_ratio(rows, segments.novelty_boundaries(rows, "user_id", 0.02), "user_id"), "ratio")


@query(f"""WITH {_BEATS}, n AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id), sg AS (SELECT *, which // 3 AS quantum, which % 3 AS place, [value, event_id % 7] AS tm, [event_id % 5, 1] AS pt FROM b WHERE which % 13 <> 5),
  qa AS (SELECT DISTINCT user_id, which // 3 AS quantum FROM b), pr AS (SELECT x.user_id, x.quantum AS src, y.quantum AS dst FROM qa x JOIN qa y ON x.user_id = y.user_id AND y.quantum - x.quantum BETWEEN 1 AND 3),
  z AS (SELECT pr.*, CASE WHEN a.which IS NULL THEN 'inf'::DOUBLE WHEN c.which IS NULL THEN 100 ELSE list_distance(a.tm::DOUBLE[], c.tm::DOUBLE[]) + 10 * list_distance(a.pt::DOUBLE[], c.pt::DOUBLE[]) + abs(a.value - c.value) + abs(a.value / 2 - c.value / 2)
    + 100 * abs(a.event_id % 3 - c.event_id % 3) + abs(a.event_id % 2 - c.event_id % 2) END AS d FROM pr LEFT JOIN sg a ON a.user_id = pr.user_id AND a.quantum = src LEFT JOIN sg c ON c.user_id = pr.user_id AND c.quantum = dst AND c.place = a.place)
  SELECT user_id, src, dst, CASE WHEN isinf(avg(d)) THEN -1 ELSE round(avg(d), 6) END AS distance FROM z GROUP BY user_id, src, dst""")
def positional_distance(spark, sf_dir):
    rows = beats(spark, sf_dir).withColumn("quantum", F.floor(F.col("which") / 3))
    body = F.struct(F.array(F.col("value"), F.col("event_id") % 7.0).alias("timbre"), F.array(F.col("event_id") % 5.0, F.lit(1.0)).alias("pitches"), F.col("value").alias("loudness_start"), (F.col("value") / 2).alias("loudness_max"), (F.col("event_id") % 3).alias("duration"), (F.col("event_id") % 2).alias("confidence"))
    held = rows.where("which % 13 <> 5").select("user_id", "quantum", (F.col("which") % 3).alias("place"), F.col("which").alias("segment"), body.alias("s"))
    own = rows.groupBy("user_id").agg(F.max("quantum").alias("top"))
    pairs = own.select("user_id", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("src")).select("user_id", "top", "src", F.explode(F.array(*[F.col("src") + k for k in (1, 2, 3)])).alias("dst")).where("dst <= top")
    out = graph.positional_distance(pairs.select("user_id", "src", "dst"), held, "user_id")
    return out.withColumn("distance", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.round("distance", 6)))


@query()
def adaptive_tatums(spark, sf_dir):
    grid, _ = paced(spark, sf_dir)
    onsets = feature_frames(spark, sf_dir).select("user_id", "frame", "onset")
    return rounded(folds.adaptive_tatums(grid, onsets, "user_id", 2.5), "start", "duration", "confidence")


def timed_onsets(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Onsets of a track, every fourth frame as its beats, and a period of four frames."""
    onsets = feature_frames(spark, sf_dir).select("user_id", "frame", "onset")
    periods = onsets.groupBy("user_id").agg((F.count("*") / 50.0).alias("duration")).withColumn("period", F.lit(4.0))
    return onsets, onsets.where("frame % 4 = 1 and onset > 0.2").select("user_id", "frame"), periods


@query()
def dense_beats(spark, sf_dir):
    onsets, _, periods = timed_onsets(spark, sf_dir)
    return beatgrids.dense_beats(onsets, periods, "user_id", "onset", 1.0)


@query()
def usable_grid(spark, sf_dir):
    onsets, own, periods = timed_onsets(spark, sf_dir)
    return beatgrids.usable_grid(onsets, own, periods, "user_id", "onset", 50.0, beatgrids.MICRO_SNAP)


@query()
def composite_beats(spark, sf_dir):
    onsets, own, periods = timed_onsets(spark, sf_dir)
    return beatgrids.composite_beats(onsets, own, periods, "user_id", "onset", 1.0)


@query()
def elastic_beats(spark, sf_dir):
    onsets, _, periods = timed_onsets(spark, sf_dir)
    return beatgrids.elastic_beats(onsets, onsets.where("frame % 4 = 1").select("user_id", "frame"), periods, "user_id", "onset", 50.0)


@query()
def piecewise_beats(spark, sf_dir):
    onsets, _, periods = timed_onsets(spark, sf_dir)
    own = onsets.where("frame % 2 = 1").select("user_id", "frame")
    return beatgrids.piecewise_beats(onsets, own, periods.withColumn("period", F.lit(2.0)), "user_id", "onset", 50.0)


def scored_tempos(spark, sf_dir: str) -> DataFrame:
    """A user's frames with four tempi whose own scores come from the user's number."""
    onsets, _, _ = timed_onsets(spark, sf_dir)
    tempo = F.posexplode(F.array(*[F.struct(F.lit(b).alias("bpm"), F.lit(o).alias("origin")) for b, o in ((90.0, "autocorrelation"), (180.0, "double-time"), (60.0, "half-time"), (120.0, "refined-peak"))]))
    own = onsets.select("user_id").distinct().select("user_id", tempo.alias("place", "t"))
    candidates = own.select("user_id", F.col("place").cast("long").alias("place"), "t.*", ((F.col("user_id") * (F.col("place") + 3)) % 7 / 7.0).alias("score"))
    return settled(beatgrids.tempo_scores(onsets, candidates, "user_id", "onset", 8.0, 1.0), "tempos")


@query()
def tempo_scores(spark, sf_dir):
    return rounded(scored_tempos(spark, sf_dir), "score", "grid_score")


@query()
def selected_tempo(spark, sf_dir):
    return rounded(beatgrids.selected_tempo(scored_tempos(spark, sf_dir), "user_id"), "score")


def vector_bars(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars of the embeddings, two seconds a bar, and their tracks' durations."""
    bars_ = segments.bar_vectors(quanta(spark, sf_dir).select("label", "which", "v"), "label", "v", 2)
    bars_ = bars_.select("label", "bar", (F.col("bar") * 6.0).alias("start"), F.col("v").alias("vector"))
    return bars_, bars_.groupBy("label").agg((F.max("start") + 6.0).alias("duration"))


@query(f"""WITH {_QUANTA}, x AS (SELECT label, which // 2 AS bar, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM q) SELECT label, bar, dim, round(avg(x), 6) AS x FROM x GROUP BY label, bar, dim""")
def bar_vectors(spark, sf_dir):
    out = vector_bars(spark, sf_dir)[0].select("label", "bar", F.posexplode("vector").alias("dim", "x"))
    return rounded(out.withColumn("dim", F.col("dim").cast("long")), "x")


@query()
def structural_sections(spark, sf_dir):
    return rounded(segments.structural_sections(*vector_bars(spark, sf_dir), "label"), "start", "duration", "confidence")


@query()
def section_novelty(spark, sf_dir):
    return rounded(segments.section_novelty(*vector_bars(spark, sf_dir), "label"), "mean", "max")


@query(f"""WITH {_CONFIDENT}, s AS (SELECT user_id, which // 10 AS which, min(start) AS start, max(start) - min(start) AS len FROM d GROUP BY user_id, which // 10),
  m AS (SELECT s.user_id, s.which, any_value(s.start) AS start, any_value(len) AS len, coalesce(avg(confidence), 0) AS c, coalesce(avg(event_id % 7 / 7), 0) AS l FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.start >= s.start AND d.start < s.start + len GROUP BY s.user_id, s.which)
  SELECT user_id, which, round(start, 6) AS start, round(len, 6) AS duration, round(CASE WHEN max(c) OVER w > min(c) OVER w THEN (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) ELSE 0 END, 6) AS confidence, round(l, 6) AS loudness FROM m WINDOW w AS (PARTITION BY user_id)""")
def enriched_sections(spark, sf_dir):
    rows = confident(spark, sf_dir)
    spans = rows.groupBy("user_id", F.floor(F.col("which") / 10).alias("which")).agg(F.min("start").alias("start"), (F.max("start") - F.min("start")).alias("duration"))
    return rounded(segments.enriched_sections(spans, rows, "user_id"), "start", "duration", "confidence", "loudness")


@query(f"""WITH {_EDGES}, g AS (SELECT e.*, (src + dst) % 9 = 0 AS gone FROM e) SELECT label, src, dst, round(distance, 6) AS distance FROM g WHERE NOT gone AND dst < (SELECT count(*) - 3 FROM q WHERE q.label = g.label)
  AND src < (SELECT count(*) - 3 FROM q WHERE q.label = g.label)""")
def valid_edges(spark, sf_dir):
    q, n, _, _, edges = similarity_graph(spark, sf_dir)
    known = q.join(n, "label").where("which < n - 3").select("label", "which")
    marked = edges.select("label", "src", "dst", "distance", ((F.col("src") + F.col("dst")) % 9 == 0).alias("deleted"))
    return rounded(graph.valid_edges(marked, known, "label").select("label", "src", "dst", "distance"), "distance")


@query(f"""WITH {_FRAMES}, r AS (SELECT user_id, frame, sqrt(sum(x * x) / 9) AS r FROM m GROUP BY user_id, frame) SELECT user_id, frame, round(CASE WHEN max(r) OVER w > 0 THEN r / max(r) OVER w ELSE r END, 6) AS rms FROM r WINDOW w AS (PARTITION BY user_id)""")
def spectral_rms(spark, sf_dir):
    return rounded(frames.spectral_rms(spectra(spark, sf_dir), "user_id"), "rms")


@query(f"""WITH {_PACED}, k AS (SELECT user_id, count(*) AS n, 60 / median(nx - start) FILTER (nx > start) AS bpm, count(*) FILTER (nx <= start) AS back, avg(value / 100) AS conf,
    max(start + duration) AS length, CASE WHEN count(*) >= 3 THEN stddev_pop(nx - start) / avg(nx - start) END AS ratio FROM b GROUP BY user_id),
  h AS (SELECT user_id, count(*) FILTER (t <= p) AS back, count(*) FILTER (g IS NULL OR g > 0.03) AS far FROM
    (SELECT d.user_id, d.t, g, lag(d.t) OVER (PARTITION BY d.user_id ORDER BY d.t) AS p FROM d LEFT JOIN nr USING (user_id, event_id)) GROUP BY user_id),
  c AS (SELECT k.*, h.back AS hb, far, CASE WHEN user_id % 3 = 0 THEN (user_id % 10) / 10 END AS cover FROM k LEFT JOIN h USING (user_id))
  SELECT user_id, n, CASE WHEN n < 2 THEN 'beat-count-too-low' WHEN bpm IS NULL OR bpm < 40 OR bpm > 220 THEN 'bpm-out-of-range' WHEN back > 0 THEN 'beat-times-not-strictly-increasing'
    WHEN conf < 0.01 THEN 'confidence-too-low' WHEN length > 0 AND n / length > 6.5 THEN 'beat-density-too-high' WHEN ratio > 0.65 THEN 'beat-interval-stddev-too-high'
    WHEN hb > 0 THEN 'downbeat-times-not-strictly-increasing' WHEN far > 0 THEN 'downbeat-not-aligned-to-beat' WHEN length > 0 AND cover < 0.8 THEN 'ai-coverage-too-low' END AS failure FROM c""")
def guardrails(spark, sf_dir):
    grid, down = paced(spark, sf_dir)
    tracks = grid.groupBy("user_id").agg(F.max(F.col("start") + F.col("duration")).alias("duration")).join(summaries.grid_quality(grid, "user_id").select("user_id", "bpm"), "user_id")
    tracks = tracks.withColumn("coverage", F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 10) / 10))
    return summaries.guardrails(grid, down, tracks, "user_id")


_LEVELS = {"beat": "true", "bar": "event_type = 'purchase'", "tatum": "event_type = 'click'", "section": "event_type = 'error'", "segment": "event_type = 'view' and value < 40"}
_RULED = " UNION ALL ".join(
    f"""SELECT user_id, unnest(list_filter([CASE WHEN start - 432000 < 0 THEN '{x.capitalize()} start cannot be negative.' END, CASE WHEN value - 5 <= 0 THEN '{x.capitalize()} duration must be greater than zero.' END,
    CASE WHEN {x == "section"} AND value - 20 <= 0 THEN 'Section tempo must be greater than zero.' END], lambda y: y IS NOT NULL)) AS error FROM b WHERE {test}
  UNION ALL SELECT DISTINCT user_id, 'Analysis must contain at least one {x}.' FROM b o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = o.user_id AND {test})"""
    for x, test in _LEVELS.items()
)


@query(f"""WITH {_BEATS}, x AS ({_RULED} UNION ALL SELECT user_id, 'Metadata tempo must be greater than zero.' FROM b GROUP BY user_id HAVING min(value) - 1 <= 0
  UNION ALL SELECT user_id, 'Metadata file hash is required.' FROM b GROUP BY user_id HAVING max(value) < 90) SELECT user_id, error, count(*) AS n FROM x GROUP BY user_id, error""")
def sanity_errors(spark, sf_dir):
    rows = beats(spark, sf_dir).select("user_id", "event_type", "value", (F.col("start") - 432_000).alias("start"), (F.col("value") - 5).alias("duration"), (F.col("value") - 20).alias("tempo"))
    tracks = rows.groupBy("user_id").agg((F.min("value") - 1).alias("tempo"), F.when(F.max("value") >= 90, F.lit("known")).alias("file_hash"))
    return checks.sanity_errors(tracks, {x: rows.where(test) for x, test in _LEVELS.items()}, "user_id")


@query(f"WITH {_BEATS} SELECT event_id, round(value - 0.97 * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY which), 0), 6) AS emphasised FROM b")
def pre_emphasis(spark, sf_dir):
    return rounded(frames.pre_emphasis(beats(spark, sf_dir), "user_id", "which", "value", "emphasised").select("event_id", "emphasised"), "emphasised")


@query("""SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'purchase' AND value > 50), min(event_id)) AS event_id FROM events GROUP BY user_id""")
def cache_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    changes = rows.where("event_type = 'purchase' and value > 50").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return cache.upsert(rows.groupBy("user_id").agg(F.min("event_id").alias("event_id")), changes, "user_id")


@query(f"""WITH {_FRAMES}, r AS (SELECT user_id, frame, round(sqrt(sum(x * x) / 16), 6) AS rms FROM x GROUP BY user_id, frame),
  s AS (SELECT user_id, frame, round(sum(x) / 9, 6) AS mean FROM m WHERE frame > 0 GROUP BY user_id, frame) SELECT r.user_id, r.frame, rms, mean FROM r JOIN s ON r.user_id = s.user_id AND r.frame = s.frame""")
def feature_matrix(spark, sf_dir):
    loud = framed(spark, sf_dir).select("user_id", "frame", F.round(frames.rms(F.col("samples")), 6).alias("rms"))
    mean = spectra(spark, sf_dir).where("frame > 0").select("user_id", "frame", F.round(frames.total(F.col("spectrum")) / 9, 6).alias("mean"))
    return frames.assembled("user_id", loud, mean)


@query(f"""WITH {_EDGES}, z AS (SELECT label, which, which >= floor(n * 0.85) OR n - which <= 16 AS zone FROM q JOIN s USING (label)),
  o AS (SELECT e.label, src, dst, distance, zone FROM e JOIN z ON z.label = e.label AND z.which = e.dst),
  e1 AS (SELECT DISTINCT q.label, q.which FROM q JOIN o ON o.label = q.label AND o.src BETWEEN q.which AND q.which + 23 WHERE NOT zone),
  e2 AS (SELECT * FROM e1 UNION SELECT q.label, q.which FROM q JOIN o ON o.label = q.label AND o.src BETWEEN q.which AND q.which + 23 JOIN e1 ON e1.label = o.label AND e1.which = o.dst),
  e3 AS (SELECT * FROM e1 UNION SELECT q.label, q.which FROM q JOIN o ON o.label = q.label AND o.src BETWEEN q.which AND q.which + 23 JOIN e2 ON e2.label = o.label AND e2.which = o.dst)
  SELECT o.label, o.src, o.dst, zone AS end_zone, NOT zone OR e3.which IS NOT NULL AS safe,
    CASE WHEN NOT zone THEN 'Destination outside end zone' WHEN e3.which IS NOT NULL THEN 'Destination has future escape' ELSE 'Destination has no terminal escape' END AS reason
  FROM o LEFT JOIN e3 ON e3.label = o.label AND e3.which = o.dst""")
def escape_guard(spark, sf_dir):
    q, _, _, _, edges = similarity_graph(spark, sf_dir)
    edges = settled(edges, "edges")
    return escape.escape_guard(q, edges, "label").select("label", "src", "dst", "end_zone", "safe", "reason")


@query(f"""WITH {_BEATS}, n AS (SELECT user_id, count(*) AS n FROM b GROUP BY user_id),
  k AS (SELECT user_id, unnest(range(0, CAST(ceil(n * 2 / 3.0) AS BIGINT))) AS which FROM n),
  w AS (SELECT k.user_id, k.which, (3 * k.which) // 2 + d AS i, ((3 * k.which) % 2) / 2.0 - d AS t FROM k, (SELECT unnest(range(-23, 25)) AS d)),
  g AS (SELECT *, CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t * 2 / 3) / (pi() * t * 2 / 3) END * power(cos(pi() * t / 48), 2) AS g FROM w)
  SELECT g.user_id, g.which, round(sum(g * coalesce(value, 0)) / sum(g), 6) AS x FROM g LEFT JOIN b ON b.user_id = g.user_id AND b.which = g.i GROUP BY g.user_id, g.which""")
def resampled_values(spark, sf_dir):
    rows = beats(spark, sf_dir).select("user_id", "which", F.col("value").alias("x"), F.lit(3).alias("rate"))
    return rounded(resample.resampled(rows, "user_id", "which", "x", "rate", 2), "x")


def analysis_texts(spark, sf_dir: str) -> DataFrame:
    """A JSON analysis for each user, its beats and segments the user's events; some break the contract."""
    odd = lambda column, n, bad, good: F.when(F.pmod(F.col(column), F.lit(n)) == 0, F.lit(bad)).otherwise(F.lit(good))
    rows = beats(spark, sf_dir).select("user_id", "event_id", "event_type", "which")
    quantum = F.concat(F.lit('{"start": '), F.col("which").cast("string"), odd("event_id", 11, ', "duration": null', ', "duration": 1.5'), F.lit(', "confidence": '), F.when(F.col("event_type") == "click", '"high"').otherwise("0.5"))
    beat = F.when(F.pmod(F.col("event_id"), F.lit(17)) == 0, "3").otherwise(F.concat(quantum, F.lit("}")))
    segment = F.concat(F.lit('{"start": 1, "duration": 1e400, "confidence": 1, "loudness_start": -1.5'), odd("event_id", 5, ', "loudness_max": true', ', "loudness_max": 2'), F.lit(', "loudness_max_time": 0'), odd("event_id", 13, ', "pitches": [1, "x", 2, [3]]', ', "pitches": [1, 2]'), odd("event_id", 7, "", ', "timbre": []'), F.lit("}"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("which", c.alias("t")))), lambda s: s["t"]), ","), F.lit("]"))
    held = rows.groupBy("user_id").agg(listed(beat).alias("beats"), listed(segment).alias("segments"))
    text = F.concat(F.lit("{"), odd("user_id", 7, "", '"info": {"title": "t"}, '), odd("user_id", 4, '"audio_summary": 5', '"audio_summary": {"duration": 9}'), F.lit(', "analysis": {"sections": [], "bars": [{}]'), odd("user_id", 5, ', "tatums": {}', ', "tatums": []'), F.lit(', "beats": '), F.col("beats"), F.lit(', "segments": '), F.col("segments"), F.lit("}}"))
    return held.select("user_id", F.when(F.pmod(F.col("user_id"), F.lit(29)) == 0, "{").otherwise(text).alias("document"))


@query(f"""WITH {_BEATS}, u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT * FROM b WHERE user_id % 29 <> 0),
  v AS (SELECT user_id, 'Analysis root' AS path, NULL AS place, 'object' AS kind FROM u WHERE user_id % 29 = 0
    UNION ALL SELECT user_id, 'info', NULL, 'object' FROM u WHERE user_id % 7 = 0 AND user_id % 29 <> 0
    UNION ALL SELECT user_id, 'audio_summary', NULL, 'object' FROM u WHERE user_id % 4 = 0 AND user_id % 29 <> 0
    UNION ALL SELECT user_id, 'analysis.tatums', NULL, 'array' FROM u WHERE user_id % 5 = 0 AND user_id % 29 <> 0
    UNION ALL SELECT user_id, 'analysis.bars[0].' || f, 0, 'number' FROM u, (SELECT unnest(['start', 'duration', 'confidence']) AS f) WHERE user_id % 29 <> 0
    UNION ALL SELECT user_id, 'analysis.beats[' || which || ']', which, 'object' FROM g WHERE event_id % 17 = 0
    UNION ALL SELECT user_id, 'analysis.beats[' || which || '].duration', which, 'number' FROM g WHERE event_id % 17 <> 0 AND event_id % 11 = 0
    UNION ALL SELECT user_id, 'analysis.beats[' || which || '].confidence', which, 'number' FROM g WHERE event_id % 17 <> 0 AND event_type = 'click'
    UNION ALL SELECT user_id, 'analysis.segments[' || which || '].duration', which, 'number' FROM g
    UNION ALL SELECT user_id, 'analysis.segments[' || which || '].loudness_max', which, 'number' FROM g WHERE event_id % 5 = 0
    UNION ALL SELECT user_id, 'analysis.segments[' || which || '].pitches[' || k || ']', k, 'number' FROM g, (SELECT unnest([1, 3]) AS k) WHERE event_id % 13 = 0
    UNION ALL SELECT user_id, 'analysis.segments[' || which || '].timbre', which, 'array' FROM g WHERE event_id % 7 = 0)
  SELECT user_id, path, CAST(place AS INTEGER) AS place, path || CASE kind WHEN 'object' THEN ' must be an object.' WHEN 'array' THEN ' must be an array.' ELSE ' must be a finite number.' END AS message FROM v""")
def analysis_violations(spark, sf_dir):
    return contracts.violation_rows(analysis_texts(spark, sf_dir), "user_id", "document")


def _made_windows(name: str) -> str:
    return f"""{name} AS (SELECT user_id, event_id AS "window", event_id * 10.0 AS start, event_id * 10.0 + event_id % 23 AS "end", CASE WHEN event_id % 19 > 0 THEN (event_id % 17) * 20.0 - 160 END AS offset_ms,
    (event_id % 11) / 10.0 AS strength, (event_id % 13) / 12.0 AS readiness, CASE event_id % 7 WHEN 0 THEN 'Blocked' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS risk, event_id % 5 > 0 AS weak, event_id % 6 > 0 AS promising,
    event_id % 4 > 0 AS correctable, CASE WHEN event_id % 8 > 0 THEN 'CandidateForExperimentalCorrection' ELSE 'DiagnosticOnly' END AS verdict, event_id % 9 AS n_reference, event_id % 9 + event_id % 3 AS n_candidate FROM events)"""


_TRIED = f"""{_made_windows("w")},
  j AS (SELECT *, coalesce(abs(n_candidate / nullif(n_reference, 0) - 1), 998) > 0.45 AS bad, coalesce(abs(offset_ms), 999) > 160 AS off, strength < 0.5 AS soft, readiness < 0.6 AS raw,
    correctable AND promising AND risk IN ('Low', 'Medium') AND verdict = 'CandidateForExperimentalCorrection' AS asked FROM w),
  x AS (SELECT *, CASE WHEN risk IN ('High', 'Blocked') THEN 'high-risk-window' WHEN "end" - start > 20 THEN 'window-duration-too-long' WHEN off THEN 'offset-too-large' WHEN soft THEN 'advisor-strength-too-low' WHEN raw THEN 'correction-readiness-too-low' WHEN bad THEN 'bad-count-ratio' END AS broken,
    CASE WHEN asked THEN row_number() OVER (PARTITION BY user_id, asked ORDER BY readiness DESC, CASE WHEN risk = 'Low' THEN 0 ELSE 1 END, start) END AS place FROM j),
  r AS (SELECT *, CASE WHEN place <= 8 THEN place END AS turn, CASE WHEN place <= 8 THEN broken END AS rejection, CASE WHEN place <= 8 THEN CASE WHEN broken IS NULL THEN 'CandidateCreated' ELSE 'Rejected' END END AS decision,
    CASE WHEN NOT weak THEN 'not-weak-window' WHEN NOT promising THEN 'advisor-not-promising' WHEN NOT correctable AND risk = 'Blocked' THEN 'risk-blocked' WHEN NOT correctable AND risk = 'High' THEN 'risk-high' WHEN NOT correctable AND raw THEN 'correction-readiness-too-low'
      WHEN NOT correctable AND soft THEN 'advisor-strength-too-low' WHEN NOT correctable AND bad THEN 'bad-count-ratio' WHEN NOT correctable AND off THEN 'offset-too-large' WHEN NOT correctable THEN 'future-correction-candidate-false' ELSE coalesce(broken, 'candidate-window') END AS blocker FROM x)"""


def decided_windows(spark, sf_dir: str) -> DataFrame:
    """Windows made from the events, so that every decision and blocker occurs, under the balanced profile."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "user_id", e.alias("window"), (e * 10.0).alias("start"), (e * 10.0 + e % 23).alias("end"), F.when(e % 19 > 0, (e % 17) * 20.0 - 160).alias("offset_ms"), ((e % 11) / 10.0).alias("strength"), ((e % 13) / 12.0).alias("readiness"),
        F.when(e % 7 == 0, "Blocked").when(e % 7 == 1, "High").when(e % 7 == 2, "Medium").otherwise("Low").alias("risk"), (e % 5 > 0).alias("weak"), (e % 6 > 0).alias("promising"), (e % 4 > 0).alias("correctable"),
        F.when(e % 8 > 0, "CandidateForExperimentalCorrection").otherwise("DiagnosticOnly").alias("verdict"), (e % 9).alias("n_reference"), (e % 9 + e % 3).alias("n_candidate"),
    )
    return corrections.decisions(rows, "user_id", "balanced-probe")


@query(f'WITH {_TRIED} SELECT user_id, "window", turn, decision, rejection, blocker FROM r')
def correction_decisions(spark, sf_dir):
    return decided_windows(spark, sf_dir).select("user_id", "window", F.col("turn").cast("long").alias("turn"), "decision", "rejection", "blocker")


@query(f"""WITH {_TRIED}, b AS (SELECT user_id, blocker, count(*) AS n FROM r GROUP BY user_id, blocker),
  t AS (SELECT user_id, string_agg(blocker || '=' || n, ',' ORDER BY blocker) AS blockers, array_to_string(list(blocker ORDER BY n DESC, blocker)[1:12], ',') AS top_blockers FROM b GROUP BY user_id)
  SELECT user_id, count(*) AS n_windows, count(*) FILTER (weak) AS n_weak, count(turn) AS n_candidates, count(*) FILTER (decision = 'CandidateCreated') AS n_accepted, count(*) FILTER (decision = 'Rejected') AS n_rejected,
    least(12, count(*) FILTER (weak OR promising OR readiness > 0)) AS n_shown, any_value(blockers) AS blockers, any_value(top_blockers) AS top_blockers FROM r JOIN t USING (user_id) GROUP BY user_id""")
def correction_summary(spark, sf_dir):
    out = corrections.correction_summary(decided_windows(spark, sf_dir), "user_id")
    listed = F.array_join(F.transform(F.map_entries("blockers"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return out.withColumns({"blockers": listed, "top_blockers": F.array_join("top_blockers", ","), "n_shown": F.col("n_shown").cast("long")})


@query()
def tempo_candidates(spark, sf_dir):
    rows = beats(spark, sf_dir).select("event_type", F.floor(F.col("start") / 1800).alias("hour"), "value").groupBy("event_type", "hour").agg(F.sum("value").alias("x"))
    which = F.row_number().over(timeline.Window.partitionBy("event_type").orderBy("hour")) - 1
    odf = timeline.onset_detection(rows.withColumn("frame", which), "event_type", "frame", "x")
    return rounded(tracker.tempo_candidates(odf.select("event_type", "frame", "odf"), "event_type", "odf", 20.0), "bpm", "score")


def tracked(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Beats of the users' feature frames; some users' durations are missing, some have a broken strength."""
    rows = feature_frames(spark, sf_dir).select("user_id", "frame", F.when((F.pmod("user_id", F.lit(31)) == 3) & (F.col("frame") == 1), float("nan")).otherwise(F.col("onset")).alias("flux"), "onset")
    tracks = rows.groupBy("user_id").agg((F.count("*") / 8.0).alias("duration")).withColumn("duration", F.when(F.pmod("user_id", F.lit(17)) > 0, F.col("duration")))
    return tracker.track_beats(rows, tracks, "user_id", 8.0, tightness=1.0)


@query()
def tracked_beats(spark, sf_dir):
    return rounded(tracked(spark, sf_dir)[0], "start", "confidence")


@query()
def tracked_summary(spark, sf_dir):
    return rounded(tracked(spark, sf_dir)[1], "bpm")


@query(f"""WITH {_BEATS}, u AS (SELECT DISTINCT user_id FROM events),
  t AS (SELECT user_id, CASE user_id % 7 WHEN 0 THEN 'BuiltIn' WHEN 1 THEN 'Auto' WHEN 2 THEN 'Shadow' WHEN 3 THEN 'Hybrid' WHEN 4 THEN 'other' ELSE 'BeatThis' END AS provider, user_id % 2 = 0 AS fallback, CASE WHEN user_id % 3 = 0 THEN 'bpm-out-of-range' END AS failure,
    EXISTS (SELECT 1 FROM b WHERE b.user_id = u.user_id AND event_type = 'click' AND b.user_id % 11 > 0) AS advised, EXISTS (SELECT 1 FROM b WHERE b.user_id = u.user_id AND event_type = 'purchase' AND b.user_id % 4 > 0) AS corrected FROM u),
  r AS (SELECT *, CASE WHEN provider = 'BeatThis' AND NOT advised THEN 'beat-this-provider-not-configured' WHEN provider = 'BeatThis' AND failure IS NOT NULL THEN 'beat-this-guardrail-rejected:' || failure END AS reason FROM t),
  c AS (SELECT *, CASE WHEN provider = 'other' THEN 'unsupported-provider' WHEN reason IS NOT NULL AND NOT fallback THEN 'provider-rejected' END AS code FROM r),
  s AS (SELECT *, CASE WHEN code IS NOT NULL THEN NULL WHEN provider = 'BeatThis' AND reason IS NULL THEN 'advisor' WHEN provider = 'Hybrid' AND corrected THEN 'corrected' ELSE 'built-in' END AS source FROM c)
  SELECT s.user_id, source, reason, code, count(start) AS n, round(coalesce(sum(start), 0), 3) AS total FROM s LEFT JOIN b ON b.user_id = s.user_id
    AND (source = 'built-in' AND event_type = 'view' OR source = 'advisor' AND event_type = 'click' AND b.user_id % 11 > 0 OR source = 'corrected' AND event_type = 'purchase' AND b.user_id % 4 > 0) GROUP BY s.user_id, source, reason, code""")
def provided_beats(spark, sf_dir):
    rows = beats(spark, sf_dir).select("user_id", "start", F.lit(0.5).alias("confidence"), "event_type")
    grid = lambda kind, n: rows.where((F.col("event_type") == kind) & (F.pmod("user_id", F.lit(n)) > 0 if n else F.lit(True)))
    users = rows.select("user_id").distinct()
    names = F.array(*map(F.lit, ("BuiltIn", "Auto", "Shadow", "Hybrid", "other", "BeatThis", "BeatThis")))
    tracks = users.select("user_id", F.get(names, F.pmod("user_id", F.lit(7)).cast("int")).alias("provider"), (F.pmod("user_id", F.lit(2)) == 0).alias("fallback"))
    failures = users.select("user_id", F.when(F.pmod("user_id", F.lit(3)) == 0, "bpm-out-of-range").alias("failure"))
    final, told = tracker.provided(tracks, grid("view", 0), grid("click", 11), failures, grid("purchase", 4), "user_id")
    sums = final.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("start").alias("total"))
    return told.join(sums, "user_id", "left").select("user_id", "source", "reason", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total"))


@query("""WITH i AS (SELECT user_id, event_id AS item, user_id % 7 AS size, 'b' || event_id % 5 || '-' || user_id AS branch_key, 'r' || event_id % 20 || '-' || user_id AS runtime_key, event_id % 3 > 0 AS available FROM events WHERE event_type = 'view'),
  n AS (SELECT user_id, event_id, user_id % 7 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS size, 'b' || event_id % 5 || '-' || user_id AS branch_key, 'r' || event_id % 20 || '-' || user_id AS runtime_key, value / 100 AS similarity, event_id % 9 AS look_ahead, event_id % 100 AS min_jump FROM events WHERE event_type = 'click'),
  x AS (SELECT n.*, (SELECT max(item) FROM i WHERE i.branch_key = n.branch_key AND i.runtime_key = n.runtime_key) AS e, (SELECT max(item) FROM i WHERE i.branch_key = n.branch_key AND i.runtime_key <> n.runtime_key AND i.user_id = n.user_id AND i.size = n.size) AS c FROM n),
  y AS (SELECT x.*, coalesce(ie.available AND ie.size = x.size, false) AS exact, coalesce(ic.available, false) AS near FROM x LEFT JOIN i ie ON ie.item = e LEFT JOIN i ic ON ic.item = c),
  z AS (SELECT *, least(greatest(similarity, 0.65), 0.95) AS s FROM y)
  SELECT event_id, CASE WHEN exact THEN 'exact' WHEN near THEN 'compatible' ELSE 'miss' END AS outcome, CASE WHEN exact THEN e WHEN near THEN c END AS item,
    CASE WHEN NOT exact AND near THEN least(greatest(look_ahead, 1), 5) END AS look_ahead, CASE WHEN NOT exact AND near THEN least(greatest(min_jump, 4), 64) END AS min_jump,
    CASE WHEN NOT exact AND near THEN least(greatest(round_even(CASE WHEN s <= 0.86 THEN 95 + (s - 0.78) / 0.08 * -15 ELSE 80 + (s - 0.86) / 0.06 * -10 END, 0), 1), 100) END AS max_threshold FROM z""")
def cache_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    keys = lambda letter: [F.concat(F.lit(letter), (F.col("event_id") % 5).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("branch_key"), F.concat(F.lit("R" if letter == "B" else "r"), (F.col("event_id") % 20).cast("string"), F.lit("-"), F.col("user_id").cast("string")).alias("runtime_key")]
    index = rows.where("event_type = 'view'").select("user_id", (F.col("user_id") % 7).alias("size"), *keys("b"), F.col("event_id").alias("item"), F.col("event_id").alias("created"), (F.col("event_id") % 3 > 0).alias("available"))
    options = {"similarity": F.col("value") / 100, "look_ahead": F.col("event_id") % 9, "min_jump": F.col("event_id") % 100, "max_branches": F.lit(4), "jump_probability": F.lit(0.5), "jump_cooldown": F.lit(8), "first_pass": F.lit(0.0), "preset": F.lit(""), "quantum": F.lit(None).cast("string")}
    inputs = rows.where("event_type = 'click'").select("event_id", "user_id", (F.col("user_id") % 7 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).alias("size"), *keys("B"), *[c.alias(x) for x, c in options.items()])
    found = cache.runtime_options(cache.lookup(inputs, index, "event_id", ["user_id", "size"], "created"))
    rebuilt = lambda x, kind: F.when(F.col("outcome") == cache.COMPATIBLE, F.col(x)).cast(kind).alias(x)
    return found.select("event_id", "outcome", "item", rebuilt("look_ahead", "long"), rebuilt("min_jump", "long"), rebuilt("max_threshold", "double"))


#: The short pairs of a track, scored, with no limit of distance.
_SHORT = _SCORED.replace(_RAW, _QUANTA + """,
p AS (SELECT a.label, a.which AS src, b.which AS dst, 50 * list_distance(a.v, b.v) + CASE WHEN a.which % 4 = b.which % 4 THEN 0 ELSE 100 END AS distance
  FROM q a JOIN q b ON a.label = b.label AND a.which <> b.which AND abs(a.which - b.which) < 16)""")


@query(f"""SELECT label, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_active, 0) AS n_active, coalesce(n_removed, 0) AS n_removed, coalesce(n_risk, 0) AS n_risk, n_rejected
  FROM (WITH {_SHORT} SELECT label, count_if(rejected) AS n_rejected FROM sc GROUP BY label) LEFT JOIN (WITH {_PAIRS} SELECT label, count(*) AS n_candidates FROM k GROUP BY label) USING (label)
  LEFT JOIN (WITH {_EDGES}, {_PRUNED.replace("distance, n, loc", "distance, n, lp, loc")} SELECT label, count_if(NOT deleted) AS n_active, count_if(deleted) AS n_removed, count_if(NOT deleted AND lp) AS n_risk FROM d GROUP BY label) USING (label)""")
def branch_diagnostics(spark, sf_dir):
    q, n, near, _, edges = similarity_graph(spark, sf_dir)
    short = graph.structural_score(graph.short_pairs(q, "label", "v", 50.0), n, "label")
    return graph.branch_diagnostics(short, near, graph.prune_clusters(edges, "label"), n, "label")


#: The settings document of an event: former presets, own values, a cut text, a wrong type, none.
_OWN_TUNING = """'{"SettingsSchemaVersion": ' || event_id % 8 || ', "Tuning": {"Preset": "wild", "SimilarityThreshold": 0.' || (60 + event_id % 40) || ', "LookaheadDepth": ' || event_id % 9 || ', "MinJumpDistance": ' || event_id % 90 || ', "JumpCooldown": ' || event_id % 80 || ', "AnalysisBeatProvider": "CLASSIC"}}'"""
_SETTINGS_TEXT = f"""CASE event_id % 9
  WHEN 0 THEN '{{"SettingsSchemaVersion": ' || user_id % 7 || ', "Tuning": {{"Preset": "balanced", "SimilarityThreshold": 0.86, "LookaheadDepth": 4, "MinJumpDistance": 20, "MaxBranchesPerBeat": 4, "BranchMaxThreshold": 80}}}}'
  WHEN 1 THEN '{{"SettingsSchemaVersion": ' || user_id % 7 || ', "Tuning": {{"Preset": "Conservative", "SimilarityThreshold": 0.92, "LookaheadDepth": 2, "MinJumpDistance": 16, "MaxBranchesPerBeat": 2, "JumpProbability": 0.14, "JumpCooldown": 16, "FirstPassLinearPlaybackRatio": 0.82}}}}'
  WHEN 2 THEN '{{"SettingsSchemaVersion": ' || user_id % 7 || ', "Tuning": {{"Preset": "Balanced", "MaxBranchesPerBeat": 4, "JumpProbability": 0.22, "JumpCooldown": 12, "FirstPassLinearPlaybackRatio": 0.78}}}}'
  WHEN 3 THEN '{{"SettingsSchemaVersion": ' || user_id % 7 || ', "Theme": "Light", "Tuning": {{"Preset": "WILD", "SimilarityThreshold": 0.78, "MaxBranchesPerBeat": 6, "JumpProbability": 0.42, "JumpCooldown": 6, "FirstPassLinearPlaybackRatio": 0.7}}}}'
  WHEN 4 THEN {_OWN_TUNING} WHEN 5 THEN substr({_OWN_TUNING}, 1, 40) WHEN 6 THEN '{{"Tuning": {{"LookaheadDepth": "' || event_id % 5 || '"}}}}' WHEN 7 THEN '{{"Theme": "' || event_type || '", "Tuning": null}}' END"""


@query(f"""WITH t AS (SELECT event_id, {_SETTINGS_TEXT} AS text FROM events),
  j AS (SELECT event_id, text, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM t),
  f AS (SELECT event_id, text, text IS NOT NULL AND (j IS NULL OR coalesce(json_type(j, '$.Tuning.LookaheadDepth') = 'VARCHAR', false)) AS corrupt, j FROM j),
  v AS (SELECT event_id, CASE WHEN corrupt THEN text END AS corrupt, CASE WHEN NOT corrupt THEN j END AS j FROM f),
  w AS (SELECT event_id, corrupt, coalesce(CAST(json_extract(j, '$.SettingsSchemaVersion') AS INT), 6) AS version, coalesce(json_extract_string(j, '$.Theme'), 'Dark') AS theme,
    coalesce(json_extract_string(j, '$.Tuning.Preset'), 'Balanced') AS preset, coalesce(CAST(json_extract(j, '$.Tuning.SimilarityThreshold') AS DOUBLE), 0.86) AS similarity,
    coalesce(CAST(json_extract(j, '$.Tuning.LookaheadDepth') AS INT), 1) AS look_ahead, coalesce(CAST(json_extract(j, '$.Tuning.MinJumpDistance') AS INT), 4) AS min_jump,
    coalesce(CAST(json_extract(j, '$.Tuning.MaxBranchesPerBeat') AS INT), 6) AS max_branches, coalesce(CAST(json_extract(j, '$.Tuning.JumpProbability') AS DOUBLE), 0.85) AS jump_probability,
    coalesce(CAST(json_extract(j, '$.Tuning.JumpCooldown') AS INT), 4) AS jump_cooldown, coalesce(CAST(json_extract(j, '$.Tuning.FirstPassLinearPlaybackRatio') AS DOUBLE), 0.1) AS first_pass,
    coalesce(json_extract_string(j, '$.Tuning.AnalysisBeatProvider'), 'Enhanced') AS provider FROM v),
  x AS (SELECT *, CASE
    WHEN version < 4 AND lower(preset) = 'balanced' AND look_ahead = 4 AND min_jump = 20 AND max_branches = 4 AND abs(similarity - 0.86) < 1e-4 THEN 'Balanced'
    WHEN version < 5 AND lower(preset) = 'conservative' AND (look_ahead, min_jump, max_branches, jump_cooldown) = (2, 16, 2, 16) AND abs(jump_probability - 0.14) < 1e-4 AND abs(first_pass - 0.82) < 1e-4 THEN 'Conservative'
    WHEN version < 5 AND lower(preset) = 'balanced' AND (look_ahead, min_jump, max_branches, jump_cooldown) = (1, 4, 4, 12) AND abs(jump_probability - 0.22) < 1e-4 AND abs(first_pass - 0.78) < 1e-4 THEN 'Balanced'
    WHEN version < 5 AND lower(preset) = 'wild' AND (look_ahead, min_jump, max_branches, jump_cooldown) = (1, 4, 6, 6) AND abs(jump_probability - 0.42) < 1e-4 AND abs(first_pass - 0.7) < 1e-4 THEN 'Wild' END AS new FROM w),
  presets(name, s, l, m, b, p, c, r) AS (VALUES ('Conservative', 0.92, 2, 16, 2, 0.35, 12, 0.5), ('Balanced', 0.86, 1, 4, 6, 0.85, 4, 0.1), ('Wild', 0.78, 1, 4, 8, 1.0, 0, 0.0)),
  y AS (SELECT event_id, corrupt, greatest(version, 6) AS schema_version, theme, CASE lower(coalesce(new, preset)) WHEN 'conservative' THEN 'Conservative' WHEN 'wild' THEN 'Wild' ELSE 'Balanced' END AS preset,
    CAST(coalesce(s, least(greatest(similarity, 0.65), 0.95)) AS DOUBLE) AS similarity, coalesce(l, least(greatest(look_ahead, 1), 5)) AS look_ahead, coalesce(m, least(greatest(min_jump, 4), 64)) AS min_jump,
    coalesce(b, max_branches) AS max_branches, CAST(coalesce(p, jump_probability) AS DOUBLE) AS jump_probability, coalesce(c, least(jump_cooldown, 64)) AS jump_cooldown, CAST(coalesce(r, first_pass) AS DOUBLE) AS first_pass,
    CASE WHEN new IS NOT NULL OR lower(provider) <> 'classic' THEN 'Enhanced' ELSE 'Classic' END AS provider FROM x LEFT JOIN presets ON name = new)
  SELECT *, CAST(least(greatest(round_even(CASE WHEN similarity <= 0.86 THEN 95 + (similarity - 0.78) / 0.08 * -15 ELSE 80 + (similarity - 0.86) / 0.06 * -10 END, 0), 1), 100) AS INT) AS max_threshold FROM
    (SELECT * REPLACE (least(greatest(similarity, 0.65), 0.95) AS similarity) FROM y)""")
def settings_migration(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_SETTINGS_TEXT).alias("text"))
    return settings.migrated(settings.read_settings(rows, "text")).drop("text", "quantum", "musical_quality")


_INPUT_PATHS = "CASE doc_id % 8 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE '/music.d/' || source || '/' || doc_id || CASE doc_id % 8 WHEN 2 THEN '.flac' WHEN 3 THEN '' WHEN 4 THEN '.MP3' ELSE '.wav' END END"


@query(f"""WITH d AS (SELECT doc_id, {_INPUT_PATHS} AS path, doc_id % 5 > 0 AS there, n_chars * least(doc_id % 3, 1) AS size FROM documents)
  SELECT doc_id, CASE WHEN coalesce(trim(path), '') = '' THEN 'input_invalid' WHEN NOT regexp_matches(lower(path), '[.](mp3|wav|m4a|aac)$') THEN 'unsupported_audio_format'
    WHEN NOT there THEN 'input_not_found' WHEN size = 0 THEN 'input_empty_file' WHEN doc_id % 11 = 0 THEN 'input_access_denied' END AS code FROM d""")
def checked_inputs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("path", F.expr(_INPUT_PATHS))
    found = rows.where("doc_id % 5 > 0 AND path IS NOT NULL").select("path", F.expr("n_chars * least(doc_id % 3, 1)").alias("size"), F.when(F.col("doc_id") % 11 == 0, audio.DENIED).alias("failure"))
    return audio.checked_inputs(rows.select("doc_id", "path"), found).select("doc_id", "code")
