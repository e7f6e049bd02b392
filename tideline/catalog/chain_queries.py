"""Kill chains, peak montages and the whole candidate pool."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog import shooter_sql as q
from tideline.catalog.kill_queries import CLIPS, PACKS, SMALL
from tideline.catalog.loudness_queries import CLUSTERS, _scan, greedy
from tideline.catalog.prefix import sql
from tideline.catalog.text_queries import _ends, _lines
from tideline.plans import chains as c
from tideline.plans import kills as k
from tideline.plans import loudness as l
from tideline.plans.pool import candidate_pool

WIDE = """el AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "time", seq) AS rn, lag("time") OVER (PARTITION BY video_id ORDER BY "time", seq) AS prev FROM kill_event),
cw AS (SELECT video_id, rn, seq, "time", "time" AS c0 FROM el WHERE rn = 1 UNION ALL
  SELECT e.video_id, e.rn, e.seq, e."time", CASE WHEN e."time" - e.prev <= 95 AND e."time" - w.c0 <= 600 THEN w.c0 ELSE e."time" END FROM cw w JOIN el e ON e.video_id = w.video_id AND e.rn = w.rn + 1),
wm AS (SELECT w.c0, e.* FROM cw w JOIN kill_event e USING (video_id, seq)),
wf AS (SELECT *, sum(CASE WHEN starts_with(roi, 'top_right') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, c0) AS feeds,
    CASE WHEN player_kill OR red_highlight THEN 50 ELSE 0 END + highlight_score * 30 + confidence * 12 + CASE WHEN starts_with(roi, 'top_right') THEN 4 ELSE 0 END AS score FROM wm),
wp AS (SELECT *, lag("time") OVER (PARTITION BY video_id, c0 ORDER BY "time", seq) AS pv FROM wf WHERE feeds < 2 OR starts_with(roi, 'top_right')),
wg AS (SELECT *, sum(CASE WHEN pv IS NULL OR "time" - pv > 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, c0 ORDER BY "time", seq) AS g FROM wp),
wt AS (SELECT *, max(score) OVER (PARTITION BY video_id, c0, g) AS top FROM wg),
wk AS (SELECT * FROM wt WHERE score >= top - 0.05 QUALIFY row_number() OVER (PARTITION BY video_id, c0, g ORDER BY "time", seq) = 1),
w4 AS (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY video_id, c0 ORDER BY "time", seq) <= 4)"""


@query("event_clusters", sql("SELECT video_id, c0 AS cluster_at, seq FROM w4 QUALIFY count(*) OVER (PARTITION BY video_id, c0) >= 2", "kill_event", more=WIDE, recursive=True))
def event_clusters(spark, d):
    return c.event_clusters(views.kill_events(spark, d)).select("video_id", "cluster_at", "seq")


WIDE_PACKS = WIDE + """,
packs AS (SELECT video_id, seq, "time", c0 AS pack_at, min(seq) OVER (PARTITION BY video_id, c0) AS pack_seq, 1 AS pos FROM w4 QUALIFY count(*) OVER (PARTITION BY video_id, c0) >= 2)""" + SMALL[len(PACKS):]
WIDE_CLIPS = CLIPS.replace("AND max(pt) - min(pt) <= 55 AND coalesce(max(jump), 0) <= 35", "AND max(pt) - min(pt) <= 600 AND (coalesce(max(jump), 0) > 35 OR max(pt) - min(pt) <= 55)")


@query("cluster_montages", sql(f"SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY kill_count DESC, pack_at)::INT AS place FROM ({WIDE_CLIPS})", "kill_event", more=WIDE_PACKS, recursive=True))
def cluster_montages(spark, d):
    """One montage per wide cluster."""
    return c.cluster_montages(views.kill_events(spark, d), views.RECORDING_SEC).drop("segments")


@query("next_distant_event", sql("""SELECT a.video_id, a.seq, n.seq AS next_seq FROM kill_event a, LATERAL (SELECT b.seq FROM kill_event b WHERE b.video_id = a.video_id AND b."time" >= a."time" + 30 ORDER BY b."time", b.seq LIMIT 1) n""", "kill_event"))
def next_distant_event(spark, d):
    rows = views.kill_events(spark, d).select("video_id", F.col("time").alias("at"), "seq")
    return c.next_at_least(rows, 30.0).select("video_id", "seq", "next_seq")


SLIDING = """nx AS (SELECT video_id, seq, "time" AS t0, lead("time", 1) OVER o AS t1, lead("time", 2) OVER o AS t2, lead("time", 3) OVER o AS t3, lead(seq, 1) OVER o AS s1, lead(seq, 2) OVER o AS s2, lead(seq, 3) OVER o AS s3
  FROM kill_event WINDOW o AS (PARTITION BY video_id ORDER BY "time", seq)),
ok AS (SELECT *, coalesce(t1 - t0 <= 95, false) AS k1, coalesce(t1 - t0 <= 95 AND t2 - t1 <= 95 AND t2 - t0 <= 600, false) AS k2, coalesce(t1 - t0 <= 95 AND t2 - t1 <= 95 AND t3 - t2 <= 95 AND t3 - t0 <= 600, false) AS k3 FROM nx),
mem AS (SELECT video_id, seq AS chain, seq FROM ok UNION ALL SELECT video_id, seq, s1 FROM ok WHERE k1 UNION ALL SELECT video_id, seq, s2 FROM ok WHERE k2 UNION ALL SELECT video_id, seq, s3 FROM ok WHERE k3),
mf AS (SELECT chain, e.*, sum(CASE WHEN starts_with(roi, 'top_right') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, chain) AS feeds,
    CASE WHEN player_kill OR red_highlight THEN 50 ELSE 0 END + highlight_score * 30 + confidence * 12 + CASE WHEN starts_with(roi, 'top_right') THEN 4 ELSE 0 END AS score FROM mem JOIN kill_event e USING (video_id, seq)),
mp AS (SELECT *, lag("time") OVER (PARTITION BY video_id, chain ORDER BY "time", seq) AS pv FROM mf WHERE feeds < 2 OR starts_with(roi, 'top_right')),
mg AS (SELECT *, sum(CASE WHEN pv IS NULL OR "time" - pv > 4.5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, chain ORDER BY "time", seq) AS g FROM mp),
mt AS (SELECT *, max(score) OVER (PARTITION BY video_id, chain, g) AS top FROM mg),
mk AS (SELECT * FROM mt WHERE score >= top - 0.05 QUALIFY row_number() OVER (PARTITION BY video_id, chain, g ORDER BY "time", seq) = 1),
kept AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY video_id, chain ORDER BY "time", seq) <= 4)"""
WIDE_CHAINS = """hop AS (SELECT a.video_id, a.seq, (SELECT min(struct_pack(t := b."time", s := b.seq)) FROM kill_event b WHERE b.video_id = a.video_id AND b."time" >= a."time" + 30).s AS nxt FROM kill_event a),
path AS (SELECT h0.video_id, h0.seq AS s0, h0.nxt AS s1, h1.nxt AS s2, h2.nxt AS s3 FROM hop h0 LEFT JOIN hop h1 ON h1.video_id = h0.video_id AND h1.seq = h0.nxt LEFT JOIN hop h2 ON h2.video_id = h0.video_id AND h2.seq = h1.nxt),
mem AS (SELECT video_id, s0 AS chain, unnest(list_filter([s0, s1, s2, s3], lambda x: x IS NOT NULL)) AS seq FROM path),
kept AS (SELECT chain, e.* FROM mem JOIN kill_event e USING (video_id, seq) QUALIFY max("time") OVER (PARTITION BY video_id, chain) - min("time") OVER (PARTITION BY video_id, chain) >= 75)"""


def _no_shared_kill(order):
    """Chains of ``kept`` kills in ``order``, each left out that shares a kill with one before."""
    return f"""ch AS (SELECT video_id, chain, list("time" ORDER BY "time") AS kill_times, count(*)::INT AS kills, min("time") AS first_at, max("time") AS last_at, max("time") - min("time") AS span, avg(confidence) AS c,
  sum(CASE WHEN player_kill OR red_highlight OR starts_with(roi, 'top_right') THEN 1 ELSE 0 END) AS f FROM kept GROUP BY 1, 2 HAVING count(*) >= 2),
sc AS (SELECT *, CASE WHEN kills >= 4 THEN 90 WHEN kills = 3 THEN 55 ELSE 12 END + kills * 35 + c * 28 + f * 18 + least(120.0, span * 0.35) - CASE WHEN first_at < 90 THEN 15 ELSE 0 END
  - CASE WHEN span < 75 THEN 100 WHEN span < 120 THEN 50 ELSE 0 END AS score FROM ch),
ps AS (SELECT video_id, list({{'q': chain, 'k': kill_times}} ORDER BY {order}) AS ps FROM sc GROUP BY 1),
red AS (SELECT video_id, list_reduce(list_transform(ps, lambda x: [x]), lambda acc, p: CASE WHEN len(list_filter(acc, lambda y: len(list_filter(y.k, lambda u: len(list_filter(p[1].k, lambda t: abs(t - u) < 3)) > 0)) > 0)) > 0
  THEN acc ELSE list_append(acc, p[1]) END, [{{'q': -1::BIGINT, 'k': [-1e9::DOUBLE]}}]) AS got FROM ps),
chosen AS (SELECT video_id, unnest(list_transform(got, lambda x: x.q)) AS chain FROM red)"""


CHAINS = "SELECT sc.video_id, chain, kill_times, kills, first_at, last_at, round(span, 6) AS span, round(score, 6) AS score FROM sc JOIN chosen USING (video_id, chain)"


def _rounded(chains):
    return chains.withColumns({"span": F.round("span", 6), "score": F.round("score", 6)})


@query("sliding_chains", sql(CHAINS, "kill_event", more=SLIDING + ",\n" + _no_shared_kill("kills DESC, span, score DESC, first_at, chain")))
def sliding_chains(spark, d):
    """Chains of two to four kills that share none."""
    return _rounded(c.sliding_chains(views.kill_events(spark, d)))


@query("wide_gap_chains", sql(CHAINS, "kill_event", more=WIDE_CHAINS + ",\n" + _no_shared_kill("span DESC, kills DESC, score DESC, first_at, chain")))
def wide_gap_chains(spark, d):
    """Chains of distant kills that share none."""
    return _rounded(c.wide_chains(views.kill_events(spark, d)))


def _peaks(spark, d):
    return l.loudness_peaks(_scan(spark, d), "kill").withColumn("strength", F.col("strength").cast("double"))


@query("tight_peaks", sql("""SELECT video_id, c0 AS cluster_at, "time" FROM (SELECT *, sum(late) OVER (PARTITION BY video_id, c0 ORDER BY "time") AS cut FROM (SELECT *, coalesce(("time" - lag("time") OVER (PARTITION BY video_id, c0 ORDER BY "time") > 22)::INT, 0) AS late
FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY video_id, c0 ORDER BY strength DESC, "time") <= 4))) WHERE cut = 0""", "loud", more=CLUSTERS, recursive=True))
def tight_peaks(spark, d):
    rows = k.gap_span_clusters(_peaks(spark, d).select("video_id", "time", "idx", "strength"), "time", ["idx"], 18.0, 105.0)
    return c.strongest_tight(rows, ["video_id", "cluster_at"]).select("video_id", "cluster_at", "time")


PEAK_CUTS = CLUSTERS + """,
tight AS (SELECT * FROM (SELECT *, sum(late) OVER (PARTITION BY video_id, c0 ORDER BY "time" ROWS UNBOUNDED PRECEDING) AS cut FROM (SELECT *, coalesce(("time" - lag("time") OVER (PARTITION BY video_id, c0 ORDER BY "time") > 22)::INT, 0) AS late
  FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY video_id, c0 ORDER BY strength DESC, "time") <= 4))) WHERE cut = 0),
pm_ow AS (SELECT video_id, c0, count(*) OVER (PARTITION BY video_id, c0) AS n, greatest(0, "time" - 0.2) AS a, 6.0 AS span, 4.0 AS low FROM tight),
""" + q.peak_cuts("pm", 32) + """,
""" + q.PAYOFF_PEAKS + """,
pm_l AS (SELECT *, pt[-1] AS lk, floor(list_sum(du) * 10 + 0.5) / 10 AS total FROM pm_oh),
pm_p AS (SELECT *, CASE WHEN len(st) >= 3 THEN (SELECT min(p."time") FROM pay_peaks p WHERE p.video_id = m.video_id AND p."time" BETWEEN lk + 1.5 AND least(32, lk + 20)) END AS pa FROM pm_l m),
pm_d AS (SELECT *, CASE WHEN greatest(0, pa - 0.5) + 6.5 > 32 THEN greatest(0, 32 - 6.5) ELSE greatest(0, pa - 0.5) END AS ps FROM pm_p),
pm_e AS (SELECT *, CASE WHEN greatest(0, pa - 0.5) + 6.5 > 32 THEN 32 - ps ELSE 6.5 END AS pd FROM pm_d),
pm AS (SELECT *, coalesce(pa > lk + 2 AND total < 47 AND pd >= 5 AND total + pd <= 47, false) AS pays FROM pm_e)"""


def _with_cuts(made):
    """Cut lists as two arrays."""
    return made.withColumns({name: F.transform("segments", lambda x: x[field]) for name, field in (("starts", "start"), ("lengths", "duration"))}).drop("segments")


@query("peak_montages", sql("""SELECT video_id, c0 AS cluster_at, st AS starts, du AS lengths, len(st)::INT AS kill_count, st[1] AS start_time, pays AS has_payoff,
  CASE WHEN pays THEN floor((floor(ps * 10 + 0.5) / 10 + floor(pd * 10 + 0.5) / 10) * 10 + 0.5) / 10 ELSE floor((st[-1] + du[-1]) * 10 + 0.5) / 10 END AS end_time,
  CASE WHEN pays THEN floor((total + floor(pd * 10 + 0.5) / 10) * 10 + 0.5) / 10 ELSE total END AS output_duration FROM pm""", "loud", more=PEAK_CUTS, recursive=True))
def peak_montages(spark, d):
    """Cut lists from loudness peak chains, with payoff moments appended."""
    rows = k.gap_span_clusters(_peaks(spark, d).select("video_id", "time", "idx", "strength"), "time", ["idx"], 18.0, 105.0)
    made = c.peak_segments(c.strongest_tight(rows, ["video_id", "cluster_at"]), ["video_id", "cluster_at"], 32.0)
    payoffs = l.loudness_peaks(_scan(spark, d), "payoff").select("video_id", "time")
    return _with_cuts(c.append_payoff(made, payoffs, 32.0)).drop("payoff")


SPARSE_CUTS = greedy(*l.PRESETS["kill"]) + """,
sq AS (SELECT video_id, list({'t': "time", 's': strength::DOUBLE} ORDER BY strength DESC, "time") AS ps FROM peaks GROUP BY 1),
sr AS (SELECT video_id, unnest(list_reduce(list_transform(ps, lambda y: [y]), lambda acc, p: CASE WHEN len(acc) < 5 AND abs(p[1].t - acc[1].t) <= 75 AND abs(p[1].t - acc[-1].t) <= 22 THEN list_append(acc, p[1]) ELSE acc END)) AS v FROM sq),
ss AS (SELECT video_id, v.t AS t, count(*) OVER (PARTITION BY video_id) AS n FROM sr),
sc_ow AS (SELECT video_id, 0 AS c0, n, greatest(0, t - 0.2) AS a, 6.0 AS span, 4.0 AS low FROM ss WHERE n >= 2),
""" + q.peak_cuts("sc", 32)


@query("sparse_montages", sql("""SELECT video_id, st AS starts, du AS lengths, len(st)::INT AS kill_count, st[1] AS start_time, floor((st[-1] + du[-1]) * 10 + 0.5) / 10 AS end_time, floor(list_sum(du) * 10 + 0.5) / 10 AS output_duration FROM sc_oh""", "loud", more=SPARSE_CUTS, recursive=True))
def sparse_montages(spark, d):
    """The strongest peak of a recording with its neighbours, as cuts."""
    return _with_cuts(c.peak_segments(c.sparse_peaks(_peaks(spark, d)), ["video_id"], 32.0))


@query("highlight_candidates")
def highlight_candidates(spark, d):
    """The ranked candidate pool of every recording."""
    return candidate_pool(_lines(spark, d), _ends(spark, d))
