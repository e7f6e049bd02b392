"""SQL counterparts of the shooter montages, from the chosen peaks to the candidate pool."""
from __future__ import annotations

import re

from tideline.catalog.kill_queries import CLIPS, FEED, SMALL
from tideline.catalog.loudness_queries import SCAN, greedy
from tideline.plans.loudness import PRESETS


def renamed(text: str, prefix: str, *names: str) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", prefix + r"\1", text)


PAYOFF_PEAKS = renamed(greedy(*PRESETS["payoff"])[len(SCAN) + 1:].strip(), "pay_", "open0", "ranked", "picked", "peaks")
LEAD = "CASE roi WHEN 'bottom_kills' THEN 0.65 WHEN 'top_right' THEN 0.85 ELSE 0.75 END"


def _tenth(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"


def payoff(src: str, name: str) -> str:
    """Montages ``src`` (video_id, id, st, du, pt, most, may) with the payoff cut where one fits, and their span."""
    begin = "greatest(0, pa - 0.5)"
    return f"""{name}_l AS (SELECT *, pt[-1] AS lk FROM {src}),
{name}_s AS (SELECT m.video_id, m.id, min(f.t) AS pa FROM {name}_l m JOIN flag f USING (video_id) WHERE may AND f.pay AND f.t >= lk + 1.5 AND f.t <= least(256, lk + 20) GROUP BY 1, 2),
{name}_a AS (SELECT m.video_id, m.id, arg_min(p."time", (-p.strength, p."time")) AS pa FROM {name}_l m JOIN pay_peaks p USING (video_id) WHERE may AND p."time" > lk + 2 AND p."time" < least(256, lk + 20) GROUP BY 1, 2),
{name}_p AS (SELECT m.*, coalesce(s.pa, a.pa) AS pa, {_tenth('list_sum(du)')} AS total FROM {name}_l m LEFT JOIN {name}_s s USING (video_id, id) LEFT JOIN {name}_a a USING (video_id, id)),
{name}_b AS (SELECT *, CASE WHEN {begin} + 6.5 > 256 THEN greatest(0, 256 - 6.5) ELSE {begin} END AS ps FROM {name}_p),
{name}_d AS (SELECT *, CASE WHEN {begin} + 6.5 > 256 THEN 256 - ps ELSE 6.5 END AS pd FROM {name}_b),
{name}_o AS (SELECT *, coalesce(pa > lk + 2 AND total < most + 7 AND pd >= 5 AND total + pd <= most + 7, false) AS has_payoff FROM {name}_d),
{name}_e AS (SELECT * EXCLUDE (st, du, pt, pa, ps, pd, total, lk), len(st) AS kill_count, CASE WHEN has_payoff THEN list_append(st, {_tenth('ps')}) ELSE st END AS st,
  CASE WHEN has_payoff THEN list_append(du, {_tenth('pd')}) ELSE du END AS du, CASE WHEN has_payoff THEN list_append(pt, {_tenth('pa')}) ELSE pt END AS pt FROM {name}_o),
{name} AS (SELECT *, st[1] AS start_time, {_tenth('st[-1] + du[-1]')} AS end_time, {_tenth('list_sum(du)')} AS output_duration FROM {name}_e)"""


def peak_cuts(x: str, end: int = 256) -> str:
    """``{x}_oh`` cut lists of the anchored peaks ``{x}_ow`` (video_id, c0, n, a, span, low): none overlaps the last, 26 s in all."""
    return f"""{x}_ox AS (SELECT *, row_number() OVER (PARTITION BY video_id, c0 ORDER BY a) AS rn, CASE WHEN greatest(0, a - 2) + span > {end} THEN greatest(0, {end} - span) ELSE greatest(0, a - 2) END AS b FROM {x}_ow),
{x}_oy AS (SELECT *, CASE WHEN greatest(0, a - 2) + span > {end} THEN {end} - b ELSE span END AS d FROM {x}_ox),
{x}_og AS (SELECT video_id, c0, n, 0::BIGINT AS i, []::DOUBLE[] AS st, []::DOUBLE[] AS du, []::DOUBLE[] AS pt, 0.0::DOUBLE AS total, -1e9::DOUBLE AS ends, true AS going FROM {x}_oy WHERE rn = 1
  UNION ALL SELECT video_id, c0, n, i + 1, CASE WHEN going AND NOT skip AND NOT big THEN list_append(st, {_tenth('b')}) ELSE st END, CASE WHEN going AND NOT skip AND NOT big THEN list_append(du, {_tenth('d')}) ELSE du END,
    CASE WHEN going AND NOT skip AND NOT big THEN list_append(pt, {_tenth('a')}) ELSE pt END, CASE WHEN going AND NOT skip AND NOT big THEN total + d ELSE total END,
    CASE WHEN going AND NOT skip AND NOT big THEN b + d ELSE ends END, going AND (skip OR NOT big)
  FROM (SELECT g.*, o.a, o.b, o.d, o.d < o.low OR o.b < g.ends - 0.2 AS skip, (g.total + o.d > 26 AND g.total >= 12) OR g.total + o.d > 26 + o.span AS big
    FROM {x}_og g JOIN {x}_oy o ON o.video_id = g.video_id AND o.c0 = g.c0 AND o.rn = g.i + 1)),
{x}_oh AS (SELECT video_id, c0, st, du, pt, 26.0 AS most FROM {x}_og WHERE i = n AND len(st) >= 1 AND (n < 2 OR (len(st) >= 2 AND total >= 12)))"""


def montages(ladder: str, chains: str, x: str) -> str:
    """``{x}`` montages of the peaks ``ladder`` (video_id, c0, rung, t, s, roi) of ``chains``, with their composite."""
    event = "rung IN ('feed', 'feed_wide', 'near_feed')"
    fold = "list_reduce(list_transform(ps, lambda y: [y]), lambda acc, p: CASE WHEN len(acc) >= 4 OR len(list_filter(acc, lambda q: abs(q.t - p[1].t) < 3.5)) > 0 THEN acc ELSE list_append(acc, p[1]) END)"
    return f"""{x}_ps AS (SELECT video_id, c0, any_value(rung) AS rung, list({{'t': t, 's': s, 'r': roi}} ORDER BY CASE WHEN starts_with(roi, 'top_right') THEN 45 ELSE 0 END + s DESC, t) AS ps FROM {ladder} GROUP BY 1, 2),
{x}_un AS (SELECT video_id, c0, rung, unnest({fold}) AS v FROM {x}_ps),
{x}_sel AS (SELECT video_id, c0, rung, v.t AS t, v.s AS s, v.r AS roi, {event} AS ev FROM {x}_un),
{x}_at AS (SELECT *, CASE WHEN ev THEN greatest(0, t - {LEAD}) ELSE t END AS u, count(*) OVER (PARTITION BY video_id, c0) AS n FROM {x}_sel),
{x}_ef AS (SELECT *, sum(starts_with(roi, 'top_right')::INT) OVER (PARTITION BY video_id, c0) AS feeds FROM {x}_at WHERE ev AND n >= 2),
{x}_ea AS (SELECT *, greatest(0, u - {LEAD}) AS a FROM {x}_ef WHERE feeds < 2 OR starts_with(roi, 'top_right')),
{x}_en AS (SELECT *, lead(a) OVER (PARTITION BY video_id, c0 ORDER BY u) AS nx FROM {x}_ea),
{x}_el AS (SELECT *, least(8.5, 1.2 + CASE WHEN nx IS NULL THEN 7 ELSE least(7, greatest(0.9, nx - a - 0.25)) END) AS len0, greatest(0, a - 1.2) AS b0 FROM {x}_en),
{x}_eb AS (SELECT *, CASE WHEN b0 + len0 > 256 THEN greatest(0, 256 - len0) ELSE b0 END AS b FROM {x}_el),
{x}_ec AS (SELECT video_id, c0, u, {_tenth('b')} AS st, {_tenth('least(len0, 256 - b)')} AS du, {_tenth('a')} AS pt FROM {x}_eb WHERE least(len0, 256 - b) >= 4.5),
{x}_et AS (SELECT *, lead(st) OVER (PARTITION BY video_id, c0 ORDER BY u) - 0.15 - st AS room FROM {x}_ec),
{x}_ed AS (SELECT *, CASE WHEN room < du THEN greatest(1.15, {_tenth('room')}) ELSE du END AS d FROM {x}_et),
{x}_eg AS (SELECT video_id, c0, list(st ORDER BY u) AS st, list(d ORDER BY u) AS du, list(pt ORDER BY u) AS pt, 44.0 AS most FROM {x}_ed WHERE d >= 1.15 GROUP BY video_id, c0
  HAVING count(*) >= 2 AND {_tenth('sum(d)')} >= CASE WHEN count(*) >= 4 THEN 12 WHEN count(*) >= 3 THEN 7 ELSE 4 END),
{x}_ow AS (SELECT video_id, c0, n, greatest(0, u + CASE WHEN ev THEN -0.75 WHEN rung = 'lines' THEN -0.15 ELSE -0.2 END) AS a, CASE WHEN n = 1 THEN 10.0 ELSE 6.0 END AS span, CASE WHEN n = 1 THEN 8.0 ELSE 4.0 END AS low FROM {x}_at WHERE NOT (ev AND n >= 2)),
{peak_cuts(x)},
{x}_cut AS (SELECT * FROM {x}_eg UNION ALL SELECT * FROM {x}_oh),
{x}_pk AS (SELECT video_id, c0, any_value(rung) AS rung, max(u) AS hook, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM kill_event e WHERE e.video_id = a.video_id AND abs(e."time" - a.u) <= 3.5) THEN u END) AS sure FROM {x}_at a GROUP BY 1, 2),
{x}_m AS (SELECT c.*, c.c0 AS id, k.rung, k.hook, k.sure, len(st) >= 3 AND k.sure >= 2 AS may, (SELECT count(*) FROM confirmed f WHERE f.video_id = c.video_id) AS confirmed FROM {x}_cut c JOIN {x}_pk k USING (video_id, c0)),
{x}_c AS (SELECT * FROM {x}_m WHERE NOT (confirmed >= 3 AND sure < 2) AND (len(pt) = 1 OR (pt[-1] - pt[1] <= 600 AND (pt[-1] - pt[1] <= 55 OR len(list_filter(range(2, len(pt) + 1), lambda j: pt[j] - pt[j - 1] > 35)) > 0)))),
{payoff(f'{x}_c', f'{x}_f')},
{x}_h AS (SELECT m.video_id, m.id, floor(least(150, (greatest(0, max(delta)::DOUBLE) * 9 + greatest(0, avg(delta::DOUBLE)) * 5) * 1.35) + 0.5) + 60 AS audio FROM {x}_f m JOIN scan s USING (video_id)
  WHERE idx BETWEEN floor(start_time / 0.5) AND floor(end_time / 0.5) GROUP BY 1, 2),
{x}_e AS (SELECT m.video_id, m.id, count(*) AS kills, least(120.0, count(*) * 28 + count(*) FILTER (WHERE confidence >= 0.65) * 12) AS boost FROM {x}_f m JOIN kill_event e USING (video_id)
  WHERE confidence >= 0.5 AND e."time" BETWEEN start_time - 0.5 AND end_time + 0.5 GROUP BY 1, 2),
{x}_k AS (SELECT m.video_id, m.id, count(*) AS kl FROM {x}_f m JOIN flag f USING (video_id) WHERE f.kill AND f.t BETWEEN start_time - 2 AND end_time + 4 GROUP BY 1, 2),
{x} AS (SELECT f.*, h.score, coalesce(e.kills, 0) AS hud_kills, coalesce(k.kl, 0) AS keyword_lines,
  (280 + h.peaks * 45 + coalesce(k.kl, 0) * 15 + a.audio + coalesce(e.boost, 0) + f.sure * 30 + len(f.st) * 25 + CASE WHEN h.strongest >= 8 THEN 50 ELSE 25 END)::DOUBLE AS composite
  FROM {x}_f f JOIN {chains} h USING (video_id, c0) JOIN {x}_h a USING (video_id, id) LEFT JOIN {x}_e e USING (video_id, id) LEFT JOIN {x}_k k USING (video_id, id))"""


_NAMES = re.findall(r"(?m)^(\w+) AS \(", SMALL)
_PACKS = renamed(SMALL.replace("highlight_score * 30", "(highlight_score * 30 + floor(60 + highlight_score * 80 + 0.5) * 0.5)").replace("2592.0", "256.0").replace("2592", "256"), "q_", *_NAMES).replace("FROM kill_event", "FROM {src}").replace("JOIN kill_event", "JOIN {src}")
_CLIPS = renamed(CLIPS, "q_", *_NAMES)


def packs(src: str, x: str) -> str:
    """``{x}`` clips of the packs of ``src`` kills with their cuts."""
    own = renamed(_PACKS.replace("{src}", src), f"{x}_", *["q_" + n for n in _NAMES])
    q = f"{x}_q_"
    clips = renamed(_CLIPS, f"{x}_", *["q_" + n for n in _NAMES])
    return f"""{own},
{x}_c AS ({clips}),
{x}_s AS (SELECT video_id, pack_seq, [{_tenth('b')}] AS st, [{_tenth('e2 - b')}] AS du, [{_tenth('a0')}] AS pt FROM {q}longf WHERE e2 - b >= 4
  UNION ALL SELECT video_id, pack_seq, [st], [du], [pt] FROM {q}cut WHERE n = 1 AND du >= 3
  UNION ALL SELECT video_id, pack_seq, list(st ORDER BY "time", seq), list(d2 ORDER BY "time", seq), list(pt ORDER BY "time", seq) FROM {q}final WHERE n >= 2 GROUP BY 1, 2),
{x} AS (SELECT c.*, s.st, s.du, s.pt FROM {x}_c c JOIN {x}_s s USING (video_id, pack_seq))"""


#: Feed kills of recordings with loudness; clips of all of them, and of recordings with two or more.
FEED_CLIPS = FEED.replace("THEN first_at ELSE anchor END AS grp", "THEN first_at ELSE anchor END AS grp").replace("WHERE kill_key IS NOT NULL", "WHERE kill_key IS NOT NULL AND anchor <= 255").replace("ranked AS", "fd_ranked AS").replace("FROM ranked", "FROM fd_ranked") + """,
fk AS (SELECT * REPLACE (true AS player_kill, true AS red_highlight) FROM validated SEMI JOIN scan USING (video_id)),
fk2 AS (SELECT * FROM fk QUALIFY count(*) OVER (PARTITION BY video_id) >= 2),
""" + packs("fk", "allc") + ",\n" + packs("fk2", "twoc")

FEED_MONTAGES = FEED_CLIPS + """,
fm0 AS (SELECT video_id, pack_seq AS id, pack_at, pack_seq, kill_count AS kills, confidence, st, du, pt, 40.0 AS most, len(st) >= 3 AND kill_count >= 2 AS may FROM twoc),
""" + payoff("fm0", "fm") + """,
feedm AS (SELECT * REPLACE (kills AS kill_count), (320 + kills * 55 + CASE WHEN confidence = 0 THEN 70 ELSE confidence END * 2)::DOUBLE AS composite FROM fm)"""

#: The strongest peak of a poor recording with its neighbours.
SPARSE = """facts AS (SELECT video_id, (SELECT count(*) FROM kill_event e WHERE e.video_id = v.video_id) AS events, (SELECT count(*) FROM confirmed e WHERE e.video_id = v.video_id) AS confirmed,
  (SELECT count(*) FROM peaks e WHERE e.video_id = v.video_id) AS loud, (SELECT count(*) FROM feedm e WHERE e.video_id = v.video_id) AS feeds FROM (SELECT DISTINCT video_id FROM scan) v),
sp_in AS (SELECT video_id, list({'t': "time", 's': strength::DOUBLE} ORDER BY strength DESC, "time") AS ps FROM peaks JOIN facts USING (video_id) WHERE events < 3 AND loud >= 2 AND NOT (confirmed >= 4 AND feeds >= 3) GROUP BY 1),
sp_un AS (SELECT video_id, unnest(list_reduce(list_transform(ps, lambda y: [y]), lambda acc, p: CASE WHEN len(acc) < 5 AND abs(p[1].t - acc[1].t) <= 75 AND abs(p[1].t - acc[-1].t) <= 22 THEN list_append(acc, p[1]) ELSE acc END)) AS v FROM sp_in),
sp AS (SELECT video_id, v.t AS t, v.s AS s, min(v.t) OVER (PARTITION BY video_id) AS c0 FROM sp_un QUALIFY count(*) OVER (PARTITION BY video_id) >= 2),
sp_chain AS (SELECT video_id, c0, min(t) AS cs, max(t) AS ce, count(*) AS peaks, max(s) AS strongest, count(*) * 22 + max(s) * 4 + sum(s) AS score FROM sp GROUP BY 1, 2)"""

UNION_ALL = """src AS (
  SELECT f.video_id, 'feed' AS source, st, du, pt, start_time, end_time, output_duration, kill_count, has_payoff, composite, -composite AS o1, pack_at AS o2, pack_seq::DOUBLE AS o3 FROM feedm f
  UNION ALL SELECT c.video_id, 'chain', st, du, pt, start_time, end_time, output_duration, kill_count, has_payoff, composite, -score, c0, 0 FROM cm c JOIN facts USING (video_id)
    WHERE NOT (facts.confirmed >= 4 AND feeds >= 3) AND NOT (facts.confirmed >= 3 AND hud_kills < 2)
  UNION ALL SELECT video_id, 'sparse', st, du, pt, start_time, end_time, output_duration, kill_count, has_payoff, composite, 0, c0, 0 FROM sm),
once AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY video_id, source, floor(start_time) ORDER BY o1, o2, o3) = 1),
win AS (SELECT * FROM once WHERE source <> 'sparse' OR (SELECT count(*) FROM once o WHERE o.video_id = once.video_id AND o.source <> 'sparse') < 4)"""

POOL = """hudc AS (SELECT video_id, 0 AS from_pool, pack_seq::VARCHAR AS seq, start_time, end_time, kill_count::BIGINT AS kill_count, local_score + 120 AS local_score FROM allc),
side AS (SELECT video_id, 1 AS from_pool, source || ':' || floor(start_time)::BIGINT AS seq, start_time, end_time, kill_count::BIGINT AS kill_count, floor(composite + 0.5) + 280 AS local_score, len(pt) - has_payoff::INT AS nk, pt FROM win),
free AS (SELECT * EXCLUDE (nk, pt) FROM side w WHERE NOT EXISTS (SELECT 1 FROM hudc h WHERE h.video_id = w.video_id) OR ((SELECT count(*) FROM hudc h WHERE h.video_id = w.video_id) < 5
  AND (nk = 1 OR (pt[nk] - pt[1] <= 600 AND (pt[nk] - pt[1] <= 55 OR len(list_filter(range(2, nk + 1), lambda j: pt[j] - pt[j - 1] > 35)) > 0)))
  AND NOT EXISTS (SELECT 1 FROM hudc h WHERE h.video_id = w.video_id AND (abs(h.start_time - w.start_time) < 20 OR (least(h.end_time, w.end_time) > greatest(h.start_time, w.start_time)
    AND (least(h.end_time, w.end_time) - greatest(h.start_time, w.start_time)) / least(h.end_time - h.start_time, w.end_time - w.start_time) > 0.35))))),
pool AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY kill_count DESC, local_score DESC, from_pool, start_time, seq) AS list_index FROM (SELECT * FROM hudc UNION ALL SELECT * FROM free))"""
