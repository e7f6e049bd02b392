"""SQL text of the entity views, shared by all oracle queries."""
from __future__ import annotations

CTES = {
    "kill_event": """kill_event AS (
  SELECT user_id AS video_id, event_id AS seq, (epoch_us(ts) / 1e6 - 1704067200) / 1000 AS "time",
    CASE event_type WHEN 'purchase' THEN 'top_right' WHEN 'signup' THEN 'bottom_kills' WHEN 'view' THEN 'top_right_2'
      WHEN 'click' THEN 'top_left' WHEN 'error' THEN 'center_banner' END AS roi,
    least(0.99::DOUBLE, 0.4::DOUBLE + value / 250) AS confidence,
    coalesce(k % 2 = 0, false) AS player_kill, coalesce(k % 3 = 0, false) AS red_highlight, value / 1000 AS highlight_score,
    'p' || (k % 7) AS killer, 'v' || (k % 11) AS victim, value / 490 AS activity,
    CASE WHEN event_type IN ('error', 'click') THEN (['headshot kill', 'bomb planted', 'round info', ''])[coalesce(k % 4, 3) + 1] END AS text,
    CASE WHEN k % 10 = 0 THEN 'red-highlight' ELSE 'ocr' END AS method
  FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
    "line": """line AS (
  SELECT video_id, seq, text, (e - d) / 10 AS "start", e / 10 AS "end", d / 10 AS duration
  FROM (SELECT *, sum(d + g) OVER (PARTITION BY video_id ORDER BY seq) AS e
    FROM (SELECT doc_id AS video_id, (i - 1)::INT AS seq, ls[i] AS text,
        greatest(5, 4 * len(list_filter(string_split(ls[i], ' '), lambda w: w <> ''))) AS d, (length(ls[i]) % 4) * 5 AS g
      FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i))))""",
    "loud": """loud AS (
  SELECT vec_id AS video_id, (i - 1)::INT AS idx, embedding[i]::DOUBLE * 40 AS db, embedding[i]::DOUBLE AS sample
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))""",
    "long_loud": """loud AS (
  SELECT vec_id // 8 AS video_id, ((vec_id % 8) * 64 + i - 1)::INT AS idx, embedding[i]::DOUBLE * 40 AS db
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))""",
    "long_line": """ln AS (SELECT video_id // 16 AS video_id, (video_id % 16) * 1000000 + seq AS seq,
    ['', 'Got him! ', '', '', 'bomb planted, ', '', 'nice HEADSHOT ', '', 'waiting to plant, ', '', 'ace, defused: ', '', 'one tap ', '', 'clutch the bomb ', '', 'eco, nice '][length(text) % 17 + 1] || text AS text,
    "start" + (video_id % 16) * 40 AS "start", "end" + (video_id % 16) * 40 AS "end" FROM line)""",
    "job": """job AS (
  SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'error' ELSE 'running' END AS status,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 <> 0 THEN 'E' || (o_orderkey % 5) END AS error_code,
    CASE o_orderkey % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'local' END AS source_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://youtube.example/v' ELSE 'https://example.org/v' END AS url,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'cs2' ELSE o_orderpriority END AS category,
    (o_orderkey % 2400) * 1000 AS took, o_orderdate AS done, coalesce(n, 0) AS highlights, coalesce(q, 0)::INT AS kills, coalesce(r, false) AS has_montage
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::INT AS n, sum(l_quantity) AS q, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
jobx AS (
  SELECT job_id, strftime(done, '%Y-%m') AS month, status = 'error' OR error_code IS NOT NULL AS failed, status = 'completed' AS completed,
    CASE WHEN status = 'error' OR error_code IS NOT NULL THEN coalesce(error_code, 'UNKNOWN') END AS error,
    CASE WHEN source_type IS NOT NULL THEN source_type WHEN contains(url, 'youtube') THEN 'youtube' ELSE 'unknown' END AS source, category,
    CASE WHEN took > 0 AND took < 1800000 THEN took END AS took_ms, highlights, has_montage OR category = 'cs2' AS montage,
    CASE WHEN (has_montage OR category = 'cs2') AND kills > 0 THEN kills END AS kills FROM job)""",
    "project": """project AS (
  SELECT c_custkey AS id, c_custkey AS job_id, c_mktsegment || ' ' || c_name AS title, 'https://example.org/' || c_custkey AS url,
    CASE WHEN c_nationkey % 2 = 0 THEN 'youtube' ELSE 'local' END AS source_type, coalesce(n, 0)::INT AS clip_count, coalesce(last, 902016000000) AS created_at, coalesce(last, 902016000000) AS updated_at,
    CASE WHEN c_acctbal <= 5000 AND last IS NOT NULL THEN last + 604800000 END AS expires_at, c_acctbal > 5000 AS saved
  FROM customer LEFT JOIN (SELECT o_custkey, epoch_ms(max(o_orderdate)) AS last, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)""",
}

CTES["long_event"] = CTES["kill_event"].replace("kill_event AS", "plain_event AS") + """,
kill_event AS (SELECT * REPLACE (seq // 25 AS video_id, ("time" * 100) % 640 AS "time") FROM plain_event)"""


def sql(body: str, *names: str, more: str = "", recursive: bool = False) -> str:
    """``body`` preceded by the named views and any further CTE text."""
    parts = [CTES[n] for n in names]
    if more:
        parts.append(more.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def tenth(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"
