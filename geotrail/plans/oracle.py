"""SQL counterparts of the checked queries, in plain relational form."""

from __future__ import annotations

from geotrail.plans import checked

LOCATIONS = """
locations AS (
  SELECT event_id AS seq, user_id AS device, (value * 7.3) % 100 AS x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, ts
  FROM events)"""

FENCES = """
shape AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS category,
         n_nationkey % 10 <> 9 AS valid, n_nationkey % 3 AS kind,
         CAST(13 * n_nationkey % 80 AS DOUBLE) AS x0, CAST(29 * n_nationkey % 70 AS DOUBLE) AS y0,
         CAST(10 + 7 * n_nationkey % 25 AS DOUBLE) AS w,
         CAST(10 + 11 * n_nationkey % 30 AS DOUBLE) AS h
  FROM nation),
vertices AS (
  SELECT id, 0 AS ring, 0 AS vertex, x0 AS x, y0 AS y FROM shape
  UNION ALL SELECT id, 0, 1, x0 + w, y0 FROM shape
  UNION ALL SELECT id, 0, 2, x0 + w, y0 + h FROM shape WHERE kind <> 1
  UNION ALL SELECT id, 0, 3, x0, y0 + h FROM shape WHERE kind <> 1
  UNION ALL SELECT id, 0, 4, x0, y0 FROM shape WHERE kind <> 1
  UNION ALL SELECT id, 0, 2, x0, y0 + h FROM shape WHERE kind = 1
  UNION ALL SELECT id, 0, 3, x0, y0 FROM shape WHERE kind = 1
  UNION ALL SELECT id, 1, 0, x0 + w / 4, y0 + h / 4 FROM shape WHERE kind = 2
  UNION ALL SELECT id, 1, 1, x0 + w / 2, y0 + h / 4 FROM shape WHERE kind = 2
  UNION ALL SELECT id, 1, 2, x0 + w / 2, y0 + h / 2 FROM shape WHERE kind = 2
  UNION ALL SELECT id, 1, 3, x0 + w / 4, y0 + h / 2 FROM shape WHERE kind = 2
  UNION ALL SELECT id, 1, 4, x0 + w / 4, y0 + h / 4 FROM shape WHERE kind = 2),
edges AS (
  SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM vertices a JOIN vertices b ON a.id = b.id AND a.ring = b.ring AND b.vertex = a.vertex + 1
  JOIN shape s ON s.id = a.id WHERE s.valid)"""

PAIRS = f"""{LOCATIONS},{FENCES},
pairs AS (
  SELECT l.seq, l.device, e.id AS polygon
  FROM locations l CROSS JOIN edges e
  GROUP BY l.seq, l.device, e.id
  HAVING sum(CASE WHEN (e.y1 > l.y) <> (e.y2 > l.y)
                   AND l.x < e.x1 + (l.y - e.y1) * ((e.x2 - e.x1) / nullif(e.y2 - e.y1, 0))
                  THEN 1 ELSE 0 END) % 2 = 1
     AND NOT bool_or((l.x - e.x1) * (e.y2 - e.y1) = (l.y - e.y1) * (e.x2 - e.x1)
                     AND l.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                     AND l.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)))"""

EVENTS = f"""{PAIRS},
steps AS (
  SELECT *, lag(seq) OVER d AS before, lead(seq) OVER d AS after,
         lead(x) OVER d AS next_x, lead(y) OVER d AS next_y, lead(ts) OVER d AS next_ts
  FROM locations WINDOW d AS (PARTITION BY device ORDER BY ts, seq)),
collisions AS (
  SELECT 'enter' AS event_type, p.polygon, s.device, true AS "in", s.x, s.y,
         date_trunc('milliseconds', s.ts) AS event_ts, s.seq
  FROM pairs p JOIN steps s ON s.seq = p.seq
  WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.seq = s.before AND q.polygon = p.polygon)
  UNION ALL
  SELECT 'exit', p.polygon, s.device, false, s.next_x, s.next_y,
         date_trunc('milliseconds', s.next_ts), s.after
  FROM pairs p JOIN steps s ON s.seq = p.seq
  WHERE s.after IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.seq = s.after AND q.polygon = p.polygon))"""

VISITS = f"""{EVENTS},
visit AS (
  SELECT device, polygon, exit_ts IS NULL AS inside, event_ts AS enter_ts, x AS in_x, y AS in_y,
         exit_ts, out_x, out_y
  FROM (SELECT *, lead(event_ts) OVER v AS exit_ts, lead(x) OVER v AS out_x, lead(y) OVER v AS out_y
        FROM collisions WINDOW v AS (PARTITION BY device, polygon ORDER BY event_ts, seq)) e
  WHERE event_type = 'enter')"""

USERS = """
people AS (
  SELECT c_custkey + 1 AS id, c_custkey AS device FROM customer WHERE c_custkey % 7 <> 3),
owners AS (SELECT device, max(id) AS id_user FROM people GROUP BY device)"""

LATEST = f"""{LOCATIONS},
latest AS (
  SELECT device, x, y, ts, seq FROM locations
  QUALIFY row_number() OVER (PARTITION BY device ORDER BY seq DESC) = 1)"""

HISTORY = f"""{LOCATIONS},
history AS (SELECT device AS id, x AS point_x, y AS point_y, ts AS "timestamp" FROM locations)"""

_EVENT_COLUMNS = 'SELECT event_type, polygon, device, "in", x, y, event_ts, seq FROM collisions'
_VISIT_COLUMNS = """SELECT device, polygon, inside, enter_ts AS collision_date_in, in_x, in_y,
  exit_ts AS collision_date_out, out_x, out_y FROM visit"""
_PAIR_COLUMNS = "SELECT seq, device, polygon FROM pairs"
_VISIT_FROM, _VISIT_TO = checked.VISIT_WINDOW.replace("T", " ").split(";")
_VISIT_HISTORY = f"""SELECT '{checked.VISIT_WINDOW}' AS "time", {{user}} AS id_user,
  v.device AS id_device, v.polygon AS id_polygon, v.inside, v.enter_ts AS enter_date,
  v.exit_ts AS exit_date, v.in_x AS enter_point_x, v.in_y AS enter_point_y,
  v.out_x AS exit_point_x, v.out_y AS exit_point_y
FROM visit v {{owner}}
WHERE v.enter_ts >= TIMESTAMP '{_VISIT_FROM}' AND v.enter_ts <= TIMESTAMP '{_VISIT_TO}'"""
_REPEATED = " OR ".join(
    f"""("timestamp" >= TIMESTAMP '2024-01-{day} 06:00:00'
      AND "timestamp" <= TIMESTAMP '2024-01-{day} 11:00:59.999999')"""
    for day in ("03", "10", "17", "24")
)
_TWO_DAYS_LATER = """h."timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
  AND h."timestamp" <= TIMESTAMP '2024-01-12 23:59:59.999999'"""
_WATCHED = ", ".join(map(str, checked.WATCHED_POLYGONS))


_BY_USER = """SELECT p.id AS user_id, p.device AS device_id, l.x, l.y,
  epoch_us(l.ts) AS "timestamp" FROM people p JOIN latest l ON l.device = p.device"""
_LISTED = f"id IN ({', '.join(map(str, checked.LISTED_USERS))})"
_INSIDE = """SELECT o.id_user, v.device AS id_device, v.polygon AS id_polygon,
  v.enter_ts AS enter_date FROM visit v JOIN owners o ON o.device = v.device WHERE v.inside"""


def _with(parts: str, body: str) -> str:
    return f"WITH {parts}\n{body}"


ORACLE = {
    "locations_scan": _with(LOCATIONS, "SELECT seq, device, x, y, ts FROM locations"),
    "polygons_scan": _with(
        FENCES,
        """SELECT s.id, s.category, s.valid, TIMESTAMP '2024-01-01 00:00:00' AS creation,
             CAST(count(DISTINCT v.ring) AS BIGINT) AS rings
           FROM shape s JOIN vertices v ON v.id = s.id GROUP BY s.id, s.category, s.valid""",
    ),
    "polygons_valid": _with(
        FENCES,
        """SELECT id AS id_polygon, count(*) AS edges, min(x1) AS min_x, min(y1) AS min_y,
             max(x1) AS max_x, max(y1) AS max_y FROM edges GROUP BY id""",
    ),
    "users_scan": _with(USERS, "SELECT id, device FROM people"),
    "wkt_points": _with(LOCATIONS, "SELECT seq, x, y FROM locations"),
    "wkt_polygons": _with(
        FENCES,
        """SELECT id, CAST(ring AS BIGINT) AS ring, CAST(vertex AS BIGINT) AS vertex, x, y
           FROM vertices""",
    ),
    "ts_truncate_ms": _with(
        LOCATIONS,
        """SELECT seq, epoch_us(ts) AS epoch_us, epoch_us(ts) // 1000 AS epoch_ms,
             date_trunc('milliseconds', ts) AS ts_ms FROM locations""",
    ),
    "reject_split": _with(
        LOCATIONS,
        """SELECT seq, ok AS accepted, CASE WHEN ok THEN device END AS device,
             CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y
           FROM (SELECT *, seq % 17 <> 3 AND seq % 19 <> 5 AS ok FROM locations) m""",
    ),
    "locations_keyed_json": _with(
        LOCATIONS,
        "SELECT device AS key_device, device, x, y, epoch_us(ts) AS epoch_us FROM locations",
    ),
    "history_flatten": _with(
        HISTORY,
        """SELECT id, point_x, point_y, "timestamp", CAST("timestamp" AS DATE) AS event_date
           FROM history""",
    ),
    "point_in_polygon_pairs": _with(PAIRS, _PAIR_COLUMNS),
    "spatial_join_grid": _with(PAIRS, _PAIR_COLUMNS),
    "inside_set": _with(
        PAIRS,
        """SELECT l.seq, count(p.polygon) AS fences,
             coalesce(string_agg(CAST(p.polygon AS VARCHAR), ',' ORDER BY p.polygon), '')
               AS polygons
           FROM locations l LEFT JOIN pairs p ON p.seq = l.seq GROUP BY l.seq""",
    ),
    "collision_events": _with(EVENTS, _EVENT_COLUMNS),
    "collision_events_setdiff": _with(EVENTS, _EVENT_COLUMNS),
    "collision_events_split": _with(EVENTS, _EVENT_COLUMNS),
    "event_json_keyed": _with(
        EVENTS,
        """SELECT event_type, polygon, device, "in", x, y, epoch_ms(event_ts) AS epoch_ms,
             md5(concat_ws('|', event_type, polygon, device, epoch_ms(event_ts))) AS content_md5
           FROM collisions""",
    ),
    "events_dedup": _with(
        EVENTS, "SELECT event_type, polygon, device, event_ts FROM collisions"
    ),
    "visits": _with(VISITS, _VISIT_COLUMNS),
    "visits_split": _with(VISITS, _VISIT_COLUMNS),
    "current_polygon_set": _with(
        VISITS, "SELECT DISTINCT device, polygon FROM visit WHERE inside"
    ),
    "stream_events_micro_batch": _with(EVENTS, _EVENT_COLUMNS),
    "sql_point_in_polygon": _with(PAIRS, _PAIR_COLUMNS),
    "history_ordered": _with(
        LOCATIONS,
        """SELECT row_number() OVER (ORDER BY device, ts, seq) AS position, device, ts, x, y
           FROM locations""",
    ),
    "visits_ordered": _with(
        VISITS,
        """SELECT row_number() OVER (ORDER BY device, enter_ts, polygon) AS position, device,
             polygon, enter_ts, exit_ts
           FROM visit""",
    ),
    "visits_of_users_bucketed": _with(
        f"{VISITS},{USERS}",
        """SELECT v.device, v.polygon, v.inside, v.enter_ts AS collision_date_in,
             v.exit_ts AS collision_date_out, o.id_user, l.x, l.y
           FROM visit v JOIN owners o ON o.device = v.device
           JOIN (SELECT device, arg_max(x, seq) AS x, arg_max(y, seq) AS y
                 FROM locations GROUP BY device) l ON l.device = v.device""",
    ),
    "stream_figures": """
SELECT n.name, count(*) AS "rows", min(ts) AS "first", max(ts) AS "last"
FROM events, (VALUES ('streamed'), ('written')) n(name) GROUP BY n.name""",
    "stream_events_stateful": _with(EVENTS, _EVENT_COLUMNS),
    "stream_events_stateful_grid": _with(EVENTS, _EVENT_COLUMNS),
    "stream_visits": _with(VISITS, _VISIT_COLUMNS),
    "stream_pipeline": _with(VISITS, _VISIT_COLUMNS),
    "reject_split_events": _with(
        EVENTS,
        """SELECT seq, polygon, seq % 17 <> 3 AND seq % 19 <> 5 AND seq % 23 <> 7 AS accepted,
             CASE WHEN seq % 17 = 3 THEN 25 ELSE length(value)
               - CASE WHEN seq % 19 = 5 THEN length(CAST(polygon AS VARCHAR)) - 3
                      WHEN seq % 23 = 7 THEN length('collision_') ELSE 0 END END AS size
           FROM (SELECT *, '{"event_type": "' || event_type || '", "polygon": ' || polygon
                   || ', "device": ' || device || ', "in": ' || "in"
                   || ', "collision_point_' || CASE WHEN "in" THEN 'in' ELSE 'out' END
                   || '": {"x": ' || x || ', "y": ' || y
                   || '}, "collision_date_' || CASE WHEN "in" THEN 'in' ELSE 'out' END
                   || '": "' || epoch_ms(event_ts) || '"}' AS value
                 FROM collisions) c""",
    ),
    "stream_latest": _with(LATEST, "SELECT device, x, y, ts, seq FROM latest"),
    "latest_by_user_streamed": _with(f"{LATEST},{USERS}", _BY_USER),
    "history_settled": _with(
        HISTORY,
        """SELECT id, point_x, point_y, "timestamp", CAST("timestamp" AS DATE) AS event_date
           FROM history""",
    ),
    "visits_stored": _with(
        f"{VISITS},{USERS}",
        _VISIT_HISTORY.format(
            user="o.id_user", owner="LEFT JOIN owners o ON o.device = v.device"
        ),
    ),
    "latest_of_users": _with(f"{LATEST},{USERS}", f"{_BY_USER} WHERE p.{_LISTED}"),
    "trajectory_all": _with(
        f"{HISTORY},{USERS}",
        f"""SELECT 'all' AS in_time, p.id AS id_user, p.device AS id_device,
              h."timestamp", h.point_x AS x, h.point_y AS y
            FROM people p JOIN history h ON h.id = p.device WHERE p.id = {checked.USER}""",
    ),
    "trajectories_of_users": _with(
        f"{HISTORY},{USERS}",
        f"""SELECT '{checked.HISTORY_WINDOW}' AS in_time, o.id_user, o.device AS id_device,
              h."timestamp", h.point_x AS x, h.point_y AS y,
              row_number() OVER (PARTITION BY o.device
                ORDER BY h."timestamp", h.point_x, h.point_y) AS ordinal
            FROM (SELECT id AS id_user, device FROM people) o JOIN history h ON h.id = o.device
            WHERE o.id_user < 200 AND o.id_user % 3 <> 0 AND {_TWO_DAYS_LATER}""",
    ),
    "polygons_catalog_category": _with(
        FENCES,
        f"""SELECT s.id, TIMESTAMP '2024-01-01 00:00:00' AS creation, s.valid,
              r.r_name AS category
            FROM shape s JOIN region r ON r.r_regionkey = s.category
            WHERE NOT s.valid AND s.category = {checked.CATEGORY}""",
    ),
    "visits_history_open_end": _with(
        f"{VISITS},{USERS}",
        f"""SELECT '{checked.OPEN_WINDOW}' AS "time", o.id_user, v.device AS id_device,
              v.polygon AS id_polygon, v.inside, v.enter_ts AS enter_date, v.exit_ts AS exit_date,
              v.in_x AS enter_point_x, v.in_y AS enter_point_y, v.out_x AS exit_point_x,
              v.out_y AS exit_point_y
            FROM visit v LEFT JOIN owners o ON o.device = v.device
            WHERE v.enter_ts >= TIMESTAMP '2024-01-20 00:00:00'""",
    ),
    "visits_history_paged": _with(
        f"{VISITS},{USERS}",
        _VISIT_HISTORY.format(
            user="row_number() OVER (PARTITION BY v.device ORDER BY v.enter_ts, v.polygon)"
            " AS ordinal, o.id_user",
            owner="LEFT JOIN owners o ON o.device = v.device",
        ),
    ),
    "currently_inside_paged": _with(f"{VISITS},{USERS}", _INSIDE),
    "currently_inside_listed": _with(
        f"{VISITS},{USERS}",
        f"{_INSIDE} AND v.polygon IN ({_WATCHED}) AND o.id_user < 200 AND o.id_user % 3 <> 0",
    ),
    "latest_location": _with(LATEST, "SELECT device, x, y, ts, seq FROM latest"),
    "device_user_map": _with(USERS, "SELECT device, id_user FROM owners"),
    "latest_by_user": _with(
        f"{LATEST},{USERS}",
        """SELECT p.id AS user_id, p.device AS device_id, l.x, l.y, epoch_us(l.ts) AS "timestamp"
           FROM people p JOIN latest l ON l.device = p.device""",
    ),
    "active_users": _with(
        f"{LATEST},{USERS}",
        """SELECT id_user AS user_id, device AS device_id FROM owners
           WHERE device IN (SELECT device FROM latest)""",
    ),
    "history_by_device": _with(
        HISTORY,
        f"""SELECT id, point_x, point_y, "timestamp" FROM history WHERE id = {checked.DEVICE}""",
    ),
    "history_in_interval": _with(
        HISTORY, f'SELECT id, point_x, point_y, "timestamp" FROM history WHERE {_REPEATED}'
    ),
    "trajectory_one_user": _with(
        f"{HISTORY},{USERS}",
        f"""SELECT '{checked.HISTORY_WINDOW}' AS in_time, p.id AS id_user, p.device AS id_device,
              h."timestamp", h.point_x AS x, h.point_y AS y
            FROM people p JOIN history h ON h.id = p.device
            WHERE p.id = {checked.USER} AND {_TWO_DAYS_LATER}""",
    ),
    "trajectories_by_user": _with(
        f"{HISTORY},{USERS}",
        f"""SELECT '{checked.HISTORY_WINDOW}' AS in_time, o.id_user, o.device AS id_device,
              h."timestamp", h.point_x AS x, h.point_y AS y,
              row_number() OVER (PARTITION BY o.device
                ORDER BY h."timestamp", h.point_x, h.point_y) AS ordinal
            FROM owners o JOIN history h ON h.id = o.device WHERE {_TWO_DAYS_LATER}""",
    ),
    "trajectory_pages": _with(
        f"{HISTORY},{USERS}",
        """SELECT id_user, id_device, (ordinal - 1) // 16 * 16 + 1 AS first_ordinal, ordinal,
             "timestamp", x, y
           FROM (SELECT o.id_user, o.device AS id_device, h."timestamp", h.point_x AS x,
                   h.point_y AS y,
                   row_number() OVER (PARTITION BY o.device
                     ORDER BY h."timestamp", h.point_x, h.point_y) AS ordinal
                 FROM owners o JOIN history h ON h.id = o.device
                 WHERE h."timestamp" >= TIMESTAMP '2024-01-01 00:00:00'
                   AND h."timestamp" < TIMESTAMP '2025-01-01 00:00:00') t""",
    ),
    "polygons_catalog": _with(
        FENCES,
        """SELECT s.id, TIMESTAMP '2024-01-01 00:00:00' AS creation, s.valid, r.r_name AS category
           FROM shape s JOIN region r ON r.r_regionkey = s.category WHERE s.valid""",
    ),
    "visits_history": _with(
        f"{VISITS},{USERS}",
        _VISIT_HISTORY.format(
            user="o.id_user", owner="LEFT JOIN owners o ON o.device = v.device"
        ),
    ),
    "visits_history_restricted": _with(
        f"{VISITS},{USERS}",
        _VISIT_HISTORY.format(user="o.id_user", owner="JOIN owners o ON o.device = v.device")
        + f"""
  AND v.polygon IN ({_WATCHED}) AND o.id_user < 200 AND o.id_user % 3 <> 0""",
    ),
    "currently_inside": _with(
        f"{VISITS},{USERS}",
        """SELECT o.id_user, v.device AS id_device, v.polygon AS id_polygon,
             v.enter_ts AS enter_date
           FROM visit v JOIN owners o ON o.device = v.device WHERE v.inside""",
    ),
}
