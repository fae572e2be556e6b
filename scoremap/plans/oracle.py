"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

import math

from scoremap.functions import geometry as G
from scoremap.plans.inputs import LAT_SQL, LON_SQL
from scoremap.sources.literals import PALETTE, SCALES, SITES

_PALETTE = "[" + ", ".join(f"'rgb({r},{g},{b})'" for r, g, b in PALETTE) + "]"
_SCORED = "s AS (SELECT *, (l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) AS score FROM lineitem)"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SCALE_ROWS = ", ".join(f"({i}, {_quote(n)}, {max(int(p.split(' = ')[0]) for p in s.replace(', IoT', '').split(', ') if ' = ' in p)})" for i, (n, s) in enumerate(SCALES))
_LEVEL_ROWS = ", ".join(
    f"({_quote(n)}, {code}, {_quote(label)})"
    for n, s in SCALES
    for code, label in ((int(p.split(" = ")[0]), p.split(" = ")[1].replace("\x00", ", ")) for p in s.replace("5G, IoT", "5G\x00IoT").split(", ") if " = " in p)
)
_OBS = f"c(i, indicator, top) AS (VALUES {_SCALE_ROWS}), obs AS (SELECT l_partkey AS segment_id, l_linenumber * 5 % 24 AS i, (l_quantity % 5)::INT AS code FROM lineitem)"


def _project(lon: str, lat: str) -> tuple[str, str]:
    t = f"(tan({math.pi / 4!r}::DOUBLE - radians({lat}) / 2) / pow(2 / (1 + sin(radians({lat})) * {G.ECCENTRICITY!r}::DOUBLE) - 1, {G.ECCENTRICITY / 2!r}::DOUBLE))"
    rho = f"(pow({t}, {G.CONE!r}::DOUBLE) * {G.SCALE!r}::DOUBLE)"
    theta = f"((radians({lon}) - ({G.LON0!r}::DOUBLE)) * {G.CONE!r}::DOUBLE)"
    return f"(({rho} * sin({theta}) + {G.FALSE_EAST!r}::DOUBLE) / {G.FOOT!r}::DOUBLE)", f"(({G.RHO0!r}::DOUBLE - {rho} * cos({theta})) / {G.FOOT!r}::DOUBLE)"


def _unproject(x: str, y: str) -> tuple[str, str]:
    """Column names of feet to degrees; the six steps are nested."""
    east, north = f"({x} * {G.FOOT!r}::DOUBLE - {G.FALSE_EAST!r}::DOUBLE)", f"({G.RHO0!r}::DOUBLE - {y} * {G.FOOT!r}::DOUBLE)"
    t = f"pow(sqrt({east} * {east} + {north} * {north}) / {G.SCALE!r}::DOUBLE, {1 / G.CONE!r}::DOUBLE)"
    lat = f"({math.pi / 2!r}::DOUBLE - 2 * atan({t}))"
    for _ in range(6):
        lat = f"({math.pi / 2!r}::DOUBLE - 2 * atan({t} * pow(2 / (1 + sin({lat}) * {G.ECCENTRICITY!r}::DOUBLE) - 1, {G.ECCENTRICITY / 2!r}::DOUBLE)))"
    return f"degrees(atan2({east}, {north}) / {G.CONE!r}::DOUBLE + ({G.LON0!r}::DOUBLE))", f"degrees({lat})"


def _boxes() -> str:
    """Vertices of the integer boxes."""
    return """b AS (SELECT s_suppkey, s_suppkey * 37 % 1000 * 100 AS x, s_suppkey * 91 % 1000 * 100 AS y, 20 + s_suppkey % 7 * 10 AS side FROM supplier),
r AS (SELECT s_suppkey, 0 AS poly, 0 AS loop, x, y, side FROM b
      UNION ALL SELECT s_suppkey, 0, 1, x + 5, y + 5, side - 10 FROM b WHERE s_suppkey % 3 = 0
      UNION ALL SELECT s_suppkey, 1, 0, x + 100, y, side FROM b WHERE s_suppkey % 5 = 0),
v AS (SELECT s_suppkey, poly, loop, k, (x + CASE WHEN k IN (1, 2) THEN side ELSE 0 END)::DOUBLE AS x, (y + CASE WHEN k IN (2, 3) THEN side ELSE 0 END)::DOUBLE AS y FROM r, range(5) AS t(k))"""


_CLICKS = "k AS (SELECT event_id, ts, user_id, CASE WHEN value >= 5 THEN event_type END AS item FROM events)"
_TOGGLE = f"""WITH {_CLICKS},
a AS (SELECT *, (item IS NULL OR item IS DISTINCT FROM lag(item) OVER w)::INT AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) % 2 = 1 THEN item END AS active FROM b)
"""


def oracle_sql() -> dict[str, str]:
    lat, lon = LAT_SQL.format(k="c_custkey"), LON_SQL.format(k="c_custkey")
    px, py = _project(lon, lat)
    slat, slon = LAT_SQL.format(k="s_suppkey"), LON_SQL.format(k="s_suppkey")
    sx, sy = _project("lon", "lat")
    ux, uy = _unproject("vx", "vy")
    tags = "t AS (SELECT DISTINCT p_partkey AS id, lower(unnest(list_append(string_split(p_name, ' '), p_type))) AS tag FROM part)"
    circle = "cos((k % {n}) * ({step!r}::DOUBLE))"
    sine = "sin((k % {n}) * ({step!r}::DOUBLE))"
    c64, s64 = (f.format(n=64, step=2 * math.pi / 64) for f in (circle, sine))
    c32, s32 = (f.format(n=32, step=2 * math.pi / 32) for f in (circle, sine))
    c16, s16 = (f.format(n=16, step=2 * math.pi / 16) for f in (circle, sine))
    starts = ", ".join(f"({s[0]}, {s[6]}, {s[7]})" for s in SITES)
    return {
        "map_layer": f"""WITH s AS (SELECT s_suppkey, (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS score FROM supplier)
SELECT s_suppkey, score, floor(score * 10)::INT AS bin, {_PALETTE}[floor(score * 10)::INT + 1] AS css, printf('Score: %.1f%%', score * 100) AS label,
       5 + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 5 ELSE 0 END AS n_vertices FROM s""",
        "score_minmax": f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, score FROM s",
        "score_ramp": f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, floor(score * 10)::INT AS bin, {_PALETTE}[floor(score * 10)::INT + 1] AS css FROM s",
        "score_ramp_scaled": f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, floor(score * 2.5::DOUBLE * 10)::INT AS line_bin, least(floor(score * 2.5::DOUBLE * 10)::INT, 10) AS clamped, {_PALETTE}[floor(score * 2.5::DOUBLE * 10)::INT + 1] AS css FROM s",
        "score_label": f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, printf('Score: %.1f%%', score * 100) AS label, CASE WHEN score <> 0 THEN printf('Score: %.1f%%', score * 100) END AS label_nonzero FROM s",
        "score_percentile": "SELECT l_orderkey, l_linenumber, l_returnflag, percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS percentile FROM lineitem",
        "score_sketches": "SELECT l_returnflag, i AS decile, count(*) AS n, true AS within FROM lineitem, range(1, 10) AS t(i) WHERE month(l_shipdate) <= 6 GROUP BY l_returnflag, i",
        "score_default_null": "SELECT doc_id, coalesce(quality::DOUBLE, 0) AS score FROM documents LEFT JOIN labels USING (doc_id)",
        "borough_filter": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
        "wkt_roundtrip": f"WITH {_boxes()} SELECT * FROM v",
        "geojson_roundtrip": f"WITH {_boxes()} SELECT * FROM v",
        "project_points": f"SELECT c_custkey, round({px}, 3) AS x, round({py}, 3) AS y FROM customer",
        "project_roundtrip": f"SELECT c_custkey, 2263 AS srid, round({lon}, 9) AS lon, round({lat}, 9) AS lat FROM customer",
        "circle_vertices": f"SELECT s_suppkey, k, round({slon} * 1000 + 400 * {c64}, 6) AS x, round({slat} * 1000 + 400 * {s64}, 6) AS y FROM supplier, range(65) AS t(k)",
        "dome_planar": f"""WITH p AS (SELECT s_suppkey AS ordinal, s_name, {slon} AS lon, {slat} AS lat FROM supplier),
q AS (SELECT ordinal, s_name, {sx} AS x, {sy} AS y FROM p),
g AS (SELECT *, cos(ring * ({math.pi / 14!r}::DOUBLE)) * 400 AS radius, sin(ring * ({math.pi / 14!r}::DOUBLE)) * 150 AS height FROM q, range(15) AS t(ring)),
w AS (SELECT *, x + radius * {c64} AS vx, y + radius * {s64} AS vy FROM g, range(65) AS u(k) WHERE radius > 1e-9)
SELECT ordinal, 'Deployment location: ' || s_name AS description, ring, round(radius, 6) AS radius, round(height, 6) AS height, k, round({ux}, 7) AS x, round({uy}, 7) AS y FROM w""",
        "dome_rings": f"SELECT s_suppkey AS ordinal, ring, round(cos(ring * ({math.pi / 14!r}::DOUBLE)) * 400, 6) AS radius, round(sin(ring * ({math.pi / 14!r}::DOUBLE)) * 150, 6) AS height, ring > 6 AS is_empty FROM supplier, range(15) AS t(ring)",
        "dome_geographic": f"""WITH g AS (SELECT s_suppkey AS ordinal, {slon} AS lon, {slat} AS lat, level, cos(level / 14::DOUBLE * ({math.pi / 2!r}::DOUBLE)) * 0.004::DOUBLE AS radius, sin(level / 14::DOUBLE * ({math.pi / 2!r}::DOUBLE)) * 250 AS height FROM supplier, range(15) AS t(level))
SELECT ordinal, level, round(height, 6) AS height, round((1 - level / 14::DOUBLE) * 0.3::DOUBLE, 9) AS opacity, k, round(lon + radius * {c32}, 9) AS x, round(lat + radius * {s32}, 9) AS y FROM g, range(33) AS u(k)""",
        "geojson_features": f"""WITH {_boxes()},
p AS (SELECT s_suppkey, poly, loop, '[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY k) || ']' AS ring FROM v GROUP BY ALL),
q AS (SELECT s_suppkey, poly, '[' || string_agg(ring, ',' ORDER BY loop) || ']' AS rings FROM p GROUP BY ALL),
m AS (SELECT s_suppkey, string_agg(rings, ',' ORDER BY poly) AS c FROM q GROUP BY ALL)
SELECT s_suppkey, '{{"type":"Feature","properties":{{"id":' || s_suppkey || ',"name":"' || s_name || '","video":null}},"geometry":{{"type":' || CASE WHEN s_suppkey % 5 = 0 THEN '"MultiPolygon","coordinates":[' || c || ']' ELSE '"Polygon","coordinates":' || c END || '}}}}' AS feature
FROM m JOIN supplier USING (s_suppkey)""",
        "csv_layer": f"WITH {_boxes()} SELECT v.*, s_acctbal AS score FROM v JOIN supplier USING (s_suppkey)",
        "csv_ranges": f"WITH {_boxes()} SELECT v.*, s_acctbal AS score FROM v JOIN supplier USING (s_suppkey)",
        "geojson_collections": f"WITH {_boxes()} SELECT v.*, s_name FROM v JOIN supplier USING (s_suppkey)",
        "selected_layers": """WITH s AS (SELECT DISTINCT n_name AS user, 'size ' || (n_nationkey % 7 + 2) AS layer FROM nation WHERE n_regionkey = 1)
SELECT s."user", layer, '{"p_partkey":' || p_partkey || '}' AS feature FROM part JOIN s ON layer = 'size ' || p_size % 10""",
        "geojson_layer": f"WITH {_boxes()} SELECT v.*, 'segments' AS layer, s_name FROM v JOIN supplier USING (s_suppkey)",
        "boundary_layer": f"""WITH p AS (SELECT s_suppkey, 'B' || s_suppkey % 5 AS boro_name, k, {slon} + CASE WHEN k IN (1, 2) THEN 0.001::DOUBLE ELSE 0 END AS lon, {slat} + CASE WHEN k = 2 THEN 0.001::DOUBLE ELSE 0 END AS lat FROM supplier, range(4) AS t(k))
SELECT boro_name, s_suppkey, k, round({sx}, 3) AS x, round({sy}, 3) AS y FROM p""",
        "layer_files": "SELECT 'size ' || p_size % 4 AS layer, '{\"p_partkey\":' || p_partkey || '}' AS feature FROM part WHERE p_size % 4 IN (1, 3)",
        "feed_files": "SELECT c_name AS title, c_mktsegment AS description, '/blog/' || c_custkey || '/' AS link FROM customer",
        "markdown_docs": "SELECT n_name AS title, 'nobody' AS author, 'a: ' || r_name AS description, r_name || ',Land' AS tags, TIMESTAMP '2023-02-14 23:49:00' AS pub_date, false AS draft FROM nation JOIN region ON n_regionkey = r_regionkey",
        "hover_labels": """SELECT 'sidewalks' AS layer, l_orderkey AS id, l_linenumber AS n, CASE WHEN l_discount <> 0 THEN printf('Score: %.1f%%', l_discount * 100) END AS label FROM lineitem
UNION ALL SELECT 'deployments', p_partkey, NULL, CASE WHEN p_size % 3 > 0 THEN p_name END FROM part UNION ALL SELECT 'cbs', c_custkey, NULL, NULL FROM customer""",
        "visible_layers": """SELECT * FROM (SELECT 'sidewalks' AS layer, s_suppkey AS id, s_acctbal AS score, NULL::VARCHAR AS name FROM supplier
UNION ALL SELECT 'cbs', c_custkey, NULL, NULL FROM customer UNION ALL SELECT 'deployments', n_nationkey, NULL, n_name FROM nation) WHERE layer IN ('sidewalks', 'deployments')""",
        "pick_points": f"""WITH p AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey * 37 % 1000 + 0.25::DOUBLE AS x, l_suppkey * 91 % 1000 + 0.25::DOUBLE AS y FROM lineitem),
d AS (SELECT s_suppkey, (s_suppkey * 53 % 1000)::DOUBLE AS cx, (s_suppkey * 71 % 1000)::DOUBLE AS cy, CASE WHEN s_suppkey % 50 = 0 THEN 60::DOUBLE ELSE (s_suppkey % 5 + 1)::DOUBLE END AS r FROM supplier),
v AS (SELECT s_suppkey, k, cx, cy, r, cx + r * {c16} AS ax, cy + r * {s16} AS ay FROM d, range(17) AS t(k)),
e AS (SELECT s_suppkey, k, cx, cy, r, ax, ay, lead(ax) OVER w AS bx, lead(ay) OVER w AS ey FROM v WINDOW w AS (PARTITION BY s_suppkey ORDER BY k))
SELECT l_orderkey, l_linenumber, s_suppkey FROM p JOIN e ON x BETWEEN cx - r AND cx + r AND y BETWEEN cy - r AND cy + r
WHERE bx IS NOT NULL AND (ay > y) <> (ey > y) AND x < (bx - ax) * (y - ay) / (ey - ay) + ax
GROUP BY rid, l_orderkey, l_linenumber, s_suppkey HAVING count(*) % 2 = 1""",
        "pick_layers": f"""WITH p AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey * 37 % 1000 + 0.25::DOUBLE AS x, l_suppkey * 91 % 1000 + 0.25::DOUBLE AS y FROM lineitem),
d AS (SELECT s_suppkey, s_suppkey % 3 AS draw_order, (s_suppkey * 53 % 1000)::DOUBLE AS cx, (s_suppkey * 71 % 1000)::DOUBLE AS cy, CASE s_suppkey % 3 WHEN 1 THEN 30::DOUBLE ELSE 12::DOUBLE END AS r FROM supplier WHERE s_suppkey % 3 > 0),
v AS (SELECT s_suppkey, draw_order, k, cx, cy, r, cx + r * {c16} AS ax, cy + r * {s16} AS ay FROM d, range(17) AS t(k)),
e AS (SELECT *, lead(ax) OVER w AS bx, lead(ay) OVER w AS ey FROM v WINDOW w AS (PARTITION BY s_suppkey ORDER BY k)),
h AS (SELECT rid, l_orderkey, l_linenumber, draw_order, s_suppkey FROM p JOIN e ON x BETWEEN cx - r AND cx + r AND y BETWEEN cy - r AND cy + r
      WHERE bx IS NOT NULL AND (ay > y) <> (ey > y) AND x < (bx - ax) * (y - ay) / (ey - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT l_orderkey, l_linenumber, max(draw_order) AS draw_order, arg_max(s_suppkey, draw_order * 1000000000 + s_suppkey) AS s_suppkey FROM h GROUP BY 1, 2""",
        # between 2 k and 2 k + 1 the border falls from the customer's height to 0
        "pick_large": """WITH o AS (SELECT o_orderkey, o_orderkey * 71 % 1600 - 600.5::DOUBLE AS x, o_custkey * 379 % 1000 AS h FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT o_orderkey, 1 AS region FROM o WHERE x > -500 AND x < h * 0.5::DOUBLE""",
        "simplify_invariants": "SELECT l_orderkey, (count(*) + 1)::INT AS n_before, true AS is_closed, true AS is_subset, true AS is_ring, true AS within FROM lineitem GROUP BY 1 HAVING count(*) >= 3",
        "feed_dated": "SELECT o_orderpriority AS title, o_orderdate AS pub_date, o_orderstatus AS description, '/blog/' || o_orderkey || '/' AS link FROM orders",
        "doc_ids": "SELECT doc_id, 'my post+' || doc_id || 'é' AS id FROM documents",
        "outline_markdown": "SELECT doc_id, i AS pos, CASE i WHEN 0 THEN 1 ELSE 3 END AS depth, CASE i WHEN 0 THEN source || ' Part' ELSE lang || '  two' END AS text, CASE i WHEN 0 THEN lower(source) || '-part' ELSE lower(lang) || '-two' END AS slug FROM documents, range(2) AS t(i) WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL",
        "percentile_bin_shares": "SELECT i::INT AS bin, true AS even FROM range(11) AS t(i)",
        "composite_score": f"""WITH {_OBS}, j AS (SELECT segment_id, CASE WHEN i % 6 <> 0 THEN 1 + i % 4 END AS w, CASE WHEN code <= top THEN code / top::DOUBLE END AS v FROM obs JOIN c USING (i))
SELECT segment_id, round(sum(w * v) / sum(w) FILTER (v IS NOT NULL), 9) AS composite, count(*) FILTER (w IS NOT NULL AND v IS NOT NULL) AS n_used, count(*) FILTER (w IS NULL OR v IS NULL) AS n_missing FROM j GROUP BY segment_id""",
        "scale_levels": f"WITH {_OBS}, l(indicator, code, label) AS (VALUES {_LEVEL_ROWS}) SELECT indicator, code, label, count(*) AS n FROM obs JOIN c USING (i) JOIN l USING (indicator, code) GROUP BY ALL",
        "weight_share": "WITH w AS (SELECT p_brand, sum(p_size) AS weight FROM part GROUP BY 1) SELECT sum(weight)::BIGINT AS top, sum(weight) / (SELECT sum(weight) FROM w)::DOUBLE AS share FROM (SELECT weight FROM w ORDER BY weight DESC LIMIT 6)",
        "extreme_ratio": "SELECT l_returnflag, max(l_extendedprice) / min(l_extendedprice) AS ratio FROM lineitem GROUP BY 1",
        "doc_validate": """WITH d AS (SELECT doc_id AS id, quality = 1 AS t, toxic IS NOT NULL AS a, coalesce(toxic = 1, false) AS draft FROM documents LEFT JOIN labels USING (doc_id))
SELECT id, draft, concat_ws(',', CASE WHEN t THEN NULL ELSE 'title' END, CASE WHEN a THEN NULL ELSE 'author' END) AS errors, coalesce(t, false) AND a AS valid FROM d""",
        "doc_dates": "SELECT o_orderkey, date_trunc('minute', o_orderdate) AS pub_date FROM orders",
        "tag_list": f"WITH {tags} SELECT DISTINCT tag FROM t",
        "tag_index": f"WITH {tags} SELECT tag, count(*) AS n_docs FROM t GROUP BY tag",
        "tag_posts": f"WITH {tags} SELECT tag, id FROM t",
        "tag_page": "SELECT p_partkey AS id FROM part WHERE lower(p_brand) = 'brand#12' OR lower(p_type) = 'brand#12'",
        "recent_docs": "SELECT doc_id AS id, source FROM documents ORDER BY id DESC LIMIT 6",
        "reverse_docs": "SELECT doc_id AS id, source FROM documents ORDER BY id DESC",
        "feed_items": "SELECT text AS title, lang AS description, '/blog/' || doc_id || '/' AS link FROM documents",
        "doc_pages": "SELECT doc_id AS id, text AS title, lang AS description FROM documents",
        "outline": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)', 1) AS hs FROM pages),
u AS (SELECT page_id, unnest(hs) AS x, generate_subscripts(hs, 1) - 1 AS pos FROM h)
SELECT page_id, pos, substr(x, 3, 1)::INT AS depth, trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ') AS text FROM u""",
        "embed_urls": f"SELECT n_nationkey, 'https://www.youtube.com/embed/' || lower(n_name) || '?start=' || s || '&end=' || e AS url FROM nation JOIN (VALUES {starts}) AS v(o, s, e) ON n_nationkey % 4 = o",
        "selection_toggle": _TOGGLE + "SELECT event_id, user_id, item, active, CASE WHEN item = active THEN 'green' ELSE 'blue' END AS colour FROM c",
        "selection_toggle_stream": _TOGGLE + "SELECT event_id, user_id, item, active FROM c",
        "selection_event_time": _TOGGLE + "SELECT event_id, user_id, item, active FROM c WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) - 2 * 86400000 FROM events)",
        "selection_changes": f"WITH {_CLICKS}, a AS (SELECT *, lag(item) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM k) SELECT event_id, user_id, item FROM a WHERE item IS DISTINCT FROM before",
        "lookup_sites": "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
        "known_sites": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')",
        "line_ordinal": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal FROM lineitem",
    }
