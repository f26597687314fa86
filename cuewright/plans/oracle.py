"""SQL that says the same as the registered queries, each in its own way, for DuckDB."""

from __future__ import annotations

from .queries import CODES

MARKS = "。！？!?…"
CLAUSES = "，、；：,;:。！？!?…"
CLOSING = "\"''”’）】》」』"


def _cut(source: str) -> str:
    """Sentence cues of a relation (source_id, text)."""
    return f"""
parts AS (
  SELECT source_id, generate_subscripts(p, 1) AS index, unnest(p) AS text FROM (
    SELECT source_id, list_filter(list_transform(string_split_regex(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([{MARKS}])', '\\1' || chr(1), 'g'), '[\\x01\\n]'),
      lambda x: trim(x, ' ' || chr(9) || chr(12288))), lambda x: x <> '') AS p FROM {source} WHERE text IS NOT NULL)),
timed AS (SELECT *, round_even(greatest(1.2::DOUBLE, len(text) / 6.0::DOUBLE) * 1000, 0)::BIGINT AS dur_ms FROM parts),
cues AS (
  SELECT source_id, index::INT AS index, index::INT AS source_block, coalesce(sum(dur_ms + 150) OVER o, 0)::BIGINT AS start_ms, coalesce(sum(dur_ms + 150) OVER o, 0)::BIGINT + dur_ms AS end_ms, dur_ms, text, true AS estimated
  FROM timed WINDOW o AS (PARTITION BY source_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


DOCS = "docs AS (SELECT doc_id AS source_id, text FROM documents)," + _cut("docs")
TURNS = "turns AS (SELECT conv_id AS source_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)," + _cut("turns")
EVENTS = """
ev AS (
  SELECT user_id AS source_id, event_id, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000)::BIGINT AS start_ms,
    greatest(1.0, round_even(value * 40, 0))::BIGINT AS dur_ms, event_type || list_extract(['.', '!', ','], event_id % 3 + 1) AS text FROM events),
cues AS (
  SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, start_ms + dur_ms, event_id)::INT AS index,
    row_number() OVER (PARTITION BY source_id ORDER BY event_id)::INT AS source_block, start_ms, start_ms + dur_ms AS end_ms, dur_ms, text, false AS estimated FROM ev)"""


def _labelled(target: int, least: int, most: int, gap: int) -> str:
    """Scene labels of the relation cues, one step for each cue."""
    sentence, late = int(target * 0.62), int(target * 1.18)
    reason = f"""CASE WHEN c.end_ms - {{b}} >= {most} THEN 'max-duration' WHEN c.end_ms - {{b}} < {least} THEN NULL WHEN c.wait >= {gap} THEN 'subtitle-gap'
      WHEN c.sentence AND c.end_ms - {{b}} >= {sentence} THEN 'sentence-boundary' WHEN c.end_ms - {{b}} >= {target} AND (c.clause OR c.end_ms - {{b}} >= {late}) THEN 'target-duration' END"""
    anew = f"(s.reason IS NOT NULL OR c.end_ms - s.b > {most})"
    begin = f"CASE WHEN {anew} THEN c.start_ms ELSE s.b END"
    return f"""
ready AS MATERIALIZED (
  SELECT *, greatest(0, coalesce(lead(start_ms) OVER (PARTITION BY source_id ORDER BY index) - end_ms, 0)) AS wait,
    regexp_matches(text, '[{MARKS}]+[{CLOSING}]*$') AS sentence, regexp_matches(text, '[{CLAUSES}]+[{CLOSING}]*$') AS clause FROM cues),
seg AS (
  SELECT c.source_id, c.index, 1 AS scene_no, c.start_ms AS b, false AS overrun, {reason.format(b="c.start_ms")} AS reason FROM ready c WHERE c.index = 1
  UNION ALL
  SELECT c.source_id, c.index, s.scene_no + {anew}::INT, {begin}, s.reason IS NULL AND {anew}, {reason.format(b="(" + begin + ")")}
  FROM seg s JOIN ready c ON c.source_id = s.source_id AND c.index = s.index + 1)"""


def _rolled(target: int, least: int, most: int, gap: int) -> str:
    """Scenes with the short tail merged, as the relation scenes."""
    return (
        _labelled(target, least, most, gap)
        + f""",
raw AS (
  SELECT source_id, scene_no, arg_min(start_ms, index) AS start_ms, arg_max(end_ms, index) AS end_ms, count(*) AS n,
    arg_max(coalesce(reason, ''), index) AS reason, bool_or(overrun) AS overrun FROM seg JOIN cues USING (source_id, index) GROUP BY ALL),
why AS (
  SELECT *, CASE WHEN reason <> '' THEN reason WHEN lead(overrun) OVER o THEN 'max-before-next-cue' ELSE 'end-of-input' END AS break_reason,
    lead(scene_no) OVER o IS NULL AND scene_no > 1 AND end_ms - start_ms < {least} AND end_ms - lag(start_ms) OVER o <= {int(most * 1.15)} AS tail
  FROM raw WINDOW o AS (PARTITION BY source_id ORDER BY scene_no)),
placed AS (
  SELECT source_id, index, start_ms, end_ms, text, CASE WHEN tail THEN scene_no - 1 ELSE scene_no END AS scene_index,
    CASE WHEN tail THEN 'merged-short-tail' ELSE break_reason END AS break_reason
  FROM seg JOIN cues USING (source_id, index) JOIN (SELECT source_id, scene_no, tail, break_reason FROM why) USING (source_id, scene_no)),
scenes AS (
  SELECT source_id, scene_index::INT AS scene_index, arg_min(start_ms, index) AS start_ms, arg_max(end_ms, index) AS end_ms, min(index) AS first_cue, max(index) AS last_cue,
    arg_max(break_reason, index) AS break_reason, printf('scene-%02d', scene_index) AS scene_id, arg_max(end_ms, index) - arg_min(start_ms, index) AS scene_duration_ms,
    string_agg(index::VARCHAR, ',' ORDER BY index) AS cue_ids, string_agg(text, ' ' ORDER BY index) AS text FROM placed GROUP BY source_id, scene_index)"""
    )


ROLLED = "SELECT *, greatest(2, least(7, ceil(len(text) / 34.0)))::INT AS estimated_element_count, scene_duration_ms > {most} AS over_max FROM scenes"
PLAIN, SHORT = (8000, 1200, 20000, 1200), (20000, 6000, 40000, 12000)

CAPTIONS = f"""{EVENTS},
cap AS (SELECT *, (source_id + source_block) % 23 AS kind, start_ms % 300000000 AS s, start_ms % 300000000 + dur_ms AS e FROM cues),
good AS (
  SELECT source_id, source_block, s AS start_ms, e AS end_ms, dur_ms, text || CASE WHEN kind = 6 THEN ' again' ELSE '' END AS text FROM cap WHERE kind NOT IN (1, 2, 3, 4))"""


def _cues_of(extra: int) -> str:
    return f"""WITH {CAPTIONS}
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, source_block)::INT AS index, source_block + {extra} AS source_block, start_ms, end_ms, dur_ms, text, false AS estimated FROM good"""


ELEMENTS = """
li AS (
  SELECT *, l_partkey AS p, l_suppkey AS s, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS position FROM lineitem),
el AS (
  SELECT l_orderkey AS scene_id, position, 'e' || (p % 50) AS id, l_linenumber AS seq, p % 30 AS x, s % 16 AS y, q % 9 + 1 AS w, (p + s) % 6 + 1 AS h,
    CASE WHEN p % 37 = 0 THEN -1 ELSE (l_linenumber - 1) * 400 + p % 300 END AS start_ms, CASE WHEN p % 41 = 0 THEN 0 ELSE q * 20 + 100 END AS dur,
    list_extract(['left_to_right', 'right_to_left', 'top_to_bottom', 'bottom_to_top', 'radial', 'auto'], p % 6 + 1) AS direction,
    list_extract(['subtract-later', 'explicit', 'none'], s % 3 + 1) AS policy, CASE WHEN l_discount > 0.005 THEN l_returnflag END AS subtitle,
    CASE WHEN l_tax > 0.005 THEN l_linestatus END AS role, p % 3 AS pad,
    CASE WHEN p % 5 = 0 THEN [{'x': p % 30 + 1, 'y': s % 16, 'w': 2, 'h': 2}, {'x': p % 30 + 4, 'y': s % 14 + 1, 'w': q % 4 + 1, 'h': 3}] ELSE [] END AS protected, CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE 32 END AS cw, CASE WHEN l_orderkey % 89 = 0 THEN 0 ELSE 3000 END AS sd FROM li),
e AS (
  SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY seq, position) - 1 AS vr, row_number() OVER (PARTITION BY scene_id ORDER BY seq, start_ms, position) - 1 AS rank,
    start_ms >= 0 AND dur > 0 AS sound, start_ms + dur AS end_ms, cw > 0 AND x + w <= 32 AND y + h <= 18 AS fits, cw > 0 AS canvas_ok FROM el)"""

#: The validator's masks cell by cell: own cells, less later ones of elements that fit, less protected ones that fit.
JUDGED = """
own AS (SELECT scene_id, vr, id, policy, sound, protected, cx, cy FROM e, range(32) a(cx), range(18) b(cy) WHERE fits AND cx >= x AND cx < x + w AND cy >= y AND cy < y + h),
top AS (SELECT scene_id, cx, cy, max(vr) AS m FROM own GROUP BY ALL),
judged AS (
  SELECT scene_id, vr, id, count(*) AS area, count(*) FILTER (
    NOT (policy = 'subtract-later' AND m > vr)
    AND NOT (policy <> 'none' AND len(list_filter(protected, lambda r: r.x + r.w <= 32 AND r.y + r.h <= 18 AND cx >= r.x AND cx < r.x + r.w AND cy >= r.y AND cy < r.y + r.h)) > 0)) AS rest
  FROM own JOIN top USING (scene_id, cx, cy) WHERE sound GROUP BY ALL)"""

ISSUES = f"""
{ELEMENTS}, {JUDGED},
sc AS (
  SELECT scene_id, count(*) AS n, list_sort(list(seq)) AS seqs, coalesce(max(end_ms) FILTER (sound), 0) AS last_end, max(cw) AS cw, max(sd) AS sd FROM e GROUP BY scene_id),
nx AS (SELECT *, lead(start_ms) OVER (PARTITION BY scene_id ORDER BY start_ms, end_ms, id, vr) AS ns, lead(id) OVER (PARTITION BY scene_id ORDER BY start_ms, end_ms, id, vr) AS nid FROM e WHERE sound),
dup AS (SELECT scene_id, string_agg(id, ', ' ORDER BY id) AS ids FROM (SELECT scene_id, id FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY scene_id),
issues AS (
  SELECT scene_id, 'error' AS level, 'duplicate-id' AS code, NULL AS element_id, ids AS detail FROM dup
  UNION ALL SELECT scene_id, 'error', 'sequence-gap', NULL, NULL FROM sc WHERE seqs <> range(1, n + 1)
  UNION ALL SELECT scene_id, 'error', 'insufficient-final-hold', NULL, (sd - last_end)::VARCHAR FROM sc WHERE sd - last_end < 700
  UNION ALL SELECT scene_id, 'error', 'invalid-canvas', NULL, NULL FROM sc WHERE cw <= 0
  UNION ALL SELECT scene_id, 'error', 'region-out-of-bounds', id, NULL FROM e WHERE canvas_ok AND NOT fits
  UNION ALL SELECT scene_id, 'error', 'invalid-start', id, NULL FROM e WHERE start_ms < 0
  UNION ALL SELECT scene_id, 'error', 'invalid-duration', id, NULL FROM e WHERE start_ms >= 0 AND dur <= 0
  UNION ALL SELECT scene_id, 'error', 'element-exceeds-scene', id, end_ms::VARCHAR FROM e WHERE sound AND end_ms > sd
  UNION ALL SELECT scene_id, 'warning', 'missing-subtitle', id, NULL FROM e WHERE sound AND subtitle IS NULL
  UNION ALL SELECT scene_id, 'warning', 'missing-narrative-role', id, NULL FROM e WHERE sound AND role IS NULL
  UNION ALL SELECT scene_id, 'error', 'protected-region-out-of-bounds', id, NULL FROM (SELECT scene_id, id, canvas_ok, unnest(protected) AS r FROM e WHERE sound) WHERE canvas_ok AND (r.x + r.w > 32 OR r.y + r.h > 18)
  UNION ALL SELECT scene_id, 'warning', 'over-masked', id, round_even((1 - rest / greatest(1, area)) * 100, 0)::INT || '%' FROM judged WHERE 1 - rest / greatest(1, area) >= 0.8
  UNION ALL SELECT scene_id, 'error', 'empty-mask', id, NULL FROM judged WHERE rest = 0
  UNION ALL SELECT scene_id, 'warning', 'timeline-overlap', NULL, id || '/' || nid || ' ' || (end_ms - ns) FROM nx WHERE ns < end_ms)"""

#: Frames one element after another.
FRAMES = f"""
{ELEMENTS},
t AS (SELECT *, greatest(1, round_even(start_ms * 15.0 / 1000, 0))::BIGINT AS sf, greatest(2, round_even(dur * 15.0 / 1000, 0))::BIGINT AS total FROM e),
u AS (SELECT *, greatest(1, round_even(total * 2.0 / 3, 0))::BIGINT AS ink FROM t),
v AS MATERIALIZED (SELECT *, greatest(1, total - ink)::BIGINT AS color FROM u),
fr AS (
  SELECT scene_id, rank, id, sf, ink, color, greatest(1, sf) AS first, greatest(1, sf) + ink + color AS done, 1 > sf + 1 AS late FROM v WHERE rank = 0
  UNION ALL
  SELECT v.scene_id, v.rank, v.id, v.sf, v.ink, v.color, greatest(fr.done, v.sf), greatest(fr.done, v.sf) + v.ink + v.color, fr.done > v.sf + 1
  FROM fr JOIN v ON v.scene_id = fr.scene_id AND v.rank = fr.rank + 1),
sf AS (SELECT scene_id, max(done) AS written, greatest(45, max(done) + 10)::BIGINT AS total FROM fr GROUP BY scene_id)"""

#: Frames, hold and finish of scenes, with `fade` frames between them.
def _ended(fade: int) -> str:
    return f"sn AS (SELECT scene_id, max(done) AS written, greatest(45, max(done) + {fade} + 10)::BIGINT AS total, count(*) AS n FROM fr GROUP BY scene_id)"


#: Paths by hand, each with a line across the region behind it.
HANDS = """
hl AS (
  SELECT scene_id, rank, dur, position % 4 AS way, x, y, w, h, CASE position % 4 WHEN 0 THEN [x, x + w, x + w] WHEN 1 THEN [x, x + w, x + w, x] ELSE [x + w, x] END AS xs,
    CASE position % 4 WHEN 0 THEN [y, y, y + h] WHEN 1 THEN [y, y, y + h, y + h] ELSE [y, y + h] END AS ys FROM e WHERE position % 4 < 3),
pl AS (SELECT scene_id, rank, 0 AS part, xs, ys FROM hl UNION ALL SELECT scene_id, rank, 1, [x, x + w], [y + h, y] FROM hl),
sg AS (SELECT *, unnest(range(1, len(xs))) AS i FROM pl),
sl AS (SELECT *, sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2) AS n FROM sg),
so AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scene_id, rank, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sl),
sk3 AS (SELECT *, unnest(range(floor(pos / 3 + 1e-9)::BIGINT + 1, floor((pos + n) / 3 + 1e-9)::BIGINT + 1)) AS k FROM so),
pp AS (
  SELECT scene_id, rank, part, 0 AS k, xs[1]::INT AS px, ys[1]::INT AS py FROM pl
  UNION ALL SELECT scene_id, rank, part, k, round_even(xs[i] + (xs[i + 1] - xs[i]) * (k * 3 - pos) / n, 0)::INT, round_even(ys[i] + (ys[i + 1] - ys[i]) * (k * 3 - pos) / n, 0)::INT FROM sk3),
pe AS (
  SELECT * FROM pp
  UNION ALL SELECT scene_id, rank, part, 1000000, xs[-1]::INT, ys[-1]::INT FROM pl
    JOIN (SELECT scene_id, rank, part, arg_max(px, k) AS lx, arg_max(py, k) AS ly FROM pp GROUP BY ALL) USING (scene_id, rank, part) WHERE lx <> xs[-1] OR ly <> ys[-1]),
hp AS (
  SELECT scene_id, rank, part, px, py, (row_number() OVER (PARTITION BY scene_id, rank ORDER BY part, k) - 1)::INT AS i, count(*) OVER (PARTITION BY scene_id, rank) AS np,
    (count(*) FILTER (part = 0) OVER (PARTITION BY scene_id, rank))::INT AS lift FROM pe)"""

#: The step in which each point of a path is reached.
REACHED = """
tm AS (SELECT DISTINCT hp.scene_id, hp.rank, np, greatest(1, round_even(dur * 15.0 / 1000, 0))::INT AS nf FROM hp JOIN hl USING (scene_id, rank)),
ks AS (SELECT *, unnest(range(nf)) AS k FROM tm),
tg AS (SELECT *, CASE WHEN nf = 1 THEN np - 1 ELSE round_even(k * (np - 1)::DOUBLE / (nf - 1), 0) END AS target FROM ks),
fs AS (SELECT hp.*, nf, (SELECT min(k) FROM tg WHERE tg.scene_id = hp.scene_id AND tg.rank = hp.rank AND target >= i)::INT AS step FROM hp JOIN tm USING (scene_id, rank))"""


#: Pixels of the embeddings as images of 8 x 8, and their backgrounds by the corners' medians.
PIXELS = """
p AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
q AS (SELECT vec_id, i % 8 AS sx, i // 8 AS sy, greatest(0, least(255, floor(v * 200.0::DOUBLE + 128)))::DOUBLE AS v FROM p)"""
GROUND = "g AS (SELECT vec_id, floor(median(v)) AS bg FROM q WHERE sx NOT BETWEEN 3 AND 4 AND sy NOT BETWEEN 3 AND 4 GROUP BY vec_id)"

#: Squares of EDGE cells by the least square that they are connected to.
LABELLED = """
sq AS MATERIALIZED (SELECT DISTINCT scene_id, rank, cx // EDGE AS col, cy // EDGE AS row, (cy // EDGE) * 100 + cx // EDGE AS s FROM cel WHERE kept),
nb AS MATERIALIZED (SELECT a.scene_id, a.rank, a.s, b.s AS t FROM sq a JOIN sq b ON a.scene_id = b.scene_id AND a.rank = b.rank AND abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1 AND a.s <> b.s),
rch AS (
  SELECT scene_id, rank, s, s AS other FROM sq
  UNION SELECT nb.scene_id, nb.rank, nb.t, r.other FROM rch r JOIN nb ON nb.scene_id = r.scene_id AND nb.rank = r.rank AND nb.s = r.s WHERE r.other < nb.t),
lb AS (SELECT sq.*, label FROM sq JOIN (SELECT scene_id, rank, s, min(other) AS label FROM rch GROUP BY ALL) USING (scene_id, rank, s))"""

#: Runs of cells along a row, those of neighbouring rows that touch, and 2 x 2 blocks by what they hold.
RUNS = """
kc AS MATERIALIZED (SELECT scene_id, rank, cx, cy FROM cel WHERE kept),
rk AS (SELECT *, cx - row_number() OVER (PARTITION BY scene_id, rank, cy ORDER BY cx) AS g FROM kc),
rn AS MATERIALIZED (SELECT scene_id, rank, cy, min(cx) AS a, max(cx) AS b, cy * 100 + min(cx) AS node FROM rk GROUP BY scene_id, rank, cy, g),
nn AS MATERIALIZED (SELECT p.scene_id, p.rank, p.node, q.node AS t FROM rn p JOIN rn q ON p.scene_id = q.scene_id AND p.rank = q.rank AND abs(p.cy - q.cy) = 1 AND p.a <= q.b + 1 AND q.a <= p.b + 1),
rc1 AS (
  SELECT scene_id, rank, node, node AS other FROM rn
  UNION SELECT nn.scene_id, nn.rank, nn.t, r.other FROM rc1 r JOIN nn ON nn.scene_id = r.scene_id AND nn.rank = r.rank AND nn.node = r.node),
qx AS (
  SELECT scene_id, rank, cx + i AS qx, cy + j AS qy, count(*) AS n, count(*) FILTER (i = j) IN (0, 2) AS diagonal FROM kc, range(2) a(i), range(2) b(j) GROUP BY ALL)"""


def _shown(strokes: str) -> str:
    """Cells by the first step of a stroke (scene_id, rank, step, ax, ay, bx, b_y, reach) near them, each compared with all strokes of its element."""
    return f"""st AS ({strokes}),
nr AS (
  SELECT c.scene_id, c.rank, cx, cy, step, reach, ax - cx AS ux, ay - cy AS uy, bx - ax AS vx, b_y - ay AS vy FROM cel c JOIN st ON c.scene_id = st.scene_id AND c.rank = st.rank WHERE kept),
nd AS (SELECT *, CASE WHEN vx = 0 AND vy = 0 THEN 0 ELSE least(1.0, greatest(0.0, -(ux * vx + uy * vy) / (vx * vx + vy * vy)::DOUBLE)) END AS t FROM nr),
hit AS (SELECT scene_id, rank, cx, cy, min(step) AS step FROM nd WHERE (ux + vx * t) ** 2 + (uy + vy * t) ** 2 <= reach * reach + 1e-9 GROUP BY ALL)
SELECT c.scene_id, c.rank, c.cx::INT AS x, c.cy::INT AS y, coalesce(hit.step, tm.nf)::INT AS step
FROM cel c LEFT JOIN hit ON c.scene_id = hit.scene_id AND c.rank = hit.rank AND c.cx = hit.cx AND c.cy = hit.cy LEFT JOIN tm ON c.scene_id = tm.scene_id AND c.rank = tm.rank WHERE kept"""


def _whole(fade: int) -> str:
    """Every frame of a scene."""
    return f"""WITH RECURSIVE {FRAMES}, {_ended(fade)}, {HANDS}, {WIPE.replace("steps AS (SELECT k, round(0.5 - 0.5 * cos(pi() * k / 5.0), 12) AS p FROM range(6) r(k)),", "")},
ru AS (
  SELECT scene_id, 'blank' AS stage, 0 AS f, 1 AS c, NULL AS rank, NULL AS id, 0 AS dn FROM sn
  UNION ALL SELECT scene_id, 'hold', coalesce(lag(done) OVER o, 1), first - coalesce(lag(done) OVER o, 1), NULL, NULL, rank FROM fr WINDOW o AS (PARTITION BY scene_id ORDER BY rank)
  UNION ALL SELECT scene_id, 'ink', first, ink, rank, id, rank FROM fr
  UNION ALL SELECT scene_id, 'color', first + ink, color, rank, id, rank FROM fr
  UNION ALL SELECT scene_id, 'fade', written, {fade}, NULL, NULL, n FROM sn
  UNION ALL SELECT scene_id, 'tail', written + {fade}, total - written - {fade}, NULL, NULL, n FROM sn),
fx AS (SELECT *, unnest(range(c)) AS k FROM ru),
fp AS (SELECT *, CASE WHEN stage IN ('ink', 'color', 'fade') THEN k END AS step, CASE WHEN stage NOT IN ('ink', 'color', 'fade') THEN NULL WHEN c = 1 THEN 1.0::DOUBLE ELSE k / (c - 1) END::DOUBLE AS progress FROM fx),
pt AS (SELECT fp.*, px, py FROM fp LEFT JOIN hp ON fp.stage = 'ink' AND hp.scene_id = fp.scene_id AND hp.rank = fp.rank AND hp.i = CASE WHEN c = 1 THEN np - 1 ELSE round_even(k * (np - 1)::DOUBLE / (c - 1), 0) END),
wu AS (SELECT pt.*, d, x0, y0, x1, y1, rw, rh, 0.5 - 0.5 * cos(pi() * progress) AS ep, 0.5 + 0.35 * sin(progress * 8 * pi()) AS wave FROM pt LEFT JOIN rd ON stage = 'color' AND rd.scene_id = pt.scene_id AND rd.rank = pt.rank),
wv AS (SELECT *, round_even(rw * ep, 0)::INT AS al, round_even(rh * ep, 0)::INT AS dw, sqrt(rw * rw / 4.0 + rh * rh / 4.0) * ep AS ra, progress * 5 * pi() AS an, x0 + trunc(wave * rw)::INT AS swx, y0 + trunc(wave * rh)::INT AS swy FROM wu)
SELECT scene_id, (f + k)::BIGINT AS frame, stage, rank, id AS element_id, step, progress, dn::BIGINT AS done,
  CASE WHEN stage = 'color' THEN greatest(0, least(31, CASE d WHEN 'right_to_left' THEN greatest(x0, least(x1 - 1, x1 - al)) WHEN 'top_to_bottom' THEN swx WHEN 'bottom_to_top' THEN swx WHEN 'radial' THEN trunc(x0 + rw / 2.0 + cos(an) * ra)::INT ELSE least(x1 - 1, x0 + al) END)) ELSE px END::INT AS target_x,
  CASE WHEN stage = 'color' THEN greatest(0, least(17, CASE d WHEN 'top_to_bottom' THEN least(y1 - 1, y0 + dw) WHEN 'bottom_to_top' THEN greatest(y0, y1 - dw) WHEN 'radial' THEN trunc(y0 + rh / 2.0 + sin(an) * ra)::INT ELSE swy END)) ELSE py END::INT AS target_y FROM wv"""


#: The renderer's masks cell by cell.
CELLS = f"""
{ELEMENTS},
own AS (
  SELECT scene_id, rank, policy, protected, direction, x, y, w, h, cx, cy FROM e, range(32) a(cx), range(18) b(cy)
  WHERE cx >= x - pad AND cx < least(32, x + w) + CASE WHEN x + w + pad <= 32 THEN pad ELSE greatest(0, 32 - least(32, x + w)) END AND cy >= y - pad AND cy < least(18, y + h + pad)),
cov AS (SELECT scene_id, cx, cy, max(rank) AS m FROM own WHERE cx >= x AND cx < x + w AND cy >= y AND cy < y + h GROUP BY ALL),
cel AS (
  SELECT own.*, NOT (policy = 'subtract-later' AND coalesce(m > rank, false))
    AND NOT (policy <> 'none' AND len(list_filter(protected, lambda r: cx >= r.x AND cx < r.x + r.w AND cy >= r.y AND cy < r.y + r.h)) > 0) AS kept
  FROM own LEFT JOIN cov USING (scene_id, cx, cy))"""

#: Masks on a canvas of 20 x 10 cells: 20 / 32 of the width, 10 / 18 of the height, paddings by the mean of both.
SCALED = f"""
{ELEMENTS},
z AS (SELECT *, round_even(pad * (20 / 32.0::DOUBLE + 10 / 18.0::DOUBLE) / 2, 0)::INT AS pd FROM e),
o AS (
  SELECT scene_id, rank, policy, protected, round_even(x * 20 / 32.0::DOUBLE, 0)::INT AS a0, round_even((x + w) * 20 / 32.0::DOUBLE, 0)::INT AS a1,
    round_even(y * 10 / 18.0::DOUBLE, 0)::INT AS b0, round_even((y + h) * 10 / 18.0::DOUBLE, 0)::INT AS b1, pd FROM z),
ow AS (SELECT *, cx, cy FROM o, range(20) a(cx), range(10) b(cy) WHERE cx >= a0 - pd AND cx < a1 + pd AND cy >= b0 - pd AND cy < b1 + pd),
cv AS (SELECT scene_id, cx, cy, max(rank) AS m FROM ow WHERE cx >= a0 AND cx < a1 AND cy >= b0 AND cy < b1 GROUP BY ALL),
ce AS (
  SELECT ow.*, NOT (policy = 'subtract-later' AND coalesce(m > rank, false))
    AND NOT (policy <> 'none' AND len(list_filter(protected, lambda r: cx >= round_even(r.x * 20 / 32.0::DOUBLE, 0) AND cx < round_even((r.x + r.w) * 20 / 32.0::DOUBLE, 0)
      AND cy >= round_even(r.y * 10 / 18.0::DOUBLE, 0) AND cy < round_even((r.y + r.h) * 10 / 18.0::DOUBLE, 0))) > 0) AS kept FROM ow LEFT JOIN cv USING (scene_id, cx, cy))"""

#: Edges of the wiped rectangles, and how far each of six steps has come.
WIPE = """
steps AS (SELECT k, round(0.5 - 0.5 * cos(pi() * k / 5.0), 12) AS p FROM range(6) r(k)),
rc AS (
  SELECT scene_id, rank, least(32, x) AS x0, least(18, y) AS y0, least(32, x + w) AS x1, least(18, y + h) AS y1,
    greatest(1, least(32, x + w) - x) AS rw, greatest(1, least(18, y + h) - y) AS rh, direction FROM e),
rd AS (SELECT *, CASE WHEN direction = 'auto' THEN CASE WHEN rw >= rh THEN 'left_to_right' ELSE 'top_to_bottom' END ELSE direction END AS d FROM rc)"""

OUTLINES = f"""
{ELEMENTS},
q4 AS (
  SELECT scene_id, position % 2 AS char_pos, position AS contour_pos, start_ms % 4 = 0 AS turned,
    [x * 10.0, (x + w) * 10.0, (x + w) * 10.0, (x + w / 3.0::DOUBLE) * 10.0]::DOUBLE[] AS px, [y * 10.0, y * 10.0, (y + h) * 10.0, (y + h) * 10.0]::DOUBLE[] AS py FROM e),
ol AS (SELECT scene_id, char_pos, contour_pos, CASE WHEN turned THEN list_reverse(px) ELSE px END AS px, CASE WHEN turned THEN list_reverse(py) ELSE py END AS py FROM q4),
ar AS (
  SELECT *, (px[1] * py[2] - px[2] * py[1] + px[2] * py[3] - px[3] * py[2] + px[3] * py[4] - px[4] * py[3] + px[4] * py[1] - px[1] * py[4]) / 2 AS area FROM ol),
ik AS (
  SELECT *, area * sign(first_value(area) OVER (PARTITION BY scene_id, char_pos ORDER BY abs(area) DESC, contour_pos)) > 0 AS is_ink FROM ar WHERE abs(area) >= 12)"""

LISTS = "s AS (SELECT user_id AS scene_id, event_id, event_type FROM events)"

#: Skeletons by repeated erosion with a cross: what an opening of each eroded set takes away.
LEVELS = 16


def _eroded() -> str:
    near = "(cx = 0 OR EXISTS (SELECT 1 FROM {b} n WHERE {k} AND n.cx = a.cx - 1 AND n.cy = a.cy)) AND (cx = 31 OR EXISTS (SELECT 1 FROM {b} n WHERE {k} AND n.cx = a.cx + 1 AND n.cy = a.cy)) AND (cy = 0 OR EXISTS (SELECT 1 FROM {b} n WHERE {k} AND n.cx = a.cx AND n.cy = a.cy - 1)) AND (cy = 17 OR EXISTS (SELECT 1 FROM {b} n WHERE {k} AND n.cx = a.cx AND n.cy = a.cy + 1))"
    key = "n.scene_id = a.scene_id AND n.rank = a.rank"
    out = ["e0 AS MATERIALIZED (SELECT scene_id, rank, cx, cy FROM cel WHERE kept)"]
    for k in range(1, LEVELS):
        out.append(f"e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} a WHERE {near.format(b=f'e{k - 1}', k=key)})")
    # a cell is in an opened set if it or a neighbour is in the next eroded one
    parts = [f"SELECT * FROM e{k} a WHERE NOT EXISTS (SELECT 1 FROM e{k + 1} n WHERE {key} AND abs(n.cx - a.cx) + abs(n.cy - a.cy) <= 1)" for k in range(LEVELS - 1)]
    return ",\n".join(out) + ",\nsk AS (" + " UNION ".join(parts) + ")"


ORACLE = {
    "plain_cues": f"WITH {DOCS} SELECT * FROM cues",
    "scene_labels": f"WITH RECURSIVE {DOCS},{_labelled(*PLAIN)} SELECT source_id, index, scene_no, reason FROM seg",
    "scene_rollup": f"WITH RECURSIVE {DOCS},{_rolled(*PLAIN)} {ROLLED.format(most=PLAIN[2])}",
    "event_scenes": f"WITH RECURSIVE {EVENTS},{_rolled(*SHORT)} {ROLLED.format(most=SHORT[2])}",
    "conversation_scenes": f"WITH RECURSIVE {TURNS},{_rolled(*PLAIN)} {ROLLED.format(most=PLAIN[2])}",
    "break_reasons": f"WITH RECURSIVE {EVENTS},{_rolled(*SHORT)} SELECT break_reason, count(*) AS scenes FROM scenes GROUP BY 1",
    "source_summary": f"WITH RECURSIVE {DOCS},{_rolled(*PLAIN)} SELECT source_id, (SELECT count(*) FROM cues c WHERE c.source_id = s.source_id) AS cue_count, (SELECT max(end_ms) - min(start_ms) FROM cues c WHERE c.source_id = s.source_id) AS total_ms, count(*) AS scene_count FROM scenes s GROUP BY source_id",
    "project_scenes": f"WITH RECURSIVE {EVENTS},{_rolled(*SHORT)} SELECT source_id, scene_id, start_ms, end_ms, scene_duration_ms AS duration_ms, first_cue || '-' || last_cue AS cue_range, '待代理依字幕提煉' AS core_message, 'adaptive' AS narrative_pattern, NULL AS image, NULL AS annotation, 'output/' || scene_id || '.mp4' AS output FROM scenes",
    "srt_cues": _cues_of(0),
    "vtt_cues": _cues_of(1),
    "parse_warnings": f"WITH {CAPTIONS} SELECT source_id, source_block, list_extract(['no-timeline', 'bad-timestamp', 'empty-body', 'end-not-after-start'], kind) AS problem FROM cap WHERE kind IN (1, 2, 3, 4)",
    "text_scalars": f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, (((conv_id % 100) * 60 + turn * 7 % 60) * 60 + conv_id % 60) * 1000 + turn % 10 * 100 AS ms, regexp_matches(trim(text), '[{MARKS}]+[{CLOSING}]*$') AS sentence,
  regexp_matches(trim(text), '[{CLAUSES}]+[{CLOSING}]*$') AS clause, round_even(greatest(1.2::DOUBLE, len(text) / 6.0::DOUBLE) * 1000, 0)::BIGINT AS estimated,
  greatest(2, least(7, ceil(len(text) / 34.0)))::INT AS elements_wanted, printf('scene-%02d', conv_id) AS scene_id,
  len(list_filter(string_split_regex(regexp_replace(text, '([{MARKS}])', '\\1' || chr(1), 'g'), '[\\x01\\n]'), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::INT AS sentences FROM c""",
    "clean_pages": r"SELECT page_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), ' '), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "colours": "SELECT doc_id, (doc_id * 7919 % 256)::INT AS blue, (doc_id * 7919 // 256 % 256)::INT AS green, (doc_id * 7919 // 65536 % 256)::INT AS red FROM documents",
    "annotation_issues": f"WITH {ISSUES} SELECT * FROM issues",
    "annotation_report": f"""WITH {ISSUES}, c AS (SELECT scene_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM issues GROUP BY scene_id)
SELECT scene_id, n AS elements, sd AS scene_duration_ms, last_end AS last_end_ms, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid FROM sc LEFT JOIN c USING (scene_id)""",
    "timeline_overlaps": f"WITH {ISSUES} SELECT scene_id, id AS first_id, nid AS second_id, end_ms - ns AS overlap_ms FROM nx WHERE ns < end_ms",
    "element_frames": f"WITH RECURSIVE {FRAMES} SELECT scene_id, rank, id AS element_id, sf AS start_frame, ink AS ink_frames, color AS color_frames, first AS first_frame, done AS end_frame, late FROM fr",
    "scene_frames": f"WITH RECURSIVE {FRAMES} SELECT scene_id, written, total, round_even(total * 1000.0 / 15, 0)::BIGINT AS duration_ms FROM sf",
    "merged_offsets": f"WITH RECURSIVE {FRAMES} SELECT scene_id % 100 AS project_id, scene_id, (sum(total) OVER o - total)::BIGINT AS offset, (sum(total) OVER o)::BIGINT AS end_offset FROM sf WINDOW o AS (PARTITION BY scene_id % 100 ORDER BY scene_id)",
    "frame_table": f"""WITH RECURSIVE {FRAMES}, st AS (SELECT *, unnest([{{'stage': 'ink', 'n': ink, 'f': first}}, {{'stage': 'color', 'n': color, 'f': first + ink}}]) AS g FROM fr), sp AS (SELECT *, unnest(range(g.n)) AS step FROM st)
SELECT scene_id, g.f + step AS frame, rank, id AS element_id, g.stage AS stage, step, CASE WHEN g.n = 1 THEN 1.0 ELSE step / (g.n - 1) END::DOUBLE AS progress FROM sp""",
    "progress_steps": f"WITH {ELEMENTS} SELECT scene_id, position, CASE WHEN n <= 0 THEN '' WHEN n = 1 THEN (m - 1)::VARCHAR ELSE array_to_string(list_transform(range(n), lambda i: round_even(i * (m - 1)::DOUBLE / (n - 1), 0)::INT), ',') END AS steps FROM (SELECT *, w * 5 AS m, trunc(dur / 67)::INT AS n FROM e)",
    "allowed_areas": f"WITH {CELLS} SELECT e.scene_id, e.rank, count(cx) AS area, count(*) FILTER (kept) AS allowed FROM e LEFT JOIN cel ON e.scene_id = cel.scene_id AND e.rank = cel.rank GROUP BY ALL",
    "scaled_areas": f"WITH {SCALED} SELECT z.scene_id, z.rank, count(cx) AS area, count(*) FILTER (kept) AS allowed FROM z LEFT JOIN ce ON z.scene_id = ce.scene_id AND z.rank = ce.rank GROUP BY ALL",
    "allowed_cells": f"WITH {CELLS} SELECT scene_id, rank, cx::INT AS x, cy::INT AS y FROM cel WHERE kept",
    "wipe_cells": f"""WITH {CELLS}, {WIPE}
SELECT c.scene_id, c.rank, cx::INT AS x, cy::INT AS y, coalesce(min(k) FILTER (CASE d WHEN 'right_to_left' THEN cx >= x1 - round_even(rw * p, 0) WHEN 'top_to_bottom' THEN cy <= y0 + round_even(rh * p, 0) WHEN 'bottom_to_top' THEN cy >= y1 - round_even(rh * p, 0)
  WHEN 'radial' THEN (cx - x0 - rw / 2.0) * (cx - x0 - rw / 2.0) + (cy - y0 - rh / 2.0) * (cy - y0 - rh / 2.0) <= (rw * rw + rh * rh) / 4.0 * p * p + 1e-9 ELSE cx <= x0 + round_even(rw * p, 0) END), 6)::INT AS step
FROM cel c JOIN rd ON c.scene_id = rd.scene_id AND c.rank = rd.rank, steps WHERE kept GROUP BY ALL""",
    "ease_curve": "SELECT round(0.5 - 0.5 * cos(pi() * least(1.0, greatest(0.0, l_discount * 10))), 9) AS eased, count(*) AS rows FROM lineitem GROUP BY 1",
    "replaced_subjects": f"""WITH {LISTS}, r AS (SELECT scene_id, event_id, event_type, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS t FROM s), f AS (SELECT scene_id, t, min(event_id) AS k FROM r GROUP BY ALL)
SELECT scene_id, ids AS subject_ids, ids <> was AS changed FROM (SELECT scene_id, string_agg(t, ',' ORDER BY k) AS ids FROM f GROUP BY scene_id) JOIN (SELECT scene_id, string_agg(event_type, ',' ORDER BY event_id) AS was FROM s GROUP BY scene_id) USING (scene_id)""",
    "removed_subjects": f"WITH {LISTS} SELECT scene_id, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (event_type <> 'click'), '') AS subject_ids, bool_or(event_type = 'click') AS changed FROM s GROUP BY scene_id",
    "contour_areas": f"WITH {OUTLINES} SELECT scene_id, char_pos, contour_pos, area, is_ink FROM ik",
    "stroke_order": f"""WITH {OUTLINES},
b AS (SELECT *, list_min(px) AS x0, list_min(py) AS y0, list_max(px) AS x1, list_max(py) AS y1 FROM ik WHERE is_ink),
o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, char_pos ORDER BY trunc(y0 / (57.0 * 0.34)), (x1 - x0 < y1 - y0), x0, contour_pos)::INT AS stroke_rank, greatest(220, least(950, trunc(260 + (x1 - x0 + y1 - y0) * 0.9)))::INT AS duration_ms FROM b)
SELECT scene_id, char_pos, stroke_rank, contour_pos, row_number() OVER w::INT AS sequence, greatest(0, trunc(x0)::INT - 14)::INT AS x, greatest(0, trunc(y0)::INT - 14)::INT AS y,
  greatest(1, least(320, ceil(x1)::INT + 14) - greatest(0, trunc(x0)::INT - 14))::INT AS width, greatest(1, least(180, ceil(y1)::INT + 14) - greatest(0, trunc(y0)::INT - 14))::INT AS height,
  CASE WHEN x1 - x0 >= y1 - y0 THEN 'left_to_right' ELSE 'top_to_bottom' END AS direction, (sum(duration_ms) OVER w - duration_ms)::BIGINT AS start_ms, duration_ms FROM o WINDOW w AS (PARTITION BY scene_id ORDER BY char_pos, stroke_rank)""",
    "bezier_points": f"WITH {OUTLINES}, s AS (SELECT *, k / 16.0 AS t FROM ol, range(1, 17) r(k)) SELECT scene_id, contour_pos, (k - 1)::INT AS k, round((1 - t)**3 * px[1] + 3 * (1 - t)**2 * t * px[2] + 3 * (1 - t) * t**2 * px[3] + t**3 * px[4], 6)::DOUBLE AS x, round((1 - t)**3 * py[1] + 3 * (1 - t)**2 * t * py[2] + 3 * (1 - t) * t**2 * py[3] + t**3 * py[4], 6)::DOUBLE AS y FROM s",
    "arrows": f"""WITH {ELEMENTS} SELECT scene_id, position,
  CASE direction WHEN 'right_to_left' THEN x + w - 1 WHEN 'top_to_bottom' THEN x + w // 2 WHEN 'bottom_to_top' THEN x + w // 2 ELSE x + 1 END::INT AS x1,
  CASE direction WHEN 'top_to_bottom' THEN y + 1 WHEN 'bottom_to_top' THEN y + h - 1 ELSE y + h // 2 END::INT AS y1,
  CASE direction WHEN 'right_to_left' THEN x + 1 WHEN 'top_to_bottom' THEN x + w // 2 WHEN 'bottom_to_top' THEN x + w // 2 ELSE x + w - 1 END::INT AS x2,
  CASE direction WHEN 'top_to_bottom' THEN y + h - 1 WHEN 'bottom_to_top' THEN y + 1 ELSE y + h // 2 END::INT AS y2 FROM e""",
    "fitted_sizes": """WITH a AS (SELECT p_partkey, p_partkey % 3000 + 1 AS w, p_partkey * 7 % 2500 + 1 AS h FROM part), b AS (SELECT *, CASE WHEN greatest(w, h) > 640 THEN 640.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS s FROM a),
c AS (SELECT p_partkey, greatest(2, round_even(w * s, 0))::INT AS w, greatest(2, round_even(h * s, 0))::INT AS h FROM b) SELECT p_partkey, greatest(2, w - w % 2) AS width, greatest(2, h - h % 2) AS height FROM c""",
    "pointers": f"""WITH {ELEMENTS}, {WIPE}, u AS (SELECT *, k / 5.0 AS t, 0.5 - 0.5 * cos(pi() * k / 5.0) AS ep, 0.5 + 0.35 * sin(k / 5.0 * 8 * pi()) AS wave FROM rd, range(6) r(k)),
v AS (SELECT *, round_even(rw * ep, 0)::INT AS al, round_even(rh * ep, 0)::INT AS dn, sqrt(rw * rw / 4.0 + rh * rh / 4.0) * ep AS ra, t * 5 * pi() AS an, x0 + trunc(wave * rw)::INT AS swx, y0 + trunc(wave * rh)::INT AS swy FROM u)
SELECT scene_id, rank, k::INT AS step,
  greatest(0, least(31, CASE d WHEN 'right_to_left' THEN greatest(x0, least(x1 - 1, x1 - al)) WHEN 'top_to_bottom' THEN swx WHEN 'bottom_to_top' THEN swx WHEN 'radial' THEN trunc(x0 + rw / 2.0 + cos(an) * ra)::INT ELSE least(x1 - 1, x0 + al) END))::INT AS x,
  greatest(0, least(17, CASE d WHEN 'top_to_bottom' THEN least(y1 - 1, y0 + dn) WHEN 'bottom_to_top' THEN greatest(y0, y1 - dn) WHEN 'radial' THEN trunc(y0 + rh / 2.0 + sin(an) * ra)::INT ELSE swy END))::INT AS y FROM v""",
    "resampled_paths": f"""WITH {OUTLINES}, r AS (SELECT scene_id, contour_pos, list_transform(px, lambda v: round_even(v, 0)) AS xs, list_transform(py, lambda v: round_even(v, 0)) AS ys FROM ol),
g AS (SELECT *, unnest(range(1, 4)) AS i FROM r),
n AS (SELECT *, sqrt((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2) AS n FROM g),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scene_id, contour_pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM n WHERE n > 1e-6),
q AS (SELECT *, floor((pos + n) / 3 + 1e-9) AS hi, floor(pos / 3 + 1e-9) AS lo FROM c),
w AS (SELECT scene_id, contour_pos, sum(hi - lo) AS k, arg_max({{'x': round_even(xs[i] + (xs[i + 1] - xs[i]) * (hi * 3 - pos) / n, 0), 'y': round_even(ys[i] + (ys[i + 1] - ys[i]) * (hi * 3 - pos) / n, 0)}}, i) FILTER (hi > lo) AS p FROM q GROUP BY ALL)
SELECT scene_id, contour_pos, (1 + k + CASE WHEN coalesce(p.x, xs[1]) = xs[4] AND coalesce(p.y, ys[1]) = ys[4] THEN 0 ELSE 1 END)::INT AS points, xs[1]::INT AS first_x, xs[4]::INT AS last_x, ys[4]::INT AS last_y FROM w JOIN r USING (scene_id, contour_pos)""",
    "skeletons": f"WITH {CELLS}, {_eroded()} SELECT scene_id, rank, count(*) AS cells FROM sk GROUP BY ALL",
    "schema_problems": """WITH w AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS source_id, l_partkey % 11 AS way FROM lineitem)
SELECT source_id, list_extract(['canvas.width', 'canvas.height', 'sceneDurationMs', 'elements', 'elements.0.label', 'elements.0.maskPolicy', 'elements.0.region.width', 'elements.0.reveal.durationMs', 'root'], way) AS path,
  list_extract(['integer', 'integer', 'integer', 'required', 'string', 'enum', 'integer', 'required', 'no-object'], way) AS problem FROM w WHERE way BETWEEN 1 AND 9""",
    "mixed_cues": f"""WITH {CAPTIONS}, docs AS (SELECT doc_id AS source_id, text FROM documents), {_cut("docs").replace("cues AS", "pc AS")}
SELECT 'u' || source_id AS source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, source_block)::INT AS index, source_block, start_ms, end_ms, dur_ms, text, false AS estimated FROM good WHERE source_id % 2 = 0
UNION ALL SELECT 'd' || source_id, index, source_block, start_ms, end_ms, dur_ms, text, estimated FROM pc""",
    "exported_captions": f"""WITH {TURNS}, b AS (SELECT source_id, index, index || chr(10) || printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text AS b FROM cues)
SELECT source_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY index) || chr(10) AS text FROM b GROUP BY source_id""",
    "preview_labels": f"""WITH {ELEMENTS} SELECT scene_id, position, seq || '. ' || coalesce(subtitle, id) || CASE WHEN position % 2 = 0 THEN '  [host,guest]' ELSE '' END || printf('  %.1f-%.1fs  ', round(start_ms / 1000.0, 1), round((start_ms + dur) / 1000.0, 1)) || direction AS label FROM e""",
    "moved_regions": f"""WITH {ELEMENTS}, m AS (SELECT *, position * 7 % 23 - 11 AS dx, seq * 5 % 13 - 6 AS dy FROM e WHERE x + w <= 32 AND y + h <= 18)
SELECT scene_id, position, greatest(0, least(32 - w, x + dx))::INT AS x, greatest(0, least(18 - h, y + dy))::INT AS y, greatest(1, least(32 - x, w + dx))::INT AS width, greatest(1, least(18 - y, h + dy))::INT AS height,
  10 BETWEEN x AND x + w AND 8 BETWEEN y AND y + h AS hit FROM m""",
    "resequenced_elements": f"WITH {ELEMENTS} SELECT scene_id, id AS element_id, (position + 1)::INT AS sequence FROM e",
    "filled_defaults": f"""WITH {ELEMENTS} SELECT scene_id, position, CASE WHEN position % 2 = 0 THEN 'element-' || (position + 1) ELSE id END AS element_id, CASE WHEN position % 3 = 0 THEN position + 1 ELSE seq END AS sequence, CASE WHEN position % 2 = 0 THEN 0 ELSE start_ms END AS start_ms,
  CASE WHEN position % 3 = 0 THEN 1200 ELSE dur END AS duration_ms, CASE WHEN position % 2 = 0 THEN 'auto' ELSE direction END AS direction, CASE WHEN position % 3 = 0 THEN 'subtract-later' ELSE policy END AS policy, 700 AS final_hold_ms FROM e""",
    "subject_profiles": """WITH t AS (SELECT DISTINCT user_id, event_type FROM events), f AS (SELECT user_id, min(event_type) AS first, bool_or(event_type = 'view') AS had FROM t GROUP BY user_id),
k AS (SELECT user_id, event_type AS id FROM t WHERE event_type NOT IN ('view', 'host') UNION SELECT user_id, 'host' FROM f)
SELECT user_id AS project_id, CASE WHEN user_id % 10 = 0 THEN 'none' ELSE 'adaptive' END AS mode, CASE WHEN user_id % 10 = 0 OR first = 'click' THEN NULL WHEN first = 'view' THEN 'host' ELSE first END AS default_id,
  CASE WHEN user_id % 10 = 0 THEN '' ELSE (SELECT string_agg(id, ',' ORDER BY id) FROM k WHERE k.user_id = f.user_id AND id <> 'click') END AS ids,
  CASE WHEN user_id % 10 <> 0 THEN CASE WHEN had THEN 'person' ELSE 'object' END END AS kind, CASE WHEN user_id % 10 <> 0 THEN CASE WHEN had THEN 'coat:blue,hat:red' ELSE 'coat:blue' END END AS look FROM f""",
    "text_fields": """SELECT c_custkey, printf('scene-%02d', c_custkey % 100) AS scene_id, c_mktsegment AS key, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'two = words' END AS raw, c_mktsegment || '|' || c_custkey AS items, c_custkey % 3 < 2 AS timed FROM customer""",
    "laid_out": """WITH l AS (SELECT l_orderkey, l_quantity::DOUBLE AS a, sum(l_quantity::DOUBLE) OVER w AS upto, row_number() OVER w - 1 AS k, sum(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey) AS total, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey AS scene_id, k::INT AS char_pos, round((320 - total - 2 * (n - 1)) / 2.0 + upto - a + 2 * k, 6)::DOUBLE AS x, 105.0::DOUBLE AS baseline FROM l""",
    "final_alphas": f"""WITH {ELEMENTS} SELECT scene_id, position, CASE WHEN seq % 3 = 2 OR position % 2 = 0 THEN 1.0 WHEN seq % 3 = 1 THEN (start_ms % 4 + 1) / 4.0 ELSE 0.0 END::DOUBLE AS alpha FROM e WHERE start_ms >= 0""",
} | {f"issues_{c.replace('-', '_')}": f"WITH {ISSUES} SELECT * FROM issues WHERE code = '{c}'" for c in CODES} | {
    "hand_paths": f"WITH {ELEMENTS}, {HANDS} SELECT scene_id, rank, lift, i, px AS x, py AS y FROM hp",
    "whole_frames": _whole(0),
    "whole_frames_fade": _whole(3),
    "components": f"WITH RECURSIVE {CELLS}, {LABELLED.replace('EDGE', '2')} SELECT scene_id, rank, count(DISTINCT label) AS components, count(*) AS squares FROM lb GROUP BY ALL",
    "component_squares": f"WITH RECURSIVE {CELLS}, {LABELLED.replace('EDGE', '1')} SELECT scene_id, rank, (dense_rank() OVER (PARTITION BY scene_id, rank ORDER BY label))::INT AS component, col::INT AS col, row::INT AS row FROM lb",
    "stroke_paths": f"WITH RECURSIVE {CELLS}, {LABELLED.replace('EDGE', '2')} SELECT scene_id, rank, count(*)::INT AS points, (count(DISTINCT label) - 1)::INT AS pen_lifts FROM lb GROUP BY ALL",
    "drawn_paths": f"""WITH RECURSIVE {CELLS}, {LABELLED.replace('EDGE', '2')},
ln AS (SELECT *, dense_rank() OVER (PARTITION BY scene_id, rank, label ORDER BY row) % 2 AS odd FROM lb),
sp AS (
  SELECT scene_id, rank, label, least(31, col * 2 + 1)::INT AS x, least(17, row * 2 + 1)::INT AS y, row_number() OVER (PARTITION BY scene_id, rank, label ORDER BY row, CASE WHEN odd = 1 THEN col ELSE -col END) AS k,
    count(*) OVER (PARTITION BY scene_id, rank, label) AS n FROM ln),
en AS MATERIALIZED (SELECT scene_id, rank, label, max(n) AS n, arg_min(x, k) AS ax, arg_min(y, k) AS ay, arg_max(x, k) AS bx, arg_max(y, k) AS b_y FROM sp GROUP BY scene_id, rank, label),
dr AS (
  (SELECT scene_id, rank, 0 AS nth, label, false AS back, bx AS px, b_y AS py, [label] AS seen FROM en QUALIFY row_number() OVER (PARTITION BY scene_id, rank ORDER BY ay, ax, label) = 1)
  UNION ALL
  (SELECT e.scene_id, e.rank, d.nth + 1, e.label, (px - bx) ** 2 + (py - b_y) ** 2 < (px - ax) ** 2 + (py - ay) ** 2,
    CASE WHEN (px - bx) ** 2 + (py - b_y) ** 2 < (px - ax) ** 2 + (py - ay) ** 2 THEN ax ELSE bx END, CASE WHEN (px - bx) ** 2 + (py - b_y) ** 2 < (px - ax) ** 2 + (py - ay) ** 2 THEN ay ELSE b_y END, list_append(seen, e.label)
   FROM dr d JOIN en e ON d.scene_id = e.scene_id AND d.rank = e.rank WHERE NOT list_contains(seen, e.label)
   QUALIFY row_number() OVER (PARTITION BY e.scene_id, e.rank ORDER BY least((px - bx) ** 2 + (py - b_y) ** 2, (px - ax) ** 2 + (py - ay) ** 2), e.label) = 1)),
ot AS (SELECT scene_id, rank, nth, x, y, CASE WHEN back THEN n - k ELSE k - 1 END AS j FROM dr JOIN sp USING (scene_id, rank, label))
SELECT scene_id, rank, (row_number() OVER (PARTITION BY scene_id, rank ORDER BY nth, j) - 1)::INT AS i, x, y, nth > 0 AND j = 0 AS lift FROM ot""",
    "traced_borders": f"""WITH RECURSIVE {CELLS}, {RUNS},
eu AS (SELECT scene_id, rank, (count(*) FILTER (n = 1) - count(*) FILTER (n = 3) - 2 * count(*) FILTER (n = 2 AND diagonal)) / 4 AS euler FROM qx GROUP BY ALL),
cm AS (SELECT scene_id, rank, count(*) AS c FROM (SELECT scene_id, rank, node FROM rc1 GROUP BY scene_id, rank, node HAVING min(other) = node) GROUP BY ALL),
ed AS (SELECT scene_id, rank, count(*) AS cells FROM kc a WHERE (SELECT count(*) FROM kc b WHERE b.scene_id = a.scene_id AND b.rank = a.rank AND abs(b.cx - a.cx) + abs(b.cy - a.cy) = 1) < 4 GROUP BY ALL)
SELECT scene_id, rank, (2 * c - euler)::BIGINT AS borders, cells FROM cm JOIN eu USING (scene_id, rank) JOIN ed USING (scene_id, rank)""",
    "contour_masks": f"""WITH {ELEMENTS},
tz AS (SELECT scene_id, rank, policy, protected, x, y, w, h, pad, round_even(x + w / 3.0::DOUBLE, 0)::INT - x AS lean FROM e),
ro AS (SELECT scene_id, rank, cy, x + ceil(lean * (cy - y) / h::DOUBLE - 1e-9)::INT AS lo, least(31, x + w) AS hi FROM tz, range(18) r(cy) WHERE cy >= y AND cy <= y + h),
rr AS (SELECT * FROM ro WHERE lo <= hi),
bd AS (SELECT scene_id, rank, unnest(range(lo, hi + 1)) AS cx, cy FROM rr),
ow AS (SELECT scene_id, rank, o.cy, greatest(0, min(lo) - any_value(pad)) AS lo, least(31, max(hi) + any_value(pad)) AS hi FROM rr JOIN tz USING (scene_id, rank), range(18) o(cy) WHERE abs(o.cy - rr.cy) <= pad GROUP BY scene_id, rank, o.cy),
oc AS (SELECT scene_id, rank, unnest(range(lo, hi + 1)) AS cx, cy FROM ow),
tp AS (SELECT scene_id, cx, cy, max(rank) AS m FROM bd GROUP BY ALL),
jd AS (
  SELECT oc.scene_id, oc.rank, NOT (policy = 'subtract-later' AND coalesce(m > oc.rank, false))
    AND NOT (policy <> 'none' AND len(list_filter(protected, lambda r: oc.cx >= r.x AND oc.cx < r.x + r.w AND oc.cy >= r.y AND oc.cy < r.y + r.h)) > 0) AS kept
  FROM oc JOIN tz USING (scene_id, rank) LEFT JOIN tp ON tp.scene_id = oc.scene_id AND tp.cx = oc.cx AND tp.cy = oc.cy)
SELECT e.scene_id, e.rank, count(kept) AS area, count(*) FILTER (kept) AS allowed FROM e LEFT JOIN jd ON e.scene_id = jd.scene_id AND e.rank = jd.rank GROUP BY ALL""",
    "changed_subjects": """WITH b AS (SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id % 4) - 1 AS n, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY event_id) - 1 AS p, event_type, event_id FROM events),
f AS (SELECT user_id, n, t, row_number() OVER (PARTITION BY user_id, n ORDER BY min(event_id)) - 1 AS p FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS t FROM b) GROUP BY user_id, n, t)
SELECT coalesce(b.user_id, f.user_id) AS source_id, 'elements[' || coalesce(b.n, f.n) || '].subjectIds[' || coalesce(b.p, f.p) || ']' AS path, CASE WHEN f.p IS NULL THEN 'removed' WHEN b.p IS NULL THEN 'added' ELSE 'changed' END AS change,
  '"' || event_type || '"' AS before, '"' || t || '"' AS after FROM b FULL JOIN f ON b.user_id = f.user_id AND b.n = f.n AND b.p = f.p WHERE event_type IS DISTINCT FROM t""",
    "rewritten_documents": "SELECT user_id AS source_id, bool_or(event_type = 'click') AS changed, bool_or(event_type = 'click') AS would_change, true AS dry_is_same, bool_or(event_type = 'click') AS has_backup, false AS \"left\" FROM events GROUP BY user_id",
    "missing_files": "SELECT p_partkey AS source_id, 'annotation' AS key, 'scenes/' || p_partkey % 500 || '.json' AS path FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 500 NOT IN (SELECT s_suppkey * 3 FROM supplier)",
    "image_problems": """WITH s AS (SELECT o_orderkey AS scene_id, o_custkey + o_orderkey % 2 * 10 AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT scene_id, 'error' AS level, CASE WHEN c_custkey IS NULL OR c_custkey % 9 = 0 THEN 'image-read-failed' ELSE 'canvas-image-mismatch' END AS code, NULL AS element_id
FROM s LEFT JOIN customer ON c_custkey = k WHERE c_custkey IS NULL OR c_custkey % 9 = 0 OR c_custkey % 4 = 0 OR c_custkey % 6 = 0""",
    "annotation_lookup": "SELECT o_orderkey AS scene_id, 'a' || o_custkey * 2 AS annotation, c_name AS doc FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2 WHERE o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 1",
    "scene_counts": f"""WITH RECURSIVE {EVENTS},{_rolled(*SHORT)}, n AS (SELECT source_id, count(*) AS scenes FROM scenes GROUP BY source_id)
SELECT c_custkey AS source_id, 'subtitle-segmentation' AS name, coalesce(scenes, 0) = c_custkey % 3 + 25 AND scenes IS NOT NULL AS ok, c_custkey % 3 + 25 AS expected, coalesce(scenes, 0) AS scenes FROM customer LEFT JOIN n ON source_id = c_custkey""",
    "strokes_of_characters": f"""WITH {OUTLINES}, n AS (SELECT scene_id, char_pos, CASE WHEN scene_id % 3 = 0 OR char_pos = 0 THEN 'x' ELSE 'y' END AS ch FROM (SELECT DISTINCT scene_id, char_pos FROM ol)),
k AS (SELECT scene_id, char_pos, count(*) AS c FROM ik WHERE is_ink GROUP BY ALL)
SELECT scene_id, ch, coalesce(arg_max(c, char_pos), 0) AS strokes FROM n LEFT JOIN k USING (scene_id, char_pos) GROUP BY ALL""",
    "centred_outlines": f"""WITH {OUTLINES}, m AS (SELECT scene_id, (180 - min(list_min(py)) - max(list_max(py))) / 2 AS dy FROM ol GROUP BY scene_id), u AS (SELECT scene_id, contour_pos, unnest(range(4))::INT AS i, px, py FROM ol)
SELECT scene_id, contour_pos, i, round(px[i + 1], 6) AS x, round(py[i + 1] + dy, 6) AS y FROM u JOIN m USING (scene_id)""",
    "scaled_paths": f"""WITH {OUTLINES}, u AS (SELECT scene_id, contour_pos, unnest(range(4)) AS k, px, py FROM ol)
SELECT scene_id, contour_pos, (row_number() OVER (PARTITION BY scene_id, contour_pos ORDER BY k) - 1)::INT AS i, round_even(px[k + 1] * 0.75, 0)::INT AS x, round_even(py[k + 1] * 1.3::DOUBLE, 0)::INT AS y FROM u WHERE (contour_pos + k) % 4 <> 0""",
    "only_scenes": f"WITH RECURSIVE {EVENTS},{_rolled(*SHORT)} SELECT source_id, scene_id, start_ms, end_ms FROM scenes WHERE scene_index IN (1, 3)",
    "project_problems": """SELECT c_custkey AS source_id, list_extract(['version', 'project.name', 'workflow.mode', 'canvas.fps', 'canvas.background', 'subject_profile.subjects.a.replaceable', 'render'], c_custkey % 8) AS path,
  list_extract(['integer', 'string', 'enum', 'integer', 'pattern', 'boolean', 'required'], c_custkey % 8) AS problem FROM customer WHERE c_custkey % 8 > 0""",
    "ready_profiles": """WITH t AS (SELECT user_id, event_type, max(event_id) % 13 <> 0 AS r FROM events GROUP BY ALL) SELECT user_id AS source_id, bool_and(r) AND count(*) >= 3 AND user_id % 5 <> 0 AS ok FROM t GROUP BY user_id""",
    "found_scenes": """SELECT c_custkey % 100 AS folder, 'scene-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') AS scene_id, s AS stem, s || '.annotation.json' AS annotation, s || CASE WHEN c_custkey % 5 <> 0 THEN '.png' ELSE '.jpg' END AS image
FROM (SELECT *, 'scene-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-' || c_custkey AS s FROM customer) WHERE c_custkey % 4 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 5 <> 0)""",
    "project_sources": """WITH o AS (SELECT o_orderkey % 130 AS folder, 'o' || o_orderkey AS scene_id, CASE WHEN o_orderkey % 130 % 3 = 0 AND o_orderkey % 2 = 0 THEN o_orderkey || '.json' END AS annotation FROM orders),
a AS (SELECT folder, bool_or(annotation IS NOT NULL) AS given FROM o GROUP BY folder),
f AS (SELECT c_custkey % 100 AS folder, 'scene-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') AS scene_id, 'scene-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-' || c_custkey AS s, c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 5 <> 0))
SELECT folder, scene_id, annotation, NULL AS image FROM o JOIN a USING (folder) WHERE given OR folder NOT IN (SELECT folder FROM f)
UNION ALL SELECT folder, scene_id, s || '.annotation.json', s || CASE WHEN c_custkey % 5 <> 0 THEN '.png' ELSE '.jpg' END FROM f WHERE folder NOT IN (SELECT folder FROM a WHERE given)""",
    "finished_steps": """WITH s AS (SELECT l_orderkey AS source_id, l_linenumber AS step, max(l_partkey) AS p FROM lineitem GROUP BY ALL), t AS (SELECT *, p % 5 <> 0 AND p % 3 <> 0 AS ok, CASE WHEN p % 7 = 0 THEN '' ELSE 'f' || p END AS a FROM s)
SELECT source_id, arg_max(a, step) FILTER (ok) AS artifact, coalesce(arg_max(a, step) FILTER (ok) <> '', false) AS valid, coalesce(string_agg(step::VARCHAR, ',' ORDER BY step) FILTER (NOT ok), '') AS warnings FROM t GROUP BY source_id""",
    "accepted": """WITH c AS (SELECT l_orderkey AS source_id, 'c' || l_linenumber AS name, l_partkey % 11 <> 0 AND l_suppkey % 8 <> 0 AS ok FROM lineitem)
SELECT source_id, bool_and(ok) AS passed, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed FROM c GROUP BY source_id""",
    "image_figures": f"""WITH {PIXELS}, {GROUND},
k AS (SELECT q.*, 3 * abs(v - bg) >= 30 AS content, 3 * abs(v - bg) >= 30 AND (bg - v >= 55 OR v < 85) AS ink FROM q JOIN g USING (vec_id)),
w AS (SELECT DISTINCT vec_id, sx + i AS wx, sy + j AS wy FROM k, range(2) a(i), range(2) b(j) WHERE ink AND sx + i < 8 AND sy + j < 8),
c AS (SELECT k.vec_id, sx, sy FROM k CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) LEFT JOIN w ON w.vec_id = k.vec_id AND wx = sx + i AND wy = sy + j WHERE sx + i < 8 AND sy + j < 8 GROUP BY ALL HAVING count(*) = count(wx)),
n AS (SELECT vec_id, count(*) AS ink FROM c GROUP BY vec_id)
SELECT k.vec_id AS scene_id, any_value(bg)::INT AS blue, any_value(bg)::INT AS green, any_value(bg)::INT AS red, count(*) FILTER (content) AS content, coalesce(any_value(n.ink), 0) AS ink
FROM (SELECT vec_id, content, bg FROM k JOIN g USING (vec_id)) k LEFT JOIN n ON n.vec_id = k.vec_id GROUP BY k.vec_id""",
    "frame_changes": f"""WITH {PIXELS}, {GROUND}, m AS (SELECT q.vec_id, avg(abs(q.v - bg)) AS e, avg(abs(r.v - q.v)) AS c FROM q JOIN g ON g.vec_id = q.vec_id JOIN q r ON r.vec_id = q.vec_id + 1 AND r.sx = q.sx AND r.sy = q.sy GROUP BY q.vec_id)
SELECT vec_id AS scene_id, round(e, 6) AS background_error, round(c, 6) AS change, e < 18 AND c > 2 AS passed FROM m""",
    "shrunk_images": f"""WITH {PIXELS},
w AS (SELECT t, s, greatest(0, least((t + 1) * 8, (s + 1) * 6) - greatest(t * 8, s * 6)) AS k FROM range(6) a(t), range(8) b(s)),
m AS (SELECT vec_id, a.t AS x, b.t AS y, sum(v * a.k * b.k) / 64.0::DOUBLE AS v FROM q JOIN w a ON a.s = sx AND a.k > 0 JOIN w b ON b.s = sy AND b.k > 0 GROUP BY ALL)
SELECT vec_id AS scene_id, x::INT AS x, y::INT AS y, round_even(round(v, 9), 0)::INT AS value FROM m""",
    "brush_targets": f"""WITH RECURSIVE {FRAMES}, {HANDS}, c AS (SELECT *, unnest(range(color)) AS k FROM fr)
SELECT c.scene_id, (first + ink + k)::BIGINT AS frame, c.rank, px AS target_x, py AS target_y FROM c LEFT JOIN hp ON hp.scene_id = c.scene_id AND hp.rank = c.rank AND hp.i = CASE WHEN color = 1 THEN np - 1 ELSE round_even(k * (np - 1)::DOUBLE / (color - 1), 0) END""",
    "ink_cells": f"""WITH {CELLS}, {HANDS}, {REACHED}, pv AS (SELECT *, lag(px) OVER o AS ax, lag(py) OVER o AS ay FROM fs WINDOW o AS (PARTITION BY scene_id, rank ORDER BY i)),
{_shown("SELECT scene_id, rank, step, CASE WHEN i IN (0, lift) OR nf = 1 THEN px ELSE ax END AS ax, CASE WHEN i IN (0, lift) OR nf = 1 THEN py ELSE ay END AS ay, px AS bx, py AS b_y, CASE WHEN i IN (0, lift) OR nf = 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS reach FROM pv WHERE nf > 1 OR i = np - 1")}""",
    "brush_cells": f"WITH {CELLS}, {HANDS}, {REACHED}, {_shown('SELECT scene_id, rank, step, px AS ax, py AS ay, px AS bx, py AS b_y, 3.0::DOUBLE AS reach FROM fs')}",
    "finish_cells": f"""WITH RECURSIVE {FRAMES}, {_ended(3)}, {CELLS.replace(ELEMENTS, "").strip().removeprefix(",")}, lf AS (SELECT scene_id, cx, cy FROM cel GROUP BY ALL HAVING NOT bool_or(kept)), al AS (SELECT *, (k + 1) / 3.0::DOUBLE AS alpha FROM lf JOIN sn USING (scene_id), range(3) r(k))
SELECT scene_id, cx::INT AS x, cy::INT AS y, (written + k)::BIGINT AS frame, round(alpha, 9) AS alpha, trunc(245 * (1.0::DOUBLE - alpha) + (cx * 7 + cy * 5) % 256 * alpha)::INT AS value FROM al""",
    "preview_cells": f"""WITH {ELEMENTS}, c AS (SELECT *, cx + 0.5::DOUBLE AS mx, cy + 0.5::DOUBLE AS my, position % 6 / 5.0::DOUBLE AS p, CASE WHEN direction = 'auto' THEN CASE WHEN w >= h THEN 'left_to_right' ELSE 'top_to_bottom' END ELSE direction END AS d FROM e, range(-2, 42) a(cx), range(-2, 26) b(cy) WHERE cx >= x - 2 AND cx < x + w + 2 AND cy >= y - 2 AND cy < y + h + 2)
SELECT scene_id, position, count(*) FILTER (CASE WHEN d = 'radial' THEN (mx - x - w / 2.0) ** 2 + (my - y - h / 2.0) ** 2 <= (w * w + h * h) * (0.55::DOUBLE * p) * (0.55::DOUBLE * p) ELSE mx >= x AND mx < x + w AND my >= y AND my < y + h
  AND CASE d WHEN 'right_to_left' THEN mx >= x + w * (1 - p) WHEN 'top_to_bottom' THEN my < y + h * p WHEN 'bottom_to_top' THEN my >= y + h * (1 - p) ELSE mx < x + w * p END END) AS cells FROM c GROUP BY ALL""",
} | {f"scene_frames_{k}": f"WITH RECURSIVE {FRAMES}, {_ended(fade)} SELECT scene_id, written, total, round_even(total * 1000.0 / 15, 0)::BIGINT AS duration_ms FROM sn" for k, fade in (("fade", 3), ("full", 0))} | {
    f"merged_offsets_{k}": f"WITH RECURSIVE {FRAMES}, {_ended(fade)} SELECT scene_id % 100 AS project_id, scene_id, (sum(total) OVER o - total)::BIGINT AS offset, (sum(total) OVER o)::BIGINT AS end_offset FROM sn WINDOW o AS (PARTITION BY scene_id % 100 ORDER BY scene_id)"
    for k, fade in (("fade", 3), ("full", 0))
}
