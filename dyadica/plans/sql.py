"""SQL twins of the queries: building blocks and one statement a query."""

from __future__ import annotations

EVENTS = "SELECT CAST(user_id AS BIGINT) AS tid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, CAST(value AS DOUBLE) AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events"
SUPPLIERS = "SELECT CAST(s_nationkey AS BIGINT) AS tid, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos, CAST(s_acctbal / 100 AS DOUBLE) AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y FROM supplier"


def points(source: str = EVENTS, name: str = "pts") -> str:
    return f"{name} AS ({source}), {name}_n AS (SELECT tid, count(*)::BIGINT AS n FROM {name} GROUP BY tid)"


def tree(name: str = "tree", sizes: str = "pts_n") -> str:
    return f"""{name}(mother, node, level, l, len) AS (
        SELECT tid, 0::BIGINT, 0::BIGINT, 0::BIGINT, n FROM {sizes}
        UNION ALL SELECT mother, 2 * node + 1 + s, level + 1, CASE WHEN s = 0 THEN l ELSE l + len // 2 END, CASE WHEN s = 0 THEN len // 2 ELSE len - len // 2 END
        FROM {name}, (VALUES (0), (1)) AS v(s) WHERE len > 1),
    nodes AS (SELECT mother, node, level, l, l + len - 1 AS r, len FROM {name})"""


def labels(radius: float, mothers: str = "pts", sample: str = "pts") -> str:
    """Least labels, column by column; a sentinel keeps the recursion going over columns without a free cell."""
    return f"""cells AS (SELECT a.tid AS m, a.pos::BIGINT AS j, b.tid AS t, b.pos::BIGINT AS i FROM {mothers} AS a JOIN {sample} AS b
              ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {radius * radius!r}::DOUBLE),
    free AS (SELECT m, j, t, i, i - row_number() OVER (PARTITION BY m, j, t ORDER BY i) AS run FROM cells
             UNION ALL SELECT DISTINCT -1, pos, -1, 0, 0 FROM {mothers}),
    lab(m, j, t, i, l) AS (
        SELECT m, j, t, i, j FROM free WHERE j = 0
        UNION ALL
        SELECT m, j, t, i, min(l0) OVER (PARTITION BY m, t, run ORDER BY i ROWS UNBOUNDED PRECEDING)
        FROM (SELECT f.m, f.j, f.t, f.i, f.run, least(f.j, min(coalesce(p.l, f.j))) AS l0
              FROM (SELECT max(j) + 1 AS j FROM lab) AS s JOIN free AS f ON f.j = s.j
              LEFT JOIN lab AS p ON p.m = f.m AND p.t = f.t AND p.i BETWEEN f.i - 1 AND f.i
              GROUP BY f.m, f.j, f.t, f.i, f.run)),
    labs AS (SELECT m, j, t, min(l)::BIGINT AS minl FROM lab WHERE m >= 0 GROUP BY m, j, t)"""


SUPPORT = """sup AS (SELECT mother, node, l, r, len, count(*)::BIGINT AS cnt, string_agg(t, ',' ORDER BY t) AS ids FROM nodes JOIN labs ON m = mother AND j = r AND minl <= l GROUP BY ALL)"""


def frequent(frequency: float, sizes: str = "pts_n") -> str:
    return f"freq AS (SELECT mother, node, l, r, len, cnt, cnt / (SELECT count(*) FROM {sizes})::DOUBLE AS frequency, ids FROM sup WHERE cnt >= ceil({frequency} * (SELECT count(*) FROM {sizes}) - 1e-9))"


def ends(min_length: int) -> str:
    return f"""long AS (SELECT * FROM nodes WHERE len >= {min_length}),
    small AS (SELECT mother, node, l, r FROM long WHERE NOT EXISTS (SELECT 1 FROM long AS c WHERE c.mother = long.mother AND c.node IN (2 * long.node + 1, 2 * long.node + 2))),
    begins AS (SELECT mother, node, x, y FROM long JOIN pts ON tid = mother AND pos = l),
    stops AS (SELECT mother, node, x, y FROM long JOIN pts ON tid = mother AND pos = r)"""


def near(name: str, marks: str, radius: float) -> str:
    return f"{name} AS (SELECT p.tid, p.pos, b.mother, b.node FROM pts AS p JOIN {marks} AS b ON (p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y) <= {radius * radius!r}::DOUBLE)"


def touched(radius: float, side: float) -> str:
    reach = int(-(-radius // side))
    corner = lambda i, j: f"(power((cx + {i}) * {side!r}::DOUBLE - x, 2) + power((cy + {j}) * {side!r}::DOUBLE - y, 2) <= {radius * radius * 1.00001!r}::DOUBLE)::INT"
    corners = " + ".join(corner(i, j) for i in (0, 1) for j in (0, 1))
    return f"""around AS (SELECT tid, pos, x, y, floor(x / {side!r}::DOUBLE)::BIGINT + i AS cx, floor(y / {side!r}::DOUBLE)::BIGINT + j AS cy FROM pts, range(-{reach}, {reach + 1}) AS u(i), range(-{reach}, {reach + 1}) AS v(j)),
    touch AS (SELECT * FROM (SELECT tid, pos, cx, cy, {corners} AS corners FROM around) WHERE corners > 0)"""


SURVIVE = """up(mother, node, anc) AS (SELECT mother, node, node FROM small UNION ALL SELECT mother, node, (anc - 1) // 2 FROM up WHERE anc > 0),
    held AS (SELECT mother, anc, count(*) AS k FROM up GROUP BY ALL),
    good AS (SELECT tid, up.mother, anc, count(*) AS k FROM (SELECT DISTINCT tid, mother, node FROM nb) JOIN (SELECT DISTINCT tid, mother, node FROM ne) USING (tid, mother, node) JOIN up USING (mother, node) GROUP BY ALL),
    counts AS (SELECT tid, count(*)::BIGINT AS c FROM good JOIN held USING (mother, anc) WHERE good.k = held.k GROUP BY tid)"""

H_INDEX = "h AS (SELECT coalesce(max(rn), 0)::BIGINT AS d FROM (SELECT floor(log2(c)) + 1 AS v, row_number() OVER (ORDER BY c DESC) AS rn FROM counts WHERE c > 0) WHERE v >= rn)"


def simplified(radius: float, factor: float) -> str:
    reach2 = (radius * factor / 2) ** 2
    return f"""walk(tid, pos, anchor, ax, ay) AS (
        SELECT tid, pos, pos, x, y FROM pts WHERE pos = 0
        UNION ALL SELECT p.tid, p.pos, CASE WHEN far THEN p.pos ELSE anchor END, CASE WHEN far THEN p.x ELSE ax END, CASE WHEN far THEN p.y ELSE ay END
        FROM (SELECT q.*, w.anchor, w.ax, w.ay, (q.x - w.ax) * (q.x - w.ax) + (q.y - w.ay) * (q.y - w.ay) > {reach2!r}::DOUBLE AS far FROM walk AS w JOIN pts AS q ON q.tid = w.tid AND q.pos = w.pos + 1) AS p),
    kept AS (SELECT tid, (row_number() OVER (PARTITION BY tid ORDER BY anchor) - 1)::INT AS pos, ax AS x, ay AS y, anchor, count(*)::INT AS weight FROM walk GROUP BY tid, anchor, ax, ay),
    kept_n AS (SELECT tid, count(*)::BIGINT AS n FROM kept GROUP BY tid)"""


def query(select: str, *parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
