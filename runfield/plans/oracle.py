"""Building blocks of the DuckDB SQL that the grid queries are held against."""

from __future__ import annotations

SHIP = """vox AS (SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS slice, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS "row",
  CAST(day(l_shipdate) - 1 AS INTEGER) AS col FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL)"""
EV = """vox AS (SELECT DISTINCT CAST(user_id AS INTEGER) AS slice, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS "row",
  CAST(hour(ts) AS INTEGER) AS col FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND CAST(ts AS DATE) >= DATE '2024-01-01')"""
EMB = """vox AS (SELECT DISTINCT 0 AS slice, CAST(vec_id AS INTEGER) AS "row", CAST(col AS INTEGER) AS col
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS col FROM embeddings) WHERE CAST(x AS DOUBLE) > 0.15)"""
RUNS = """run AS (SELECT slice, "row", CAST(min(col) AS INTEGER) AS x0, CAST(max(col) + 1 AS INTEGER) AS x1
  FROM (SELECT *, col - row_number() OVER (PARTITION BY slice, "row" ORDER BY col) AS g FROM vox) GROUP BY slice, "row", g)"""
SEG = """seg AS (SELECT slice, "row", CAST(row_number() OVER (PARTITION BY slice, "row" ORDER BY x0) - 1 AS INTEGER) AS seg, x0, x1,
  row_number() OVER (ORDER BY slice, "row", x0) AS seg_id FROM run)"""
CONTACTS = """off(dz, dy) AS (VALUES (0, -1), (-1, 0), (-1, -1), (-1, 1)),
contacts AS (SELECT a.seg_id AS a, b.seg_id AS b, o.dz, o.dy, a.slice, a."row" FROM seg a, off o, seg b
  WHERE b.slice = a.slice + o.dz AND b."row" = a."row" + o.dy AND a.x1 >= b.x0 AND b.x1 >= a.x0)"""
ROOTS = """e AS (SELECT a, b FROM contacts UNION ALL SELECT b, a FROM contacts),
reach(n, l) AS (SELECT seg_id, seg_id FROM seg UNION SELECT e.a, r.l FROM reach r JOIN e ON e.b = r.n WHERE r.l < e.a),
roots AS (SELECT n AS seg_id, min(l) AS root FROM reach GROUP BY n)"""
LABELLED = """labelled AS (SELECT s.*, r.root, dense_rank() OVER (ORDER BY r.root) AS label FROM seg s JOIN roots r USING (seg_id))"""
CELLS = """cells AS (SELECT slice, "row", CAST(unnest(range(x0, x1)) AS INTEGER) AS col, label FROM labelled)"""

_TO_SEG = (RUNS, SEG)
_TO_CONTACTS = (*_TO_SEG, CONTACTS)
_TO_LABELS = (*_TO_CONTACTS, ROOTS, LABELLED)


def _with(volume: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((volume, *parts)) + "\n"


def vox(volume: str, query: str, *more: str) -> str:
    return _with(volume, *more) + query


def seg(volume: str, query: str, *more: str) -> str:
    return _with(volume, *_TO_SEG, *more) + query


def contacts(volume: str, query: str, *more: str) -> str:
    return _with(volume, *_TO_CONTACTS, *more) + query


def labels(volume: str, query: str, *more: str) -> str:
    return _with(volume, *_TO_LABELS, *more) + query


def cells(volume: str, query: str, *more: str) -> str:
    return _with(volume, *_TO_LABELS, CELLS, *more) + query


def features(rows: str, keys: str = "label", names: str | None = None) -> str:
    return f"""SELECT {names or keys}, CAST(sum(x1 - x0) AS BIGINT) AS "S", CAST(sum((x0 + x1 - 1) * (x1 - x0) // 2) AS BIGINT) AS "Sx",
  CAST(sum("row" * (x1 - x0)) AS BIGINT) AS "Sy", CAST(sum(slice * (x1 - x0)) AS BIGINT) AS "Sz", min(x0) AS lo_col, min("row") AS lo_row, min(slice) AS lo_slice,
  max(x1) AS hi_col, CAST(max("row") + 1 AS INTEGER) AS hi_row, CAST(max(slice) + 1 AS INTEGER) AS hi_slice FROM {rows} GROUP BY {keys}"""


#: Every cell of the activity grid (24 hours, days and users up to the last).
GRID = """grid AS (SELECT CAST(s AS INTEGER) AS slice, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col
  FROM (SELECT unnest(range(0, (SELECT max(slice) + 1 FROM vox))) AS s), (SELECT unnest(range(0, (SELECT max("row") + 1 FROM vox))) AS r), (SELECT unnest(range(0, 24)) AS c))"""
DENSE = """dense AS (SELECT g.slice, g."row", g.col, CASE WHEN v.slice IS NULL THEN 0 ELSE 1 END AS val FROM grid g LEFT JOIN vox v ON g.slice = v.slice AND g."row" = v."row" AND g.col = v.col)"""
EDGES = """edges AS (SELECT *, CAST(xor(val, coalesce(lag(val) OVER (PARTITION BY slice, "row" ORDER BY col), 0)) AS INTEGER) AS edge FROM dense)"""
