"""DuckDB SQL that states the same results as the Spark plans, written
independently as plain SQL (one CTE block per tree level, unrolled).

Used only as the correctness oracle (``__spark_entry__.oracle_sql``); never
run on Spark: Catalyst would inline the unrolled CTEs.
"""

from __future__ import annotations

EPS = "1e-9"

CELLS = """cells AS (
  SELECT CAST(o_custkey AS INT) AS user_id, CAST(l_partkey AS INT) AS item_id,
         CAST(FLOOR((l_quantity - 1) / 10) + 1 AS DOUBLE) AS rating,
         CAST(l_suppkey AS INT) AS supp_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

RATINGS = {
    "part": """ratings AS (
  SELECT user_id, item_id, MAX(rating) AS rating FROM cells GROUP BY user_id, item_id)""",
    "supp": """ratings AS (
  SELECT user_id, supp_id AS item_id, CAST(ROUND(AVG(rating)) AS DOUBLE) AS rating
  FROM cells GROUP BY user_id, supp_id)""",
}


def base_ctes(which: str = "supp", swap: bool = False, lam: float = 7.0) -> list[str]:
    ctes = [CELLS, RATINGS[which]]
    if swap:
        ctes.append("rs AS (SELECT item_id AS user_id, user_id AS item_id, rating FROM ratings)")
        src = "rs"
    else:
        src = "ratings"
    ctes += [
        f"cut AS (SELECT FLOOR((MAX(user_id) + 1) * 0.7) AS c FROM {src})",
        f"train AS (SELECT user_id, item_id, rating FROM {src} WHERE user_id < (SELECT c FROM cut) AND rating <> 0)",
        f"test AS (SELECT user_id, item_id, rating FROM {src} WHERE user_id >= (SELECT c FROM cut) AND rating <> 0)",
        "mu AS (SELECT AVG(rating) AS mu FROM train)",
        f"bias AS (SELECT user_id, (SUM(rating) + {lam} * (SELECT mu FROM mu)) / ({lam} + COUNT(*)) AS bias,"
        " COUNT(*) AS n FROM train GROUP BY user_id)",
        "e AS (SELECT t.user_id, t.item_id, t.rating, t.rating - b.bias AS e FROM train t JOIN bias b ON t.user_id = b.user_id)",
        "a0 AS (SELECT 0 AS node, user_id FROM bias)",
    ]
    return ctes


def level_ctes(level: int, k: int = 200, order: str = "most", score_items: str = "all") -> list[str]:
    L, N = level, level + 1
    pop = "DESC" if order == "most" else "ASC"
    path_filter = (
        ""
        if L == 0
        else f" AND NOT EXISTS (SELECT 1 FROM path{L} p WHERE p.node = x.node AND p.item_id = x.item_id)"
    )
    right = f"ea{L}"
    extra = []
    if score_items == "candidates":
        extra.append(
            f"ear{L} AS (SELECT ea.* FROM ea{L} ea WHERE EXISTS (SELECT 1 FROM cand{L} c WHERE c.node = ea.node AND c.item_id = ea.item_id))"
        )
        right = f"ear{L}"
        base_src = f"(SELECT t.* FROM tot{L} t WHERE EXISTS (SELECT 1 FROM cand{L} c WHERE c.node = t.node AND c.item_id = t.item_id))"
    else:
        base_src = f"tot{L}"
    ctes = [
        f"ea{L} AS (SELECT a.node, e.user_id, e.item_id, e.rating, e.e FROM a{L} a JOIN e ON a.user_id = e.user_id)",
        f"tot{L} AS (SELECT node, item_id, SUM(e) AS ts, SUM(e * e) AS s2, COUNT(*) AS tn FROM ea{L} GROUP BY node, item_id)",
        f"cand{L} AS (SELECT x.node, x.item_id, x.tn AS popularity FROM ("
        f"SELECT node, item_id, tn, ROW_NUMBER() OVER (PARTITION BY node ORDER BY tn {pop}, item_id) AS rn FROM tot{L}) x"
        f" WHERE x.rn <= {k}{path_filter})",
        *extra,
        f"base{L} AS (SELECT node, SUM(s2 - ts * ts / (tn + {EPS})) AS base FROM {base_src} GROUP BY node)",
        f"ask{L} AS (SELECT ea.node, ea.user_id, ea.item_id AS cand, CASE WHEN ea.rating >= 4 THEN 0 ELSE 1 END AS branch"
        f" FROM ea{L} ea JOIN cand{L} c ON ea.node = c.node AND ea.item_id = c.item_id WHERE ea.rating >= 4 OR ea.rating <= 3)",
        f"br{L} AS (SELECT a.node, a.cand, r.item_id,"
        " SUM(CASE WHEN a.branch = 0 THEN r.e ELSE 0 END) AS sL, SUM(CASE WHEN a.branch = 0 THEN 1 ELSE 0 END) AS nL,"
        " SUM(CASE WHEN a.branch = 1 THEN r.e ELSE 0 END) AS sD, SUM(CASE WHEN a.branch = 1 THEN 1 ELSE 0 END) AS nD"
        f" FROM ask{L} a JOIN {right} r ON a.user_id = r.user_id AND a.node = r.node GROUP BY a.node, a.cand, r.item_id)",
        f"gain{L} AS (SELECT b.node, b.cand, SUM(b.sL * b.sL / (b.nL + {EPS}) + b.sD * b.sD / (b.nD + {EPS})"
        f" + (t.ts - b.sL - b.sD) * (t.ts - b.sL - b.sD) / (t.tn - b.nL - b.nD + {EPS}) - t.ts * t.ts / (t.tn + {EPS})) AS gain"
        f" FROM br{L} b JOIN tot{L} t ON b.node = t.node AND b.item_id = t.item_id GROUP BY b.node, b.cand)",
        f"size{L} AS (SELECT node, COUNT(*) AS n_users FROM a{L} GROUP BY node)",
        f"scored{L} AS (SELECT g.node, g.cand AS item_id, bs.base - g.gain AS error, g.gain, c.popularity, s.n_users"
        f" FROM gain{L} g JOIN cand{L} c ON g.node = c.node AND g.cand = c.item_id JOIN base{L} bs ON bs.node = g.node"
        f" JOIN size{L} s ON s.node = g.node)",
        f"split{L} AS (SELECT {L} AS level, node, item_id, error, gain, n_users, popularity FROM ("
        f"SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY CAST(printf('%.8e', gain) AS DOUBLE) DESC, popularity {pop}, item_id) AS rn"
        f" FROM scored{L}) WHERE rn = 1)",
        f"a{N} AS (SELECT a.node * 3 + CASE WHEN t.rating >= 4 THEN 0 WHEN t.rating <= 3 THEN 1 ELSE 2 END AS node, a.user_id"
        f" FROM a{L} a JOIN split{L} s ON a.node = s.node LEFT JOIN train t ON t.user_id = a.user_id AND t.item_id = s.item_id)",
    ]
    inherited = "" if L == 0 else f" UNION ALL SELECT p.node, p.item_id FROM path{L} p WHERE p.node IN (SELECT node FROM split{L})"
    ctes.append(
        f"pp{L} AS (SELECT node, item_id FROM split{L}{inherited})"
    )
    ctes.append(
        f"path{N} AS (SELECT node * 3 AS node, item_id FROM pp{L} UNION ALL SELECT node * 3 + 1, item_id FROM pp{L}"
        f" UNION ALL SELECT node * 3 + 2, item_id FROM pp{L})"
    )
    return ctes


def tree_ctes(which="supp", depth=3, k=200, order="most", score_items="all", swap=False) -> list[str]:
    ctes = base_ctes(which, swap)
    for level in range(depth):
        ctes += level_ctes(level, k, order, score_items)
    ctes.append(
        "splits AS (" + " UNION ALL ".join(f"SELECT * FROM split{L}" for L in range(depth)) + ")"
    )
    ctes.append(
        "assignment AS ("
        + " UNION ALL ".join(f"SELECT {L} AS level, node, user_id FROM a{L}" for L in range(depth + 1))
        + ")"
    )
    ctes.append(
        "pseudo AS (SELECT x.level, x.node, e.item_id, AVG(e.rating) AS rating FROM assignment x"
        " JOIN e ON x.user_id = e.user_id GROUP BY x.level, x.node, e.item_id)"
    )
    return ctes


def route_ctes(depth=3, max_questions: int | None = None) -> list[str]:
    """Walk the test users down the tree (requires tree_ctes)."""
    q = depth if max_questions is None else min(depth, max_questions)
    ctes = [
        "r0 AS (SELECT user_id, 0 AS level, 0 AS node, TRUE AS alive, '' AS asked, '' AS trace"
        " FROM (SELECT DISTINCT user_id FROM test))"
    ]
    for L in range(q):
        N = L + 1
        ctes += [
            f"q{L} AS (SELECT r.*, s.item_id AS q_item FROM r{L} r LEFT JOIN split{L} s ON r.node = s.node AND r.alive AND r.level = {L})",
            f"b{L} AS (SELECT q.*, CASE WHEN t.rating >= 4 THEN 0 WHEN t.rating <= 3 THEN 1 ELSE 2 END AS branch,"
            f" CASE WHEN t.rating >= 4 THEN 'L' WHEN t.rating <= 3 THEN 'D' ELSE 'U' END AS letter"
            f" FROM q{L} q LEFT JOIN test t ON t.user_id = q.user_id AND t.item_id = q.q_item)",
            f"m{L} AS (SELECT b.*, b.node * 3 + b.branch AS child,"
            f" (b.q_item IS NOT NULL AND EXISTS (SELECT 1 FROM a{N} a WHERE a.node = b.node * 3 + b.branch)) AS mv FROM b{L} b)",
            f"ans{L} AS (SELECT user_id, q_item AS item_id FROM m{L} WHERE mv AND branch IN (0, 1))",
            f"r{N} AS (SELECT user_id,"
            f" CASE WHEN mv THEN {N} ELSE level END AS level,"
            f" CASE WHEN mv THEN child ELSE node END AS node,"
            f" alive AND mv AS alive,"
            f" CASE WHEN mv THEN asked || CASE WHEN asked = '' THEN '' ELSE ',' END || CAST(q_item AS VARCHAR) || ':' || letter ELSE asked END AS asked,"
            f" CASE WHEN q_item IS NOT NULL THEN trace || letter ELSE trace END AS trace FROM m{L})",
        ]
    ctes.append(f"routed AS (SELECT user_id, level, node, asked, trace FROM r{q})")
    if q:
        ctes.append("answered AS (" + " UNION ALL ".join(f"SELECT * FROM ans{L}" for L in range(q)) + ")")
    else:
        ctes.append("answered AS (SELECT user_id, item_id FROM test WHERE FALSE)")
    ctes += [
        "pairs AS (SELECT t.user_id, t.item_id, t.rating, r.level, r.node FROM test t JOIN routed r ON t.user_id = r.user_id"
        " WHERE t.item_id IN (SELECT item_id FROM train)"
        " AND NOT EXISTS (SELECT 1 FROM answered a WHERE a.user_id = t.user_id AND a.item_id = t.item_id))",
        "pred AS (SELECT p.*, COALESCE(n.rating, r.rating) AS prediction FROM pairs p"
        " LEFT JOIN pseudo n ON n.level = p.level AND n.node = p.node AND n.item_id = p.item_id"
        " LEFT JOIN (SELECT item_id, rating FROM pseudo WHERE level = 0) r ON r.item_id = p.item_id)",
        "user_rmse AS (SELECT user_id, SQRT(AVG((rating - prediction) * (rating - prediction))) AS rmse, COUNT(*) AS n"
        " FROM pred GROUP BY user_id)",
    ]
    return ctes


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
