"""The SQL a boosting run must agree with: the same trees from joins, groupings and windows over rows.

Written for a few rounds of shallow trees with given bin edges; bins, gradients, splits, leaves and
probabilities are all plain SQL over the long (row, class, column) table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from widecast.spec import TableSpec


def boost_sql(
    source: str,
    train: str,
    test: str,
    spec: TableSpec,
    classes: Sequence[str],
    edges: Mapping[str, Sequence[float]],
    mode: str,
    rounds: int,
    depth: int,
    eta: float,
    annealing: float = 1.0,
    min_rows: float = 10.0,
    min_child_weight: float = 1.0,
    reg_lambda: float = 1.0,
) -> str:
    """``source`` is a CTE chain, ``train`` and ``test`` are tables in it."""
    k = len(classes)
    names = [*spec.numeric, *spec.categorical]
    ctes = [source]
    binned = []
    for j, c in enumerate(names):
        if c in spec.numeric:
            steps = " + ".join(f"CASE WHEN {c} >= {e!r} THEN 1 ELSE 0 END" for e in edges[c])
            binned.append(f"SELECT \"user\", {j} AS j, CASE WHEN {c} IS NULL THEN 0 ELSE 1 + {steps} END AS bin FROM {{0}}")
        else:
            t = f"CAST({c} AS VARCHAR)"
            ctes.append(
                f"lev{j} AS (SELECT {t} AS v, row_number() OVER (ORDER BY count(*) DESC, {t}) AS bin "
                f"FROM {train} WHERE {c} IS NOT NULL GROUP BY {t})"
            )
            binned.append(f"SELECT \"user\", {j}, coalesce(lev{j}.bin, 0) FROM {{0}} LEFT JOIN lev{j} ON {t} = lev{j}.v")
    everything = f"(SELECT * FROM {train} UNION ALL SELECT * FROM {test})"
    ctes.append("bins AS MATERIALIZED (" + " UNION ALL ".join(b.format(everything) for b in binned) + ")")
    ctes.append(f"cls AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)})' for i, c in enumerate(classes))}) t(c, name))")
    ctes.append(f"prior AS (SELECT name, count(*) / sum(count(*)) OVER () AS p FROM {train} JOIN cls ON label = name GROUP BY name)")
    ctes.append(f"total AS (SELECT count(*) AS rows FROM {train})")
    # Margin per (row, class) of all rows; training rows carry a target.
    ctes.append(
        f"""m0 AS MATERIALIZED (
  SELECT a."user", cls.c, ln(prior.p) AS f, CASE WHEN a.label = cls.name THEN 1 ELSE 0 END AS y, a.learns
  FROM (SELECT "user", label, true AS learns FROM {train} UNION ALL SELECT "user", label, false FROM {test}) a, cls JOIN prior ON cls.name = prior.name)"""
    )
    newton = mode == "newton"
    side = f"(h + {reg_lambda})" if newton else "n"

    def weight(g: str, h: str, n: str) -> str:
        return f"({g}) * ({g}) / nullif({f'({h}) + {reg_lambda}' if newton else n}, 0)"

    def leaf(g: str, h: str) -> str:
        return f"-({g}) / (({h}) + {reg_lambda})" if newton else f"-({g}) / greatest({h}, 1e-12) * {(k - 1) / k!r}"

    least_rows = min_rows if not newton else 0.0
    for r in range(rounds):
        step = eta * annealing**r
        ctes.append(
            f"""g{r} AS MATERIALIZED (
  SELECT "user", c, learns, p - y AS g, greatest(p * (1 - p), 1e-6) AS h
  FROM (SELECT *, exp(f - top) / sum(exp(f - top)) OVER (PARTITION BY "user") AS p
        FROM (SELECT *, max(f) OVER (PARTITION BY "user") AS top FROM m{r})))"""
        )
        ctes.append(f'n{r}_0 AS (SELECT "user", c, 0 AS node, true AS open FROM m{r})')
        for level in range(depth):
            t = f"{r}_{level}"
            ctes.append(
                f"""hist{t} AS (
  SELECT c, node, j, bin, sum(g) AS g, sum(h) AS h, CAST(count(*) AS DOUBLE) AS n
  FROM g{r} JOIN n{t} USING ("user", c) JOIN bins USING ("user") WHERE learns AND open GROUP BY ALL)"""
            )
            ctes.append(
                f"""place{t} AS MATERIALIZED (SELECT *, j < {len(spec.numeric)} AS is_number,
  CASE WHEN j < {len(spec.numeric)} THEN CAST(bin AS DOUBLE) ELSE round(g / {side}, 10) END AS place FROM hist{t})"""
            )
            sums = ", ".join(
                f"sum({x}) OVER (PARTITION BY c, node, j ORDER BY place, bin ROWS UNBOUNDED PRECEDING) AS l{x}, "
                f"sum({x}) OVER (PARTITION BY c, node, j) AS t{x}, "
                f"sum(CASE WHEN is_number AND bin = 0 THEN {x} ELSE 0 END) OVER (PARTITION BY c, node, j) AS m{x}"
                for x in "ghn"
            )
            ctes.append(
                f"cum{t} AS (SELECT *, {sums} FROM place{t})"
            )
            both = []
            for missing_left in (True, False):
                gl, hl, nl = (f"l{x}" if missing_left else f"(l{x} - m{x})" for x in "ghn")
                allowed = f"{nl} >= {max(least_rows, 1e-9)!r} AND tn - {nl} >= {max(least_rows, 1e-9)!r}"
                if newton:
                    allowed += f" AND {hl} >= {min_child_weight} AND th - {hl} >= {min_child_weight}"
                if not missing_left:
                    allowed += " AND is_number AND mn > 0"
                gain = f"{weight(gl, hl, nl)} + {weight(f'tg - {gl}', f'th - {hl}', f'tn - {nl}')} - {weight('tg', 'th', 'tn')}"
                zero = f"(mn > 0 OR {nl} >= tn - {nl})" if missing_left else "false"
                both.append(
                    f"SELECT c, node, j, bin, is_number, place AS spot, CASE WHEN {allowed} THEN round(({gain}) / (SELECT rows FROM total), 10) ELSE -1 END AS score, "
                    f"{zero} AS zero_left, {gain} AS gain, {gl} AS lg, {hl} AS lh, tg, th FROM cum{t}"
                )
            ctes.append(
                f"""best{t} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, node ORDER BY score DESC, j, bin, zero_left DESC) AS place
                 FROM ({' UNION ALL '.join(both)})) WHERE place = 1)"""
            )
            ctes.append(
                f"""n{r}_{level + 1} AS MATERIALIZED (
  SELECT n."user", n.c, CASE WHEN n.open AND b.score > 0 THEN 2 * n.node + CASE
           WHEN b.is_number AND x.bin = 0 THEN CASE WHEN b.zero_left THEN 1 ELSE 2 END
           WHEN b.is_number THEN CASE WHEN x.bin <= b.bin THEN 1 ELSE 2 END
           WHEN y.place < b.spot OR y.place = b.spot AND x.bin <= b.bin THEN 1 ELSE 2 END ELSE n.node END AS node,
         n.open AND coalesce(b.score > 0, false) AS open
  FROM n{t} n LEFT JOIN best{t} b ON n.c = b.c AND n.node = b.node AND n.open LEFT JOIN bins x ON n."user" = x."user" AND x.j = b.j
  LEFT JOIN place{t} y ON y.c = b.c AND y.node = b.node AND y.j = b.j AND y.bin = x.bin)"""
            )
        values = [f"SELECT c, 0 AS node, {leaf('tg', 'th')} AS v FROM best{r}_0"]
        for level in range(depth):
            values.append(f"SELECT c, 2 * node + 1, {leaf('lg', 'lh')} FROM best{r}_{level} WHERE score > 0")
            values.append(f"SELECT c, 2 * node + 2, {leaf('tg - lg', 'th - lh')} FROM best{r}_{level} WHERE score > 0")
        ctes.append(f"v{r} AS (" + " UNION ALL ".join(values) + ")")
        ctes.append(
            f"""m{r + 1} AS MATERIALIZED (
  SELECT m."user", m.c, m.f + {step!r} * v.v AS f, m.y, m.learns
  FROM m{r} m JOIN n{r}_{depth} n ON m."user" = n."user" AND m.c = n.c JOIN v{r} v ON v.c = n.c AND v.node = n.node)"""
        )
    ctes.append(
        f"""boosted AS (
  SELECT "user", {', '.join(f'max(p) FILTER (WHERE c = {i}) AS p{i}' for i in range(k))}, arg_max(name, (p, -c)) AS predict
  FROM (SELECT *, exp(f - top) / sum(exp(f - top)) OVER (PARTITION BY "user") AS p
        FROM (SELECT *, max(f) OVER (PARTITION BY "user") AS top FROM m{rounds} WHERE NOT learns)) JOIN cls USING (c)
  GROUP BY "user")"""
    )
    splits = " UNION ALL ".join(
        f"SELECT j, gain FROM best{r}_{level} WHERE score > 0" for r in range(rounds) for level in range(depth)
    )
    names_sql = ", ".join(f"({j}, '{c}')" for j, c in enumerate(names))
    ctes.append(
        f"""importance AS (
  SELECT variable, coalesce(sum(gain), 0) AS importance FROM (VALUES {names_sql}) v(j, variable) LEFT JOIN ({splits}) USING (j) GROUP BY variable)"""
    )
    return "WITH " + ",\n".join(ctes)
