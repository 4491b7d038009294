"""SQL that solves least squares and ridge by elimination, as a check on the fitted regressions."""

from __future__ import annotations

from .base import r


def ridge_sql(rows: str, p: int, lam: float, digits: int = 0) -> str:
    """CTEs up to ``yh(series, ds, yhat)``.

    ``rows`` are CTEs that end in ``x(series, ds, y, t, f)``: t marks train rows, f lists the p
    features.  Columns are centred and scaled, the penalty is added to the diagonal of their
    correlations, and the p equations of each series are reduced one pivot at a time.
    """
    return f"""WITH RECURSIVE {rows},
ok AS (SELECT * FROM x WHERE t AND y IS NOT NULL AND len(list_filter(f, lambda v: v IS NULL)) = 0),
lg AS (SELECT series, ds, y, unnest(f) AS v, unnest(range(1, {p} + 1)) AS i FROM ok),
mv AS (SELECT series, i, avg(v) AS m, stddev_pop(v) AS s, avg(y) AS ym FROM lg GROUP BY 1, 2),
z AS (SELECT series, ds, i, (v - m) / s AS z, y - ym AS yc FROM lg JOIN mv USING (series, i)),
c AS (SELECT a.series, a.i, b.i AS j, avg(a.z * b.z) + CASE WHEN a.i = b.i THEN {lam} ELSE 0 END AS g
  FROM z a JOIN z b USING (series, ds) GROUP BY 1, 2, 3
  UNION ALL SELECT series, i, {p} + 1, avg(z * yc) FROM z GROUP BY 1, 2),
rw AS (SELECT series, i, list(g ORDER BY j) AS r FROM c GROUP BY 1, 2),
mt AS (SELECT series, list(r ORDER BY i) AS m FROM rw GROUP BY 1),
el AS (SELECT series, 1 AS k, m FROM mt UNION ALL
  SELECT series, k + 1, list_transform(range(1, {p} + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
    ELSE list_transform(range(1, {p} + 2), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= {p}),
bt AS (SELECT series, unnest(range(1, {p} + 1)) AS i, unnest(list_transform(m, lambda q: q[{p} + 1])) AS b FROM el WHERE k = {p} + 1),
tf AS (SELECT series, ds, unnest(f) AS v, unnest(range(1, {p} + 1)) AS i FROM x WHERE NOT t),
yh AS (SELECT series, ds, any_value(ym) + sum(b * (v - m) / s) AS yhat FROM tf JOIN mv USING (series, i) JOIN bt USING (series, i) GROUP BY 1, 2)"""


_DATEPARTS = ", ".join(["date_diff('day', DATE '1970-01-01', ds) / 365.25 - 30.0",
                        *[f"(isodow(ds) - 1 = {i})::DOUBLE" for i in range(1, 7)],
                        *[f"{f}(2 * pi() * {k} * dayofyear(ds) / 365.25)" for k in (1, 2, 3) for f in ("sin", "cos")]])


def datepart_sql(days: str, lam: float) -> str:
    """Date-part regression of the last 30 days of ``odf``."""
    rows = f"""{days}, x AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds DESC) > 30 AS t, [{_DATEPARTS}] AS f FROM odf)"""
    return f"{ridge_sql(rows, 13, lam)} SELECT series, ds, {r('yhat', 0)} AS yhat FROM yh"


def datepart_future_sql(days: str, lam: float, h: int) -> str:
    """Date-part regression fitted on all of ``odf``, for the ``h`` days after it."""
    rows = f"""{days}, al AS (SELECT series, ds, y, true AS t FROM odf UNION ALL
SELECT series, CAST(max(ds) + unnest(generate_series(1, {h})) * INTERVAL 1 DAY AS DATE), NULL, false FROM odf GROUP BY 1),
x AS (SELECT *, [{_DATEPARTS}] AS f FROM al)"""
    return f"""{ridge_sql(rows, 13, lam)} SELECT series, CAST(date_diff('day', (SELECT max(ds) FROM odf o WHERE o.series = yh.series), ds) AS INTEGER) AS lead,
ds, {r('greatest(yhat, 0)', 0)} AS yhat FROM yh"""


def window_sql(days: str, lam: float, h: int, lags, means) -> str:
    """Lagged-window regression of the last ``h`` days of ``odf``."""
    w = "PARTITION BY series ORDER BY ds"
    f = [f"lag(y, {h + n}) OVER ({w})" for n in lags] + [
        f"avg(y) OVER ({w} ROWS BETWEEN {h + n - 1} PRECEDING AND {h} PRECEDING)" for n in means]
    rows = f"""{days}, x AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds DESC) > {h} AS t, [{', '.join(f)}] AS f FROM odf)"""
    return f"{ridge_sql(rows, len(f), lam)} SELECT series, ds, {r('yhat', 0)} AS yhat FROM yh"
