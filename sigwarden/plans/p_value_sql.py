"""DuckDB SQL of p-values by their closed forms and series, and of draws and scans that need a recursion."""

from __future__ import annotations

import math

_ROOT_PI = f"{math.sqrt(math.pi)!r}::DOUBLE"


def erfc(x: str) -> str:
    """1 less the error function, whose series of positive terms is x^(2n+1) 2^n / (2n+1)!! times 2 exp(-x^2) / sqrt(pi)."""
    size = f"abs({x})"
    series = f"list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest({size}, 1e-300)) - ln(2::DOUBLE) - lgamma(k + 1.5)) * {_ROOT_PI}))"
    return f"(1 - sign({x}) * CASE WHEN {size} > 6 THEN 1.0 ELSE 2 / {_ROOT_PI} * exp(-({x}) * ({x})) * {series} END)"


def normal_sf(z: str) -> str:
    return f"(0.5 * {erfc(f'(({z}) / sqrt(2.0::DOUBLE))')})"


def t_p(t: str, df: str) -> str:
    """Two-sided p-value of a t statistic with a whole number of degrees of freedom, by its finite sums in the angle atan(t / sqrt(df))."""
    a = f"atan(abs({t}) / sqrt({df}))"
    odd = f"2 / pi() * ({a} + sin({a}) * coalesce(list_sum(list_transform(range(0, (({df} - 1) // 2)::BIGINT), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * {_ROOT_PI} / 2 * pow(cos({a}), 2 * k + 1))), 0))"
    even = f"sin({a}) * list_sum(list_transform(range(0, ({df} // 2)::BIGINT), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / {_ROOT_PI} * pow(cos({a}), 2 * k)))"
    return f"CASE WHEN {t} IS NULL OR {df} <= 0 THEN NULL ELSE 1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END END"


def mann_whitney_p(u: str, n_a: str, n_b: str, ties: str) -> str:
    """Upper tail of the normal approximation with tie and continuity correction."""
    n, var = f"({n_a} + {n_b})", f"({n_a} * {n_b} / 12.0::DOUBLE * ({n_a} + {n_b} + 1 - ({ties}) / (({n_a} + {n_b}) * ({n_a} + {n_b} - 1.0::DOUBLE))))"
    return f"CASE WHEN {n} <= 1 OR {var} <= 0 THEN 1.0 ELSE {normal_sf(f'({u} - {n_a} * {n_b} / 2.0::DOUBLE - 0.5) / sqrt({var})')} END"


def signed_rank_ways(sizes: str) -> str:
    """CTE ``ways`` (recursive): for each n of the table ``sizes`` (n, at most 50) in how many ways ranks 1 to n give each sum, as a list at k = n."""
    return f"""ways AS (SELECT n, 0 AS k, list_transform(range(0, n * (n + 1) // 2 + 1), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w FROM {sizes}
  UNION ALL SELECT n, k + 1, list_transform(range(1, len(w) + 1), lambda s: w[s] + CASE WHEN s > k + 1 THEN w[s - k - 1] ELSE 0.0::DOUBLE END) FROM ways WHERE k < n)"""


def change_points(source: str, hazard: float = 1 / 50, fall: int = 5, longest: int = 200) -> str:
    """CTEs up to ``online`` (recursive): the run-length posterior after each value of ``source`` (participant_id, x: a list), ``now`` and ``last`` being the
    most probable run lengths. Counts behind a run length r are known: kappa = 1 + r and alpha = 1 + r / 2."""
    scale = "(beta[j] * (j + 1) / ((1 + (j - 1) / 2.0::DOUBLE) * j))"
    nu = "(2 * (1 + (j - 1) / 2.0::DOUBLE))"
    density = f"exp(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2) - 0.5 * ln({nu} * pi() * {scale}) - ({nu} + 1) / 2 * ln(1 + pow(v - mu[j], 2) / ({nu} * {scale})))"
    return f"""online AS (SELECT participant_id, x, 0 AS t, [1.0::DOUBLE] AS p, [list_avg(x[1:5])] AS mu, [1.0::DOUBLE] AS beta, list_avg(x[1:5]) AS mu0, 0::BIGINT AS now, 0::BIGINT AS last FROM {source}
  UNION ALL SELECT participant_id, x, t, p, mu, beta, mu0, list_position(p, list_max(p)) - 1, last FROM (
    SELECT participant_id, x, t, list_transform(q, lambda e: e / list_sum(q)) AS p, mu, beta, mu0, last FROM (
      SELECT participant_id, x, t + 1 AS t, [list_sum(g) * {hazard!r}::DOUBLE] || list_transform(g, lambda e: e * {1 - hazard!r}::DOUBLE) AS q,
        [mu0] || list_transform(range(1, len(mu) + 1), lambda j: (j * mu[j] + v) / (j + 1)) AS mu, [1.0::DOUBLE] || list_transform(range(1, len(mu) + 1), lambda j: beta[j] + j * pow(v - mu[j], 2) / (2 * (j + 1))) AS beta, mu0, now AS last
      FROM (SELECT *, list_transform(range(1, len(p) + 1), lambda j: p[j] * {density}) AS g FROM (SELECT *, x[t + 1] AS v FROM online WHERE t < len(x))))))"""


def logistic(name: str, rows: str, steps: int = 12, ridge: float = 1.0) -> str:
    """CTEs up to ``name`` (fold, b0, b1, b2): a logistic model of y on x1 and x2 for each fold of ``rows`` (fold, y, x1, x2), the intercept free and the others
    penalised, after ``steps`` Newton steps, each of which solves its three equations by determinants."""
    out = [f"{name}_0 AS (SELECT DISTINCT fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {rows})"]
    for k in range(steps):
        last = k == steps - 1
        out.append(f"""{name}{'' if last else f'_{k + 1}'} AS (SELECT fold,
  b0 + (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0, b1 + (a * (g1 * f - g2 * e) - g0 * (b * f - e * c) + c * (b * g2 - g1 * c)) / det AS b1, b2 + (a * (d * g2 - e * g1) - b * (b * g2 - g1 * c) + g0 * (b * e - d * c)) / det AS b2
  FROM (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM (
    SELECT fold, b0, b1, b2, sum(y - p) AS g0, sum((y - p) * x1) - {ridge} * b1 AS g1, sum((y - p) * x2) - {ridge} * b2 AS g2, sum(p * (1 - p)) AS a, sum(p * (1 - p) * x1) AS b, sum(p * (1 - p) * x2) AS c, sum(p * (1 - p) * x1 * x1) + {ridge} AS d, sum(p * (1 - p) * x1 * x2) AS e, sum(p * (1 - p) * x2 * x2) + {ridge} AS f
    FROM (SELECT r.fold, y, x1, x2, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {rows} AS r JOIN {name}_{k} AS m USING (fold)) GROUP BY fold, b0, b1, b2)))""")
    return ",\n".join(out)


def held_out(name: str, rows: str, least: int = 10) -> str:
    """CTEs up to ``name`` (subject, n, auroc): leave-one-subject-out models of ``rows`` (subject, y, f1, f2), as models.loso_classify has them."""
    scaled = lambda f: f"(t.{f} - m{f}) / d{f}"
    return f"""{name}_s AS (SELECT subject AS fold, count(*) AS n, sum(y) AS pos FROM {rows} GROUP BY 1),
{name}_k AS (SELECT fold FROM {name}_s, (SELECT count(*) AS n_all, sum(y) AS pos_all FROM {rows}) WHERE n >= {least} AND pos > 0 AND pos < n AND pos_all > pos AND pos_all - pos < n_all - n),
{name}_m AS (SELECT fold, {', '.join(f"avg({f}) AS m{f}, CASE WHEN var_pop({f}) > 1e-12 * (1 + pow(avg({f}), 2)) THEN stddev_pop({f}) ELSE 1.0 END AS d{f}" for f in ("f1", "f2"))} FROM {rows} JOIN {name}_k ON subject <> fold GROUP BY fold),
{name}_t AS (SELECT fold, y, {scaled('f1')} AS x1, {scaled('f2')} AS x2 FROM {rows} AS t JOIN {name}_m ON subject <> fold),
{logistic(f"{name}_b", f"{name}_t")},
{name}_h AS (SELECT subject, y, round(b0 + b1 * {scaled('f1')} + b2 * {scaled('f2')}, 9) AS score FROM {rows} AS t JOIN {name}_m AS mm ON mm.fold = subject JOIN {name}_b AS bb ON bb.fold = subject),
{name} AS (SELECT subject, count(*) AS n, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auroc
  FROM (SELECT *, rank() OVER (PARTITION BY subject ORDER BY score) + (count(*) OVER (PARTITION BY subject, score) - 1) / 2.0::DOUBLE AS r FROM {name}_h) GROUP BY subject)"""
