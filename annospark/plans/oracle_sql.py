"""SQL text builders for the DuckDB oracle of the enrichment queries.

The Fisher p-value here sums over the *full* support of the hypergeometric
distribution with ``lgamma`` — an independent formulation of what the Spark
side computes with a windowed Stirling series.
"""

from __future__ import annotations


def _lf(x: str) -> str:
    return f"lgamma(({x}) + 1)"


def fisher_ctes(target_sql: str, background_sql: str, group: str | None = None) -> str:
    """CTEs ``t, b, tab, fis``; ``fis`` has [grp,] term, tp, tn, fp, fn, odds_ratio, p_value."""
    g = f"{group}, " if group else ""
    gj = f"t.{group} = tt.{group}" if group else "TRUE"
    lp = lambda k: (f"{_lf('n1')} - {_lf(k)} - {_lf(f'n1 - {k}')} + {_lf('n2')} - {_lf(f'r - {k}')} "
                    f"- {_lf(f'n2 - r + {k}')} - {_lf('n1 + n2')} + {_lf('r')} + {_lf('n1 + n2 - r')}")
    return f"""
t_src AS ({target_sql}),
b_src AS ({background_sql}),
t AS (SELECT {g}term, count(*) AS tp FROM t_src WHERE term IS NOT NULL GROUP BY ALL),
b AS (SELECT term, count(*) AS tn FROM b_src WHERE term IS NOT NULL GROUP BY ALL),
tt AS (SELECT {g}sum(tp) AS t_total FROM t GROUP BY ALL),
bt AS (SELECT sum(tn) AS b_total FROM b),
tab AS (
  SELECT {('t.' + group + ', ') if group else ''}t.term, tp, tn, CAST(t_total - tp AS BIGINT) AS fp, CAST(b_total - tn AS BIGINT) AS fn
  FROM t JOIN b ON t.term = b.term JOIN tt ON {gj} CROSS JOIN bt
),
cells AS (SELECT DISTINCT tp, tn, fp, fn, tp + fp AS n1, tn + fn AS n2, tp + tn AS r FROM tab),
sup AS (
  SELECT tp, tn, fp, fn, n1, n2, r, unnest(range(greatest(0, r - n2), least(r, n1) + 1)) AS k FROM cells
),
lps AS (SELECT tp, tn, fp, fn, {lp('k')} AS lpk, {lp('tp')} AS lpo FROM sup),
pv AS (
  SELECT tp, tn, fp, fn, least(1.0, sum(CASE WHEN lpk <= lpo + 1e-7 THEN exp(lpk) ELSE 0 END)) AS p_value
  FROM lps GROUP BY tp, tn, fp, fn
),
fis AS (
  SELECT tab.*, pv.p_value,
         CASE WHEN tn * fp = 0 THEN 'inf'::DOUBLE ELSE (tp::DOUBLE * fn) / (tn::DOUBLE * fp) END AS odds_ratio
  FROM tab JOIN pv USING (tp, tn, fp, fn)
)"""


def enrich_ctes(target_sql: str, background_sql: str, group: str | None = None) -> str:
    """Adds ``res`` = Fisher ⋈ depth>0 ⋈ labels with propagated p-values (needs the DAG CTEs)."""
    g = f"{group}, " if group else ""
    gsel = f"r.{group}, " if group else ""
    gon = f"r.{group} = pc.{group} AND " if group else ""
    return fisher_ctes(target_sql, background_sql, group) + f""",
known AS (SELECT depth.term, depth, label FROM depth JOIN nodes USING (term) WHERE depth > 0),
res0 AS (SELECT fis.*, known.depth, known.label FROM fis JOIN known USING (term)),
pc AS (
  SELECT {gsel}clo.ancestor AS term, min(r.p_value) AS p_child
  FROM res0 r JOIN clo ON clo.descendant = r.term
  WHERE clo.descendant IN (SELECT term FROM nodes)
  GROUP BY ALL
),
res AS (
  SELECT r.* REPLACE (least(r.p_value, coalesce(pc.p_child, r.p_value)) AS p_value)
  FROM res0 r LEFT JOIN pc ON {gon}r.term = pc.term
)"""


def gate_sql(src: str, max_p: float, max_depth: int, bonferroni: bool, group: str | None = None) -> str:
    """SELECT applying the significance gate to CTE ``src``; adds ``score``."""
    thr = f"({max_p} / s._n)" if bonferroni else f"{max_p}"
    if group:
        stats = (f"(SELECT {group}, count(*) AS _n, min(CASE WHEN depth <= {max_depth} THEN p_value END) AS _pmin "
                 f"FROM {src} GROUP BY {group}) s")
        join = f"{src} r JOIN {stats} ON r.{group} = s.{group}"
    else:
        stats = (f"(SELECT count(*) AS _n, min(CASE WHEN depth <= {max_depth} THEN p_value END) AS _pmin "
                 f"FROM {src}) s")
        join = f"{src} r CROSS JOIN {stats}"
    passes = f"coalesce(s._pmin <= {thr}, FALSE)"
    return (f"SELECT r.*, CASE WHEN {passes} THEN (CASE WHEN r.p_value = 0 THEN 'inf'::DOUBLE ELSE -ln(r.p_value) END) "
            f"ELSE -1.0 END AS score FROM {join} "
            f"WHERE NOT {passes} OR (r.p_value < {thr} AND r.depth <= {max_depth})")
