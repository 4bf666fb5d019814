"""The extended scenario: the flagship plus the reconstructed post-model steps (pressures, resilience, future, score,
Index, global region) on the proxy matrices, with an SQL oracle that composes the same steps."""

from __future__ import annotations

from ..sources.proxy import proxy_store
from ..sources.tables import Tables
from . import extension_queries as XQ
from . import goal_oracles as GO
from . import metadata as M
from . import proxy_sql as Q
from .registry import register
from .scenario import ExtensionInputs, run_scenario


def _extension_inputs(spark, store) -> ExtensionInputs:
    return ExtensionInputs(
        **XQ.matrices(spark),
        layer_values=XQ.layer_values(store),
        areas=store.narrow("rgn_area", id_num="region_id", val_num="area"),
        goals=M.goals_frame(spark),
        element_weights=XQ.proxy_weights(store),
    )


def _extended_sql() -> str:
    base = GO.ORACLES_FINALIZE_PARTS
    roots = ", ".join(f"('{g[3]}', {g[6]})" for g in M.GOALS if g[4] is None)
    return f"""WITH {base['leaf_ctes']},
leaf0 AS ({base['leaf_union']}),
s_p AS ({XQ.PRESSURES_SQL}), s_r AS ({XQ.RESILIENCE_SQL}),
leafpr AS (SELECT * FROM leaf0 UNION ALL SELECT * FROM s_p UNION ALL SELECT * FROM s_r),
wide AS (SELECT region_id, goal, max(score) FILTER (WHERE dimension = 'status') AS status, max(score) FILTER (WHERE dimension = 'trend') AS trend,
                max(score) FILTER (WHERE dimension = 'pressures') AS p, max(score) FILTER (WHERE dimension = 'resilience') AS r
         FROM leafpr GROUP BY 1, 2),
fut AS (SELECT region_id, goal, status,
          CASE WHEN status IS NULL THEN NULL ELSE greatest(0.0, least(100.0,
            (1 + 0.67 * coalesce(trend, 0.0) + (1 - 0.67) * (coalesce(r / 100, 0.0) - coalesce(p / 100, 0.0))) * status / 1.0)) END AS future
        FROM wide),
fs AS (SELECT region_id, goal, 'future' AS dimension, round(future, 6) AS score FROM fut
       UNION ALL
       SELECT region_id, goal, 'score', round((coalesce(status, 0) + coalesce(future, 0))
              / NULLIF((CASE WHEN status IS NULL THEN 0 ELSE 1 END) + (CASE WHEN future IS NULL THEN 0 ELSE 1 END), 0), 6) FROM fut),
leaf AS (SELECT * FROM leafpr UNION ALL SELECT * FROM fs),
{base['composites']},
roots AS (SELECT * FROM (VALUES {roots}) v(goal, weight)),
idx AS (SELECT s5.region_id, 'Index' AS goal, s5.dimension,
               round(sum(s5.score * roots.weight) FILTER (WHERE s5.score IS NOT NULL)
                     / NULLIF(sum(roots.weight) FILTER (WHERE s5.score IS NOT NULL), 0), 6) AS score
        FROM s5 JOIN roots ON roots.goal = s5.goal WHERE s5.dimension IN ('score', 'future') GROUP BY s5.region_id, s5.dimension),
s5i AS (SELECT * FROM s5 UNION ALL SELECT * FROM idx),
area AS (WITH {Q.OF}, {Q.ON} SELECT rgn_id AS region_id, rgn_area AS area FROM onx),
glb AS (SELECT 0 AS region_id, x.goal, x.dimension,
                round(sum(x.score * a.area) FILTER (WHERE x.score IS NOT NULL) / NULLIF(sum(a.area) FILTER (WHERE x.score IS NOT NULL), 0), 6) AS score
         FROM s5i x JOIN area a ON a.region_id = x.region_id
         WHERE x.region_id <> 0 AND x.dimension IN ('status', 'future', 'score') GROUP BY x.goal, x.dimension),
s5g AS (SELECT * FROM s5i UNION ALL SELECT * FROM glb),
{base['restrict_and_grid'].replace('FROM s5 WHERE', 'FROM s5g WHERE')}"""


@register("scenario_extended", _extended_sql())
def q_scenario_extended(spark, sf):
    store = proxy_store(Tables(spark, sf)).materialize()
    return run_scenario(store, M.PROXY_PARAMS, leaf_digits=6, extensions=_extension_inputs(spark, store)).scores
