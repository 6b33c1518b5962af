"""Ordered results: the reports and listings that come sorted, with the place of each
row as ``pos``. The oracles number the rows of the unordered queries' oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import access
from ledgerline.operators.ordering import with_position
from ledgerline.plans import drift_plans, snapshot_plans, tieout_plans  # noqa: F401  (their queries come first)
from ledgerline.plans.registry import ORACLES, PLANS, register
from ledgerline.sources.fixtures import fixture, oracle_cte


def _ordered(query: str, *order: str) -> None:
    """Register ``query``_ordered: ``query`` in the order of ``order`` ("column" or
    "column desc"), nulls first."""
    sql = ", ".join(f"{o} nulls first" for o in order)

    def plan(spark, sf_dir):
        keys = [F.desc_nulls_first(o.split()[0]) if o.endswith(" desc") else F.asc_nulls_first(o) for o in order]
        return with_position(PLANS[query](spark, sf_dir), *keys)

    plan.__doc__ = f"The rows of {query}, ordered by {', '.join(order)}."
    register(f"{query}_ordered", f"select *, row_number() over (order by {sql}) as pos from ({ORACLES[query]}) unordered")(plan)


_ordered("sum_overview", "name")
_ordered("sum_column", "name", "col_nm")
_ordered("sum_detail", "col_diff_cnt desc", "name", "col_nm", "from_val", "to_val")
_ordered("schema_list", "database_name", "schema_name desc")
_ordered("copy_base_tables", "table_catalog", "table_schema", "table_name")
_ordered("copy_refresh_plan", "table_name", "clone_db_sc", "src_db_sc")


@register("grant_schemas_ordered", oracle_cte("schemata") + """
select catalog_name, schema_name, row_number() over (order by catalog_name, schema_name) as pos
  from schemata
 where schema_owner not in ('ACCOUNTADMIN') and schema_name not like '%-%' and deleted is null
   and schema_name not in ('INTERNAL', 'PUBLIC', 'INFORMATION_SCHEMA') and catalog_name not in ('DEMO_DB')""")
def grant_schemas_ordered(spark, sf_dir):
    """The schemas whose future grants are materialised, in order."""
    kept = access.grant_schemas(fixture(spark, sf_dir, "schemata")).select("catalog_name", "schema_name")
    return with_position(kept, "catalog_name", "schema_name")
