"""Staged views: the field-survey shapes laid over the star-schema tables.

Each view is a list of SQL expressions that Spark and DuckDB read alike, so the query and its
oracle share one definition. Literals are doubles (``2e0``), never decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.runtime import table

#: view: (table, expressions, filter)
VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    # one field event, with the columns that each evidence class reads
    "field_event": (
        "events",
        [
            "event_id",
            "user_id",
            "event_type",
            "value",
            "case when event_type in ('purchase', 'click') then value end as mass_kg",
            "case when event_type in ('click', 'view') then event_id % 50 end as pieces",
            "case when event_type = 'view' then abs(value) % 100e0 end as cover_pct",
            "case when event_type = 'signup' then value end as grid_kg_m2",
            "case when event_type in ('error', 'purchase') then abs(value) % 3e0 end as grade_pct",
        ],
        None,
    ),
    # one record of one evidence class
    "record": (
        "events",
        [
            "event_id as seq",
            "case event_type when 'purchase' then 'MASS' when 'click' then 'COUNT' when 'view' then 'COVER' when 'signup' then 'GRID' else 'GRADE' end as evidence_class",
            "case when event_id % 11 = 0 then null else value end as abundance_value_original",
            "case event_id % 3 when 0 then 'kg_m2' when 1 then ' KG/m2 ' else 'kg' end as abundance_unit_original",
            "case when event_id % 7 = 0 then null else value end as nodule_mass_kg",
            "case when event_id % 13 = 0 then 0e0 when event_id % 5 = 0 then null else 0.25e0 * (1 + event_id % 4) end as sampled_area_m2",
            "case when event_id % 6 = 0 then null else (event_id % 40) * 1e0 end as nodule_density_m2",
            "case when event_id % 10 = 0 then null else 5e0 + event_id % 60 end as mean_nodule_mass_g",
            "case when event_id % 17 = 0 then null else abs(value) % 120e0 end as visible_cover_percent",
            "cast(null as string) as derivation_formula",
            "case when event_id % 19 = 0 then 'fail' when event_id % 23 = 0 then 'pass' else 'pending' end as qa_status",
            "event_id % 9 <> 0 as is_open",
            "'observed' as observation_or_prediction",
        ],
        None,
    ),
    "station": (
        "customer",
        [
            "c_custkey as id",
            "c_nationkey as site",
            "-125e0 + (c_nationkey % 5) * 2e0 + ((c_custkey * 7919) % 1009) / 5000e0 as lon",
            "10e0 + floor(c_nationkey / 5e0) * 2e0 + ((c_custkey * 104729) % 997) / 5000e0 as lat",
            "c_acctbal as y",
            "c_mktsegment as cruise",
        ],
        None,
    ),
    # a small station table for pair statistics
    "outpost": (
        "supplier",
        [
            "s_suppkey as id",
            "s_nationkey as site",
            "-125e0 + (s_nationkey % 5) * 0.4e0 + ((s_suppkey * 7919) % 1009) / 5000e0 as lon",
            "10e0 + floor(s_nationkey / 5e0) * 0.4e0 + ((s_suppkey * 104729) % 997) / 5000e0 as lat",
            "s_acctbal as y",
        ],
        None,
    ),
    "cell": (
        "part",
        [
            "cast(floor(p_partkey / 50e0) as int) as i",
            "cast(p_partkey % 50 as int) as j",
            "-4000e0 - 8e0 * p_size as z",
        ],
        None,
    ),
    "sampling": (
        "lineitem",
        ["l_orderkey as event", "l_linenumber as nth", "l_quantity as mass_g", "l_returnflag as flag", "l_partkey", "l_extendedprice"],
        None,
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, condition = VIEWS[name]
    df = table(spark, sf_dir, source)
    if condition:
        df = df.filter(condition)
    return df.selectExpr(*columns)


def sql(name: str) -> str:
    """The view as a subquery of DuckDB's."""
    source, columns, condition = VIEWS[name]
    return f"(select {', '.join(columns)} from {source}{f' where {condition}' if condition else ''})"
