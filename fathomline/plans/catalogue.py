"""Queries of the library's own operators over the staged views, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.geodesy import covered, haversine_km
from fathomline.operators import contracts, geo, grid, ingest, matrix, merge, models, pairs, polygons, provenance, surfaces, validation
from fathomline.plans.staging import sql, view
from fathomline.runtime import materialise, scratch, table
from fathomline.sources import adapters, rasters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WEST, NORTH, RES = -125.0, 20.0, 0.01
EDGES = [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 20.0, 40.0]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def r6(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c), digits).alias(c)


# ---------------------------------------------------------------- ingest

FANNED = {"MASS": "mass_kg", "COUNT": "pieces", "COVER": "cover_pct", "GRID": "grid_kg_m2", "GRADE": "grade_pct"}


@query(
    "select event_id, user_id, evidence_class, cast(measured as double) as measured,"
    " printf('src_events_%s_%06d', lower(evidence_class), event_id) as source_record_id from ("
    + " union all ".join(f"select event_id, user_id, '{c}' as evidence_class, {p} as measured from {sql('field_event')}" for c, p in FANNED.items())
    + ") where measured is not null"
)
def evidence_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.fan_out(view(spark, sf_dir, "field_event"), "src_events", "event_id", FANNED, ["user_id"])


_NORMAL = f"""
select *, case
    when is_ready or evidence_class = 'GRID' then abundance_value_original
    when is_divided then nodule_mass_kg / sampled_area_m2
    when is_counted then nodule_density_m2 * mean_nodule_mass_g / 1000 end as abundance_kg_m2,
  case when is_ready or is_divided then 'A' when is_counted or evidence_class in ('COVER', 'GRADE') then 'B'
    when evidence_class = 'GRID' then 'C' end as quality_grade,
  case when is_ready then 'unknown' end as abundance_basis,
  case when evidence_class = 'GRID' then 'compiled' else 'observed' end as origin,
  case when evidence_class = 'MASS' and sampled_area_m2 <= 0 then 'fail' else qa_status end as status
from (select *, evidence_class = 'MASS' and lower(trim(abundance_unit_original)) in ('kg_m2', 'kg/m2')
        and abundance_value_original is not null as is_ready,
      evidence_class = 'MASS' and nodule_mass_kg is not null and coalesce(sampled_area_m2 > 0, false) as is_divided,
      evidence_class = 'COUNT' and nodule_density_m2 is not null and mean_nodule_mass_g is not null as is_counted
      from {sql("record")})
"""
_SCREENED = f"""
select *, case when coalesce(abundance_kg_m2 < 0 or abundance_kg_m2 > 45, false) and (status is null or status in ('pending', 'pass'))
  then 'flagged' else status end as screened from ({_NORMAL})
"""


@query(f"select seq, evidence_class, abundance_kg_m2, quality_grade, abundance_basis, origin, status from ({_NORMAL})")
def normalize_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalise(view(spark, sf_dir, "record")).select(
        "seq", "evidence_class", "abundance_kg_m2", "quality_grade", "abundance_basis",
        F.col("observation_or_prediction").alias("origin"), F.col("qa_status").alias("status"),
    )


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.screen(ingest.normalise(view(spark, sf_dir, "record")))


@query(f"select seq, evidence_class, abundance_kg_m2, screened as qa_status from ({_SCREENED})")
def screening_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).select("seq", "evidence_class", "abundance_kg_m2", "qa_status")


_ELIGIBLE = f"select * from ({_SCREENED}) where evidence_class = 'MASS' and abundance_kg_m2 is not null and is_open and screened not in ('fail', 'flagged')"


@query(f"select seq, abundance_kg_m2, quality_grade from ({_ELIGIBLE})")
def training_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.eligible(_screened(spark, sf_dir)).select("seq", "abundance_kg_m2", "quality_grade")


@query(
    f"select evidence_class, screened as qa_status, count(*) as n, count(abundance_kg_m2) as with_value,"
    f" round(sum(abundance_kg_m2), 4) as total from ({_SCREENED}) group by all"
)
def class_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).groupBy("evidence_class", "qa_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("abundance_kg_m2").alias("with_value"), F.round(F.sum("abundance_kg_m2"), 4).alias("total")
    )


@query(f"""
select seq, array_to_string(list_sort(list_filter([
    case when cover > 100 then 'range:visible_cover_percent' end,
    case when abundance_kg_m2 < 0 or abundance_kg_m2 > 100 then 'range:abundance_kg_m2' end,
    case when nodule_mass_kg < 0 then 'range:nodule_mass_kg' end,
    case when evidence_class in ('COVER', 'GRADE') and abundance_kg_m2 is not null then 'rule:no_abundance' end,
    case when evidence_class = 'COUNT' and abundance_kg_m2 is not null and mean_nodule_mass_g is null then 'rule:count_needs_mean' end,
    case when evidence_class = 'GRID' then 'rule:grid_not_observed' end], lambda x: x is not null)), ',') as violations
from (select *, visible_cover_percent as cover, abundance_value_original as abundance_kg_m2 from {sql("record")})
""")
def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "record").withColumn("abundance_kg_m2", F.col("abundance_value_original"))
    return rows.select("seq", F.array_join(ingest.violations(rows), ",").alias("violations"))


@query(f"""
select event, count(mass) as weighed_count, cast(coalesce(sum(extra), 0) as bigint) as unweighed_count,
  count(mass) + cast(coalesce(sum(extra), 0) as bigint) as nodule_count, round(sum(mass), 4) as mass_g,
  round(sum(mass) / nullif(count(mass), 0), 6) as mean_mass_g,
  (count(mass) + cast(coalesce(sum(extra), 0) as bigint)) / 0.25e0 as density_m2
from (select event, case when flag = 'R' then null else mass_g end as mass, case when flag = 'R' then nth else 0 end as extra
      from {sql("sampling")}) group by event
""")
def event_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "sampling").select("event", "flag", "nth", F.when(F.col("flag") != "R", F.col("mass_g")).alias("mass_g"))
    out = ingest.nested_to_events(rows, "event", "mass_g", F.when(F.col("flag") == "R", F.col("nth")).otherwise(0), 0.25)
    return out.select("event", "weighed_count", "unweighed_count", "nodule_count", r6("mass_g", 4), r6("mean_mass_g"), "density_m2")


_LICENCE = "case r_regionkey % 3 when 0 then 'CC-BY-4.0' when 1 then 'cc-by-nc-4.0' else 'Non-Commercial use' end"


@query(f"""
select r_name as source, licence, coalesce(regexp_matches(upper(licence), '-NC-|NONCOMMERCIAL|NON-COMMERCIAL'), false) as non_commercial,
  count(*) as stations, round(avg(y), 6) as mean_y
from {sql("station")} s join nation on site = n_nationkey
join (select r_regionkey, r_name, {_LICENCE} as licence from region) on n_regionkey = r_regionkey group by all
""")
def source_join_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "region").selectExpr("r_regionkey", "r_name as source", f"{_LICENCE} as licence")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    per_site = view(spark, sf_dir, "station").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    # stations are summed by site before the lookups; both lookups are dimension tables left to the planner
    return (
        per_site.join(nation, F.col("site") == F.col("n_nationkey")).join(source, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("source", "licence").agg(F.sum("n").alias("stations"), (F.sum("s") / F.sum("n")).alias("mean_y"))
        .select("source", "licence", ingest.non_commercial(F.col("licence")).alias("non_commercial"), "stations", r6("mean_y"))
    )


_ORIGIN = "case when y < 0 then 'SYNTHETIC' when y < 5000 then 'LITERATURE' when y < 9000 then 'DERIVED' else 'MEASURED' end"


@query(f"""
select site, ['MEASURED', 'DERIVED', 'LITERATURE', 'SYNTHETIC', 'AUTHORED'][cast(max(rank) + 1 as int)] as origin, count(*) as rows_combined
from (select site, case origin when 'MEASURED' then 0 when 'DERIVED' then 1 when 'LITERATURE' then 2 when 'SYNTHETIC' then 3 else 4 end as rank
      from (select site, {_ORIGIN} as origin from {sql("outpost")})) group by site
""")
def origin_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "outpost").selectExpr("site", f"{_ORIGIN} as origin").withColumn("rank", ingest.origin_rank(F.col("origin")))
    return rows.groupBy("site").agg(ingest.least_real(F.col("rank")).alias("origin"), F.count(F.lit(1)).alias("rows_combined"))


# ---------------------------------------------------------------- duplicates

TOL = 0.01
#: The corpus holds the odd stations, the batch the even ones; both are one evidence class.
_RECORD = (
    "select id as seq, concat('r', cast(id as string)) as source_record_id, concat('src_', cast(id % 3 as string)) as source_id,"
    " 'MASS' as evidence_class, lon as longitude, lat as latitude, case when id % 4 = 0 then null else cruise end as cruise,"
    " case when y < 0 then null else y end as abundance_kg_m2, case when id % 5 = 0 then null else y end as water_depth_m,"
    " case id % 3 when 0 then 'A' when 1 then 'B' else 'C' end as quality_grade,"
    " case when id % 29 = 0 then 'fail' when id % 13 = 0 then 'flagged' else 'pending' end as qa_status,"
    " cast(null as string) as duplicate_group_id, cast(null as string) as notes"
)


def _records(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    return view(spark, sf_dir, "station").selectExpr(*_split(_RECORD)).filter(F.col("seq") % 2 == int(odd))


def _split(select: str) -> list[str]:
    """The columns of a select list, cut at commas outside brackets."""
    parts, depth, at = [], 0, ""
    for ch in select.removeprefix("select "):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(at)
            at = ""
        else:
            at += ch
    return [*parts, at]


_BOTH = f"with rec as ({_RECORD} from {sql('station')}), corpus as (select * from rec where seq % 2 = 1), batch as (select * from rec where seq % 2 = 0)"
_MATCH = (
    f"{_BOTH}, met as (select b.seq as l, c.seq as r from batch b join corpus c on abs(b.longitude - c.longitude) <= {TOL}e0"
    f" and abs(b.latitude - c.latitude) <= {TOL}e0 and (b.cruise is null or c.cruise is null or b.cruise = c.cruise)),"
    " first as (select l, min(r) as r from met group by l)"
)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_match(
        _records(spark, sf_dir, False), _records(spark, sf_dir, True), {"longitude": TOL, "latitude": TOL},
        key="seq", order="seq", equal=["evidence_class"], tolerant_on=["cruise"],
    )


@query(f"with s as {sql('station')} select a.id as a, b.id as b from s a join s b on a.id < b.id and abs(a.lon - b.lon) <= {TOL}e0 and abs(a.lat - b.lat) <= {TOL}e0")
def band_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "station").select("id", "lon", "lat")
    return geo.band_join(s, s, {"lon": TOL, "lat": TOL}).filter("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


_RANK = "case {0}.quality_grade when 'A' then 3 when 'B' then 2 when 'C' then 1 else 0 end"


@query(f"""{_MATCH} select b.seq as candidate, c.seq as slot, case when c.seq is null then 'Admit'
  when b.source_id = c.source_id and b.source_record_id = c.source_record_id then 'AlreadyPresent'
  when {_RANK.format('b')} > {_RANK.format('c')} then 'Replace' else 'AbsorbInto' end as disposition
from batch b left join first on b.seq = l left join corpus c on r = c.seq""")
def dedup_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(F.col("l_seq").alias("candidate"), F.col("r_seq").alias("slot"), merge.disposition().alias("disposition"))


_SEV = "case {0}.qa_status when 'fail' then 2 when 'flagged' then 1 else 0 end"


@query(f"""{_MATCH} select d.seq as candidate, s.seq as slot, coalesce(s.cruise, d.cruise) as cruise,
  coalesce(s.abundance_kg_m2, d.abundance_kg_m2) as abundance_kg_m2, coalesce(s.water_depth_m, d.water_depth_m) as water_depth_m,
  case when {_SEV.format('d')} > {_SEV.format('s')} then d.qa_status else s.qa_status end as qa_status,
  concat('dupgrp_', s.source_record_id) as duplicate_group_id,
  array_to_string(list_filter([case when s.abundance_kg_m2 is null and d.abundance_kg_m2 is not null then 'abundance_kg_m2' end,
    case when s.cruise is null and d.cruise is not null then 'cruise' end,
    case when s.water_depth_m is null and d.water_depth_m is not null then 'water_depth_m' end], lambda x: x is not null), ', ') as donated
from first join batch d on d.seq = l join corpus s on s.seq = r where {_RANK.format('d')} <= {_RANK.format('s')}""")
def merge_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir).withColumn("disposition", merge.disposition()).filter("disposition = 'AbsorbInto'")
    fields = [c[2:] for c in m.columns if c.startswith("l_") and c != "l_seq"]
    out = merge.merge_rows("r_", "l_", fields)
    return m.select(
        F.col("l_seq").alias("candidate"), F.col("r_seq").alias("slot"), out["cruise"].alias("cruise"),
        out["abundance_kg_m2"].alias("abundance_kg_m2"), out["water_depth_m"].alias("water_depth_m"), out["qa_status"].alias("qa_status"),
        out["duplicate_group_id"].alias("duplicate_group_id"), F.array_join(out["donated_fields"], ", ").alias("donated"),
    )


@query(f"""{_MATCH}, disposed as (select b.source_id, case when c.seq is null then 'Admit'
  when {_RANK.format('b')} > {_RANK.format('c')} then 'Replace' else 'AbsorbInto' end as d
  from batch b left join first on b.seq = l left join corpus c on r = c.seq)
select source_id, count(*) as adapted, cast(count(*) filter (d in ('Admit', 'Replace')) as bigint) as admitted,
  cast(count(*) filter (d = 'AbsorbInto') as bigint) as absorbed, cast(0 as bigint) as already_present,
  count(*) = count(*) filter (d in ('Admit', 'Replace')) + count(*) filter (d = 'AbsorbInto') as reconciles
from disposed group by source_id""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _matched(spark, sf_dir).select(F.col("l_source_id").alias("source_id"), merge.disposition().alias("d"))
    out = d.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("adapted"), F.count_if(F.col("d").isin("Admit", "Replace")).alias("admitted"),
        F.count_if(F.col("d") == "AbsorbInto").alias("absorbed"), F.count_if(F.col("d") == "AlreadyPresent").alias("already_present"),
    )
    return out.withColumn("reconciles", F.col("adapted") == F.col("admitted") + F.col("absorbed") + F.col("already_present"))


# ---------------------------------------------------------------- geometry

_KM = (
    "2e0 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin((radians({1}.lat) - radians({0}.lat)) / 2), 2)"
    " + cos(radians({0}.lat)) * cos(radians({1}.lat)) * pow(sin((radians({1}.lon) - radians({0}.lon)) / 2), 2))))"
)
_PAIRS = f"select a.id as a, b.id as b, a.site as sa, b.site as sb, {_KM.format('a', 'b')} as km, 0.5e0 * (a.y - b.y) * (a.y - b.y) as half_sq from o a join o b on a.id < b.id"
_OUT = f"with o as {sql('outpost')}, pairs as ({_PAIRS})"


@query(f"select count(*) as stations, round(min(lon), 9) as west, round(max(lon), 9) as east, round(min(lat), 9) as south, round(max(lat), 9) as north, count(distinct (lon, lat)) as locations from {sql('station')}")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "station").agg(
        F.count(F.lit(1)).alias("stations"), F.round(F.min("lon"), 9).alias("west"), F.round(F.max("lon"), 9).alias("east"),
        F.round(F.min("lat"), 9).alias("south"), F.round(F.max("lat"), 9).alias("north"), F.count_distinct("lon", "lat").alias("locations"),
    )


@query(f"{_OUT} select count(*) as pairs, round(min(km), 4) as min_km, round(max(km), 4) as max_km, round(avg(km), 4) as mean_km, cast(count(*) filter (km <= 20e0) as bigint) as within_20 from pairs")
def pairwise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairs.distances(view(spark, sf_dir, "outpost"), 20.0)
    return got.select("pairs", r6("min_km", 4), r6("max_km", 4), r6("mean_km", 4), F.col("near").alias("within_20"))


RING = [(-124.95, 10.02), (-122.5, 10.1), (-121.0, 14.0), (-123.0, 16.0), (-124.95, 13.5), (-124.95, 10.02)]


def _ring_sql() -> str:
    odd = " + ".join(
        f"case when ({y1}e0 > lat) <> ({y2}e0 > lat) and lon < ({x2}e0 - ({x1}e0)) * (lat - {y1}e0) / ({y2}e0 - {y1}e0) + ({x1}e0) then 1 else 0 end"
        for (x1, y1), (x2, y2) in zip(RING, RING[1:], strict=False)
        if y1 != y2
    )
    return f"({odd}) % 2 = 1"


@query(f"select site, count(*) as stations, cast(count(*) filter ({_ring_sql()}) as bigint) as inside from {sql('station')} group by site")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = covered(F.col("lon"), F.col("lat"), RING)
    return view(spark, sf_dir, "station").groupBy("site").agg(F.count(F.lit(1)).alias("stations"), F.count_if(inside).alias("inside"))


LINK_KM = 2.0
#: Closeness is found by cells, then components spread by the smallest id, as the query does.
_LINKED = f"""with recursive o as {sql('outpost')}, link as (
  select a.id as a, b.id as b from o a join o b on a.id <> b.id and abs(a.lat - b.lat) <= 0.019e0 and {_KM.format('a', 'b')} <= {LINK_KM}e0),
reach(id, seen) as (select id, id from o union select l.b, seen from reach join link l on l.a = reach.id),
label as (select id, min(seen) as cluster from reach group by id)"""


@query(f"{_LINKED} select id, cluster from label")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.single_linkage(view(spark, sf_dir, "outpost"), LINK_KM)


@query(f"""{_LINKED} select cluster, count(*) as members, round(avg(lon), 6) as lon, round(avg(lat), 6) as lat,
  round(max(lon) - min(lon), 9) as width, round(max(lat) - min(lat), 9) as height from label join o using (id) group by cluster""")
def cluster_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "outpost")
    return geo.single_linkage(o, LINK_KM).join(o, "id").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"),
        F.round(F.max("lon") - F.min("lon"), 9).alias("width"), F.round(F.max("lat") - F.min("lat"), 9).alias("height"),
    )


# ---------------------------------------------------------------- terrain

_METRIC = f"(select *, {NORTH}e0 - (i + 0.5e0) * {RES}e0 as lat, {RES}e0 * 111320e0 * cos(radians({NORTH}e0 - (i + 0.5e0) * {RES}e0)) as dx, {RES}e0 * 111320e0 as dy from {sql('cell')})"
_NEAR = f"""(select c.i, c.j, c.z, c.dx, c.dy, nw.z as nw, n.z as n, ne.z as ne, w.z as w, e.z as e, sw.z as sw, s.z as s, se.z as se from {_METRIC} c
""" + "".join(
    f" left join {sql('cell')} {k} on {k}.i = c.i + ({di}) and {k}.j = c.j + ({dj})"
    for k, (di, dj) in {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}.items()
) + ")"
_SLOPE = f"""(select i, j, z, dx, dy, degrees(atan(sqrt(p * p + q * q))) as slope, case when p = 0 and q = 0 then -1e0
  when degrees(atan2(-p, -q)) < 0 then degrees(atan2(-p, -q)) + 360e0 else degrees(atan2(-p, -q)) end as aspect
from (select *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * dx) as p, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / (8 * dy) as q from {_NEAR}))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.metric(view(spark, sf_dir, "cell"), NORTH, RES)


@query(f"select i, j, round(slope, 9) as slope, round(aspect, 6) as aspect from {_SLOPE}")
def terrain_slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.slope_aspect(grid.gather(_cells(spark, sf_dir))).select("i", "j", r6("slope", 9), r6("aspect"))


@query(f"""select i, j, round(1e6 * case when den is null then null when den = 0 then 0e0 else -(r * p * p + 2 * t2 * p * q + t * q * q) / den end, 6) as profile_curvature,
  round(1e6 * case when den is null then null when den = 0 then 0e0 else -(t * p * p - 2 * t2 * p * q + r * q * q) / den end, 6) as plan_curvature
from (select *, (p * p + q * q) + 0 * (nw + ne + sw + se) as den from (select *, (e - w) / (2 * dx) as p, (n - s) / (2 * dy) as q,
  (e - 2 * z + w) / (dx * dx) as r, (n - 2 * z + s) / (dy * dy) as t, (ne - nw - se + sw) / (4 * dx * dy) as t2 from {_NEAR}))""")
def terrain_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.curvature(grid.gather(_cells(spark, sf_dir)))
    return out.select("i", "j", *(F.round(F.col(c) * 1e6, 6).alias(c) for c in ("profile_curvature", "plan_curvature")))


def _square(side: int) -> str:
    h = side // 2
    return f"(select c.i, c.j, c.z, count(k.z) as m, avg(k.z + 4200e0) - 4200e0 as mean, stddev_pop(k.z) as sd from {sql('cell')} c join {sql('cell')} k on k.i between c.i - {h} and c.i + {h} and k.j between c.j - {h} and c.j + {h} group by c.i, c.j, c.z)"


@query(f"select i, j, round(case when m = 25 then sd end, 6) as roughness, round(case when m = 25 then z - mean end, 6) as tpi from {_square(5)}")
def terrain_roughness_tpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.square_moments(view(spark, sf_dir, "cell"), 5).select("i", "j", r6("roughness"), r6("tpi"))


@query(f"""select i, j, round(case when m = {grid.ring_size(2, 4)} then z - mean end, 6) as bpi from (
  select c.i, c.j, c.z, count(k.z) as m, avg(k.z) as mean from {sql('cell')} c left join {sql('cell')} k on k.i between c.i - 4 and c.i + 4
  and k.j between c.j - 4 and c.j + 4 and (k.i - c.i) * (k.i - c.i) + (k.j - c.j) * (k.j - c.j) between 4 and 16 group by c.i, c.j, c.z)""")
def terrain_bpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bpi(view(spark, sf_dir, "cell"), 2, 4).select("i", "j", r6("bpi"))


def _ring(inner: int, outer: int) -> str:
    return f"""(select i, j, case when m = {grid.ring_size(inner, outer)} then z - mean end as bpi from (
  select c.i, c.j, c.z, count(k.z) as m, avg(k.z) as mean from {sql('cell')} c left join {sql('cell')} k on k.i between c.i - {outer} and c.i + {outer}
  and k.j between c.j - {outer} and c.j + {outer} and (k.i - c.i) * (k.i - c.i) + (k.j - c.j) * (k.j - c.j) between {inner * inner} and {outer * outer} group by c.i, c.j, c.z))"""


@query(f"""select i, j, z as depth, round(slope, 9) as slope, round(aspect, 6) as aspect, round(case when m = 9 then sd end, 6) as roughness,
  round(case when m = 9 then q.z - mean end, 6) as tpi, round(bpi, 6) as bpi
from {_square(3)} q join (select i, j, slope, aspect from {_SLOPE}) using (i, j) join {_ring(1, 3)} using (i, j)""")
def terrain_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = grid.stack(_cells(spark, sf_dir))
    return layers.select("i", "j", "depth", r6("slope", 9), *(r6(c) for c in ("aspect", "roughness", "tpi", "bpi")))


_PLACED = f"(select id, y, cast(floor((20e0 - lat) / 0.05e0) as int) as i, cast(floor((lon - (-125e0)) / 0.2e0) as int) as j from {sql('station')})"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "station")
    return s.select("id", "y", geo.cell_of(F.col("lon"), F.col("lat"), WEST, NORTH, 0.05)[0].alias("i"), geo.cell_of(F.col("lon"), F.col("lat"), WEST, NORTH, 0.2)[1].alias("j"))


@query(f"select id, p.i, p.j, z, round(slope, 9) as slope, slope is null as missing from {_PLACED} p join {_SLOPE} t on p.i = t.i and p.j = t.j")
def station_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = grid.slope_aspect(grid.gather(_cells(spark, sf_dir))).select("i", "j", "z", "slope")
    return _placed(spark, sf_dir).join(layers, ["i", "j"]).select("id", "i", "j", "z", r6("slope", 9), F.col("slope").isNull().alias("missing"))


@query(f"select i, j, count(*) as stations, min(id) as first_id, max(id) as last_id, count(*) >= 2 as is_shared from {_PLACED} group by i, j")
def cell_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("stations"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), (F.count(F.lit(1)) >= 2).alias("is_shared")
    )


@query(f"select id, i, j from {_PLACED} p where not exists (select 1 from {sql('cell')} c where c.i = p.i and c.j = p.j)")
def off_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).join(view(spark, sf_dir, "cell"), ["i", "j"], "left_anti").select("id", "i", "j")


# ---------------------------------------------------------------- folds and scores

@query(f"select site as label, count(*) as test_rows, cast(sum(count(*)) over () - count(*) as bigint) as train_rows from {sql('station')} group by site")
def folds_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = view(spark, sf_dir, "station").groupBy(F.col("site").alias("label")).agg(F.count(F.lit(1)).alias("test_rows"))
    total = part.agg(F.sum("test_rows").alias("n"))
    return part.join(F.broadcast(total), F.lit(True)).select("label", "test_rows", (F.col("n") - F.col("test_rows")).alias("train_rows"))


@query(f"select id, id as label from {sql('station')}")
def folds_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "station").select("id", F.col("id").alias("label"))


@query(f"select id, cast((row_number() over (order by md5(concat('7:', cast(id as string)))) - 1) % 5 as int) as label from {sql('station')}")
def folds_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.random_folds(view(spark, sf_dir, "station").select("id"), 5, 7).select("id", "label")


@query(f"""{_OUT}, near as (select fold, min(km) as km from (select sa as fold, km from pairs where sa <> sb and km <= 30e0 union all
  select sb, km from pairs where sa <> sb and km <= 30e0) group by fold)
select site as fold, count(*) as test_rows, round(any_value(km), 6) as min_km from o left join near on site = fold group by site""")
def fold_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.fold_separation(view(spark, sf_dir, "outpost"), "site", 30.0).select("fold", "test_rows", r6("min_km"))


@query(f"""{_OUT}, near as (select fold, min(km) as km from (select sa as fold, km from pairs where sa <> sb union all
  select sb, km from pairs where sa <> sb) group by fold)
select site as fold, count(*) as test_rows, round(any_value(km), 6) as min_km from o left join near on site = fold group by site""")
def fold_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.fold_distance(view(spark, sf_dir, "outpost"), "site", 30.0).select("fold", "test_rows", r6("min_km"))


_BASE = f"""(select f.site as fold, s.id, s.y, m.prediction, m.sd from {sql('station')} s join (
  select t.site, avg(y) as prediction, stddev_samp(y) as sd from (select distinct site from {sql('station')}) t join {sql('station')} u on u.site <> t.site group by t.site
) m on s.site = m.site join (select distinct site from {sql('station')}) f on f.site = s.site)"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "station").select("id", "y", F.col("site").alias("label"))
    fit = validation.mean_baseline(rows)
    return rows.join(fit, F.col("label") == F.col("fold")).select("fold", "id", "y", "prediction", "sd")


@query(f"select fold, count(*) as n, round(any_value(prediction), 6) as prediction, round(any_value(sd), 6) as sd from {_BASE} group by fold")
def baseline_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.any_value("prediction"), 6).alias("prediction"), F.round(F.any_value("sd"), 6).alias("sd")
    )


#: A second estimator to compare: the mean of the other rows of the same segment, with the baseline's sd.
_MODELS = f"""(select 'baseline' as estimator, fold, id, y, prediction, sd from {_BASE} union all
  select 'segment', b.fold, b.id, b.y, g.prediction, b.sd from {_BASE} b join {sql('station')} s on s.id = b.id join (
    select t.site, u.cruise, avg(u.y) as prediction from (select distinct site from {sql('station')}) t join {sql('station')} u on u.site <> t.site group by all
  ) g on g.site = b.fold and g.cruise = s.cruise)"""
_SCORES = """count(*) as n, round(sqrt(avg((prediction - y) * (prediction - y))), 6) as rmse, round(avg(abs(prediction - y)), 6) as mae,
  round(avg(prediction - y), 6) as mean_error, round(avg(case when abs(prediction - y) <= sd then 1e0 else 0e0 end), 9) as coverage_1sigma,
  round(sqrt(avg((prediction - y) / sd * (prediction - y) / sd)), 9) as standardized_rmse,
  round(case when count(*) >= 2 and max(y) > min(y) then 1 - sum((prediction - y) * (prediction - y)) / (var_pop(y) * count(*)) end, 9) as r2_pooled"""


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _baseline(spark, sf_dir)
    s = view(spark, sf_dir, "station").select("id", "site", "cruise", "y")
    part = s.groupBy("site", "cruise").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    whole = part.groupBy("cruise").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    segment = part.join(whole, "cruise").filter("tn > n").select(F.col("site").alias("fold"), "cruise", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("p"))
    other = base.join(s.select("id", "cruise"), "id").join(segment, ["fold", "cruise"]).select(F.lit("segment").alias("estimator"), "fold", "id", "y", F.col("p").alias("prediction"), "sd")
    return base.select(F.lit("baseline").alias("estimator"), "fold", "id", "y", "prediction", "sd").unionByName(other)


def _rounded(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, "n", *(r6(c) for c in ("rmse", "mae", "mean_error")), *(r6(c, 9) for c in ("coverage_1sigma", "standardized_rmse", "r2_pooled")))


@query(f"select estimator, fold, {_SCORES} from {_MODELS} group by estimator, fold")
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(validation.scores(_estimates(spark, sf_dir), ["estimator", "fold"]), ["estimator", "fold"])


@query(f"select estimator, {_SCORES} from {_MODELS} group by estimator")
def cv_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(validation.scores(_estimates(spark, sf_dir), ["estimator"]), ["estimator"])


@query(f"""with s as (select estimator, fold, count(*) as n, sqrt(avg((prediction - y) * (prediction - y))) as rmse from {_MODELS} group by all)
select a.fold, a.estimator, round(a.rmse, 6) as rmse, round(b.rmse, 6) as baseline_rmse, round(b.rmse - a.rmse, 6) as rmse_uplift, round(a.rmse / b.rmse, 9) as rmse_ratio
from s a join s b on a.fold = b.fold and b.estimator = 'baseline' where a.estimator <> 'baseline'""")
def cv_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = validation.uplift(validation.scores(_estimates(spark, sf_dir), ["estimator", "fold"]), ["fold"], "baseline")
    return got.select("fold", "estimator", r6("rmse"), r6("baseline_rmse"), r6("rmse_uplift"), r6("rmse_ratio", 9))


# ---------------------------------------------------------------- variogram and kriging

_BINS = "(select * from (values " + ", ".join(f"({k}, {a}e0, {b}e0)" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + ") t(bin, lo, hi))"


def _variogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.point_variogram(view(spark, sf_dir, "outpost"), EDGES)


@query(f"""{_OUT} select bin, lo as lag_lo_km, hi as lag_hi_km, count(km) as pair_count, round(avg(half_sq), 2) as semivariance, round(avg(km), 6) as mean_lag_km
from {_BINS} left join pairs on km >= lo and km < hi group by bin, lo, hi""")
def variogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _variogram(spark, sf_dir)
    return got.select("bin", "lag_lo_km", "lag_hi_km", "pair_count", r6("semivariance", 2), r6("mean_lag_km"))


@query(f"""{_OUT}, bins as (select avg(half_sq) as g, avg(km) as h, cast(count(*) as double) as w from {_BINS} join pairs on km >= lo and km < hi
  where hi <= 40e0 group by bin having count(*) >= 10),
fit as (select c, a, sum(w) as w, sum(w * s) as s, sum(w * g) as g, sum(w * s * s) as ss, sum(w * s * g) as sg, sum(w * g * g) as gg from (
  select c, a, w, g, 1 - exp(-3 * h / a) as s from bins, (select range as c, 0.05e0 * top * pow(40e0, cast(range as double) / 199e0) as a
    from range(200), (select max(h) as top from bins))) group by c, a),
one as (select *, (w * sg - s * g) / (w * ss - s * s) as p0, (g - (w * sg - s * g) / (w * ss - s * s) * s) / w as n0 from fit),
two as (select *, case when n0 < 0 then greatest(0e0, sg / ss) else p0 end as p1, greatest(n0, 0e0) as n1 from one),
three as (select *, case when p1 < 0 then g / w else n1 end as n, greatest(p1, 0e0) as p from two),
four as (select *, gg - 2 * n * g - 2 * p * sg + n * n * w + 2 * n * p * s + p * p * ss as sse from three)
select round(n / 1e3, 2) as nugget, round(p / 1e3, 2) as partial_sill, round(case when p > 0 then a else 0e0 end, 4) as range_km from four order by sse, c limit 1""")
def variogram_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = models.variogram_fit(_variogram(spark, sf_dir), max_lag=40.0, min_pairs=10)
    return fit.select(F.round(F.col("nugget") / 1e3, 2).alias("nugget"), F.round(F.col("partial_sill") / 1e3, 2).alias("partial_sill"), r6("range_km", 4))


@query()
def kriging_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "outpost").select("id", "lon", "lat", "y", (F.col("site") % 5).alias("label"))
    return models.kriging_cv(rows, [float(e) for e in range(0, 320, 20)])


@query()
def kriging_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "cell").select("i", "j", (F.lit(-125.0) + F.col("j") * 0.04).alias("lon"), (F.lit(10.0) + (F.col("i") % 50) * 0.04).alias("lat"))
    return models.kriging_surface(view(spark, sf_dir, "outpost"), cells, [float(e) for e in range(0, 360, 60)], min_pairs=4)


def _spanning(points: str) -> str:
    """Spanning edges of (id, lon, lat, g): pairs that no path of shorter pairs joins. Only pairs without a third point nearer
    to both ends can be such, and paths of these are enough."""
    return f"""with recursive p as ({points}), pair as materialized (select a.g, a.id as a, b.id as b, {_KM.format('a', 'b')} as km from p a join p b on a.g = b.g and a.id < b.id),
way as materialized (select g, a, b, km from pair union all select g, b, a, km from pair),
free as materialized (select * from pair e where not exists (select 1 from way x join way y on x.g = y.g and x.b = y.b where x.g = e.g and x.a = e.a and y.a = e.b and x.km < e.km and y.km < e.km)),
step as materialized (select g, a, b, km from free union all select g, b, a, km from free),
reach(g, a, b, km, node) as (select g, a, b, km, a from free union select r.g, r.a, r.b, r.km, s.b from reach r join step s on s.g = r.g and s.a = r.node and s.km < r.km),
spanning as (select g, a, b, km from free f where not exists (select 1 from reach r where r.g = f.g and r.a = f.a and r.b = f.b and r.node = f.b))"""


@query(f"{_spanning('select id, lon, lat, site as g from ' + sql('station'))} select g as site, a, b, round(km, 6) as km from spanning")
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.mst_edges(view(spark, sf_dir, "station").select("id", "lon", "lat", "site"), "site").select("site", "a", "b", r6("km"))


_ALL_OUTPOSTS = _spanning("select id, lon, lat, 0 as g from " + sql("outpost"))


@query(f"{_ALL_OUTPOSTS} select a, b, round(km, 6) as km from spanning")
def spanning_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outposts as one group, scale by scale, as groups of any size are."""
    rows = view(spark, sf_dir, "outpost").select("id", "lon", "lat", F.lit(0).alias("all"))
    return models.mst_edges(rows, "all", most=0).select("a", "b", r6("km"))


@query()
def forest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "station").select("id", "lon", "lat", F.col("site").cast("double").alias("site"), "y")
    return models.forest_quantiles(rows.filter("id % 10 <> 0"), rows.filter("id % 10 = 0"), ["lon", "lat", "site"])


# ---------------------------------------------------------------- surfaces

_YIELD = f"(select cast(floor(l_partkey / 50e0) as int) as i, cast(l_partkey % 50 as int) as j, avg(l_extendedprice) / 1e4 as metric from {sql('sampling')} group by 1, 2)"


def _yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "sampling").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("p"))
    return rows.selectExpr("cast(floor(l_partkey / 50e0) as int) as i", "cast(l_partkey % 50 as int) as j", "p / 1e4 as metric")


@query(f"""select count(*) as cells, round(corr(z, metric), 6) as spatial_correlation, round(avg(z - metric), 6) as mean_difference,
  round(sqrt(avg((z - metric) * (z - metric))), 6) as rmse from {sql('cell')} join {_YIELD} using (i, j)""")
def surface_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = surfaces.agreement(view(spark, sf_dir, "cell"), _yield(spark, sf_dir), "z", "metric", ["i", "j"])
    return got.select("cells", r6("spatial_correlation"), r6("mean_difference"), r6("rmse"))


_MINE = f"(select i, j, metric, slope, dx, dy from {_SLOPE} join {_YIELD} using (i, j) where metric >= {{0}} and slope <= 6e0 and not (i % 7 = 0))"


def _minable(spark: SparkSession, sf_dir: str, cutoff: float) -> DataFrame:
    cells = grid.slope_aspect(grid.gather(_cells(spark, sf_dir))).select("i", "j", "slope", "dx", "dy").join(_yield(spark, sf_dir), ["i", "j"])
    return surfaces.minable(cells, F.col("metric"), cutoff, 6.0, F.col("i") % 7 == 0)


@query(f"select i, j, round(metric, 6) as metric, round(slope, 9) as slope, round(dx * dy / 1e6, 9) as km2 from {_MINE.format('5.2e0')}")
def minable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minable(spark, sf_dir, 5.2).select("i", "j", r6("metric"), r6("slope", 9), F.round(F.col("dx") * F.col("dy") / 1e6, 9).alias("km2"))


@query(f"select i, j from {_MINE.format('5e0')} a where not exists (select 1 from {_MINE.format('5.6e0')} b where a.i = b.i and a.j = b.j)")
def scenario_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.difference(_minable(spark, sf_dir, 5.0), _minable(spark, sf_dir, 5.6), ["i", "j"]).select("i", "j")


# ---------------------------------------------------------------- adapters, reports and guards

_CORE = [
    "'SO' || cast(user_id % 7 as string) || '_' || cast(event_id as string) as event", "-abs(value) as elevation_m",
    "case when event_id % 6 = 0 then 'recovery FAILED' when event_id % 4 = 0 then 'fine' end as comment",
]


@query(f"""select source_record_id, evidence_class, cruise, round(-elevation_m, 9) as water_depth_m, kg, gear,
  case when lower(comment) like '%failed%' then 'flagged' else 'pending' end as qa_status,
  case when evidence_class in ('MASS', 'COUNT') then 'A' end as quality_grade,
  nullif(concat_ws('; ', case when lower(comment) like '%failed%' then 'event comment: ' || comment end,
    case when evidence_class = 'COVER' then 'cover read from photographs' end), '') as notes
from (select printf('core_%s_%06d', lower(c), event_id) as source_record_id, c as evidence_class, split_part(event, '_', 1) as cruise, 'box core' as gear,
    elevation_m, comment, case when c = 'MASS' then mass_kg end as kg
  from (select *, {', '.join(_CORE)} from {sql('field_event')}) e, (values ('MASS'), ('COUNT'), ('COVER')) k(c)
  where case c when 'MASS' then mass_kg when 'COUNT' then pieces else cover_pct end is not null)""")
def box_core_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "field_event").selectExpr("*", *_CORE)
    records = adapters.mapped_fan_out(
        rows, "core", "event_id", {"MASS": "mass_kg", "COUNT": "pieces", "COVER": "cover_pct"},
        shared={"event": "event", "elevation_m": "elevation_m", "comment": "comment"}, static={"gear": "box core"}, per_class={"MASS": {"kg": "mass_kg"}},
    )
    columns = ("source_record_id", "evidence_class", "cruise", "kg", "gear", "qa_status", "quality_grade", "notes")
    return adapters.box_cores(records).select(*columns, r6("water_depth_m", 9))


@query(f"""select printf('grid_grid_%06d', event_id) as source_record_id, 'GRID' as evidence_class, 'compiled' as observation_or_prediction, grid_kg_m2 as value
from {sql('field_event')} where grid_kg_m2 is not null""")
def regional_grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.regional_grid(view(spark, sf_dir, "field_event"), "grid", "event_id", "grid_kg_m2", per_class={"GRID": {"value": "grid_kg_m2"}})
    return rows.select("source_record_id", "evidence_class", "observation_or_prediction", "value")


@query(f"""{_LINKED} select cluster as label, count(*) as test_rows, cast(sum(count(*)) over () - count(*) as bigint) as train_rows from label group by cluster""")
def linkage_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.linkage_folds(geo.single_linkage(view(spark, sf_dir, "outpost"), LINK_KM), 2)


@query(f"""{_OUT}, s as (select km, lead(km) over (order by km) as after, row_number() over (order by km) as k from pairs)
select (select count(*) from pairs) as n, round((select min(km) from pairs), 6) as least, round((select km from s where k = (select count(*) from pairs) // 2 + 1), 6) as median,
  round((select max(km) from pairs), 6) as most, round(after - km, 6) as gap, round(km, 6) as gap_from, round(after, 6) as gap_to
from s where after is not null order by after - km desc, km limit 1""")
def spatial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairs.distance_order(view(spark, sf_dir, "outpost"))
    return got.select("n", *(r6(c) for c in ("least", "median", "most", "gap", "gap_from", "gap_to")))


@query(f"""{_LINKED} select cluster, count(distinct l.id) as members, round(coalesce(max(km), 0e0), 6) as internal_km from label l left join (
  select la.id as a, {_KM.format('a', 'b')} as km from label la join label lb on la.cluster = lb.cluster and la.id <> lb.id
  join o a on a.id = la.id join o b on b.id = lb.id) d on d.a = l.id group by cluster""")
def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "outpost")
    label = geo.single_linkage(o, LINK_KM).join(o.select("id", "lon", "lat"), "id")
    return geo.cluster_spread(label).select("cluster", "members", r6("internal_km"))


@query(f"""{_OUT} select bin, lo as lag_lo_km, hi as lag_hi_km, count(km) as pair_count, case when count(km) = 0 then 'no pairs' when hi > 20e0 then 'beyond the largest lag'
  when count(km) < 30 then 'too few pairs' else 'fitted' end as status from {_BINS} left join pairs on km >= lo and km < hi group by bin, lo, hi""")
def variogram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.bin_report(_variogram(spark, sf_dir), max_lag=20.0, min_pairs=30).select("bin", "lag_lo_km", "lag_hi_km", "pair_count", "status")


@query(f"select count(*) as cells, count(distinct (z, round(slope, 6))) as distinct_rows, cast(count(*) filter (slope is null) as bigint) as incomplete from {_SLOPE}")
def distinct_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes count as equal to 6 decimals: rows as far north as south have one cell width, up to its last digits."""
    layers = grid.slope_aspect(grid.gather(_cells(spark, sf_dir)))
    rows = layers.select(F.struct("z", F.round("slope", 6)).alias("x"), F.col("slope").isNull().alias("gap"))
    return rows.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("x").alias("distinct_rows"), F.count_if("gap").alias("incomplete"))


@query(f"""select cast(sum(n) as bigint) as points, sha256(string_agg(h, '|' order by b)) as fingerprint from (
  select cast(floor(id / 4096e0) as bigint) as b, count(*) as n, sha256(string_agg(concat_ws(',', cast(id as string), printf('%.9f', lon), printf('%.9f', lat)), '|' order by id)) as h
  from {sql('station')} group by 1)""")
def coordinate_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.coordinate_fingerprint(view(spark, sf_dir, "station"))


@query(f"""select cast(count(*) filter (is_open) as bigint) as published, cast(count(*) filter (not is_open) as bigint) as withheld,
  cast(sum(seq) filter (is_open) as bigint) as published_seq from {sql('record')}""")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, kept = contracts.publishable(view(spark, sf_dir, "record"))
    told = out.agg(F.count(F.lit(1)).alias("published"), F.sum("seq").alias("published_seq"))
    return told.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("withheld"))), F.lit(True)).select("published", "withheld", "published_seq")


@query(f"select count(*) as cells, round(sum(dx * dy / 1e6), 6) as km2, round(sum(metric * dx * dy / 1e6 * 3.5e0), 4) as worth from {_MINE.format('5.2e0')}")
def minable_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    km2 = F.col("dx") * F.col("dy") / 1e6
    return _minable(spark, sf_dir, 5.2).agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.sum(km2), 6).alias("km2"), F.round(F.sum(F.col("metric") * km2 * 3.5), 4).alias("worth")
    )


_LEAVES = "(select id, y, tree, (id * (7 + 4 * tree)) % 23 + tree as leaf from {0} cross join range(5) t(tree) where id % 10 {1} 0)"


@query(f"""with held as {_LEAVES.format(sql('station'), '<>')}, asked as {_LEAVES.format(sql('station'), '=')},
w as (select tree, leaf, y, count(*) / sum(count(*)) over (partition by tree, leaf) / 5e0 as w from held group by tree, leaf, y),
p as (select a.id, w.y, sum(w) as w from asked a join w on a.tree = w.tree and a.leaf = w.leaf group by a.id, w.y),
c as (select *, sum(w) over (partition by id order by y) as c from p)
select id, round(sum(y * w), 6) as prediction, min(y) filter (c >= 0.16e0 - 1e-12) as q16, min(y) filter (c >= 0.84e0 - 1e-12) as q84 from c group by id""")
def leaf_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "station").select("id", "y", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tree"))
    rows = rows.withColumn("leaf", F.col("id") * (7 + 4 * F.col("tree")) % 23 + F.col("tree"))
    got = models.pooled_quantiles(rows.filter("id % 10 <> 0").select("tree", "leaf", "y"), rows.filter("id % 10 = 0").select("id", "tree", "leaf"), 5)
    return got.select("id", r6("prediction"), "q16", "q84")


@query(f"""{_ALL_OUTPOSTS} select round(max(km) filter (km <= {LINK_KM}e0), 6) as holds_from, round(min(km) filter (km > {LINK_KM}e0), 6) as holds_to from spanning""")
def linkage_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = models.mst_edges(view(spark, sf_dir, "outpost").select("id", "lon", "lat", F.lit(0).alias("all")), "all")
    return validation.stability_interval(edges, LINK_KM).select(r6("holds_from"), r6("holds_to"))


# ---------------------------------------------------------------- polygons and grids

#: A ring of twelve around every nation's sites, with a hole of four, and an island of three; numbers of vertices and steps from the middle.
_RINGS = [(0, k, x, y) for k, (x, y) in enumerate([(6, 0), (5, 3), (3, 5), (0, 6), (-3, 5), (-5, 3), (-6, 0), (-5, -3), (-3, -5), (0, -6), (3, -5), (5, -3)])]
_RINGS += [(1, k, x, y) for k, (x, y) in enumerate([(2, 0), (0, 2), (-2, 0), (0, -2)])] + [(2, k, x, y) for k, (x, y) in enumerate([(8, 0), (9, 2), (10, 0)])]
_CLAIM = (
    "select n_nationkey as polygon, ring, nth, -125e0 + (n_nationkey % 5) * 2e0 + 0.1e0 + dx * (1 + n_nationkey % 3) * 0.0125e0 as x,"
    " 10e0 + floor(n_nationkey / 5e0) * 2e0 + 0.1e0 + dy * (1 + n_nationkey % 4) * 0.0125e0 as y from nation cross join {0}"
)
_CLAIM_SQL = "(" + _CLAIM.format("(values " + ", ".join(str(r) for r in _RINGS) + ") v(ring, nth, dx, dy)") + ")"
_EDGE_SQL = f"""(select polygon, x as x1, y as y1, coalesce(lead(x) over w, first(x) over w) as x2, coalesce(lead(y) over w, first(y) over w) as y2
  from {_CLAIM_SQL} window w as (partition by polygon, ring order by nth rows between unbounded preceding and unbounded following))"""


def _crossed(points: str) -> str:
    """(id, polygon) of points (id, px, py) that a polygon covers, by crossings of all its edges."""
    return f"""(select id, polygon from (select id, polygon, sum(case when (y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / (case when y2 = y1 then null else y2 - y1 end) + x1 then 1 else 0 end) as n,
  bool_or((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0 and px between least(x1, x2) and greatest(x1, x2) and py between least(y1, y2) and greatest(y1, y2)) as on_edge
  from {points} cross join {_EDGE_SQL} group by id, polygon) where n % 2 = 1 or on_edge)"""


def _claims(spark: SparkSession, sf_dir: str) -> polygons.Index:
    steps = spark.createDataFrame(_RINGS, "ring int, nth int, dx int, dy int")
    nations = table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(steps), F.lit(True))  # a fixed table of steps
    made = _CLAIM.removeprefix("select ").split(" from nation")[0]
    return polygons.Index(nations.selectExpr(*(c.strip() for c in _split(made))))


@query(f"""select polygon, count(*) as stations, min(id) as first_id, max(id) as last_id, round(sum(y), 2) as y
from {_crossed('(select id, lon as px, lat as py from ' + sql('station') + ')')} join {sql('station')} using (id) group by polygon""")
def polygon_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "station")
    met = _claims(spark, sf_dir).covering(rows, "id", "lon", "lat")
    return met.join(rows.select("id", "y"), "id").groupBy("polygon").agg(
        F.count(F.lit(1)).alias("stations"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.round(F.sum("y"), 2).alias("y")
    )


_SPOT = ["i", "j", "-125e0 + j * 0.16e0 as lon", "10e0 + (i % 50) * 0.16e0 as lat"]


@query(f"""with spot as (select row_number() over () as id, * from (select {', '.join(_SPOT)} from {sql('cell')}))
select i, j from spot where id not in (select id from {_crossed('(select id, lon as px, lat as py from spot)')})""")
def outside_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = view(spark, sf_dir, "cell").selectExpr(*_SPOT)
    return _claims(spark, sf_dir).outside(spots, ["i", "j"], "lon", "lat").select("i", "j")


FINE, COARSE = surfaces.Grid(WEST, NORTH, RES), surfaces.Grid(-125.003, 20.004, 0.025)
_RESAMPLED = f"""(select r as i, c as j, sum(w * z) / sum(w) as z, sum(w) as covered from (select z, r, c, (least(y1, r + 1) - greatest(y0, r)) * (least(x1, c + 1) - greatest(x0, c)) as w from (
  select *, unnest(range(cast(floor(x0 + 1e-9) as bigint), cast(ceil(x1 - 1e-9) as bigint))) as c from (select *, unnest(range(cast(floor(y0 + 1e-9) as bigint), cast(ceil(y1 - 1e-9) as bigint))) as r from (
    select z, y0, x0, y0 + {RES}e0 / 0.025e0 as y1, x0 + {RES}e0 / 0.025e0 as x1 from (
      select z, (i * {RES}e0 + ({COARSE.north}e0 - {NORTH}e0)) / 0.025e0 as y0, (j * {RES}e0 + ({WEST}e0 - ({COARSE.west}e0))) / 0.025e0 as x0 from {sql('cell')}))))) where w > 0 group by r, c)"""


def _resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.resample(view(spark, sf_dir, "cell"), "z", FINE, COARSE)


@query(f"""select cast(i as int) as i, cast(j as int) as j, round(z, 6) as z, round(covered, 6) as covered,
  case when z is null then null when z >= -4190e0 then 'shallow' when z >= -4210e0 then 'middle' else 'deep' end as band from {_RESAMPLED}""")
def resampled_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = surfaces.classify(F.col("z"), [-4210.0, -4190.0], ["deep", "middle", "shallow"])
    return _resampled(spark, sf_dir).select("i", "j", r6("z"), r6("covered"), bands.alias("band"))


@query(f"""select count(*) as cells, round(corr(z, metric), 6) as spatial_correlation, round(avg(z - metric), 6) as mean_difference,
  round(sqrt(avg((z - metric) * (z - metric))), 6) as rmse from {_RESAMPLED} a join {_YIELD} b on a.i = b.i and a.j = b.j where covered >= 0.5e0""")
def resampled_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface against another one on a grid of other width and origin."""
    got = surfaces.agreement(_resampled(spark, sf_dir).filter("covered >= 0.5"), _yield(spark, sf_dir), "z", "metric", ["i", "j"])
    return got.select("cells", r6("spatial_correlation"), r6("mean_difference"), r6("rmse"))


@query(f"select i, j, cast(z as float)::double as value from {sql('cell')} where z is not null")
def raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer written as a mosaic of float tiles and read back, a partition a tile."""
    folder = scratch(spark, "raster")
    rasters.write_raster(view(spark, sf_dir, "cell"), "z", FINE, folder, "depth", side=32)
    return rasters.read_raster(spark, folder)


# ---------------------------------------------------------------- dispositions and reports

@query(f"""{_MATCH}, d as (select b.source_id, c.source_id as other, case when c.seq is null then 'Admit' when b.source_id = c.source_id and b.source_record_id = c.source_record_id then 'AlreadyPresent'
  when {_RANK.format('b')} > {_RANK.format('c')} then 'Replace' else 'AbsorbInto' end as d from batch b left join first on b.seq = l left join corpus c on r = c.seq),
signed as (select source_id, case when d in ('Admit', 'Replace') then 1 else 0 end as a, case when d = 'AbsorbInto' then 1 else 0 end as b, case when d = 'AlreadyPresent' then 1 else 0 end as p from d
  union all select other, -1, 1, 0 from d where d = 'Replace')
select source_id, 'MASS' as evidence_class, cast(sum(a) as bigint) as admitted, cast(sum(b) as bigint) as absorbed, cast(sum(p) as bigint) as already_present from signed group by source_id
having sum(a) <> 0 or sum(b) <> 0 or sum(p) <> 0""")
def source_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _matched(spark, sf_dir).withColumn("disposition", merge.disposition())
    log = matched.select("disposition", F.col("l_evidence_class").alias("evidence_class"), F.col("l_source_id").alias("source_id"), F.col("r_source_id").alias("displaced_source"))
    return merge.dispositions(log, "source_id", "evidence_class")


_FIT = ORACLE["variogram_fit"][: ORACLE["variogram_fit"].index("select round(n / 1e3, 2)")]


@query(f"""{_FIT.rstrip()}, told as (select lo, hi, count(km) as n, avg(km) as h from {_BINS} left join pairs on km >= lo and km < hi group by bin, lo, hi),
whole as (select cast(count(*) filter (n >= 10 and hi <= 40e0) as bigint) as fitted_bins, cast(count(*) filter (n = 0) as bigint) as empty_bins, cast(count(*) filter (n > 0 and hi > 40e0) as bigint) as far_bins,
  cast(count(*) filter (n between 1 and 9 and hi <= 40e0) as bigint) as thin_bins, 2 * max(h) filter (n >= 10 and hi <= 40e0) as ceiling, min(hi) filter (n >= 10 and hi <= 40e0) as least, sum(n) as binned,
  coalesce(string_agg(cast(cast(lo as int) as varchar) || '-' || cast(cast(hi as int) as varchar), ',' order by lo) filter (n = 0), '') as unsupported_lags from told)
select round((n + p) / 1e3, 2) as sill, round(case when p > 0 then a else 0e0 end, 4) as range_km, fitted_bins, empty_bins, far_bins, thin_bins, fitted_bins - 3 as residual_dof,
  p > 0 and a >= ceiling * (1 - 1e-12) as range_at_ceiling, p > 0 and a <= least as range_below_first_lag, unsupported_lags,
  cast((select count(*) from o) * ((select count(*) from o) - 1) // 2 - binned as bigint) as pairs_outside from four cross join whole order by sse, c limit 1""")
def kriging_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = materialise(_variogram(spark, sf_dir), "report-bins")
    fit = models.variogram_fit(bins, max_lag=40.0, min_pairs=10)
    got = models.fit_report(bins, fit, view(spark, sf_dir, "outpost"), max_lag=40.0, min_pairs=10)
    return got.drop("nugget", "partial_sill").withColumns({"sill": F.round(F.col("sill") / 1e3, 2), "range_km": F.round("range_km", 4)})


_GRADED = "select id, case when id % 3 = 0 then concat('s', cast(id as string)) when id % 3 = 1 then 'unknown' end as station_id, cruise, cast(site as string) as event, lon, lat from {0}"


@query(f"""with s as ({_GRADED.format(sql('station'))}), g as (select id + 100000 as grade_id, case when id % 2 = 0 then concat('s', cast(id * 3 as string)) end as station_id, cruise, event, lon + 0.002e0 as lon, lat from s),
named as (select grade_id, min(s.id) as station from g join s on g.station_id = s.station_id group by grade_id),
near as (select grade_id, id as station from (select g.grade_id, s.id, row_number() over (partition by g.grade_id order by {_KM.format('g', 's')}, s.id) as k from g join s on g.cruise = s.cruise and g.event = s.event
  and abs(g.lat - s.lat) <= 0.02e0 and {_KM.format('g', 's')} <= 1.5e0 where g.grade_id not in (select grade_id from named)) where k = 1)
select g.grade_id, coalesce(n.station, m.station) as station, case when n.station is not null then 'station_id' when m.station is not null then 'nearness' else 'unmatched' end as method
from g left join named n using (grade_id) left join near m on m.grade_id = g.grade_id""")
def grades_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades find stations by id first, the rest by cruise, event and nearness."""
    s = view(spark, sf_dir, "station").selectExpr(*(c.strip() for c in _split(_GRADED.split(" from ")[0])))
    g = s.selectExpr("id + 100000 as grade_id", "case when id % 2 = 0 then concat('s', cast(id * 3 as string)) end as station_id", "cruise", "event", "lon + 0.002e0 as lon", "lat")
    return matrix.grades_at_stations(g, s, 1.5)


_STEPS = [("longitude", TOL), ("latitude", TOL)]
_STATE = "struct_pack(seq := seq, lon := longitude, lat := latitude, cruise := cruise, grade := quality_grade, src := source_id, rec := source_record_id)"


@query(f"""{_BOTH.replace('with ', 'with recursive ', 1)}, queue as (select *, row_number() over (order by seq) as k from batch),
fold(k, candidate, slot, disposition, displaced, held) as (
  select 0, cast(null as bigint), cast(null as bigint), '', cast(null as varchar), (select list({_STATE} order by seq) from corpus)
  union all select * from (select q.k, q.seq, held[pos].seq, d, case when pos is not null then held[pos].src end, case when d in ('Admit', 'AlreadyPresent') then held else list_transform(held, lambda s, i:
    case when i <> pos then s when d = 'Replace' then struct_pack(seq := s.seq, lon := q.longitude, lat := q.latitude, cruise := coalesce(q.cruise, s.cruise), grade := q.quality_grade, src := q.source_id, rec := q.source_record_id)
      else struct_pack(seq := s.seq, lon := s.lon, lat := s.lat, cruise := coalesce(s.cruise, q.cruise), grade := s.grade, src := s.src, rec := s.rec) end) end
  from (select q.*, f.held, pos, case when pos is null then 'Admit' when f.held[pos].src = q.source_id and f.held[pos].rec = q.source_record_id then 'AlreadyPresent'
      when case q.quality_grade when 'A' then 3 when 'B' then 2 else 1 end > case f.held[pos].grade when 'A' then 3 when 'B' then 2 else 1 end then 'Replace' else 'AbsorbInto' end as d
    from (select f.k, f.held, list_filter(range(1, len(f.held) + 1), lambda i: abs(f.held[i].lon - q.longitude) <= {TOL}e0 and abs(f.held[i].lat - q.latitude) <= {TOL}e0
        and (f.held[i].cruise is null or q.cruise is null or f.held[i].cruise = q.cruise))[1] as pos from fold f join queue q on q.k = f.k + 1) f join queue q on q.k = f.k + 1) q))
select candidate, slot, disposition, displaced as displaced_source from fold where k > 0""")
def upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole batch folded in order: slots that were moved or filled decide what later candidates match."""
    corpus, batch = (_records(spark, sf_dir, odd) for odd in (True, False))
    return merge.decisions(corpus, batch, dict(_STEPS), ["cruise"]).select("candidate", "slot", "disposition", "displaced_source")


_SEEDS = [0, 1, 2]


def _guess(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", F.col("near") * 3 - F.col("far"))


@query(f"""with r as (select *, row_number() over (order by id) as k from (select id, y / 1e3 as near, lat as far, cast(site as double) as idle, y / 1e3 * 3 - lat + (id % 7) / 10e0 as y from {sql('station')})),
d as (select s, row_number() over (partition by s order by md5(concat(cast(s as string), ':', cast(id as string))), id) as k, near as n, far as f from r, (values (0), (1), (2)) t(s)),
told as (select s as seed, unnest(['near', 'far', 'idle']) as feature, unnest([n * 3 - far, near * 3 - f, near * 3 - far]) as p, y from r join d using (k))
select feature, seed, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(sqrt(avg((p - y) * (p - y))) - (select sqrt(avg((near * 3 - far - y) * (near * 3 - far - y))) from r), 6) as loss from told group by all""")
def permutation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of a known predictor: the column it leans on loses most, the one it does not read loses nothing."""
    rows = view(spark, sf_dir, "station").selectExpr("id", "y / 1e3 as near", "lat as far", "cast(site as double) as idle", "y / 1e3 * 3 - lat + (id % 7) / 10e0 as y")
    return models.permutation_importance(rows, ["near", "far", "idle"], _guess, _SEEDS).select("feature", "seed", r6("rmse"), r6("loss"))


@query()
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "station").selectExpr("id", "lon", "lat", "cast(id % 11 as double) as idle", "site * 10e0 + (id % 3) as y")
    return models.forest_importance(rows.filter("id % 10 <> 0"), rows.filter("id % 10 = 0"), ["lon", "lat", "idle"], [0, 1])


_PIECES = [
    "concat('SO', cast(l_orderkey % 7 as string), '_', cast(l_orderkey as string)) as event", "l_linenumber as nth", "l_partkey", "l_suppkey",
    "case when l_returnflag = 'R' or l_linenumber = 5 then null else l_quantity end as mass_g", "case when l_linenumber = 5 then l_extendedprice end as length_mm",
    "case when l_returnflag = 'R' then concat('Plus ', cast(l_linenumber as string), ' Nodules of less than 5g') when l_linenumber = 5 then 'broken' end as remark",
    "case when l_orderkey % 9 = 0 then 'recovery failed' end as event_comment", "-1e0 * l_partkey as elevation_m", "l_extendedprice", "l_discount",
]
_FIRST = "nth, l_partkey, l_suppkey, l_extendedprice, l_discount"


@query(f"""with p as (select {', '.join(_PIECES)} from lineitem), e as (
  select event, count(mass_g) as weighed, coalesce(sum(mass_g), 0) as grams, cast(count(*) filter (mass_g is not null or length_mm is not null) as bigint) as seen,
    cast(coalesce(sum(case when remark like 'Plus%' then nth end), 0) as bigint) as unweighed, arg_min(elevation_m, ({_FIRST})) as elevation, arg_min(event_comment is not null, ({_FIRST})) as failed,
    arg_min(l_suppkey, ({_FIRST})) as vessel, row_number() over (order by event) - 1 as k from p group by event)
select printf('src_pieces_%s_%06d', c, k) as source_record_id, c as evidence_class, event, split_part(event, '_', 1) as cruise, vessel, -elevation as water_depth_m,
  case when failed then 'flagged' else 'pending' end as qa_status, case when c = 'MASS' then 'B' end as quality_grade, round(grams / nullif(weighed, 0), 6) as mean_nodule_mass_g,
  case when c = 'MASS' then round(grams / 1000, 9) end as nodule_mass_kg, case when c = 'COUNT' then seen + unweighed end as nodule_count, case when c = 'COUNT' then (seen + unweighed) / 0.25e0 end as nodule_density_m2,
  unweighed > 0 as is_biased from e cross join (values ('MASS'), ('COUNT')) t(c)""")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of nested pieces as a MASS and a COUNT record, numbered in the order of events."""
    pieces = table(spark, sf_dir, "lineitem").selectExpr(*_PIECES)
    made = adapters.event_records(
        pieces, "src_pieces", "event", _FIRST.split(", "), "mass_g", dimensions=["length_mm"], remark="remark", shared={"vessel": "l_suppkey"},
        elevation="elevation_m", event_comment="event_comment", area_m2=0.25,
    )
    columns = ["source_record_id", "evidence_class", "event", "cruise", "vessel", "water_depth_m", "qa_status", "quality_grade", "nodule_count", "nodule_density_m2"]
    return made.select(*columns, r6("mean_nodule_mass_g"), r6("nodule_mass_kg", 9), F.coalesce(F.col("notes").contains("unweighed"), F.lit(False)).alias("is_biased"))


@query(f"""with near as (select fold, min(km) as km from (with o as {sql('outpost')}, pairs as ({_PAIRS}) select sa as fold, km from pairs where sa <> sb union all select sb, km from pairs where sa <> sb) group by fold),
told as (select fold, km as measured, case when fold % 5 = 1 then km + 0.5e0 when fold % 5 <> 2 then km end as recorded from near)
select fold, round(recorded, 6) as recorded_km, round(measured, 6) as measured_km, case when measured < 3e0 then 'too near' when recorded is null or abs(recorded - measured) > 1e-6 then 'not as recorded' else 'ok' end as verdict from told""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded distances between folds against those measured anew; one in five was recorded wrongly, one in five not at all."""
    o = view(spark, sf_dir, "outpost")
    true = materialise(validation.fold_distance(o, "site", 30.0), "leak-recorded")
    recorded = true.filter("fold % 5 <> 2").select("fold", (F.col("min_km") + F.when(F.col("fold") % 5 == 1, 0.5).otherwise(0.0)).alias("min_km"))
    return validation.leakage(o, "site", recorded, 3.0).select("fold", r6("recorded_km"), r6("measured_km"), "verdict")


@query(f"""select count(*) as adapted, count(abundance_kg_m2) as with_value, cast(count(*) filter (screened = 'flagged') as bigint) as flagged,
  cast(count(*) filter (visible_cover_percent > 100 or abundance_kg_m2 < 0 or abundance_kg_m2 > 100 or nodule_mass_kg < 0 or (evidence_class = 'COUNT' and abundance_kg_m2 is not null and mean_nodule_mass_g is null)) as bigint) as refused,
  min(abundance_kg_m2) as least, max(abundance_kg_m2) as most from ({_SCREENED})""")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writing job saw of a batch."""
    return ingest.ingested(view(spark, sf_dir, "record"))[1]


_FLAT = f"(select estimator, fold, id, y, case when id % 14 = 0 then y else prediction end as prediction, case when id % 7 = 0 then 0e0 else sd end as sd from {_MODELS})"


@query(f"""with z as (select *, prediction - y as e, 1e-9 * greatest(abs(y), abs(prediction)) as tiny from {_FLAT} where fold % 2 = 0 or id % 14 = 0 or id % 7 <> 0),
f as (select *, sd <= tiny as is_zero, abs(e) <= tiny as is_exact from z)
select estimator, fold, count(*) as n, cast(count(*) filter (is_zero) as bigint) as n_sd_zero, cast(count(*) filter (is_zero and not is_exact) as bigint) as n_sd_zero_wrong,
  round(avg(case when abs(e) <= greatest(sd, tiny) then 1e0 else 0e0 end), 9) as coverage_1sigma, round(sqrt(avg(case when is_zero and is_exact then 0e0 when not is_zero then e / sd * e / sd end)), 9) as standardized_finite,
  round(case when count(*) filter (is_zero and not is_exact) = 0 then sqrt(avg(case when is_zero then 0e0 else e / sd * e / sd end)) end, 9) as standardized_rmse from f group by estimator, fold""")
def cv_flat_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores where some spreads are zero: an exact prediction counts as none, a wrong one leaves the ratio undefined."""
    rows = _estimates(spark, sf_dir).withColumns(
        {"prediction": F.when(F.col("id") % 14 == 0, F.col("y")).otherwise(F.col("prediction")), "sd": F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("sd"))}
    )
    got = validation.scores(rows.filter("fold % 2 = 0 or id % 14 = 0 or id % 7 <> 0"), ["estimator", "fold"])
    return got.select("estimator", "fold", "n", "n_sd_zero", "n_sd_zero_wrong", *(r6(c, 9) for c in ("coverage_1sigma", "standardized_finite", "standardized_rmse")))


_PLACE = "(select row_number() over (order by lon, lat) as id, lon, lat, 0 as site, 0e0 as y from (select distinct lon, lat from " + sql("outpost") + " where {0}))"


def _places_sql(basis: str, condition: str) -> str:
    o = _PLACE.format(condition)
    return f"""(with recursive o as {o}, pairs as ({_PAIRS}), link as (select a, b from pairs where km <= {LINK_KM}e0 union all select b, a from pairs where km <= {LINK_KM}e0),
  reach(id, seen) as (select id, id from o union select l.b, seen from reach join link l on l.a = reach.id), label as (select id, min(seen) as cluster from reach group by id),
  s as (select km, lead(km) over (order by km) as after, row_number() over (order by km) as k, count(*) over () as n from pairs),
  gap as (select after - km as gap, km as gap_from, after as gap_to from s where after is not null order by after - km desc, km limit 1)
  select '{basis}' as basis, (select count(*) from o) as locations, {LINK_KM}e0 as linkage_km, (select count(distinct cluster) from label) as clusters, (select count(*) from pairs) as pairs,
    round((select min(km) from s), 4) as least_km, round((select km from s where k = n // 2 + 1), 4) as median_km, round((select max(km) from s), 4) as most_km, round(gap, 4) as gap_km, round(gap_from, 4) as gap_from_km, round(gap_to, 4) as gap_to_km from gap)"""


@query(f"select * from {_places_sql('all rows', 'true')} union all select * from {_places_sql('eligible rows', 'y > 0 and id % 5 <> 0')}")
def places_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where all rows and those that may train lie, as a corpus manifest tells it."""
    o = view(spark, sf_dir, "outpost")
    return provenance.places_report(o, LINK_KM, "all rows").unionByName(provenance.places_report(o.filter("y > 0 and id % 5 <> 0"), LINK_KM, "eligible rows"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_cv(spark, sf_dir)
