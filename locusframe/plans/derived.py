"""Variant tables derived from the driver's orders and lineitem tables, in package shape and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of the derived tables, and their (overlapping) groups.
N_SAMPLES = 7
GROUPS = {"A": [0, 2, 4, 6], "B": [1, 3, 5], "C": [0]}

_SITES = """
select o_orderkey as site_id, 'chr' || cast(o_orderkey % 5 + 1 as string) as contig, (o_orderkey + 1) * 10 as pos,
  case when o_custkey % 3 = 0 then null else 'rs' || cast(o_orderkey as string) end as id,
  substr('ACGT', cast(o_custkey % 4 + 1 as int), 1) || case when o_orderkey % 13 = 0 then 'TT' else '' end as ref,
  case when o_orderkey % 13 = 0 then substr('ACGT', cast(o_custkey % 4 + 1 as int), 1)
       when o_orderkey % 11 = 0 then substr('ACGT', cast(o_custkey % 4 + 1 as int), 1) || 'ACG'
       else substr('ACGT', cast((o_custkey + 1 + o_orderkey % 3) % 4 + 1 as int), 1) end as alt1,
  case when o_orderkey % 7 = 0 and o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0
       then substr('ACGT', cast((o_custkey + 1 + (o_orderkey + 1) % 3) % 4 + 1 as int), 1) end as alt2,
  case when o_orderkey % 10 = 0 then null else cast(floor(o_totalprice / 1000) as double) end as qual,
  o_orderstatus as flt
from {orders}"""

#: DuckDB: the same sites, one row for each call, and groups.
CTE = (
    "with fx_sites as (" + _SITES.format(orders="orders") + "), "
    "fx_calls as (select s.site_id, m.sample_id, "
    "case when l.rn is null or l.l_quantity = 1 then -1 else l.l_partkey % (case when s.alt2 is null then 2 else 3 end) end as a0, "
    "case when l.rn is null or l.l_quantity = 1 then -1 when l.l_partkey % 17 = 0 then null else l.l_suppkey % (case when s.alt2 is null then 2 else 3 end) end as a1, "
    "case when l.rn is null then false else l.l_linestatus = 'F' end as phased "
    "from fx_sites s cross join (select cast(sample_id as bigint) as sample_id from (values (0), (1), (2), (3), (4), (5), (6)) t(sample_id)) m "
    "left join (select l_orderkey, l_partkey, l_suppkey, l_quantity, l_linestatus, "
    "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as rn from lineitem) l "
    "on l.l_orderkey = s.site_id and l.rn - 1 = m.sample_id), "
    "fx_groups as (select cast(sample_id as bigint) as sample_id, grp from (values (0, 'A'), (2, 'A'), (4, 'A'), (6, 'A'), (1, 'B'), (3, 'B'), (5, 'B'), (0, 'C')) t(sample_id, grp))"
)


def blocks_sql(n_variants: int, n_bases: int) -> str:
    """DuckDB: ``b`` (contig, pos, id, seq, block_id), blocks being formed row after row."""
    return (
        CTE.replace("with ", "with recursive ", 1)
        + f""", o as (select contig, pos, id, row_number() over (partition by contig order by pos) - 1 as i, count(*) over (partition by contig) as total,
  least({n_variants}, count(*) over (partition by contig order by pos range between current row and {n_bases} following)) as own from fx_sites),
st as (select contig, cast(0 as bigint) as i, 0 as number from o where i = 0 union all select o.contig, o.i + o.own, st.number + 1 from st join o on o.contig = st.contig and o.i = st.i where o.i + o.own < o.total),
bk as (select contig, i, number, lead(i) over (partition by contig order by i) as following, row_number() over (order by contig, i) - 1 as seq from st),
b as (select o.contig, o.pos, o.id, bk.seq, o.contig || ':' || cast(bk.number as varchar) as block_id from o join bk on bk.contig = o.contig and o.i >= bk.i and o.i < coalesce(bk.following, o.total)) """
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants without genotypes: one scan of orders, no shuffle. filters is an array of one; site_id is kept."""
    s = spark.sql(_SITES.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return s.select("site_id", "contig", "pos", "id", F.filter(F.array("ref", "alt1", "alt2"), lambda x: x.isNotNull()).alias("alleles"), "qual", F.array("flt").alias("filters"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with ``gt``: the first N_SAMPLES lines of each order, as calls. One shuffle by order key."""
    lines = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .groupBy(F.col("l_orderkey").alias("site_id"))
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus"))), 1, N_SAMPLES).alias("lines"))
    )
    n = F.when(F.size("alleles") > 2, F.lit(3)).otherwise(F.lit(2))

    def call(i):
        x = F.get(F.col("lines"), i)
        none = x.isNull() | (x["l_quantity"] == 1)
        first, second = (x["l_partkey"] % n).cast("int"), (x["l_suppkey"] % n).cast("int")
        phased = F.coalesce(x["l_linestatus"] == "F", F.lit(False))
        two = F.struct(F.when(none, F.array(F.lit(-1), F.lit(-1))).otherwise(F.array(first, second)).alias("a"), F.array(F.lit(False), phased).alias("p"))
        one = F.struct(F.array(first).alias("a"), F.array(F.lit(False)).alias("p"))
        return F.when(~none & (x["l_partkey"] % 17 == 0), one).otherwise(two)

    # both sides grow with the data, and the planner's estimate of grouped lines is far too low: never broadcast them. The
    # sort-merge join takes over the aggregate's partitioning, and the work on genotypes is spread like it
    joined = sites(spark, sf_dir).join(lines.hint("shuffle_merge"), "site_id", "left")
    return joined.withColumn("gt", F.transform(F.sequence(F.lit(0), F.lit(N_SAMPLES - 1)), call)).drop("lines")
