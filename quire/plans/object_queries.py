"""Queries over object tables of paged files, made of orders (files) and their line items (pages, fonts, outline entries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import objects
from quire.plans.queries import _PAGES_SQL, _pages, query, table
from quire.sources import tables


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("job"), number.alias("file_no"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 97 == 0).alias("encrypted"))


@query(f"""
with p as ({_PAGES_SQL}
), o as (select o_orderkey, o_custkey as job, row_number() over (partition by o_custkey order by o_orderkey) - 1 as file_no, o_orderpriority as title, o_orderkey % 97 = 0 as encrypted from orders
), f as (select * from o where job not in (select job from o where encrypted)
), t as (select job, file_no, any_value(o_orderkey) as o_orderkey, any_value(title) as title, coalesce(400 + max(page), 0) as top from f left join p on l_orderkey = o_orderkey group by job, file_no
), b as (select *, 1 + coalesce(sum(top + 2) over (partition by job order by file_no rows between unbounded preceding and 1 preceding), 0) as base from t
), k as (select b.*, page as k, l_returnflag as flag, row_number() over (partition by job order by file_no, page) - 1 as number from b join p on l_orderkey = o_orderkey
), n as (
  select distinct job, 0 as new_id, 'tree' as kind, null as parent, 0 as place, null as title, null as target, null as rotate, false as folded from f
  union all select job, base + 100 + k, 'page', 0, number, null, null, case when flag = 'R' then 180 when k // 3 % 2 = 1 then 90 else o_orderkey % 4 * 90 end, false from k
  union all select job, base + x + k, 'font', null, k, 'F' || k, null, null, false from k, (values (200), (300)) v(x) where k % 2 = 0
  union all select job, base + 400 + k, 'outline', case when k % 2 = 1 then base + 399 + k else base + top + 1 end, k, 'L' || k, case when k % 3 < 2 then base + 100 + k end, null, false from k where not (k % 5 = 4 or (k % 2 = 1 and k % 5 = 0))
  union all select job, base + top + 1, 'outline', null, file_no, title, null, null, true from b)
select job, new_id::bigint as new_id, kind, parent::bigint as parent, place::bigint as place, title, target::bigint as target, rotate::int as rotate, folded from n
""")
def objects_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one file: page trees flattened, fonts that pages lead to, outlines of which some entries are their own parents."""
    files = _files(spark, sf_dir)
    k, keys = F.col("page"), ["job", "file_no"]
    lines = tables.saved(_pages(spark, sf_dir).join(files.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(*keys, "page", "l_returnflag"), "lines")
    none = lambda kind: F.lit(None).cast(kind)

    def made(df: DataFrame, node, kind: str, parent, place, title=None, target=None, rotate=None) -> DataFrame:
        given = {"title": (title, "string"), "target": (target, "long"), "rotate": (rotate, "int")}
        columns = [(none(t) if c is None else c.cast(t)).alias(n) for n, (c, t) in given.items()]
        return df.select(*keys, node.cast("long").alias("node"), F.lit(kind).alias("kind"), parent.cast("long").alias("parent"), place.cast("long").alias("place"), *columns)

    group = F.floor(k / 3)
    root = made(files, F.lit(0), "tree", F.lit(None), F.lit(0), rotate=F.col("o_orderkey") % 4 * 90)
    groups = made(lines.where(k % 3 == 0), group + 1, "tree", F.lit(0), group, rotate=F.when(group % 2 == 1, 90))
    of_pages = made(lines, k + 100, "page", group + 1, k % 3, rotate=F.when(F.col("l_returnflag") == "R", 180))
    fonts = [made(lines, k + base, "font", F.lit(None), k, title=F.concat(F.lit("F"), k.cast("string"))) for base in (200, 300)]
    up = F.when(k % 5 == 4, k + 400).when(k % 2 == 1, k + 399)
    outline = made(lines, k + 400, "outline", up, k, title=F.concat(F.lit("L"), k.cast("string")), target=F.when(k % 3 < 2, k + 100).otherwise(999))
    every = root
    for part in (groups, of_pages, *fonts, outline):
        every = every.unionByName(part)
    leads = [(lines.where(k % 2 == 0), 100, 200), (lines, 200, 300), (lines, 300, 200)]
    refs = None
    for df, a, b in leads:
        some = df.select(*keys, (k + a).cast("long").alias("node"), (k + b).cast("long").alias("to"))
        refs = some if refs is None else refs.unionByName(some)
    return objects.merged(files.select(*keys, "title", "encrypted"), every, refs, ["rotate"])
