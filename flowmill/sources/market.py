"""The star-schema tables seen as a multi-regional economy.

Suppliers' regions (or nations) sell to customers' regions; part sizes give the selling sector,
market segments the buying sector; returned lines are household demand. Money is summed as
decimals, so results don't depend on the order of rows.

Scale: fact tables are joined to small dimensions and aggregated in one shuffle to at most
years x industries^2 rows; every later operator works on that aggregate.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sectors whose labour creates value; S4 does not.
UNPRODUCTIVE = ("S4",)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
HOUSEHOLDS = "HH"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def hundredths(c: str) -> Column:
    """``money`` in whole hundredths: a product and a rounding where that is certain to give the same, which spares
    the number's way through its digits; the decimal elsewhere."""
    x = F.col(c) * 100
    near = F.rint(x)
    return F.when((F.abs(x) < 1e11) & (F.abs(x - near) < 1e-4), near.cast("long")).otherwise((money(c) * 100).cast("long"))


#: Measures of a line, in hundredths. Below LARGE, sums of products of two of them are exact as longs up to 2^31 lines a cell.
MEASURES = ["price", "discount", "tax", "hours"]
LARGE = 2.0**32


#: Sellers up to this number are sent to every task as (key, label): some 50 MB, whatever their size by Spark's estimate.
BROADCAST_ROWS = 1_000_000


def lines(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """Order lines with seller and buyer labels, sectors as numbers, and MEASURES; ``grain``: region or nation. Sellers come
    first, without a shuffle where they are few, so that the shuffles by part and by order carry narrow lines."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = nation.select("n_nationkey", F.col("r_name" if grain == "region" else "n_name").alias("country"))
    supplier = read(spark, sf_dir, "supplier")
    seller = supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("country").alias("o_country"))
    seller = F.broadcast(seller) if supplier.count() <= BROADCAST_ROWS else seller
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("int") - 1
    buyer = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("country").alias("d_country"), segment.alias("segment"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.floor((F.col("p_size") - 1) / 10).cast("int").alias("size"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "d_country", "segment")
    item = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("final"), (F.col("l_linestatus") == "O").alias("open"),
        hundredths("l_extendedprice").alias("price"), hundredths("l_discount").alias("discount"), hundredths("l_tax").alias("tax"), hundredths("l_quantity").alias("hours"),
    )
    item = item.join(seller, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
    item = item.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    return item.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")


def parted(lines: DataFrame) -> DataFrame:
    """A line with a large product gets its measures in ``large`` (and whether it is open), and null elsewhere."""
    price, discount, tax, hours = (F.abs(F.col(c).cast("double")) for c in MEASURES)
    lines = lines.withColumn("large", F.when(F.greatest(price * F.greatest(discount + 100, tax), hours) >= LARGE, F.struct(*MEASURES, "open")))
    return lines.withColumns({c: F.when(F.col("large").isNull(), F.col(c)) for c in MEASURES})


FLOW = ["year", "o_country", "o_sector", "d_country", "d_sector", "kind"]
#: Bounds of the discount, in hundredths, that set the two upper skills apart.
HIGH, MIDDLE = 3, 7
#: Fractional digits of the cells' measures.
PLACES = {"go_us": 2, "gdp_us": 4, "hours_emp": 2, "hours_empe": 2, "comp_emp": 6, "comp_empe": 6, "capital": 6, "hours_hs": 2, "hours_ms": 2, "comp_hs": 6, "comp_ms": 6}


def _measured(price: Column, discount: Column, tax: Column, hours: Column, open_: Column) -> dict[str, Column]:
    """The measures of a line in units of their last decimal place but for the factors that ``_FACTOR`` names."""
    pay, high, middle = price * tax, discount < HIGH, (discount >= HIGH) & (discount < MIDDLE)
    part = lambda cond, c: F.when(cond, c).otherwise(F.lit(0))
    return {
        "go_us": price, "gdp_us": price * (F.lit(100) - discount), "hours_emp": hours, "hours_empe": part(open_, hours), "comp_emp": pay, "comp_empe": part(open_, pay), "capital": price * discount,
        "hours_hs": part(high, hours), "hours_ms": part(middle, hours), "comp_hs": part(high, pay), "comp_ms": part(middle, pay),
    }


#: Pay is 8 times price x tax and capital 20 times price x discount.
_FACTOR = {"comp_emp": 800, "comp_empe": 800, "comp_hs": 800, "comp_ms": 800, "capital": 2000}


def cells(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """All measures by flow cell: the only aggregation of the facts. Flows and accounts are sums of it, exact as it
    holds decimals. Lines are summed as longs; equal large ones are counted, and multiplied as decimals."""
    own = _measured(*map(F.col, MEASURES), F.col("open"))
    keys = ["year", "o_country", "size", "d_country", F.when(~F.col("final"), F.col("segment")).alias("segment"), "final", "large"]
    sums = parted(lines(spark, sf_dir, grain)).groupBy(*keys).agg(F.count("*").alias("emp"), F.count_if("open").alias("empe"), *(F.sum(c).alias(n) for n, c in own.items()))
    numbered = lambda c: F.concat(F.lit("S"), F.col(c))
    sums = sums.withColumns({"o_sector": numbered("size"), "d_sector": F.when(F.col("final"), HOUSEHOLDS).otherwise(numbered("segment")), "kind": F.when(F.col("final"), "final").otherwise("industry")})
    large = _measured(*(F.col(f"large.{c}").cast("decimal(18,0)") for c in MEASURES), F.col("large.open"))
    whole = {n: F.when(F.col("large").isNull(), F.col(n).cast("decimal(38,0)")).otherwise((large[n] * F.col("emp").cast("decimal(18,0)")).cast("decimal(38,0)")) for n in PLACES}
    total = lambda n: (F.sum(whole[n]) * F.lit(_FACTOR.get(n, 1)) * F.lit(Decimal(1).scaleb(-PLACES[n]))).cast(f"decimal(38,{PLACES[n]})")
    return sums.groupBy(*FLOW).agg(F.sum("emp").alias("emp"), F.sum("empe").alias("empe"), *(total(n).alias(n) for n in PLACES))


def flows_of(cells: DataFrame) -> DataFrame:
    """io_flow(year, o_country, o_sector, d_country, d_sector, kind, value)."""
    return cells.select(*FLOW, F.col("go_us").cast("double").alias("value"))


def accounts_of(cells: DataFrame) -> DataFrame:
    """Socio-economic accounts per (year, country, sector), wide."""
    names = [c for c in cells.columns if c not in FLOW]
    return cells.groupBy("year", F.col("o_country").alias("country"), F.col("o_sector").alias("sector")).agg(*(F.sum(c).cast("double").alias(c) for c in names))


def flows(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    return flows_of(cells(spark, sf_dir, grain))


def accounts(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    return accounts_of(cells(spark, sf_dir, grain))


def productive(sector: str | Column) -> Column:
    return ~(F.col(sector) if isinstance(sector, str) else sector).isin(*UNPRODUCTIVE)


#: The same tables as DuckDB common table expressions (region grain), for the oracles.
SQL = """
raw as (select year(l_shipdate)::int as year, sr.r_name as o_country, 'S' || ((p_size - 1) // 10)::int as o_sector, cr.r_name as d_country,
  case when l_returnflag = 'R' then 'final' else 'industry' end as kind,
  case when l_returnflag = 'R' then 'HH' else 'S' || (list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1) end as d_sector,
  l_extendedprice::decimal(18,2) as price, l_discount::decimal(18,2) as disc, l_tax::decimal(18,2) as tax, l_quantity::decimal(18,2) as qty, l_linestatus as status
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey join region cr on cn.n_regionkey = cr.r_regionkey),
flow as (select year, o_country, o_sector, d_country, d_sector, kind, sum(price)::double as value from raw group by all),
acc as (select year, o_country as country, o_sector as sector, sum(price)::double as go_us, sum(price * (1 - disc)::decimal(18,2))::double as gdp_us, count(*)::double as emp,
  sum(case when status = 'O' then 1 else 0 end)::double as empe, sum(qty)::double as hours_emp, sum(case when status = 'O' then qty else 0 end)::double as hours_empe,
  sum(price * tax * 8)::double as comp_emp, sum(case when status = 'O' then price * tax * 8 else 0 end)::double as comp_empe, sum(price * disc * 20)::double as capital,
  sum(case when disc < 0.03 then qty else 0 end)::double as hours_hs, sum(case when disc >= 0.03 and disc < 0.07 then qty else 0 end)::double as hours_ms,
  sum(case when disc < 0.03 then price * tax * 8 else 0 end)::double as comp_hs, sum(case when disc >= 0.03 and disc < 0.07 then price * tax * 8 else 0 end)::double as comp_ms
  from raw group by all)"""
#: Adds lam(year, country, sector, lam): a Neumann series with a zero self-edge for every industry.
SQL_LAMBDA = SQL + """,
x as (select year, country, sector, go_us as x, hours_emp as hours from acc where sector <> 'S4' and go_us > 0),
a as (select f.year, f.o_country as i_c, f.o_sector as i_s, f.d_country as j_c, f.d_sector as j_s, f.value / x.x as a from flow f join x on f.year = x.year and f.d_country = x.country and f.d_sector = x.sector
  join x y on f.year = y.year and f.o_country = y.country and f.o_sector = y.sector where f.kind = 'industry' union all select year, country, sector, country, sector, 0.0 from x),
n(k, year, country, sector, lam) as (select 0, year, country, sector, hours / x from x union all
  select n.k + 1, a.year, a.j_c, a.j_s, any_value(x.hours / x.x) + sum(a.a * n.lam) from n join a on n.year = a.year and n.country = a.i_c and n.sector = a.i_s join x on x.year = a.year and x.country = a.j_c and x.sector = a.j_s
  where n.k < 150 group by n.k, a.year, a.j_c, a.j_s),
lam as (select p.year, p.country, p.sector, coalesce(n.lam, 0) as lam from acc p left join n on n.k = 150 and n.year = p.year and n.country = p.country and n.sector = p.sector)"""
