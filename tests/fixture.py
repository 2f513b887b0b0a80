"""The two-country economy of one sector with known labour values."""

from pyspark.sql import functions as F

from flowmill.plans.run import Economy

FLOWS = {2000: {"A": (2, 1, 5, 2), "B": (1, 3, 2, 6)}, 2001: {"A": (3, 1, 6, 2), "B": (2, 2, 3, 7)}}
ACCOUNTS = [(2000, "A", 4, 10, 2), (2000, "B", 6, 12, 3), (2001, "A", 6, 12, 4), (2001, "B", 7, 14, 5)]
LAMBDA = {(2000, "A"): 0.0000005915492957746479, (2000, "B"): 0.0000007323943661971831, (2001, "A"): 0.0000008113207547169811, (2001, "B"): 0.0000006509433962264151}
OUTPUT = {(2000, "A"): 5.915492957746479, (2000, "B"): 8.788732394366198, (2001, "A"): 9.735849056603774, (2001, "B"): 9.113207547169811}
TRADE = {
    (2000, "A", "B"): (1.774647887323944, 0.2112676056338028), (2000, "B", "A"): (2.197183098591549, -0.2112676056338028),
    (2001, "A", "B"): (2.433962264150943, -0.3007075471698113), (2001, "B", "A"): (3.254716981132075, 0.3007075471698113),
}


def economy(spark) -> Economy:
    rows = []
    for year, by in FLOWS.items():
        for origin, cells in by.items():
            for (dest, kind), v in zip((("A", "industry"), ("B", "industry"), ("A", "final"), ("B", "final")), cells):
                rows.append((year, origin, "S", dest, "S" if kind == "industry" else "HH", kind, v * 1e6))
    flows = spark.createDataFrame(rows, "year int, o_country string, o_sector string, d_country string, d_sector string, kind string, value double")
    acc = spark.createDataFrame([(y, c, "S", float(l), g * 1e6, float(p)) for y, c, l, g, p in ACCOUNTS], "year int, country string, sector string, hours_emp double, go_us double, price double")
    acc = acc.withColumns({"gdp_us": F.col("go_us") / 2, "emp": F.lit(1.0), "comp_emp": F.col("go_us") / 4})
    return Economy(flows, acc, lambda s: s == "S")
