"""Queries over files, scenarios, living arrangements and report datasets."""

import uuid
from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.operators import living, reports, timeline, whatif
from ebbtide.plans import adapters as A
from ebbtide.plans.q_presence import _PRESENCE, a10_presence_index
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import shared_folder
from ebbtide.sources import files


def _folder(spark, name):
    return f"{shared_folder(spark)}/ebbtide-{name}-{uuid.uuid4().hex}"


@query("s1_text_csv", "SELECT '0' || c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def s1_text_csv(spark, sf_dir):
    """All-text CSV written and read again; leading zeros survive."""
    path = _folder(spark, "csv")
    A.table(spark, sf_dir, "customer").selectExpr("concat('0', c_custkey) as id", "c_name as name", "c_mktsegment as segment").write.option("header", True).csv(path)
    return files.read_text_csv(spark, path)


@query("s2_typed_csv", "SELECT o_orderkey AS id, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS n FROM orders")
def s2_typed_csv(spark, sf_dir):
    """CSV by schema; bad numbers are null."""
    path = _folder(spark, "typed")
    A.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "date(o_orderdate) as day", "if(o_orderkey % 7 = 0, 'bad', cast(o_custkey as string)) as n").write.option("header", True).csv(path)
    return files.read_typed_csv(spark, path, "id long, day date, n long")


@query("s4_ragged_set", "SELECT n_nationkey AS id, n_name AS name, NULL::INT AS region FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_nationkey >= 10")
def s4_ragged_set(spark, sf_dir):
    """Parquet files with different columns, read as one."""
    path, nation = _folder(spark, "ragged"), A.table(spark, sf_dir, "nation")
    nation.filter("n_nationkey < 10").selectExpr("n_nationkey as id", "n_name as name").write.parquet(f"{path}/a")
    nation.filter("n_nationkey >= 10").selectExpr("n_nationkey as id", "n_regionkey as region").write.parquet(f"{path}/b")
    return files.read_parquet_set(spark, [f"{path}/a", f"{path}/b"], ragged=True).select("id", "name", "region")


@query("r2_union_ragged", "SELECT n_nationkey AS id, n_name AS name, NULL AS city FROM nation UNION ALL SELECT r_regionkey, r_name, 'x' FROM region")
def r2_union_ragged(spark, sf_dir):
    nation, region = A.table(spark, sf_dir, "nation"), A.table(spark, sf_dir, "region")
    return files.union_ragged(nation.selectExpr("n_nationkey as id", "n_name as name"), region.selectExpr("r_regionkey as id", "r_name as name", "'x' as city"))


@query("s5_month_of_file", "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY ALL")
def s5_month_of_file(spark, sf_dir):
    """The month comes from each file's name."""
    path = _folder(spark, "months")
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month"))
    files.write_months(orders, path)
    named = files.with_file_part(spark.read.option("basePath", path).parquet(path).drop("month"), r"month=(\d{6})", "file_month")
    return named.groupBy(F.col("file_month").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("s6_positional", "SELECT c_custkey::VARCHAR AS id, c_name AS name, NULL::VARCHAR AS beyond FROM customer WHERE c_nationkey % 3 = 0")
def s6_positional(spark, sf_dir):
    """Headerless piped lines picked by level code and place."""
    path = _folder(spark, "piped")
    A.table(spark, sf_dir, "customer").selectExpr("concat_ws('|', if(c_nationkey % 3 = 0, '060', '040'), c_custkey, c_name) as value").write.text(path)
    rows = files.positional(spark.read.text(path)).filter(files.field(1) == "060")
    return rows.select(files.field(2).alias("id"), files.field(3).alias("name"), files.field(9).alias("beyond"))


@query("s7_looked_up", "SELECT c_custkey AS id, 'total' AS variable, c_nationkey::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'second', (c_nationkey * 2)::DOUBLE FROM customer")
def s7_looked_up(spark, sf_dir):
    """Values at the places that a lookup table names."""
    records = A.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "'0001' as sequence", "array('x', cast(c_nationkey as string), cast(c_nationkey * 2 as string)) as fields")
    lookup = spark.createDataFrame([("0001", "total", 2, 1), ("0001", "second", 2, 2)], "sequence string, variable string, start int, number int")
    return files.looked_up(records, lookup)


@query("s8_normalise_header", "SELECT n_name AS NAME, n_nationkey AS ID FROM nation")
def s8_normalise_header(spark, sf_dir):
    return files.normalise_header(A.table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias(" name "), F.col("n_nationkey").alias("Id")))


@query("s11_new_months", "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders WHERE month(o_orderdate) > 3 GROUP BY ALL")
def s11_new_months(spark, sf_dir):
    """Only months that aren't done yet."""
    orders = A.table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    done = orders.filter("month(o_orderdate) <= 3").select("month").distinct()
    return files.new_months(orders, done).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("b12_thousands", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 1234 END AS n FROM orders")
def b12_thousands(spark, sf_dir):
    """Numbers with thousands separators; blanks are null."""
    text = A.table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "if(o_orderkey % 11 = 0, ' ', format_number(o_orderkey * 1234, 0)) as text")
    return text.select("id", files.thousands(F.col("text")).alias("n"))


@query(
    "b13_street_counts",
    """SELECT DISTINCT l_suppkey % 50 AS location, l_shipdate::DATE AS date, isodow(l_shipdate)::INT AS weekday, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END AS vehicles FROM lineitem""",
)
def b13_street_counts(spark, sf_dir):
    """Counts with dates inside text, zeros as not counted, repeats once."""
    raw = A.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 50 as location", "concat(date_format(l_shipdate, 'M/d/yyyy'), ' 4:00:00.000') as text", "l_suppkey % 3 as day_veh")
    day = F.to_date(F.try_to_timestamp(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("M/d/yyyy")))
    return raw.select("location", day.alias("date"), F.when(F.col("day_veh") > 0, F.col("day_veh")).alias("vehicles")).withColumn("weekday", F.weekday("date") + 1).distinct()


# --- scenarios

_INPUTS = f"""{_PRESENCE}, o AS (SELECT week_start, 1 - presence_index AS out, least(summer_break_share, 1 - presence_index) AS summer FROM px), i AS (SELECT *, CASE WHEN out - summer > 1e-12 THEN out - summer ELSE 0 END AS breaks, month(week_start + 3) AS m FROM o),
    inp AS (SELECT week_start, out, summer, breaks, CASE WHEN m = 11 THEN breaks ELSE 0 END AS thanksgiving, CASE WHEN m IN (12, 1) THEN breaks ELSE 0 END AS winter, CASE WHEN m NOT IN (11, 12, 1) THEN breaks ELSE 0 END AS spring FROM i)"""


@query("p16_weekly_inputs", f"WITH {_INPUTS} SELECT * FROM inp")
def p16_weekly_inputs(spark, sf_dir):
    return whatif.weekly_inputs(a10_presence_index(spark, sf_dir))


@query("p18_with_changes", f"WITH {_INPUTS} SELECT inp.*, out - lag(out) OVER w AS from_previous, lead(out) OVER w - out AS to_next, lag(out) OVER w AS lag_1 FROM inp WINDOW w AS (ORDER BY week_start)")
def p18_with_changes(spark, sf_dir):
    return whatif.with_changes(p16_weekly_inputs(spark, sf_dir))


_ARR = "arr AS (SELECT fall_year, sum(dorm_capacity)::DOUBLE AS in_university_housing, sum(distance_only)::DOUBLE AS elsewhere, (sum(total) // 10)::DOUBLE AS with_parents FROM enr GROUP BY ALL)"


def _arrangements(spark, sf_dir):
    return A.enrollment(spark, sf_dir).groupBy("fall_year").agg(F.sum("dorm_capacity").cast("double").alias("in_university_housing"), F.sum("distance_only").cast("double").alias("elsewhere"), F.floor(F.sum("total") / 10).cast("double").alias("with_parents"))


@query(
    "p19_scale_students",
    f"WITH {A.ENROLLMENT}, {_ARR} SELECT fall_year, in_university_housing * 1.5::DOUBLE AS in_university_housing, elsewhere * 1.5::DOUBLE AS elsewhere, with_parents, in_university_housing * 1.5::DOUBLE + elsewhere * 1.5::DOUBLE + with_parents AS college_students FROM arr",
)
def p19_scale_students(spark, sf_dir):
    return whatif.scale_students(_arrangements(spark, sf_dir), 0.5)


_SCEN = """wk AS (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, count(*)::DOUBLE AS v FROM orders GROUP BY ALL), sc AS (SELECT 'fewer' AS scenario, week_start, v * 0.5::DOUBLE AS v FROM wk UNION ALL SELECT 'june', week_start, CASE WHEN month(week_start) = 6 THEN v + 8 ELSE v END FROM wk),
    ch AS (SELECT sc.*, sc.v - wk.v AS change FROM sc JOIN wk USING (week_start))"""


def _scenarios(spark, sf_dir):
    base = A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    fewer = base.select(F.lit("fewer").alias("scenario"), "week_start", (F.col("v") * 0.5).alias("v"))
    june = base.select(F.lit("june").alias("scenario"), "week_start", F.when(F.month("week_start") == 6, F.col("v") + 8).otherwise(F.col("v")).alias("v"))
    return whatif.against_baseline(fewer.unionByName(june), base, "v")


@query("j18_against_baseline", f"WITH {_SCEN} SELECT * FROM ch")
def j18_against_baseline(spark, sf_dir):
    """Scenarios against the baseline by week."""
    return _scenarios(spark, sf_dir)


@query("a25_scenario_summary", f"WITH {_SCEN} SELECT scenario, avg(v) AS mean, min(v) AS lowest, arg_min(week_start, (v, week_start)) AS lowest_week, avg(change) AS mean_change, max(abs(change)) AS largest_change, count(*) FILTER (abs(change) > 0) AS changed_weeks FROM ch GROUP BY ALL")
def a25_scenario_summary(spark, sf_dir):
    return whatif.summary(_scenarios(spark, sf_dir), "v")


@query(
    "v12_fullest_break",
    """WITH s AS (SELECT o_custkey % 8 AS unit, year(o_orderdate) AS year, date_trunc('week', o_orderdate)::DATE AS week_start, greatest(count(*) - 3, 0)::DOUBLE AS breaks, (o_custkey % 8 + 1)::DOUBLE AS weight FROM orders WHERE month(o_orderdate) BETWEEN 2 AND 4 GROUP BY ALL),
    g AS (SELECT *, CASE WHEN date_diff('day', lag(week_start) OVER w, week_start) = 7 THEN 0 ELSE 1 END AS b FROM s WHERE breaks > 0 WINDOW w AS (PARTITION BY unit, year ORDER BY week_start)), r AS (SELECT *, sum(b) OVER (PARTITION BY unit, year ORDER BY week_start) AS run FROM g),
    p AS (SELECT unit, year, week_start AS peak, run, weight FROM (SELECT *, row_number() OVER (PARTITION BY unit, year ORDER BY breaks DESC, week_start) AS n FROM r) WHERE n = 1),
    c AS (SELECT year, peak AS common FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY votes DESC, peak) AS n FROM (SELECT year, peak, sum(weight) AS votes FROM p GROUP BY ALL)) WHERE n = 1)
    SELECT r.unit, r.year, r.week_start, r.breaks, p.peak, r.week_start + date_diff('day', p.peak, c.common)::INT AS moved_to FROM r JOIN p ON r.unit = p.unit AND r.year = p.year AND r.run = p.run JOIN c ON c.year = r.year""",
)
def v12_fullest_break(spark, sf_dir):
    """Each unit's fullest break run, moved to the commonest week."""
    shares = A.table(spark, sf_dir, "orders").filter("month(o_orderdate) between 2 and 4").groupBy((F.col("o_custkey") % 8).alias("unit"), F.year("o_orderdate").alias("year"), timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg(
        F.greatest(F.count(F.lit(1)) - 3, F.lit(0)).cast("double").alias("breaks")
    ).withColumn("weight", (F.col("unit") + 1).cast("double"))
    return whatif.fullest_break(shares, "unit", ["year"])


# --- living arrangements

_PEOPLE = """ppl AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::VARCHAR END AS area_10, CASE WHEN c_custkey % 4 = 0 THEN 'old' || c_nationkey END AS area_00, (c_custkey % 9 + 1)::DOUBLE AS weight, c_custkey % 3 = 0 AS student, (c_custkey % 20)::INT AS relation FROM customer),
    kp AS (SELECT area_10 AS area, weight * ((SELECT sum(weight) FROM ppl) / (SELECT sum(weight) FROM ppl WHERE area_10 IS NOT NULL)) AS weight, student, relation FROM ppl WHERE area_10 IS NOT NULL),
    ar AS (SELECT area, coalesce(sum(weight) FILTER (student), 0) AS students, coalesce(sum(weight) FILTER (student AND relation = 17), 0) AS group_quarters, coalesce(sum(weight) FILTER (student AND relation IN (2, 3)), 0) AS with_parents FROM kp GROUP BY ALL)"""


def _areas(spark, sf_dir):
    people = A.table(spark, sf_dir, "customer").selectExpr(
        "case when c_custkey % 4 <> 0 then cast(c_nationkey as string) end as area_10", "case when c_custkey % 4 = 0 then concat('old', c_nationkey) end as area_00", "cast(c_custkey % 9 + 1 as double) as weight", "c_custkey % 3 = 0 as student", "cast(c_custkey % 20 as int) as relation"
    )
    return living.area_counts(living.main_vintage(people, ["area_10", "area_00"]))


@query("a17_area_counts", f"WITH {_PEOPLE} SELECT * FROM ar")
def a17_area_counts(spark, sf_dir):
    """Main coding kept with rescaled weights, weighted counts by area."""
    return _areas(spark, sf_dir)


@query(
    "a18_split_over_towns",
    f"""WITH {_PEOPLE}, sh AS (SELECT n_nationkey::VARCHAR AS area, 'T' || (n_nationkey % 4) AS town, 0.75::DOUBLE AS share FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'T' || (n_nationkey % 3), 0.25::DOUBLE FROM nation),
    bd AS (SELECT 'T' || n AS town, (n * 20 + 5)::DOUBLE AS beds FROM (VALUES (0), (1), (2)) v(n)), dl AS (SELECT town, sum(students * share) AS students, sum(group_quarters * share) AS gq, sum(with_parents * share) AS with_parents FROM ar JOIN sh USING (area) GROUP BY ALL)
    SELECT town, students, least(gq, coalesce(beds, 0)) AS in_university_housing, with_parents, students - least(gq, coalesce(beds, 0)) - with_parents AS elsewhere FROM dl LEFT JOIN bd USING (town)""",
)
def a18_split_over_towns(spark, sf_dir):
    """Counts dealt to towns, dormitories capped by beds."""
    nation = A.table(spark, sf_dir, "nation")
    area = F.col("n_nationkey").cast("string").alias("area")
    shares = nation.select(area, F.concat(F.lit("T"), F.col("n_nationkey") % 4).alias("town"), F.lit(0.75).alias("share")).unionByName(nation.select(area, F.concat(F.lit("T"), F.col("n_nationkey") % 3).alias("town"), F.lit(0.25).alias("share")))
    beds = spark.createDataFrame([(f"T{n}", n * 20 + 5.0) for n in range(3)], "town string, beds double")
    return living.split_over_towns(_areas(spark, sf_dir), shares, beds)


# --- reports


@query("k2_largest", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_nationkey LIMIT 10")
def k2_largest(spark, sf_dir):
    """The ten largest, ties by id (K2): a report of that many."""
    return reports.largest(A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), "n", "c_nationkey", 10)


@query("k3_best_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def k3_best_per_group(spark, sf_dir):
    """Best row per group with a fixed tie order (K3, K4)."""
    return reports.best_per_group(A.table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("k5_smallest_passing", "SELECT l_linenumber, l_suppkey, count(*) AS n, avg((l_partkey % 3 > 0)::INT) AS share FROM lineitem GROUP BY ALL HAVING avg((l_partkey % 3 > 0)::INT) >= 0.75 ORDER BY l_linenumber, l_suppkey LIMIT 1")
def k5_smallest_passing(spark, sf_dir):
    """Shortest run, then smallest widening, that covers enough (K5)."""
    rows = A.table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("l_partkey") % 3 > 0).cast("int")).alias("share"))
    return reports.smallest_passing(rows, F.col("share") >= 0.75, ["l_linenumber", "l_suppkey"])


@query(
    "d1_coverage_spans",
    """WITH d AS (SELECT l_shipdate::DATE AS day FROM lineitem GROUP BY ALL HAVING count(*) % 5 > 0), g AS (SELECT day, day - row_number() OVER (ORDER BY day)::INT AS k FROM d)
    SELECT 'ships' AS dataset, greatest(min(day), DATE '1996-01-01') AS first, least(max(day), DATE '2000-12-31') AS last FROM g GROUP BY k HAVING greatest(min(day), DATE '1996-01-01') <= least(max(day), DATE '2000-12-31')""",
)
def d1_coverage_spans(spark, sf_dir):
    """Spans of covered days, cut to the study; a day counts as covered unless its shipments are a multiple of five."""
    days = A.table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n % 5 > 0").select("day")
    return reports.coverage_spans(days, "ships", F.lit(date(1996, 1, 1)), F.lit(date(2000, 12, 31)))


@query("d5_interval_text", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'not known' ELSE format('{:,} ({:,}–{:,})', c_custkey * 1000, c_custkey * 900, c_custkey * 1100) END AS text FROM customer")
def d5_interval_text(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") * 1000)
    return A.table(spark, sf_dir, "customer").select("c_custkey", reports.interval_text(value, F.col("c_custkey") * 900, F.col("c_custkey") * 1100).alias("text"))


@query("r6_long_metrics", "UNPIVOT (SELECT c_nationkey, count(*)::DOUBLE AS n, max(c_acctbal) AS most, min(c_acctbal) AS least FROM customer GROUP BY ALL) ON n, most, least INTO NAME metric VALUE value")
def r6_long_metrics(spark, sf_dir):
    """A wide result as long metric rows."""
    wide = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("most"), F.min("c_acctbal").alias("least"))
    return reports.long_metrics(wide, ["c_nationkey"], ["n", "most", "least"])


@query("d8_whole_years", "WITH w AS (SELECT year(o_orderdate) AS year, date_trunc('week', o_orderdate)::DATE AS week_start, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY year) AS k FROM w) WHERE k >= 52", )
def d8_whole_years(spark, sf_dir):
    """Only years with enough weeks."""
    weekly = A.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg(F.count(F.lit(1)).alias("n"))
    return reports.whole_years(weekly, "year").withColumn("k", F.count(F.lit(1)).over(W.partitionBy("year")))


@query("r4_pivot", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY ALL")
def r4_pivot(spark, sf_dir):
    """Fixed values as columns, zero where there are none."""
    wide = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return wide.fillna(0).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query("r8_set_difference", "SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def r8_set_difference(spark, sf_dir):
    customers = A.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_nationkey").distinct()
    suppliers = A.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    return customers.join(suppliers, "c_nationkey", "left_anti")


@query("a24_weighted_share", "SELECT c_mktsegment, sum(c_acctbal * (c_custkey % 7)) / sum(c_custkey % 7) AS share, string_agg(DISTINCT c_nationkey::VARCHAR, '; ' ORDER BY c_nationkey::VARCHAR) AS nations FROM customer GROUP BY ALL")
def a24_weighted_share(spark, sf_dir):
    """Shares combined by respondents, and the groups as text."""
    w = F.col("c_custkey") % 7
    return A.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.try_divide(F.sum(F.col("c_acctbal") * w), F.sum(w)).alias("share"), reports.named_list(F.col("c_nationkey").cast("string")).alias("nations"))


@query(
    "a20_latest_directory",
    "SELECT o_custkey AS unit, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(DISTINCT o_orderstatus) > 1 AS changed FROM orders GROUP BY ALL",
)
def a20_latest_directory(spark, sf_dir):
    """Newest attributes, span and whether one ever changed."""
    return A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), (F.count_distinct("o_orderstatus") > 1).alias("changed")
    )


@query("v10_busy", "SELECT * FROM (SELECT l_suppkey, year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY median(n) OVER (PARTITION BY l_suppkey, year) >= 7")
def v10_busy(spark, sf_dir):
    """Station-years with a large enough median."""
    months = A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.withColumn("m", F.percentile("n", 0.5).over(W.partitionBy("l_suppkey", "year"))).filter("m >= 7").drop("m")


@query("a33_yearly", "SELECT year(l_shipdate) AS year, count(*) AS trips, max(l_quantity) AS largest, count(*) FILTER (l_quantity >= 45) AS n_high, arg_max(l_suppkey, (l_quantity, l_suppkey)) AS busiest FROM lineitem GROUP BY ALL")
def a33_yearly(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("trips"), F.max("l_quantity").alias("largest"), F.count_if(F.col("l_quantity") >= 45).alias("n_high"), F.max_by("l_suppkey", F.struct("l_quantity", "l_suppkey")).alias("busiest")
    )
