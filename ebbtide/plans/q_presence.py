"""Queries over presence, the range of students away, joins and windows."""

from pyspark.sql import functions as F

from ebbtide import config
from ebbtide.operators import calendars, joins, presence, timeline, windows
from ebbtide.plans import adapters as A
from ebbtide.plans.registry import query

#: The remote fall of the derived enrollment, which ends in 2000.
REMOTE = 1999

_PRESENCE = (
    A.CALENDAR
    + ","
    + A.ENROLLMENT
    + f""", norm AS (SELECT e.*, CASE WHEN e.fall_year = {REMOTE} AND b.unitid IS NOT NULL THEN least(greatest(e.total - coalesce(b.distance_only, 0), e.in_person), e.total) ELSE e.in_person END AS normal_in_person
        FROM enr e LEFT JOIN enr b ON b.unitid = e.unitid AND b.fall_year = {REMOTE - 1}),
    wk AS (SELECT DISTINCT week_start FROM wsess), sp AS (SELECT min(fall_year) AS lo, max(fall_year) AS hi FROM enr),
    wy AS (SELECT week_start, year(week_start + 3) - (month(week_start + 3) < 8)::INT AS fy, lo, hi FROM wk, sp),
    ew AS (SELECT week_start, fy NOT BETWEEN lo AND hi AS enrollment_imputed, n.* FROM wy JOIN norm n ON n.fall_year = least(greatest(fy, lo), hi)),
    sh AS (SELECT ew.*, days_in_session / 7 AS os, summer_break_days / 7 AS ob FROM ew LEFT JOIN wsess s ON s.week_start = ew.week_start AND s.unitid = ew.unitid),
    ty AS (SELECT week_start, sum(os * in_person) / sum(in_person) FILTER (os IS NOT NULL) AS ts, sum(ob * in_person) / sum(in_person) FILTER (ob IS NOT NULL) AS tb FROM sh GROUP BY ALL),
    pi AS (SELECT sh.* EXCLUDE (os, ob), coalesce(os, ts) AS session_share, coalesce(ob, tb) AS summer_share, CASE WHEN os IS NULL THEN 'typical calendar' ELSE 'own calendar' END AS calendar_source FROM sh JOIN ty USING (week_start)),
    pw AS (SELECT week_start, sum(in_person)::BIGINT AS in_person_enrollment, sum(normal_in_person)::BIGINT AS normal_enrollment, sum(in_person * session_share) AS students_in_session,
        sum(in_person * summer_share) / sum(in_person) AS summer_break_share, sum(dorm_capacity)::BIGINT AS housing_beds, sum(dorm_capacity * session_share) AS beds_in_session,
        coalesce(sum(in_person) FILTER (calendar_source = 'own calendar'), 0) / sum(in_person) AS own_calendar_share, bool_or(enrollment_imputed) AS enrollment_imputed FROM pi GROUP BY ALL),
    px AS (SELECT *, students_in_session / normal_enrollment AS presence_index, beds_in_session / housing_beds AS housing_presence_index, 'normal' AS covid_period FROM pw),
    halls AS (SELECT n_nationkey::VARCHAR AS unitid, CASE n_nationkey % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' END AS thanksgiving, CASE n_nationkey % 2 WHEN 0 THEN 'closed' ELSE 'open' END AS winter,
        CASE n_nationkey % 5 WHEN 0 THEN 'closed' ELSE 'limited' END AS spring FROM nation WHERE n_nationkey % 6 <> 5),
    cb AS (SELECT week_start, sum(dorm_capacity * (summer_share + greatest(1 - session_share - summer_share, 0) * (coalesce(CASE WHEN month(week_start + 3) = 11 THEN thanksgiving WHEN month(week_start + 3) IN (12, 1) THEN winter
        ELSE spring END, 'unknown') = 'closed')::INT)) / sum(dorm_capacity) AS closed_bed_share FROM pi LEFT JOIN halls USING (unitid) GROUP BY ALL)"""
)


def _session(spark, sf_dir):
    return calendars.weekly_session(calendars.session_days(A.calendar(spark, sf_dir)))


def _per_institution(spark, sf_dir):
    session = _session(spark, sf_dir)
    enrolled = presence.enrollment_by_week(session.select("week_start").distinct(), presence.normal_enrollment(A.enrollment(spark, sf_dir), REMOTE))
    return presence.own_else_typical(enrolled, session)


def _halls(spark, sf_dir):
    return A.table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 5").selectExpr(
        "cast(n_nationkey as string) as unitid", "case n_nationkey % 3 when 0 then 'closed' when 1 then 'open' end as thanksgiving", "if(n_nationkey % 2 = 0, 'closed', 'open') as winter", "if(n_nationkey % 5 = 0, 'closed', 'limited') as spring"
    )


@query("p21_normal_enrollment", f"WITH {_PRESENCE} SELECT * FROM norm")
def p21_normal_enrollment(spark, sf_dir):
    return presence.normal_enrollment(A.enrollment(spark, sf_dir), REMOTE)


@query("p8_enrollment_by_week", f"WITH {_PRESENCE} SELECT * FROM ew")
def p8_enrollment_by_week(spark, sf_dir):
    """Year clipped to the published range, with a flag."""
    return presence.enrollment_by_week(_session(spark, sf_dir).select("week_start").distinct(), presence.normal_enrollment(A.enrollment(spark, sf_dir), REMOTE))


@query("j7_own_else_typical", f"WITH {_PRESENCE} SELECT * FROM pi")
def j7_own_else_typical(spark, sf_dir):
    return _per_institution(spark, sf_dir)


@query("a10_presence_index", f"WITH {_PRESENCE} SELECT * FROM px")
def a10_presence_index(spark, sf_dir):
    return presence.presence_index(presence.apply_covid(_per_institution(spark, sf_dir)))


@query("a11_closed_bed_share", f"WITH {_PRESENCE} SELECT * FROM cb")
def a11_closed_bed_share(spark, sf_dir):
    return presence.closed_bed_share(_per_institution(spark, sf_dir), _halls(spark, sf_dir))


_ARRANGEMENTS = "arr AS (SELECT fall_year AS acs_year, sum(dorm_capacity)::BIGINT AS in_university_housing, sum(distance_only)::BIGINT AS elsewhere FROM enr GROUP BY ALL)"


@query(
    "a12_away_range",
    f"""WITH {_PRESENCE}, {_ARRANGEMENTS}, sq AS (SELECT min(acs_year) AS lo, max(acs_year) AS hi FROM arr)
    SELECT week_start, presence_index, closed_bed_share, in_university_housing * closed_bed_share AS min_students_away,
    in_university_housing * (1 - housing_presence_index) + elsewhere * (1 - presence_index) AS max_students_away
    FROM px JOIN cb USING (week_start), sq JOIN arr ON acs_year = least(greatest(year(week_start + 3) - (month(week_start + 3) < 8)::INT, lo), hi)""",
)
def a12_away_range(spark, sf_dir):
    """Fewest and most students away each week."""
    rows = _per_institution(spark, sf_dir)
    arrangements = A.enrollment(spark, sf_dir).groupBy(F.col("fall_year").alias("acs_year")).agg(F.sum("dorm_capacity").alias("in_university_housing"), F.sum("distance_only").alias("elsewhere"))
    return presence.away_range(presence.presence_index(presence.apply_covid(rows)), presence.closed_bed_share(rows, _halls(spark, sf_dir)), arrangements)


@query(
    "a36_covid_policy",
    """WITH w AS (SELECT n_nationkey::VARCHAR AS unitid, unnest(generate_series(DATE '2020-03-02', DATE '2021-09-27', INTERVAL 7 DAY))::DATE AS week_start, n_nationkey * 100 AS normal_in_person FROM nation),
    t AS (SELECT *, CASE WHEN week_start + 3 BETWEEN DATE '2020-08-16' AND DATE '2020-12-31' THEN 'fall_2020' WHEN week_start + 3 BETWEEN DATE '2021-01-01' AND DATE '2021-08-15' THEN 'spring_2021' END AS term FROM w),
    p AS (SELECT n_nationkey::VARCHAR AS unitid, term, CASE WHEN (n_nationkey + length(term)) % 3 = 0 THEN 'remote' ELSE 'hybrid' END AS instruction FROM nation, (VALUES ('fall_2020'), ('spring_2021')) v(term) WHERE n_nationkey % 4 <> 1)
    SELECT week_start, coalesce(sum(normal_in_person) FILTER (instruction = 'remote'), 0)::DOUBLE / sum(normal_in_person) AS remote_share,
    coalesce(sum(normal_in_person) FILTER (instruction IS NOT NULL), 0)::DOUBLE / sum(normal_in_person) AS known_share FROM t LEFT JOIN p USING (unitid, term) GROUP BY ALL""",
)
def a36_covid_policy(spark, sf_dir):
    """Remote and known shares of enrollment in the pandemic year."""
    nation = A.table(spark, sf_dir, "nation")
    weeks = nation.selectExpr("cast(n_nationkey as string) as unitid", "explode(sequence(date'2020-03-02', date'2021-09-27', interval 7 days)) as week_start", "n_nationkey * 100 as normal_in_person")
    terms = spark.createDataFrame([("fall_2020",), ("spring_2021",)], "term string")
    policy = nation.filter("n_nationkey % 4 <> 1").crossJoin(terms).selectExpr("cast(n_nationkey as string) as unitid", "term", "if((n_nationkey + length(term)) % 3 = 0, 'remote', 'hybrid') as instruction")
    rows = presence.add_policy(weeks, policy)
    def share(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("normal_in_person"))), F.lit(0)) / F.sum("normal_in_person")
    return rows.groupBy("week_start").agg(share(F.col("instruction") == "remote").alias("remote_share"), share(F.col("instruction").isNotNull()).alias("known_share"))


# --- joins


@query(
    "j1_spine",
    f"""WITH {A.WEATHER}, {A.ENTRIES}, s AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS week_start FROM orders), w AS (SELECT date_trunc('week', date)::DATE AS week_start, sum(rain_mm) AS rain_mm FROM weather WHERE date < DATE '1999-06-01' GROUP BY ALL),
    e AS (SELECT date_trunc('week', date)::DATE AS week_start, sum(entries)::BIGINT AS entries FROM entries WHERE date >= DATE '1997-03-01' GROUP BY ALL) SELECT * FROM s LEFT JOIN w USING (week_start) LEFT JOIN e USING (week_start)""",
)
def j1_spine(spark, sf_dir):
    """Weekly sources of different spans joined onto the spine."""
    spine = A.table(spark, sf_dir, "orders").select(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).distinct()
    week = timeline.week_of(F.col("date")).alias("week_start")
    rain = A.weather_days(spark, sf_dir).filter("date < '1999-06-01'").groupBy(week).agg(F.sum("rain_mm").alias("rain_mm"))
    entries = A.daily_entries(spark, sf_dir).filter("date >= '1997-03-01'").groupBy(week).agg(F.sum("entries").alias("entries"))
    return joins.onto_spine(spine, [rain, entries])


@query(
    "j5_full_outer",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY ALL), b AS (SELECT c_custkey + 50 AS k, c_acctbal FROM customer) SELECT coalesce(a.k, b.k) AS k, orders, c_acctbal FROM a FULL JOIN b ON a.k = b.k""",
)
def j5_full_outer(spark, sf_dir):
    a = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"))
    b = A.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 50).alias("k"), "c_acctbal")
    return a.join(b, "k", "full")


@query(
    "j6_fallback_lookup",
    f"""WITH {A.TRIPS}, d AS (SELECT *, strftime(date, '%Y%m') AS month FROM station_day), m AS (SELECT DISTINCT station_id, month, 'M' || (station_id::INT % 3) AS town FROM d WHERE station_id::INT % 5 <> 0 AND month::INT % 2 = 0),
    o AS (SELECT DISTINCT station_id, 'O' || (station_id::INT % 4) AS town FROM d WHERE station_id::INT % 7 <> 0)
    SELECT coalesce(m.town, o.town, 'unknown') AS town, sum(trips)::BIGINT AS trips, count(*) AS n FROM d LEFT JOIN m USING (station_id, month) LEFT JOIN o USING (station_id) GROUP BY ALL""",
)
def j6_fallback_lookup(spark, sf_dir):
    """Monthly value, else overall value, else default."""
    days = A.station_days(spark, sf_dir).withColumn("month", F.date_format("date", "yyyyMM"))
    known = days.filter("station_id is not null")
    station = F.col("station_id").cast("int")
    fine = known.filter((station % 5 != 0) & (F.col("month").cast("int") % 2 == 0)).select("station_id", "month", F.concat(F.lit("M"), station % 3).alias("town")).distinct()
    coarse = known.filter(station % 7 != 0).select("station_id", F.concat(F.lit("O"), station % 4).alias("town")).distinct()
    tagged = joins.fallback_lookup(days, fine, ["station_id", "month"], coarse, ["station_id"], {"town": "unknown"})
    return tagged.groupBy("town").agg(F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("n"))


_BREAKS = f"""WITH {A.CALENDAR}, {A.ENTRIES}, e AS (SELECT date_trunc('week', date)::DATE AS week_start, (right(stop_id, 1)::INT)::VARCHAR AS unitid, sum(entries)::DOUBLE AS value FROM entries GROUP BY ALL),
    j AS (SELECT w.week_start, w.unitid, w.days_in_session, value FROM wsess w JOIN e USING (week_start, unitid)),
    n AS (SELECT a.*, (SELECT avg(b.value) FROM j b WHERE b.unitid = a.unitid AND b.days_in_session >= 5 AND abs(date_diff('day', a.week_start, b.week_start)) <= 21) AS nearby FROM j a)"""


def _break_rows(spark, sf_dir):
    week = timeline.week_of(F.col("date")).alias("week_start")
    entries = A.daily_entries(spark, sf_dir).groupBy(week, F.right("stop_id", F.lit(1)).alias("unitid")).agg(F.sum("entries").cast("double").alias("value"))
    return _session(spark, sf_dir).join(entries, ["week_start", "unitid"])


@query("j9_mean_nearby", f"{_BREAKS} SELECT week_start, unitid, days_in_session, value, nearby FROM n WHERE days_in_session = 0")
def j9_mean_nearby(spark, sf_dir):
    """Break weeks against the unit's session weeks within 21 days."""
    rows = joins.mean_nearby(_break_rows(spark, sf_dir), "unitid", "week_start", "value", F.col("days_in_session") >= 5, 21, "nearby")
    return rows.filter("days_in_session = 0").select("week_start", "unitid", "days_in_session", "value", "nearby")


@query(
    "a28_break_summary",
    f"{_BREAKS}, d AS (SELECT CASE WHEN month(week_start + 3) = 11 THEN 'thanksgiving' WHEN month(week_start + 3) IN (12, 1) THEN 'winter' ELSE 'spring' END AS kind, value / nearby - 1 AS change FROM n WHERE days_in_session = 0 AND nearby > 0) SELECT kind, count(*) AS n, median(change) AS median_change, avg((change < 0)::INT) AS share_down FROM d GROUP BY ALL",
)
def a28_break_summary(spark, sf_dir):
    """Median change in breaks and the share that fell."""
    rows = j9_mean_nearby(spark, sf_dir).filter("nearby > 0").withColumn("change", F.col("value") / F.col("nearby") - 1)
    return rows.groupBy(timeline.break_kind(F.col("week_start")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.percentile("change", 0.5).alias("median_change"), F.avg((F.col("change") < 0).cast("int")).alias("share_down"))


@query(
    "j11_interpolate",
    """WITH s AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE + 3 AS day FROM orders), a AS (SELECT make_date(year(o_orderdate), 7, 1) AS d, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY ALL),
    p AS (SELECT day, (SELECT max(d) FROM a WHERE d <= day) AS lo, (SELECT min(d) FROM a WHERE d >= day) AS hi FROM s)
    SELECT day, CASE WHEN lo = day THEN l.v WHEN lo IS NULL THEN h.v WHEN hi IS NULL THEN l.v ELSE l.v + (h.v - l.v) * date_diff('day', lo, day) / date_diff('day', lo, hi) END AS population, lo IS NULL OR hi IS NULL AS extrapolated
    FROM p LEFT JOIN a l ON l.d = lo LEFT JOIN a h ON h.d = hi""",
)
def j11_interpolate(spark, sf_dir):
    """Weekly values between yearly anchors, flat outside."""
    orders = A.table(spark, sf_dir, "orders")
    weeks = orders.select(F.date_add(timeline.week_of(F.to_date("o_orderdate")), 3).alias("day")).distinct()
    year = F.year("o_orderdate")
    anchors = orders.filter(year.between(1996, 2000)).groupBy(F.make_date(year, F.lit(7), F.lit(1)).alias("anchor")).agg(F.count(F.lit(1)).alias("value"))
    return joins.interpolate(weeks, "day", anchors, "anchor", "value", "population")


@query(
    "j14_paired_change",
    """WITH w AS (SELECT l_suppkey, year(l_shipdate) AS year, avg(l_quantity) FILTER (month(l_shipdate) = 6) AS before, avg(l_quantity) FILTER (month(l_shipdate) = 9) AS after FROM lineitem GROUP BY ALL) SELECT *, ln(after / before) AS log_change FROM w WHERE before > 0 AND after > 0""",
)
def j14_paired_change(spark, sf_dir):
    """June against September of the same place and year."""
    rows = A.table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return joins.paired_change(rows, ["l_suppkey", "year"], F.month("l_shipdate"), 6, 9, "l_quantity")


@query(
    "a29_street_rows",
    """WITH w AS (SELECT l_suppkey, l_suppkey % 3 AS zone, year(l_shipdate) AS year, avg(l_quantity) FILTER (month(l_shipdate) = 6) AS before, avg(l_quantity) FILTER (month(l_shipdate) = 9) AS after FROM lineitem GROUP BY ALL) SELECT zone, count(*) AS n, 100 * (exp(median(ln(after / before))) - 1) AS percent FROM w WHERE before > 0 AND after > 0 GROUP BY zone""",
)
def a29_street_rows(spark, sf_dir):
    """Median change in percent by zone."""
    rows = j14_paired_change(spark, sf_dir)
    return rows.groupBy((F.col("l_suppkey") % 3).alias("zone")).agg(F.count(F.lit(1)).alias("n"), (100 * (F.exp(F.percentile("log_change", 0.5)) - 1)).alias("percent"))


@query(
    "j16_asked_shares",
    """WITH k AS (SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer), q AS (SELECT DISTINCT c_mktsegment AS segment, o_orderpriority AS answer FROM customer, (SELECT DISTINCT o_orderpriority FROM orders)),
    a AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, o_orderpriority AS answer, count(*)::DOUBLE AS share FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 50 = 0 GROUP BY ALL)
    SELECT segment, nation, answer, coalesce(share, 0) AS share FROM k JOIN q USING (segment) LEFT JOIN a USING (segment, nation, answer)""",
)
def j16_asked_shares(spark, sf_dir):
    """An answer nobody gave is a share of 0."""
    customer, orders = A.table(spark, sf_dir, "customer"), A.table(spark, sf_dir, "orders")
    keys = customer.select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).distinct()
    asked = keys.select("segment").distinct().crossJoin(F.broadcast(orders.select(F.col("o_orderpriority").alias("answer")).distinct()))  # five priorities
    answers = orders.filter("o_orderkey % 50 = 0").join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("answer")
    ).agg(F.count(F.lit(1)).cast("double").alias("share"))
    return joins.asked_shares(keys, asked, answers, ["segment", "nation", "answer"], "share")


@query(
    "j17_rotations",
    """WITH n AS (SELECT n_name AS key, n_regionkey, dense_rank() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS m FROM nation) SELECT a.key, b.key AS donor, k::INT AS k, b.n_regionkey FROM n a, (SELECT unnest(range(1, 200)) AS k) r JOIN n b ON b.i = (a.i + k) % a.m WHERE k < a.m""",
)
def j17_rotations(spark, sf_dir):
    """Every key takes the rows of the k-th next key, for every k."""
    return joins.rotations(A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), "n_regionkey"), "key").withColumn("k", F.col("k").cast("int"))


# --- windows and descriptive statistics

_WEEKS = "wk AS (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, count(*) AS n, sum(o_custkey)::DOUBLE AS v FROM orders GROUP BY ALL)"


def _weeks(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("double").alias("v"))


@query("v2_deviations", f"WITH {_WEEKS} SELECT week_start, year(week_start) AS year, n, v - avg(v) OVER (PARTITION BY year(week_start)) AS v FROM wk")
def v2_deviations(spark, sf_dir):
    return windows.deviations(_weeks(spark, sf_dir).withColumn("year", F.year("week_start")), ["v"], ["year"])


@query(
    "v3_moving_average",
    f"WITH {_WEEKS} SELECT week_start, CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END AS smooth FROM wk WINDOW w AS (PARTITION BY year(week_start) ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
)
def v3_moving_average(spark, sf_dir):
    rows = _weeks(spark, sf_dir).withColumn("year", F.year("week_start"))
    return rows.select("week_start", windows.moving_average("v", "week_start", ["year"]).alias("smooth"))


@query(
    "v4_neighbours",
    f"WITH {_WEEKS} SELECT week_start, year(week_start) AS year, n, v, lag(v) OVER w AS previous, lead(v) OVER w AS next, v - lag(v) OVER w AS change FROM wk WINDOW w AS (PARTITION BY year(week_start) ORDER BY week_start)",
)
def v4_neighbours(spark, sf_dir):
    return windows.neighbours(_weeks(spark, sf_dir).withColumn("year", F.year("week_start")), "v", "week_start", ["year"])


@query(
    "v5_runs",
    """WITH f AS (SELECT DISTINCT n_nationkey AS unit, d::DATE AS day, (dayofyear(d) + n_nationkey * 3) % 17 < 6 AS flag FROM nation, (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)),
    g AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day) - row_number() OVER (PARTITION BY unit, flag ORDER BY day) AS k FROM f) SELECT unit, flag, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY unit, flag, k""",
)
def v5_runs(spark, sf_dir):
    """Contiguous runs of a flag."""
    days = A.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    flags = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit")).crossJoin(days).withColumn("flag", (F.dayofyear("day") + F.col("unit") * 3) % 17 < 6)
    return windows.runs(flags, ["unit"], "day", "flag")


@query(
    "v9_filled",
    f"WITH {_WEEKS}, h AS (SELECT week_start, CASE WHEN n % 3 = 0 THEN v END AS v FROM wk) SELECT week_start, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY year(week_start) ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY year(week_start) ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM h",
)
def v9_filled(spark, sf_dir):
    rows = _weeks(spark, sf_dir).select("week_start", F.year("week_start").alias("year"), F.when(F.col("n") % 3 == 0, F.col("v")).alias("v"))
    return rows.select("week_start", windows.filled("v", "week_start", ["year"]).alias("v"))


@query(
    "a27_within_year_corr",
    f"WITH {A.WEATHER}, w AS (SELECT date_trunc('week', date)::DATE AS week_start, sum(rain_mm)::DOUBLE AS x FROM weather GROUP BY ALL), {_WEEKS} SELECT year(week_start) AS year, count(*) AS n, CASE WHEN count(*) >= 20 THEN corr(x, n) END AS r FROM w JOIN wk USING (week_start) GROUP BY ALL",
)
def a27_within_year_corr(spark, sf_dir):
    """Correlation within each year with enough weeks, guarded against constants."""
    rain = A.weather_days(spark, sf_dir).groupBy(timeline.week_of(F.col("date")).alias("week_start")).agg(F.sum("rain_mm").alias("x"))
    both = rain.join(_weeks(spark, sf_dir), "week_start")
    return both.groupBy(F.year("week_start").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= config.MIN_YEAR_WEEKS, windows.corr_from_sums(F.col("x"), F.col("n").cast("double"))).alias("r"))


@query(
    "a34_input_changes",
    """WITH y AS (SELECT c_nationkey, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), d AS (SELECT *, n - lag(n) OVER w AS d, year - lag(year) OVER w AS gap FROM y WHERE year <> 1998 WINDOW w AS (PARTITION BY c_nationkey ORDER BY year))
    SELECT c_nationkey, max(abs(d)) AS largest, median(abs(d)) AS median FROM d WHERE gap = 1 GROUP BY ALL""",
)
def a34_input_changes(spark, sf_dir):
    years = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return windows.yearly_changes(years, "year", "n", [1998], ["c_nationkey"])


@query(
    "a31_requests_signal",
    """WITH d AS (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS day, count(*) FILTER (o_custkey % 3 = 0) AS campus, count(*) FILTER (o_custkey % 3 = 1) AS away FROM orders GROUP BY ALL)
    SELECT week_start, max(ln(campus / away)) FILTER (day = 'weekday') AS weekday, max(ln(campus / away)) FILTER (day = 'weekend') AS weekend FROM d WHERE campus > 0 AND away > 0 GROUP BY ALL""",
)
def a31_requests_signal(spark, sf_dir):
    """Log ratio of requests by zone, per week and day kind."""
    day = F.to_date("o_orderdate")
    rows = A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(day).alias("week_start"), F.when(timeline.is_weekend(day), "weekend").otherwise("weekday").alias("day")).agg(
        F.count_if(F.col("o_custkey") % 3 == 0).alias("campus"), F.count_if(F.col("o_custkey") % 3 == 1).alias("away")
    )
    ratio = rows.filter("campus > 0 and away > 0").withColumn("ratio", F.ln(F.col("campus") / F.col("away")))
    return ratio.groupBy("week_start").pivot("day", ["weekday", "weekend"]).agg(F.max("ratio"))


@query("r5_unpivot", "UNPIVOT (SELECT n_nationkey, n_nationkey * 10 AS POPESTIMATE2019, n_regionkey * 7 AS POPESTIMATE2020 FROM nation) ON POPESTIMATE2019, POPESTIMATE2020 INTO NAME year_column VALUE population")
def r5_unpivot(spark, sf_dir):
    """Year columns that match a pattern, as rows."""
    import re

    wide = A.table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_nationkey * 10 as POPESTIMATE2019", "n_regionkey * 7 as POPESTIMATE2020", "n_name as NAME")
    years = [c for c in wide.columns if re.fullmatch(r"POPESTIMATE\d{4}", c)]
    return wide.unpivot("n_nationkey", years, "year_column", "population")


@query(
    "r3_series_splice",
    "SELECT date_trunc('week', o_orderdate)::DATE AS week_start, 'old' AS series, count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-01-05' GROUP BY ALL UNION ALL SELECT date_trunc('week', l_shipdate)::DATE, 'new', count(*) FROM lineitem WHERE l_shipdate >= DATE '1998-01-05' GROUP BY ALL",
)
def r3_series_splice(spark, sf_dir):
    """One series before a date, another from it."""
    def weekly(rows, day, name):
        return rows.groupBy(timeline.week_of(F.to_date(day)).alias("week_start"), F.lit(name).alias("series")).agg(F.count(F.lit(1)).alias("n"))
    old = weekly(A.table(spark, sf_dir, "orders").filter("o_orderdate < '1998-01-05'"), "o_orderdate", "old")
    return old.unionByName(weekly(A.table(spark, sf_dir, "lineitem").filter("l_shipdate >= '1998-01-05'"), "l_shipdate", "new"))
