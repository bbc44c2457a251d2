"""Queries over places, panels, hold-outs and bootstraps."""

from pyspark.sql import functions as F

from ebbtide.operators import geo, panel, resample, timeline
from ebbtide.plans import adapters as A
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import materialize

_XY = f"(lng - ({geo.LNG0})) * {geo.M_PER_LNG}::DOUBLE AS x, (lat - {geo.LAT0}) * {geo.M_PER_LAT}::DOUBLE AS y"
_PLACES = A.POINTS.replace("::DOUBLE / 10000", "::DOUBLE / 10000") + f", px AS (SELECT *, {_XY} FROM points), cx AS (SELECT *, {_XY} FROM campuses WHERE typical_in_person >= 1000)"
_XYF = _PLACES.replace(f"- ({geo.LNG0})", f"- ({geo.LNG0})::DOUBLE").replace(f"- {geo.LAT0})", f"- {geo.LAT0}::DOUBLE)")


@query("g4_project", f"WITH {_XYF} SELECT point_id, lat, lng, x, y FROM px")
def g4_project(spark, sf_dir):
    return geo.located(A.points(spark, sf_dir))


_NEAREST = f"""{_XYF}, d AS (SELECT p.point_id, p.lat, p.lng, c.unitid, c.institution, c.typical_in_person, round(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))) AS m FROM px p, cx c),
    b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, typical_in_person DESC, unitid) AS n FROM d),
    near AS (SELECT point_id, lat, lng, unitid AS campus_unitid, institution AS campus_institution, m AS campus_distance_m, CASE WHEN m <= 400 THEN 'campus' WHEN m <= 1000 THEN 'near' ELSE 'away' END AS campus_zone FROM b WHERE n = 1)"""


@query("g1_nearest_campus", f"WITH {_NEAREST} SELECT * FROM near")
def g1_nearest_campus(spark, sf_dir):
    """Nearest major campus and zone of each point."""
    return geo.nearest_campus(A.points(spark, sf_dir), "point_id", A.campuses(spark, sf_dir))


@query(
    "j19_place_once",
    f"WITH {_NEAREST} SELECT campus_zone, count(*) AS n FROM lineitem JOIN near ON point_id = l_suppkey GROUP BY ALL",
)
def j19_place_once(spark, sf_dir):
    """Events tagged by placing each distinct coordinate once."""
    events = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("point_id")).join(A.points(spark, sf_dir), "point_id").drop("point_id")
    tagged = geo.place_once(events, lambda places: geo.nearest_campus(places, "place", A.campuses(spark, sf_dir)))
    return tagged.groupBy("campus_zone").agg(F.count(F.lit(1)).alias("n"))


_TOWNS = """corners AS (SELECT r_name AS town, p AS position, -6000 + 2500 * r_regionkey + 2500 * (p = 1 OR p = 2)::INT AS x, CASE WHEN p >= 2 THEN 4000 ELSE -5500 END AS y FROM region, (VALUES (0), (1), (2), (3)) v(p)),
    edges AS (SELECT a.town, a.x::DOUBLE AS x1, a.y::DOUBLE AS y1, b.x::DOUBLE AS x2, b.y::DOUBLE AS y2 FROM corners a JOIN corners b ON a.town = b.town AND b.position = (a.position + 1) % 4)"""


def _town_edges(spark, sf_dir):
    corners = A.table(spark, sf_dir, "region").selectExpr("r_name as town", "r_regionkey", "explode(array(0, 1, 2, 3)) as position").selectExpr(
        "town", "position", "cast(-6000 + 2500 * r_regionkey + if(position in (1, 2), 2500, 0) as double) as x", "cast(if(position >= 2, 4000, -5500) as double) as y"
    )
    return geo.edges(corners)


@query(
    "g2_assign_towns",
    f"""WITH {_XYF}, {_TOWNS}, pe AS (SELECT point_id, x, y, town, (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 AS crossing,
        least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t, x1, y1, x2, y2 FROM px, edges),
    pt AS (SELECT point_id, town, count(*) FILTER (crossing) % 2 = 1 AS odd, min(sqrt((x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1))))) AS edge_m FROM pe GROUP BY ALL),
    pi AS (SELECT *, odd OR edge_m = 0 AS inside, CASE WHEN odd OR edge_m = 0 THEN 0 ELSE edge_m END AS away FROM pt),
    own AS (SELECT point_id, town FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY inside DESC, away, town) AS n FROM pi WHERE inside OR edge_m <= 100) WHERE n = 1),
    oth AS (SELECT pi.*, row_number() OVER (PARTITION BY pi.point_id ORDER BY away, pi.town) AS n FROM pi LEFT JOIN own USING (point_id) WHERE coalesce(own.town, '') <> pi.town AND away <= 1000)
    SELECT p.point_id, p.lat, p.lng, coalesce(own.town, 'unknown') AS municipality, round(away) AS border_distance_m, oth.town AS nearest_other_municipality
    FROM points p LEFT JOIN own USING (point_id) LEFT JOIN oth ON oth.point_id = p.point_id AND n = 1""",
)
def g2_assign_towns(spark, sf_dir):
    """Town of each point and the nearest other one."""
    return geo.assign_towns(A.points(spark, sf_dir), "point_id", _town_edges(spark, sf_dir))


@query(
    "g5_same_station",
    f"""WITH RECURSIVE {_XYF}, l AS (SELECT a.point_id AS a, b.point_id AS b FROM px a JOIN px b ON a.point_id <> b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 600::DOUBLE * 600),
    r(a, b) AS (SELECT point_id, point_id FROM px UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS point_id, min(b) AS station FROM r GROUP BY a""",
)
def g5_same_station(spark, sf_dir):
    """Records chained by short steps (G5); 600 m, as the derived points lie far apart."""
    return geo.same_station(A.points(spark, sf_dir), "point_id", 600)


@query(
    "g6_station_data",
    f"""WITH RECURSIVE {_XYF}, l AS (SELECT a.point_id AS a, b.point_id AS b FROM px a JOIN px b ON a.point_id <> b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 600::DOUBLE * 600),
    r(a, b) AS (SELECT point_id, point_id FROM px UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), g AS (SELECT a AS point_id, min(b) AS station FROM r GROUP BY a),
    u AS (SELECT l_suppkey AS point_id, count(*) AS trips, min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem GROUP BY ALL)
    SELECT station, count(*) AS records, sum(trips)::BIGINT AS trips, sum(trips)::DOUBLE / (date_diff('day', min(lo), max(hi)) + 1) AS per_day FROM g JOIN u USING (point_id) GROUP BY station""",
)
def g6_station_data(spark, sf_dir):
    """A component's records combined, with use per day."""
    used = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("point_id")).agg(F.count(F.lit(1)).alias("trips"), F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    grouped = g5_same_station(spark, sf_dir).join(used, "point_id").groupBy("station")
    return grouped.agg(F.count(F.lit(1)).alias("records"), F.sum("trips").alias("trips"), (F.sum("trips") / (F.datediff(F.max("hi"), F.min("lo")) + 1)).alias("per_day"))


@query(
    "g9_groups_by_shared",
    """WITH RECURSIVE m AS (SELECT DISTINCT o_custkey AS area, (o_custkey + (o_custkey % 7 = 2 AND o_orderkey % 2 = 0)::INT) // 3 AS town FROM orders), l AS (SELECT DISTINCT a.area AS a, b.area AS b FROM m a JOIN m b USING (town)),
    r(a, b) AS (SELECT DISTINCT area, area FROM m UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS area, min(b) AS "group" FROM r GROUP BY a""",
)
def g9_groups_by_shared(spark, sf_dir):
    """Areas that share a town, directly or through others."""
    members = A.table(spark, sf_dir, "orders").selectExpr("o_custkey as area", "(o_custkey + if(o_custkey % 7 = 2 and o_orderkey % 2 = 0, 1, 0)) div 3 as town").distinct()
    return geo.groups_by_shared(members, "area", "town")


# --- panels

_PANEL = """
    sup AS (SELECT s_suppkey, 0.07::DOUBLE * (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS measure FROM supplier),
    act AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, l_suppkey, sum(l_quantity) AS activity, isodow(l_shipdate) >= 6 AS weekend FROM lineitem GROUP BY ALL),
    pan AS (SELECT week_start, l_suppkey AS unit, weekend, ln(activity) AS y, measure AS x FROM act JOIN sup ON s_suppkey = l_suppkey)
"""


def _panel(spark, sf_dir):
    supplier = A.table(spark, sf_dir, "supplier")
    span = supplier.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    measure = supplier.crossJoin(F.broadcast(span)).select("s_suppkey", (0.07 * (F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))
    day = F.to_date("l_shipdate")
    activity = A.table(spark, sf_dir, "lineitem").groupBy(timeline.week_of(day).alias("week_start"), "l_suppkey", timeline.is_weekend(day).alias("weekend")).agg(F.sum("l_quantity").alias("activity"))
    return activity.join(measure, F.col("s_suppkey") == F.col("l_suppkey")).select("week_start", F.col("l_suppkey").alias("unit"), "weekend", F.ln("activity").alias("y"), "x")


@query("m1_demean")
def m1_demean(spark, sf_dir):
    """Activity without unit and week means, by alternating projections (M1)."""
    rows = _panel(spark, sf_dir).filter("not weekend").select("week_start", "unit", "y")
    return panel.demean(rows, ["y"], [["unit"], ["week_start"]])


@query("m6_fixed_effects")
def m6_fixed_effects(spark, sf_dir):
    """Effect of a week's orders on activity with unit and year levels, clustered by unit (M3, M4, M6, M7)."""
    busy = A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg((F.count(F.lit(1)) / 100).alias("busy"))
    rows = _panel(spark, sf_dir).filter("not weekend").join(busy, "week_start").withColumn("year", F.year("week_start"))
    found = panel.fixed_effects(rows, ["busy"], "y", [["unit"], ["year"]], "unit")
    row = spark.createDataFrame([(float(found["beta"][0]), float(found["se"][0]), int(found["n"]), float(found["r2_within"]))], "beta double, se double, n long, r2_within double")
    effect, low, high = panel.effect_percent(F.col("beta"), F.col("se"))
    return row.withColumns({"percent": effect, "percent_low": low, "percent_high": high})


_SERIES = f"""
    {A.WEATHER}, ser AS (SELECT date_trunc('week', date)::DATE AS week_start, sum(rain_mm) AS rain, sum(snow_mm) AS snow FROM weather GROUP BY ALL),
    obs AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, count(*)::DOUBLE AS y FROM lineitem GROUP BY ALL),
    dat AS (SELECT week_start, y, rain, snow, 1::DOUBLE AS one, strftime(week_start, '%Y-%m') AS month FROM ser JOIN obs USING (week_start))
"""


def _series(spark, sf_dir):
    week = timeline.week_of(F.col("date")).alias("week_start")
    weather = A.weather_days(spark, sf_dir).groupBy(week).agg(F.sum("rain_mm").alias("rain"), F.sum("snow_mm").alias("snow"))
    counts = A.table(spark, sf_dir, "lineitem").groupBy(timeline.week_of(F.to_date("l_shipdate")).alias("week_start")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return weather.join(counts, "week_start").withColumns({"one": F.lit(1.0), "month": F.date_format("week_start", "yyyy-MM")})


@query(
    "m3_gram",
    f"WITH {_SERIES} SELECT year(week_start) AS year, count(*) AS n, sum(y * y) AS yy, [sum(one), sum(rain), sum(rain), sum(rain * rain)] AS xx, [sum(y), sum(rain * y)] AS xy FROM dat GROUP BY ALL",
)
def m3_gram(spark, sf_dir):
    """Sums of products per year, the sufficient statistics of a fit (M3, L2)."""
    return panel.gram(_series(spark, sf_dir).withColumn("year", F.year("week_start")), ["one", "rain"], "y", ["year"])


@query(
    "l1_held_out",
    f"""WITH {_SERIES}, f AS (SELECT month, min(week_start) - 7 AS lo, max(week_start) + 7 AS hi FROM dat GROUP BY ALL),
    b AS (SELECT month, regr_slope(y, rain) AS b, regr_intercept(y, rain) AS a FROM (SELECT f.month, y, rain FROM f JOIN dat d ON d.week_start < lo OR d.week_start > hi) GROUP BY month)
    SELECT year(week_start) AS year, count(*) AS n, avg(abs(y - a - b * rain)) AS mae, sqrt(avg((y - a - b * rain) ** 2)) AS rmse, 1 - sum((y - a - b * rain) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM dat JOIN b USING (month) GROUP BY ALL""",
)
def l1_held_out(spark, sf_dir):
    """Scores on held-out months with a one-week buffer, by subtracting sums."""
    guessed = panel.held_out_scores(_series(spark, sf_dir), ["one", "rain"], "y", "month", "week_start").withColumn("year", F.year("week_start"))
    return panel.scores(guessed, "y", "predicted", ["year"])


@query(
    "l2_forward",
    f"""WITH {_SERIES}, t AS (SELECT unnest([1998, 1999, 2000]) AS test), b AS (SELECT test, regr_slope(y, rain) AS b, regr_intercept(y, rain) AS a FROM t JOIN dat ON year(week_start) < test GROUP BY test)
    SELECT test, count(*) AS n, avg(abs(y - a - b * rain)) AS mae, sqrt(avg((y - a - b * rain) ** 2)) AS rmse, 1 - sum((y - a - b * rain) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM b JOIN dat ON year(week_start) = test GROUP BY test""",
)
def l2_forward(spark, sf_dir):
    """Each year predicted from the years before it (L2)."""
    rows = _series(spark, sf_dir).withColumn("year", F.year("week_start"))
    sums = panel.gram(rows, ["one", "rain"], "y", ["year"])
    tests = spark.createDataFrame([(y,) for y in (1998, 1999, 2000)], "test int")
    past = tests.join(sums, F.col("year") < F.col("test")).groupBy("test").agg(*(F.sum(F.col("xx")[k]).alias(f"x{k}") for k in (0, 1, 3)), *(F.sum(F.col("xy")[k]).alias(f"y{k}") for k in (0, 1)))
    slope = (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / (F.col("x0") * F.col("x3") - F.col("x1") * F.col("x1"))
    fitted = past.withColumn("b", slope).withColumn("a", (F.col("y0") - F.col("b") * F.col("x1")) / F.col("x0")).select("test", "a", "b")
    return panel.scores(rows.join(fitted, F.col("year") == F.col("test")).withColumn("predicted", F.col("a") + F.col("b") * F.col("rain")), "y", "predicted", ["test"])


@query("m12_r2_gain", f"WITH {_SERIES}, mix AS (SELECT rain, snow, y + rain AS y FROM dat) SELECT regr_r2(y, rain) AS r2_base, 1 - (1 - regr_r2(y, rain)) * (1 - pc) AS r2_more FROM mix, (SELECT (corr(y, snow) - corr(y, rain) * corr(snow, rain)) ** 2 / ((1 - corr(y, rain) ** 2) * (1 - corr(snow, rain) ** 2)) AS pc FROM mix) GROUP BY pc")
def m12_r2_gain(spark, sf_dir):
    """R2 without and with one more input, from one set of sums."""
    base, more = panel.r2_gain(_series(spark, sf_dir).withColumn("y", F.col("y") + F.col("rain")), ["one", "rain"], "snow", "y")
    return spark.createDataFrame([(base, more)], "r2_base double, r2_more double")


# --- bootstraps


def drawn(blocks: str, seed: int = 1) -> str:
    """SQL of a block drawn with replacement by a hash of (draw, i): the same 60 bits of MD5 as ``resample.draw_blocks``."""
    return f"('0x' || substr(md5('{seed}-' || draw || '-' || i), 1, 15))::BIGINT % {blocks}"


_DRAWS = f"dr AS (SELECT draw, block, count(*) AS times FROM (SELECT draw, {drawn('nb')} AS block FROM (SELECT unnest(range(0, 1000)) AS draw), (SELECT unnest(range(0, nb)) AS i, nb FROM (SELECT count(DISTINCT month) AS nb FROM dat)) z) GROUP BY ALL)"


def _blocks(spark, rows):
    months = resample.numbered(rows, "month")
    return months, months.count()


@query(
    "u1_block_bootstrap",
    f"""WITH {_SERIES}, m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS block FROM (SELECT DISTINCT month FROM dat)), g AS (SELECT block, count(*) AS n, sum(rain) AS sx, sum(y) AS sy, sum(rain * rain) AS sxx, sum(rain * y) AS sxy FROM dat JOIN m USING (month) GROUP BY ALL), {_DRAWS}
    SELECT draw::INT AS draw, (sum(times * n) * sum(times * sxy) - sum(times * sx) * sum(times * sy)) / (sum(times * n) * sum(times * sxx) - sum(times * sx) * sum(times * sx)) AS slope FROM dr JOIN g USING (block) GROUP BY draw""",
)
def u1_block_bootstrap(spark, sf_dir, draws=1000, seed=1):
    """Slopes of draws of months, from each month's sums."""
    rows = _series(spark, sf_dir)
    months, many = _blocks(spark, rows)
    x, y = F.col("rain"), F.col("y")
    cells = rows.join(months, "month").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    sums = resample.weighted_sums(cells, [resample.draw_blocks(spark, draws, many, seed=seed)], {c: F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")})
    return sums.selectExpr("draw", "(n * sxy - sx * sy) / (n * sxx - sx * sx) as slope")


@query(
    "u2_moving_blocks",
    f"""WITH {_SERIES}, m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS block FROM (SELECT DISTINCT month FROM dat)), nb AS (SELECT count(*) AS nb FROM m),
    s AS (SELECT draw, {drawn('(nb - 2)')} AS s FROM nb, (SELECT unnest(range(0, 1000)) AS draw), (SELECT unnest(range(0, (nb + 2) // 3)) AS i FROM nb)),
    d AS (SELECT draw, s + o AS block, count(*) AS times FROM s, (SELECT unnest(range(0, 3)) AS o) GROUP BY ALL), g AS (SELECT block, count(*) AS n, sum(y) AS sy FROM dat JOIN m USING (month) GROUP BY ALL)
    SELECT draw::INT AS draw, sum(times * sy) / sum(times * n) AS mean FROM d JOIN g USING (block) GROUP BY draw""",
)
def u2_moving_blocks(spark, sf_dir):
    """Means of 1,000 draws of runs of three months."""
    rows = _series(spark, sf_dir)
    cells = materialize(rows.join(_blocks(spark, rows)[0], "month").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")), "cells")
    runs, starts, picks = resample.moving_runs(cells, 3, ["n", "sy"])
    sums = resample.weighted_sums(runs, [resample.draw_blocks(spark, 1000, starts, picks)], {"n": F.col("n"), "sy": F.col("sy")})
    return sums.selectExpr("draw", "sy / n as mean")


_TWO_WAY = f"""cell AS (SELECT l_suppkey % 20 AS station, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS month, count(*) AS known, count(*) FILTER (l_partkey % 5 = 0) AS young FROM lineitem GROUP BY ALL),
    bs AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS block FROM (SELECT DISTINCT station FROM cell)), bm AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS block FROM (SELECT DISTINCT month FROM cell)),
    ns AS (SELECT count(*) AS ns FROM bs), nm AS (SELECT count(*) AS nm FROM bm),
    ds AS (SELECT draw, station, count(*) AS ts FROM (SELECT draw, {drawn('ns', 2)} AS block FROM (SELECT unnest(range(0, 1000)) AS draw), (SELECT ns, unnest(range(0, ns)) AS i FROM ns)) JOIN bs USING (block) GROUP BY ALL),
    dm AS (SELECT draw, month, count(*) AS tm FROM (SELECT draw, {drawn('nm', 3)} AS block FROM (SELECT unnest(range(0, 1000)) AS draw), (SELECT nm, unnest(range(0, nm)) AS i FROM nm)) JOIN bm USING (block) GROUP BY ALL),
    tw AS (SELECT draw, sum(ts * tm * young)::DOUBLE / sum(ts * tm * known) AS share FROM cell JOIN ds USING (station) JOIN dm USING (draw, month) GROUP BY draw)"""


def _two_way(spark, sf_dir, draws=1000, seed=1):
    cells = A.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).cast("int").alias("station"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("month")).agg(
        F.count(F.lit(1)).alias("known"), F.count_if(F.col("l_partkey") % 5 == 0).alias("young")
    )
    cells, times = materialize(cells, "cells"), []
    for k, key in enumerate(("station", "month")):  # the blocks are those the data holds
        blocks = materialize(resample.numbered(cells, key), "blocks")
        drawn = resample.draw_blocks(spark, draws, blocks.count(), seed=2 * seed + k)
        times.append(drawn.join(blocks, "block").select("draw", key, "times"))
    return resample.weighted_sums(cells, times, {"known": F.col("known"), "young": F.col("young")}).selectExpr("draw", "young / known as share")


@query("u3_two_way", f"WITH {_TWO_WAY} SELECT draw::INT AS draw, share FROM tw")
def u3_two_way(spark, sf_dir, draws=1000, seed=1):
    """Station weights times month weights on aggregated cells."""
    return _two_way(spark, sf_dir, draws, seed)


@query("u5_interval", f"WITH {_TWO_WAY} SELECT quantile_cont(share, 0.025) AS low, quantile_cont(share, 0.975) AS high, count(share) AS draws FROM tw")
def u5_interval(spark, sf_dir, draws=1000, seed=1):
    return resample.interval(_two_way(spark, sf_dir, draws, seed), "share")


@query(
    "u5_widened",
    f"WITH {_TWO_WAY} SELECT quantile_cont(0.2::DOUBLE + 1.4 * (share - 0.2::DOUBLE), 0.025) AS low, quantile_cont(0.2::DOUBLE + 1.4 * (share - 0.2::DOUBLE), 0.975) AS high, count(share) AS draws FROM tw",
)
def u5_widened(spark, sf_dir, draws=1000, seed=1):
    """Draws moved away from the estimate by a factor."""
    return resample.interval(resample.widen(_two_way(spark, sf_dir, draws, seed), "share", F.lit(0.2), 1.4), "share")


@query(
    "b8_band",
    f"""WITH {_TWO_WAY}, w AS (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), c AS (SELECT week_start, least(greatest(n * share, 4), 12) AS v FROM w, tw)
    SELECT week_start, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM c GROUP BY ALL""",
)
def b8_band(spark, sf_dir, draws=1000, seed=1):
    """Band of a clamped guess over all draws, per week."""
    weeks = A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return resample.band(weeks, _two_way(spark, sf_dir, draws, seed), F.col("n") * F.col("share"), F.lit(4.0), F.lit(12.0))


@query(
    "u7_coverage",
    """WITH r AS (SELECT l_linenumber AS runs, (l_partkey % 4)::DOUBLE AS truth, (l_partkey % 4) - 2 + l_quantity / 20 AS low, (l_partkey % 4) + l_quantity / 20 AS high FROM lineitem), p AS (SELECT runs, truth, avg((truth BETWEEN low AND high)::INT) AS s FROM r GROUP BY ALL)
    SELECT runs, avg(s) AS mean_coverage, min(s) AS worst_coverage FROM p GROUP BY ALL""",
)
def u7_coverage(spark, sf_dir):
    """How often intervals hold the truth, on average and at worst."""
    rows = A.table(spark, sf_dir, "lineitem").selectExpr("l_linenumber as runs", "cast(l_partkey % 4 as double) as truth", "l_partkey % 4 - 2 + l_quantity / 20 as low", "l_partkey % 4 + l_quantity / 20 as high")
    return resample.coverage(rows, ["runs"])
