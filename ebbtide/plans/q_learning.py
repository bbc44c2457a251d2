"""Queries over model families, joint shares and streams."""

import uuid

from pyspark.sql import functions as F

from ebbtide.operators import leaving, models, panel, resample, timeline
from ebbtide.plans import adapters as A
from ebbtide.plans.q_models import _PANEL, _SERIES, _panel, _series, drawn
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import materialize, shared_folder
from ebbtide.streaming import jobs

TREES = 300


def _learning(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumns({**timeline.harmonics(F.col("week_start")), "fold": (F.month("week_start") % 4).cast("int")})
    return materialize(rows, "learning")


_FEATURES = ["rain", "snow", "sin_1", "cos_1", "sin_2", "cos_2"]


@query("l18_family_scores")
def l18_family_scores(spark, sf_dir):
    """Every family's scores on out-of-fold predictions."""
    rows, out = _learning(spark, sf_dir), None
    for name, pipeline in models.families(_FEATURES, trees=TREES).items():
        scored = panel.scores(models.out_of_fold(rows, pipeline, "fold", 4).withColumn("family", F.lit(name)), "y", "prediction", ["family"])
        out = scored if out is None else out.unionByName(scored)
    return out


@query("l9_grouped_choice")
def l9_grouped_choice(spark, sf_dir):
    """Penalty chosen over folds of whole months."""
    chosen = models.grouped_choice(_learning(spark, sf_dir), _FEATURES, "fold", [0.01, 1.0, 100.0])
    return spark.createDataFrame([(float(chosen),)], "penalty double")


@query("l11_stack_weights")
def l11_stack_weights(spark, sf_dir):
    """Non-negative weights of three members' out-of-fold predictions."""
    rows, both = _learning(spark, sf_dir), None
    for name in ("linear", "forest", "ridge"):
        part = models.out_of_fold(rows, models.families(_FEATURES, trees=TREES)[name], "fold", 4).select("week_start", "y", F.col("prediction").alias(name))
        both = part if both is None else both.join(part.drop("y"), "week_start")
    weights = models.stack_weights(materialize(both, "members"), ["linear", "forest", "ridge"])
    return spark.createDataFrame(list(weights.items()), "member string, weight double")


@query(
    "l7_nearest_neighbours",
    """WITH c AS (SELECT c_custkey AS id, (c_nationkey * 7 % 13)::DOUBLE AS a, (c_custkey % 11)::DOUBLE AS b FROM customer), t AS (SELECT s_suppkey AS k, (s_nationkey * 5 % 13)::DOUBLE + 0.5 AS a, (s_suppkey % 11)::DOUBLE AS b, (s_suppkey % 17)::DOUBLE AS l FROM supplier),
    p AS (SELECT id, k, l, sqrt((c.a - t.a) * (c.a - t.a) + (c.b - t.b) * (c.b - t.b)) AS d FROM c, t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS n FROM p)
    SELECT id, coalesce(avg(l) FILTER (d = 0), sum(l / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)) AS predicted FROM r WHERE n <= 5 GROUP BY id""",
)
def l7_nearest_neighbours(spark, sf_dir):
    """Distance-weighted neighbours by a join."""
    queries = A.table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_nationkey * 7 % 13 as double) as a", "cast(c_custkey % 11 as double) as b")
    train = A.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "cast(s_nationkey * 5 % 13 as double) + 0.5D as a", "cast(s_suppkey % 11 as double) as b", "cast(s_suppkey % 17 as double) as l")
    return models.nearest_neighbours(queries, "id", train, "k", ["a", "b"], "l", 5)


@query("l16_half_width", f"WITH {_SERIES} SELECT year(week_start) AS year, quantile_cont(abs(y - rain), 0.95) AS half_width FROM dat GROUP BY ALL")
def l16_half_width(spark, sf_dir):
    rows = _series(spark, sf_dir).withColumn("year", F.year("week_start"))
    return models.half_width(rows, F.col("y") - F.col("rain"), ["year"])


@query("l13_permutation_importance")
def l13_permutation_importance(spark, sf_dir):
    """Loss of accuracy when an input is dealt anew."""
    rows = _learning(spark, sf_dir)
    model, out = models.families(_FEATURES)["linear"].fit(rows), None
    for column in _FEATURES:
        scored = panel.scores(model.transform(models.shuffled(rows, "week_start", column, 1)).withColumn("input", F.lit(column)), "y", "prediction", ["input"])
        out = scored if out is None else out.unionByName(scored)
    return out.select("input", "rmse", "r2")


@query(
    "m8_placebo_rotations",
    f"""WITH {_PANEL}, u AS (SELECT unit, week_start, y, x FROM pan WHERE NOT weekend), o AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS n, count(*) OVER () AS many FROM (SELECT DISTINCT unit FROM u)),
    k AS (SELECT r.unit, d.unit AS donor, k FROM (SELECT *, unnest(range(1, many)) AS k FROM o) r JOIN o d ON d.n = (r.n + k) % r.many)
    SELECT k, count(*) AS n, regr_slope(u.y, v.x) AS slope FROM u JOIN k USING (unit) JOIN u v ON v.unit = k.donor AND v.week_start = u.week_start GROUP BY k HAVING count(*) >= 3""",
)
def m8_placebo_rotations(spark, sf_dir):
    """The same slope after every rotation of the units' measures."""
    return panel.rotation_slopes(_panel(spark, sf_dir).filter("not weekend"), "unit", "week_start", "y", "x")


@query(
    "m14_away",
    """WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, (count(*) % 10) / 10::DOUBLE AS summer, (count(*) % 7) / 10::DOUBLE AS breaks FROM orders GROUP BY ALL), d AS (SELECT draw::INT AS draw, draw * 0.25::DOUBLE - 0.5 AS s, 1.5 - draw * 0.25::DOUBLE AS b FROM (SELECT unnest(range(0, 8)) AS draw))
    SELECT week_start, draw, least(greatest(1000 * (least(greatest(s, 0), 1) * summer + least(greatest(b, 0), 1) * breaks), 100), 900)::DOUBLE AS away FROM w, d""",
)
def m14_away(spark, sf_dir):
    """Students away for every draw of the shares, clipped and clamped."""
    from ebbtide.operators.whatif import away

    weeks = A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg((F.count(F.lit(1)) % 10 / 10).alias("summer"), (F.count(F.lit(1)) % 7 / 10).alias("breaks"))
    draws = spark.range(8).select(F.col("id").cast("int").alias("draw"), (F.col("id") * 0.25 - 0.5).alias("s"), (1.5 - F.col("id") * 0.25).alias("b"))
    value = away(weeks, F.col("s"), F.col("b"), F.lit(1000.0), F.lit(100.0), F.lit(900.0))
    return weeks.crossJoin(F.broadcast(draws)).select("week_start", "draw", value.alias("away"))


_BLOCKS = f"m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS block FROM (SELECT DISTINCT month FROM dat)), nb AS (SELECT count(*) AS nb FROM m), dr AS (SELECT draw, block, count(*) AS times FROM (SELECT draw, {drawn('nb')} AS block FROM nb, (SELECT unnest(range(0, 2000)) AS draw), (SELECT unnest(range(0, nb)) AS i FROM nb)) GROUP BY ALL)"


@query(
    "u4_rmse_ratio",
    f"WITH {_SERIES}, {_BLOCKS}, g AS (SELECT block, sum((y - rain) * (y - rain)) AS a, sum((y - 2 * rain) * (y - 2 * rain)) AS b FROM dat JOIN m USING (month) GROUP BY ALL) SELECT draw::INT AS draw, sqrt(sum(times * a) / sum(times * b)) AS ratio FROM dr JOIN g USING (block) GROUP BY draw",
)
def u4_rmse_ratio(spark, sf_dir, draws=2000, seed=1):
    """RMSE ratio of two models on the same draws (U4)."""
    rows = _series(spark, sf_dir)
    months = resample.numbered(rows, "month")
    errors = rows.join(months, "month").withColumns({"e1": F.col("y") - F.col("rain"), "e2": F.col("y") - 2 * F.col("rain")})
    return leaving.rmse_ratio(errors, "e1", "e2", resample.draw_blocks(spark, draws, months.count(), seed=seed), "block")


@query(
    "u8_draws_divided",
    """WITH o AS (SELECT o_custkey % 50 AS draw, sum(o_orderkey)::DOUBLE AS v FROM orders GROUP BY ALL), l AS (SELECT l_suppkey % 50 AS draw, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT draw, o.v / l.v AS v FROM o JOIN l USING (draw)""",
)
def u8_draws_divided(spark, sf_dir):
    a = A.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("draw")).agg(F.sum("o_orderkey").cast("double").alias("v"))
    b = A.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("draw")).agg(F.sum("l_quantity").alias("v"))
    return leaving.draws_divided(a, b, "v")


@query(
    "u9_corrected_slopes",
    f"WITH {_SERIES}, f AS (SELECT unnest([0.5::DOUBLE, 1, 1.25, 1.5]) AS factor), s AS (SELECT count(*) AS n, sum(rain) AS sx, sum(y) AS sy, sum(rain * rain) AS sxx, sum(rain * y) AS sxy FROM dat) SELECT factor, (n * factor * sxy - factor * sx * sy) / (n * factor * factor * sxx - factor * factor * sx * sx) AS slope FROM s, f",
)
def u9_corrected_slopes(spark, sf_dir):
    """Slopes with an input scaled by each factor, from the same sums."""
    x, y = F.col("rain"), F.col("y")
    sums = _series(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    factors = spark.createDataFrame([(0.5,), (1.0,), (1.25,), (1.5,)], "factor double")
    return leaving.corrected_slopes(sums, factors, x).select("factor", "slope")


# --- streams


def _replayed(spark, rows, ts, label, per_trigger, ranges=None):
    """Stored rows as a stream of files, each a range of time, in the order of time."""
    dealt = rows.repartitionByRange(ranges, ts) if ranges else rows.repartitionByRange(ts)
    held = materialize(dealt.sortWithinPartitions(ts), label)
    folder = held.inputFiles()[0].rsplit("/", 1)[0]
    jobs.in_time_order(spark, folder)
    return jobs.read_stream(spark, folder, held.schema, per_trigger)


def _drained(spark, df, mode="append"):
    path = f"{shared_folder(spark)}/ebbtide-stream-{uuid.uuid4().hex}"
    jobs.start(df, f"{path}/out", f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query("q2_without_repeats", "SELECT DISTINCT event_id FROM events")
def q2_without_repeats(spark, sf_dir, per_trigger=1000, ranges=None):
    """Each event once although every file comes twice (Q2)."""
    held = A.table(spark, sf_dir, "events")
    stream = _replayed(spark, held.unionByName(held), "ts", "events", per_trigger, ranges)
    return _drained(spark, jobs.without_repeats(stream, "event_id").select("event_id"))


@query("q1_weekly_counts", "SELECT date_trunc('week', ts)::DATE AS week_start, count(*) AS events FROM events GROUP BY ALL")
def q1_weekly_counts(spark, sf_dir, per_trigger=2, ranges=4):
    """Monday weeks of a stream, each batch's update kept in its latest state (Q1)."""
    path = f"{shared_folder(spark)}/ebbtide-stream-{uuid.uuid4().hex}"

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    counts = jobs.weekly_counts(_replayed(spark, A.table(spark, sf_dir, "events"), "ts", "events", per_trigger, ranges))
    jobs.start_batches(counts, put, f"{path}/checkpoint").awaitTermination()
    latest = spark.read.parquet(f"{path}/out").groupBy("week_start").agg(F.max_by("events", "batch").alias("events"))
    return latest


@query("q3_cleaning_counts", f"WITH {A.TRIPS} SELECT date_trunc('week', started_at)::DATE AS week_start, coalesce(reason, 'kept') AS reason, count(*) AS rows FROM judged GROUP BY ALL")
def q3_cleaning_counts(spark, sf_dir, per_trigger=1000, ranges=None):
    """Reject reasons of a stream of trips by week (Q3)."""
    path = f"{shared_folder(spark)}/ebbtide-stream-{uuid.uuid4().hex}"
    stream = _replayed(spark, A.trips(spark, sf_dir), "started_at", "trips", per_trigger, ranges)

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/out")

    jobs.start_batches(jobs.cleaning_counts(stream), put, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("week_start", "reason").agg(F.max_by("rows", "batch").alias("rows"))
