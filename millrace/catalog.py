"""Queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import outcome, units
from millrace.operators import asof_join, bin_rates, bootstrap_intervals, brier_parts, calibration_error, cluster_error, drift, equal_mass_bins, exact_auc, interval_join, isotonic_blocks, line_fit, store_periods, stored_rates, survival_curve, with_curve
from millrace.operators.bootstrap import poisson_steps
from millrace.sources import TOP_LENGTH, TOP_PRICE, bought, event_stream, event_times, priced_lines, scored_documents, scored_lines, shared_folder, table, valid_views, viewed
from millrace.streaming import latest_windows, running_rates
from millrace.streaming.settlements import appended, asof_stream, settle


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles rounded: engines add them in other orders."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def calibration_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bin_rates(scored_lines(spark, folder)).select("bin", "n", "hits", "mean_score", "rate"))


def calibration_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bin_rates(scored_lines(spark, folder), width=2).select("bin", "n", "hits", "low", "high"))


def mean_payoffs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bin_rates(scored_lines(spark, folder)).select("bin", "n", "mean_payoff"))


def calibration_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(line_fit(scored_lines(spark, folder)))


def brier_score(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(brier_parts(scored_lines(spark, folder)))


def clustered_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cluster_error(scored_lines(spark, folder)))


def last_view(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with its user's last view before or at its time."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return asof_join(bought, viewed, "user_id", "ts", ["view_value"]).withColumnRenamed("ts_right", "view_ts")


def daily_rates(spark: SparkSession, folder: str) -> DataFrame:
    return running_rates(event_times(spark, folder), "ts", outcome(F.col("event_type") == "purchase")).select(F.to_date("start").alias("day"), "n", "hits")


def daily_rates_stream(spark: SparkSession, folder: str) -> DataFrame:
    """daily_rates over the events as a stream, read to its end."""
    batch = table(spark, folder, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{folder}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    rates = running_rates(stream, "ts", outcome(F.col("event_type") == "purchase"))
    return latest_windows(rates, shared_folder(spark)).select(F.to_date("start").alias("day"), "n", "hits")


#: Units of a price in steps of 50, and levels of a range of them.
STEP, LEVELS = 50, 128


def isotonic_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(isotonic_blocks(priced_lines(spark, folder, STEP), TOP_PRICE // STEP, LEVELS, 4))


def isotonic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Each score with its rows, hits and the isotonic curve's rate."""
    rows = priced_lines(spark, folder, STEP)
    fitted = with_curve(rows, isotonic_blocks(rows, TOP_PRICE // STEP, LEVELS, 4), LEVELS)
    return rounded(fitted.groupBy("units", "fitted").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")))


def auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(exact_auc(priced_lines(spark, folder), width=4096))


def auc_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(exact_auc(priced_lines(spark, folder), ["cluster"], width=4096))


def mass_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(equal_mass_bins(priced_lines(spark, folder), 20, TOP_PRICE))


def mass_error(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(calibration_error(equal_mass_bins(priced_lines(spark, folder), 20, TOP_PRICE)))


def cluster_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bootstrap_intervals(scored_lines(spark, folder)))


def quality_isotonic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(isotonic_blocks(scored_documents(spark, folder), TOP_LENGTH, 1024, 4))


def quality_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The Brier score of lengths as scores of quality, and of the isotonic curve's rates."""
    rows = scored_documents(spark, folder)
    fitted = with_curve(rows, isotonic_blocks(rows, TOP_LENGTH, 1024, 4), 1024)
    off = lambda c: F.avg((c - F.col("y")) * (c - F.col("y")))
    return rounded(fitted.where("units is not null and y is not null").agg(F.count(F.lit(1)).alias("n"), off(F.col("units") / float(TOP_LENGTH)).alias("brier"), off(F.col("fitted")).alias("fitted_brier")))


def quality_auc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(exact_auc(scored_documents(spark, folder), width=1024))


def quality_auc_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(exact_auc(scored_documents(spark, folder), ["cluster"], width=1024).withColumnRenamed("cluster", "source"))


def quality_mass_bins(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(equal_mass_bins(scored_documents(spark, folder), 20, TOP_LENGTH))


def quality_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(bootstrap_intervals(scored_documents(spark, folder), TOP_LENGTH))


def valid_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with all views of its user that are valid at its time."""
    bought = table(spark, folder, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return interval_join(bought, valid_views(spark, folder), "user_id", "ts", "valid_from", "valid_to")


def without_zone(df: DataFrame) -> DataFrame:
    """Times as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def settled_views(spark: SparkSession, folder: str) -> DataFrame:
    """Each view with all purchases of its user within two days, or none."""
    events = table(spark, folder, "events")
    return without_zone(settle(viewed(events), bought(events), "user_id", "viewed", "bought", "2 days"))


def settled_views_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same of two streams, read to their end: views without purchases as far as the watermark says so."""
    events = event_stream(spark, folder)
    return without_zone(appended(settle(viewed(events), bought(events), "user_id", "viewed", "bought", "2 days"), shared_folder(spark)))


def last_view_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with its user's last view, of two streams, as far as the watermark has come."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = event_stream(spark, folder).select("event_id", "ts", "user_id", "event_type", "value")
        asks = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
        views = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
        return appended(asof_stream(asks, views, "user_id", "ts", ["view_value"]), shared_folder(spark)).withColumnRenamed("ts_right", "view_ts")
    finally:
        spark.conf.set(name, before)


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(units(F.col("l_discount"), 100).alias("units"), outcome(F.col("l_returnflag") == "R").alias("y"), F.col("l_suppkey").alias("cluster"), F.to_date("l_shipdate").alias("day"))


def drift_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier's days with what its discounts miss, against an allowance of 28 units a row."""
    return drift(dated_lines(spark, folder), "cluster", "day", allowance=28, limit=1500)


def waits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (user_id, duration in minutes, ended): how long after a view its user buys. Unended
    after two days, or where the events end."""
    events = table(spark, folder, "events")
    until = F.broadcast(events.agg(F.max("ts").alias("until")))
    first = settled_views(spark, folder).groupBy("view_id", "user_id", "viewed").agg(F.min("bought").alias("bought")).join(until, F.lit(True))
    end = F.coalesce("bought", F.least("until", F.col("viewed") + F.expr("interval 2 days")))
    return first.select("user_id", F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("viewed").cast("timestamp"))) / 60_000_000).alias("duration"), F.col("bought").isNotNull().cast("int").alias("ended"))


def wait_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(survival_curve(waits(spark, folder), width=256))


def maintained_table(spark: SparkSession, folder: str) -> DataFrame:
    """calibration_table of sums by month: all months are stored without the lines that come
    late, then those months that late lines belong to are stored again."""
    rows, kept = dated_lines(spark, folder).withColumn("month", F.date_format("day", "yyyy-MM")), shared_folder(spark)
    late = (F.dayofmonth("day") > 20) & F.col("month").endswith("3")
    store_periods(rows.where(~late), "month", kept)
    store_periods(rows.where(F.col("month").endswith("3")), "month", kept)
    return rounded(stored_rates(spark, kept).select("bin", "n", "hits", "mean_score", "rate"))


QUERIES = {
    "calibration_table": calibration_table,
    "calibration_intervals": calibration_intervals,
    "calibration_line": calibration_line,
    "mean_payoffs": mean_payoffs,
    "brier_score": brier_score,
    "clustered_error": clustered_error,
    "last_view": last_view,
    "daily_rates": daily_rates,
    "daily_rates_stream": daily_rates_stream,
    "isotonic_curve": isotonic_curve,
    "isotonic_scores": isotonic_scores,
    "auc": auc,
    "auc_by_cluster": auc_by_cluster,
    "mass_bins": mass_bins,
    "mass_error": mass_error,
    "cluster_bootstrap": cluster_bootstrap,
    "quality_isotonic": quality_isotonic,
    "quality_fit": quality_fit,
    "quality_auc": quality_auc,
    "quality_auc_by_source": quality_auc_by_source,
    "quality_mass_bins": quality_mass_bins,
    "quality_bootstrap": quality_bootstrap,
    "valid_quotes": valid_quotes,
    "settled_views": settled_views,
    "settled_views_stream": settled_views_stream,
    "last_view_stream": last_view_stream,
    "drift_by_cluster": drift_by_cluster,
    "wait_curve": wait_curve,
    "maintained_table": maintained_table,
}

ROWS = "WITH s AS (SELECT CAST(round(l_discount * 100) AS BIGINT) AS u, CAST(l_returnflag = 'R' AS INT)::BIGINT AS y, l_suppkey AS g FROM lineitem)"
DAYS = "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS hits FROM events GROUP BY 1"

PRICED = "WITH s AS (SELECT CAST(floor(l_extendedprice / {step}) AS BIGINT) AS u, CAST(l_returnflag = 'R' AS INT)::BIGINT AS y, l_suppkey AS g FROM lineitem)"

LENGTHS = "WITH s AS (SELECT least(n_chars, 20000) AS u, CAST(quality AS BIGINT) AS y, source AS g FROM documents JOIN labels USING (doc_id))"

#: The rate at a score: the largest over its left ends of the least mean up to a right end.
FITTED = """, p AS (SELECT u, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, row_number() OVER (ORDER BY u) AS i FROM s GROUP BY u),
    c AS (SELECT i, u, n, k, CAST(sum(n) OVER w AS BIGINT) AS cn, CAST(sum(k) OVER w AS BIGINT) AS ck FROM p WINDOW w AS (ORDER BY i)),
    m AS (SELECT b.i, min((b.ck - a.ck + a.k)::DOUBLE / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b ON a.i <= b.i),
    f AS (SELECT u, n, k, fitted FROM c JOIN (SELECT i, max(least) AS fitted FROM m GROUP BY i) USING (i))"""

BLOCKS = "SELECT min(u) AS low, max(u) AS high, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS hits, round(sum(k)::DOUBLE / sum(n), 9) AS rate FROM f GROUP BY fitted"

AUC = """, p AS (SELECT {key} AS g, u, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS q FROM s GROUP BY 1, 2),
    w AS (SELECT g, p, q, (coalesce(sum(q) OVER (PARTITION BY g ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0::DOUBLE)::DOUBLE AS below,
      (coalesce(sum(p) OVER (PARTITION BY g ORDER BY u ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) + p / 2.0::DOUBLE)::DOUBLE AS above FROM p),
    t AS (SELECT g, sum(p)::DOUBLE AS np, sum(q)::DOUBLE AS nq, sum(p * below) / nullif(sum(p) * sum(q), 0)::DOUBLE AS auc FROM w GROUP BY g),
    v AS (SELECT g, any_value(np) AS np, any_value(nq) AS nq, any_value(auc) AS auc, sum(p * (below / nullif(nq, 0) - auc) ** 2) / nullif(any_value(np) - 1, 0) AS sp, sum(q * (above / nullif(np, 0) - auc) ** 2) / nullif(any_value(nq) - 1, 0) AS sq FROM w JOIN t USING (g) GROUP BY g)
    SELECT {shown} CAST(np AS BIGINT) AS n_pos, CAST(nq AS BIGINT) AS n_neg, round(auc, 9) AS auc, round(sqrt(sp / np + sq / nq), 9) AS auc_error FROM v"""

MASS = """, t AS (SELECT count(*) AS n FROM s),
    p AS (SELECT u, sum(count(*)) OVER (ORDER BY u) AS c FROM s GROUP BY u),
    b AS (SELECT i, (SELECT min(u) FROM p WHERE c * 20 >= i * (SELECT n FROM t)) AS bound FROM range(1, 20) r(i)),
    e AS (SELECT u, y, (SELECT CAST(count(*) AS INT) FROM b WHERE bound < u) AS bin FROM s),
    m AS (SELECT bin, min(u) AS lowest, max(u) AS highest, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, sum(u)::DOUBLE / (count(*)::DOUBLE * {top}) AS mean_score, sum(y)::DOUBLE / count(*) AS rate, 1.96::DOUBLE AS z FROM e GROUP BY bin)"""

SETTLED = """WITH e AS (SELECT event_id, user_id, event_type, value, ts FROM events),
    v AS (SELECT event_id AS view_id, user_id, ts AS viewed FROM e WHERE event_type = 'view'),
    b AS (SELECT user_id AS buyer, ts AS bought, value AS amount FROM e WHERE event_type = 'purchase'),
    s AS (SELECT view_id, user_id, viewed, bought, amount FROM v LEFT JOIN b ON user_id = buyer AND bought BETWEEN viewed AND viewed + INTERVAL 2 DAY)"""

LAST_VIEW = """SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.value AS view_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""

DRIFT = """WITH s AS (SELECT l_suppkey AS cluster, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END - CAST(round(l_discount * 100) AS BIGINT) AS e FROM lineitem),
    p AS (SELECT cluster, day, count(*) AS n, CAST(sum(e) AS BIGINT) AS missed FROM s GROUP BY 1, 2),
    q AS (SELECT *, CAST(sum(missed - n * 28) OVER w AS BIGINT) AS u, CAST(sum(-missed - n * 28) OVER w AS BIGINT) AS d FROM p WINDOW w AS (PARTITION BY cluster ORDER BY day)),
    r AS (SELECT cluster, day, n, missed, u - least(0, min(u) OVER w) AS up, d - least(0, min(d) OVER w) AS down FROM q WINDOW w AS (PARTITION BY cluster ORDER BY day))
    SELECT cluster, day, n, missed, up, down, greatest(up, down) > 1500 AS alarm FROM r"""

BINS = """SELECT bin, lowest, highest, n, hits, round(mean_score, 9) AS mean_score, round(rate, 9) AS rate,
    round(greatest(0.0::DOUBLE, (rate + z * z / (2 * n) - z * sqrt(rate * (1 - rate) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n)), 9) AS low,
    round(least(1.0::DOUBLE, (rate + z * z / (2 * n) + z * sqrt(rate * (1 - rate) / n + z * z / (4.0::DOUBLE * n * n))) / (1 + z * z / n)), 9) AS high FROM m"""

BOOTSTRAP = """, c AS (SELECT coalesce('=' || g, 'null') AS g, count(*) AS n, CAST(sum({top} * y - u) AS BIGINT) AS e, CAST(sum(y) AS BIGINT) AS y, CAST(sum(({top} * y - u) ** 2) AS BIGINT) AS ee FROM s GROUP BY s.g),
    steps AS (SELECT unnest({steps}) AS step),
    d AS (SELECT g, 4 * k + j AS replicate, CAST('0x' || substr(md5('7:' || k || ':' || g), 8 * j + 1, 8) AS BIGINT) AS x FROM c, range(0, 50) r(k), range(0, 4) q(j)),
    w AS (SELECT g, replicate, (SELECT count(*) FROM steps WHERE step <= x) AS w FROM d),
    r AS (SELECT replicate, sum(w * n)::DOUBLE AS n, sum(w * e)::DOUBLE AS e, sum(w * y)::DOUBLE AS y, sum(w * ee)::DOUBLE AS ee FROM w JOIN c USING (g) WHERE w > 0 GROUP BY 1
      UNION ALL SELECT -1, sum(n)::DOUBLE, sum(e)::DOUBLE, sum(y)::DOUBLE, sum(ee)::DOUBLE FROM c),
    v AS (SELECT replicate, 'mean_error' AS statistic, e / (n * {top}) AS value FROM r UNION ALL SELECT replicate, 'rate', y / n FROM r UNION ALL SELECT replicate, 'brier', ee / (n * {top} * {top}) FROM r),
    l AS (SELECT statistic, any_value(value) FILTER (replicate < 0) AS estimate, list_sort(list(value) FILTER (replicate >= 0)) AS v FROM v GROUP BY 1)
    SELECT statistic, round(estimate, 9) AS estimate, round(v[CAST(ceil(round(len(v) * 0.025, 6)) AS INT)], 9) AS low, round(v[CAST(ceil(round(len(v) * 0.975, 6)) AS INT)], 9) AS high, CAST(len(v) AS BIGINT) AS replicates FROM l"""

SQL = {
    "calibration_table": f"{ROWS} SELECT CAST(u AS INT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, round(sum(u)::DOUBLE / (count(*) * 100.0::DOUBLE), 9) AS mean_score, round(sum(y)::DOUBLE / count(*), 9) AS rate FROM s GROUP BY u",
    "calibration_intervals": f"""{ROWS}, b AS (SELECT CAST(u // 2 AS INT) AS bin, count(*)::DOUBLE AS m, sum(y)::DOUBLE AS k, 1.96::DOUBLE AS z FROM s GROUP BY 1)
        SELECT bin, CAST(m AS BIGINT) AS n, CAST(k AS BIGINT) AS hits,
        round(greatest(0.0::DOUBLE, (k / m + z * z / (2 * m) - z * sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))) / (1 + z * z / m)), 9) AS low,
        round(least(1.0::DOUBLE, (k / m + z * z / (2 * m) + z * sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))) / (1 + z * z / m)), 9) AS high FROM b""",
    "calibration_line": f"""{ROWS} SELECT count(*) AS n, round(regr_slope(y, u / 100.0::DOUBLE), 9) AS slope, round(regr_intercept(y, u / 100.0::DOUBLE), 9) AS intercept, round(regr_r2(y, u / 100.0::DOUBLE), 9) AS r2,
        round(sqrt((regr_syy(y, u / 100.0::DOUBLE) - regr_sxy(y, u / 100.0::DOUBLE) ** 2 / regr_sxx(y, u / 100.0::DOUBLE)) / ((count(*) - 2) * regr_sxx(y, u / 100.0::DOUBLE))), 9) AS slope_error FROM s""",
    "mean_payoffs": f"{ROWS} SELECT CAST(u AS INT) AS bin, count(*) AS n, round((sum(y)::DOUBLE / count(*) - u / 100.0::DOUBLE) / nullif(u / 100.0::DOUBLE, 0), 9) AS mean_payoff FROM s GROUP BY u",
    "brier_score": f"""{ROWS}, b AS (SELECT u / 100.0::DOUBLE AS p, count(*)::DOUBLE AS m, sum(y)::DOUBLE AS k FROM s GROUP BY u), t AS (SELECT avg(y)::DOUBLE AS r, count(*) AS n, avg((u / 100.0::DOUBLE - y) ** 2) AS brier FROM s)
        SELECT any_value(n) AS n, round(any_value(brier), 9) AS brier, round(sum(m * (p - k / m) ** 2) / any_value(n), 9) AS reliability, round(sum(m * (k / m - r) ** 2) / any_value(n), 9) AS resolution, round(any_value(r * (1 - r)), 9) AS uncertainty FROM b, t""",
    "clustered_error": f"""{ROWS}, e AS (SELECT g, y - u / 100.0::DOUBLE AS e FROM s), t AS (SELECT avg(e) AS m, count(*) AS n FROM e), c AS (SELECT g, sum(e - m) AS d FROM e, t GROUP BY g)
        SELECT any_value(t.n) AS n, count(*) AS clusters, round(any_value(m), 9) AS mean_error, round((SELECT sqrt(sum((e - m) ** 2)) / count(*) FROM e, t), 9) AS plain_error, round(sqrt(sum(d * d)) / any_value(t.n), 9) AS robust_error FROM c, t""",
    "last_view": LAST_VIEW,
    "daily_rates": DAYS,
    "daily_rates_stream": DAYS,
    "isotonic_curve": f"{PRICED.format(step=STEP)}{FITTED} {BLOCKS}",
    "isotonic_scores": f"{PRICED.format(step=STEP)}{FITTED} SELECT u AS units, n, k AS hits, round(fitted, 9) AS fitted FROM f",
    "auc": PRICED.format(step=1) + AUC.format(key="0", shown=""),
    "auc_by_cluster": PRICED.format(step=1) + AUC.format(key="g", shown="g AS cluster,"),
    "mass_bins": PRICED.format(step=1) + MASS.format(top=TOP_PRICE) + BINS,
    "mass_error": f"{PRICED.format(step=1)}{MASS.format(top=TOP_PRICE)} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(rate - mean_score) * n) / sum(n), 9) AS expected_error, round(max(abs(rate - mean_score)), 9) AS largest_error FROM m",
    "cluster_bootstrap": ROWS + BOOTSTRAP.format(top=100, steps=poisson_steps()),
    "quality_isotonic": f"{LENGTHS}{FITTED} {BLOCKS}",
    "quality_fit": f"{LENGTHS}{FITTED} SELECT count(*) AS n, round(avg((u / 20000.0::DOUBLE - y) ** 2), 9) AS brier, round(avg((fitted - y) ** 2), 9) AS fitted_brier FROM s JOIN f USING (u)",
    "quality_auc": LENGTHS + AUC.format(key="0", shown=""),
    "quality_auc_by_source": LENGTHS + AUC.format(key="g", shown="g AS source,"),
    "quality_mass_bins": LENGTHS + MASS.format(top=TOP_LENGTH) + BINS,
    "quality_bootstrap": LENGTHS + BOOTSTRAP.format(top=TOP_LENGTH, steps=poisson_steps()),
    "valid_quotes": """WITH v AS (SELECT event_id AS view_id, user_id AS viewer, ts AS valid_from,
        ts + to_seconds(CASE WHEN event_id % 250 < 5 THEN NULL WHEN event_id % 100 < 5 THEN 864000 ELSE floor(value * 360) END) AS valid_to FROM events WHERE event_type = 'view')
        SELECT event_id, user_id, ts, view_id, valid_from, valid_to FROM events e JOIN v ON user_id = viewer AND valid_from <= ts AND (valid_to IS NULL OR ts < valid_to) WHERE event_type = 'purchase'""",
    "settled_views": f"{SETTLED} SELECT view_id, user_id, viewed, bought, amount FROM s",
    "settled_views_stream": f"""{SETTLED} SELECT view_id, user_id, viewed, bought, amount FROM s
        WHERE bought IS NOT NULL OR viewed + INTERVAL 2 DAY < (SELECT least((SELECT max(viewed) FROM v), (SELECT max(bought) FROM b)) - INTERVAL 10 MINUTE)""",
    "last_view_stream": f"{LAST_VIEW} WHERE p.ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_type IN ('purchase', 'view'))",
    "drift_by_cluster": DRIFT,
    "wait_curve": f"""{SETTLED}, f AS (SELECT view_id, viewed, min(bought) AS bought FROM s GROUP BY 1, 2),
        w AS (SELECT (epoch_us(coalesce(bought, least((SELECT max(ts) FROM e), viewed + INTERVAL 2 DAY))) - epoch_us(viewed)) // 60000000 AS t, CAST(bought IS NOT NULL AS INT) AS d FROM f),
        p AS (SELECT t, count(*) AS n, CAST(sum(d) AS BIGINT) AS d FROM w GROUP BY t),
        r AS (SELECT t, n, d, CAST(sum(n) OVER (ORDER BY t DESC) AS BIGINT) AS r FROM p),
        c AS (SELECT t, n, d, r, exp(sum(CASE WHEN r > d THEN ln(1 - d::DOUBLE / r) ELSE 0 END) OVER w) AS s, sqrt(sum(CASE WHEN r > d THEN d::DOUBLE / (r::DOUBLE * (r - d)) ELSE 0 END) OVER w) AS g FROM r WINDOW w AS (ORDER BY t))
        SELECT t AS duration, r AS at_risk, d AS ended, n - d AS censored, round(CASE WHEN r > d THEN s ELSE 0.0::DOUBLE END, 9) AS survival, round(CASE WHEN r > d THEN s * g END, 9) AS error FROM c""",
}

SQL["maintained_table"] = SQL["calibration_table"]
