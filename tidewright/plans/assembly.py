"""Queries of the guarded joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly
from ..operators.skew import dealt
from .registry import Tables, query, r6, sql_r6


@query(
    "attach_outer_predictions",
    """SELECT l_orderkey AS sample_id, l_linenumber, 'pair' || least(l_orderkey % 5, (l_orderkey + 1) % 5) || greatest(l_orderkey % 5, (l_orderkey + 1) % 5) AS pair,
      l_extendedprice AS pred, CAST(l_orderkey % 5 AS INT) AS cv_fold, o_custkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def attach_outer_predictions(t: Tables) -> DataFrame:
    """Lines are inner predictions, orders the outer table; an order's fold is one of its pair's two."""
    fold, other = F.col("l_orderkey") % 5, (F.col("l_orderkey") + 1) % 5
    pair = F.concat(F.lit("pair"), F.least(fold, other).cast("string"), F.greatest(fold, other).cast("string"))
    inner = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), "l_linenumber", pair.alias("pair"), F.col("l_extendedprice").alias("pred"))
    outer = t.orders.select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 5).cast("int").alias("cv_fold"), "o_custkey")
    return assembly.attach_outer(inner, outer, "sample_id", pair="pair", fold="cv_fold", keep=["o_custkey"])


@query(
    "attach_forecasts_wide",
    f"""SELECT o_orderkey, o_custkey, {sql_r6('c.v')} AS cmp_click, {sql_r6('w.v')} AS cmp_view FROM orders
    LEFT JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) c ON c.user_id = o_custkey
    LEFT JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) w ON w.user_id = o_custkey""",
)
def attach_forecasts_wide(t: Tables) -> DataFrame:
    """Mean clicks and views of a user beside the orders of the customer with that number."""
    long = t.events.groupBy(F.col("user_id").alias("o_custkey"), "event_type").agg(F.avg("value").alias("v"))
    out = assembly.attach_wide(
        t.orders.select("o_orderkey", "o_custkey"), long, ["o_custkey"], target="event_type", value="v", names={"click": "cmp_click", "view": "cmp_view"}
    )
    return out.withColumns({c: r6(c) for c in ("cmp_click", "cmp_view")})


@query(
    "samples_in_both_predictions",
    """SELECT a.o_orderkey, a.o_custkey, a.o_totalprice AS pred_a, b.n AS pred_b FROM orders a
    JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey WHERE a.o_orderstatus <> 'P'""",
)
def samples_in_both_predictions(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("pred_a"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("pred_b"))
    b = lines.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return assembly.in_both(a, b, "o_orderkey", ["o_custkey"])


@query(
    "rows_outside_excluded_days",
    """WITH x AS (SELECT DISTINCT unnest(generate_series(CAST(ts AS DATE) - 1, CAST(ts AS DATE), INTERVAL 1 DAY))::DATE AS day FROM events WHERE event_type = 'error' AND user_id % 50 = 7)
    SELECT event_id FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT day FROM x)""",
)
def rows_outside_excluded_days(t: Tables) -> DataFrame:
    """Events on no day with, or before one with, an error of certain users."""
    e = t.events
    return assembly.outside_days(e, "ts", assembly.days_between(e.where("event_type = 'error' and user_id % 50 = 7"), "ts", "ts")).select("event_id")


@query(
    "known_missing_urls",
    "SELECT DISTINCT '/u/' || user_id || '/' || (event_id % 40) AS url FROM events WHERE event_type = 'error'",
)
def known_missing_urls(t: Tables) -> DataFrame:
    url = F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 40).cast("string"))
    ledger = t.events.select(url.alias("url"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("http_status"))
    return assembly.known_missing(ledger, "url", "http_status")


@query(
    "elements_in_range",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 12:00:00'",
)
def elements_in_range(t: Tables) -> DataFrame:
    return t.events.where(assembly.half_open(F.col("ts"), "2024-01-05", "2024-01-12 12:00:00")).select("event_id")


@query(
    "lines_wide",
    """SELECT l_orderkey, max(l_extendedprice) FILTER (l_linenumber = 1) AS "1", max(l_extendedprice) FILTER (l_linenumber = 2) AS "2",
      max(l_extendedprice) FILTER (l_linenumber = 3) AS "3" FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def lines_wide(t: Tables) -> DataFrame:
    """Order lines side by side; repeated line numbers are settled first, or the pivot would refuse them."""
    lines = dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], t.lineitem.count())
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    return assembly.wide_unique(one, ["l_orderkey"], "l_linenumber", "l_extendedprice", [1, 2, 3])


@query(
    "rows_young_enough",
    "SELECT o_orderkey FROM orders",
)
def rows_young_enough(t: Tables) -> DataFrame:
    """All orders pass a guard of a hundred years before 2024."""
    return assembly.check_age(t.orders, "o_orderdate", F.lit("2024-01-01").cast("timestamp"), "36525d").select("o_orderkey")


@query(
    "rows_too_old",
    "SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 1000 DAYS) AS too_old, min(date_diff('day', o_orderdate, TIMESTAMP '2001-01-01')) AS youngest_days FROM orders GROUP BY 1",
)
def rows_too_old(t: Tables) -> DataFrame:
    """Orders of each priority older than a thousand days at the beginning of 2001: what the guard counts before it refuses."""
    out = assembly.age_counts(t.orders, "o_orderdate", F.lit("2001-01-01").cast("timestamp"), "1000d", by=["o_orderpriority"])
    return out.select("o_orderpriority", "rows", "too_old", F.floor("youngest_days").cast("bigint").alias("youngest_days"))


@query(
    "years_of_all_priorities",
    """SELECT CAST(y AS INT) AS year FROM (SELECT DISTINCT o_orderpriority AS p, year(o_orderdate) AS y FROM orders) GROUP BY y
    HAVING count(*) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""",
)
def years_of_all_priorities(t: Tables) -> DataFrame:
    return assembly.years_in_all(t.orders, "o_orderpriority", "o_orderdate")
