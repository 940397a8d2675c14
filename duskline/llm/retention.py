"""Cohort retention matrix as a window plan, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A client with more than one in SHARE of all rows, and more rows than LEAST, is cut into PARTS window partitions. There
#: are fewer than SHARE such clients, whatever the input.
SHARE, LEAST, PARTS = 4096, 10_000, 256
DAY = 86_400_000_000
WEEK = 7 * DAY


def micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a timestamp as its clock shows it, in any session time zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    second = F.extract(F.lit("SECOND"), ts).cast("decimal(12,6)")
    return F.unix_date(ts.cast("date")).cast("long") * DAY + clock.cast("long") * 1_000_000 + (second * 1_000_000).cast("long")


def large_clients(clicks: DataFrame, share: int = SHARE, least: int = LEAST) -> list[int]:
    """Clients with more than one in `share` of all rows and more than `least`: fewer than `share`, so they may go to the driver."""
    n = clicks.count()
    counts = clicks.filter("client_id is not null").groupBy("client_id").count()
    return [r[0] for r in counts.filter(F.col("count") > max(n // share, least)).select("client_id").collect()]


def starts(clicks: DataFrame, large: list[int], parts: int = PARTS) -> DataFrame:
    """Rows (client_id, _t, cents, _known0, _start0, _start1) from distinct clicks with ts and client_id: both starts are the
    least ts of an error over the client's window partition.

    A large client is many partitions. Each of them also gets one row with the client's least errors, from
    an aggregation that is combined before it moves; these rows have no click and leave after the window.
    """
    late = F.crc32(F.col("click_id").cast("string"))
    arrival = micros(F.col("arrived_at")) + F.when(late % 3 == 0, late % 100).otherwise(0) * DAY
    base = clicks.filter("ts is not null and client_id is not null")
    is_large = F.col("client_id").isin(large) if large else F.lit(False)
    part = F.when(is_large, F.pmod(F.xxhash64("click_id", "ts"), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    # equal clicks meet in one part, so the same shuffle serves the distinct and the window
    once = base.withColumn("_p", part).repartition("client_id", "_p").dropDuplicates()

    def facts(df: DataFrame) -> DataFrame:
        return df.withColumns({"_t": micros(F.col("ts")), "_known0": F.coalesce(arrival < F.unix_date(F.lit("2024-02-01").cast("date")).cast("long") * DAY, F.lit(False))})

    error = F.when(F.col("kind") == "error", F.col("_t"))
    cents = F.coalesce(F.floor(100 * F.col("value") + 0.5), F.lit(0)).cast("long")
    rows = facts(once).select("client_id", "_p", "_t", "_known0", F.when(F.col("_known0"), error).alias("_e0"), error.alias("_e1"), cents.alias("cents"))
    if large:
        least = facts(base.filter(is_large)).groupBy("client_id").agg(F.min(F.when(F.col("_known0"), error)).alias("_e0"), F.min(error).alias("_e1"))
        none = least.select("client_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"), F.lit(None).cast("long").alias("_t"), F.lit(None).cast("boolean").alias("_known0"), "_e0", "_e1", F.lit(0).cast("long").alias("cents"))
        rows = rows.unionByName(none.repartition("client_id", "_p"))
    client = Window.partitionBy("client_id", "_p")
    both = rows.select("client_id", "_t", "cents", "_known0", F.min("_e0").over(client).alias("_start0"), F.min("_e1").over(client).alias("_start1"))
    return both.filter("_t is not null")


def retention(clicks: DataFrame, clients: DataFrame, large: list[int] | None = None, parts: int = PARTS) -> DataFrame:
    """Rows (state, segment, cohort, period, users, users_crc32, moved, cents), one for each nonempty cell.

    clicks (click_id, ts, arrived_at, client_id, kind, value) count once where all columns are equal, and not
    without ts or client_id. A null click_id is not delayed; a click without arrival is known to state 1
    only; a null kind is no error; a null value is 0 cents. clients (client_id, source) gives the segment; of
    several rows of a client the greatest source stands, a null source or a missing client is ''. Empty
    tables give no rows. Clicks of equal ts are all counted. Props of any length only take part in telling clicks apart.
    """
    large = large_clients(clicks) if large is None else large
    both = starts(clicks, large, parts)
    # one row for each state that knows the click and whose start it does not precede
    state = lambda s, known: F.struct(F.lit(s).alias("state"), F.when(known & (F.col("_t") >= F.col(f"_start{s}")), F.col(f"_start{s}")).alias("start"))
    known = both.withColumn("_s", F.explode(F.array(state(0, F.col("_known0")), state(1, F.lit(True))))).filter("_s.start is not null")
    cohort = lambda start: ((start - F.pmod(start, F.lit(WEEK))) / WEEK).cast("long")
    moved = F.coalesce(cohort(F.col("_start0")) != cohort(F.col("_start1")), F.lit(False))
    cells = known.select("client_id", "_s.state", cohort(F.col("_s.start")).alias("cohort"), F.expr(f"(_t - _s.start) DIV {WEEK}L").alias("period"), moved.cast("int").alias("_moved"), "cents")
    users = cells.groupBy("client_id", "state", "cohort", "period").agg(F.max("_moved").alias("_moved"), F.sum("cents").alias("cents"))
    segments = clients.filter("client_id is not null").groupBy("client_id").agg(F.max("source").alias("segment"))
    named = users.join(segments.hint("merge"), "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))
    return named.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(F.crc32(F.col("client_id").cast("string"))).alias("users_crc32"),
        F.sum("_moved").cast("long").alias("moved"), F.sum("cents").alias("cents"))
