"""Attack trends, risk profiles and top lists over stored events.

Events need source_ip, threat_level, risk_score and an order key (t_us, packet_id); ``arrival`` is another order of first arrival than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from packetrisk.config import SERIOUS
from packetrisk.functions.addresses import is_private
from packetrisk.functions.scores import badge
from packetrisk.operators.trust import with_location


def serious(events: DataFrame, levels: list[str] = SERIOUS) -> DataFrame:
    ip = F.col("source_ip")
    return events.where(ip.isNotNull() & (ip != "") & F.col("threat_level").isin(levels) & ~is_private(ip))


def top(counted: DataFrame, n: int) -> DataFrame:
    """The n largest counts; ties in order of first arrival."""
    return counted.orderBy(F.desc("n"), F.asc("first_seen")).limit(n)


def _arrival(arrival: Column | None) -> Column:
    return F.struct("t_us", "packet_id") if arrival is None else arrival


def counts_of(df: DataFrame, key: Column | str, name: str = "key", arrival: Column | None = None) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.cast("string").alias(name)).agg(F.count("*").alias("n"), F.min(_arrival(arrival)).alias("first_seen"))


def attackers(events: DataFrame, n: int = 5, levels: list[str] = SERIOUS, arrival: Column | None = None) -> DataFrame:
    return top(counts_of(serious(events, levels), "source_ip", arrival=arrival), n)


def attack_types(events: DataFrame, levels: list[str] = SERIOUS) -> DataFrame:
    """Counts by alert type; a missing type is 'unknown'."""
    exploded = serious(events, levels).select("t_us", "packet_id", F.explode("alerts").alias("a"))
    return counts_of(exploded, F.coalesce(F.col("a.type"), F.lit("unknown")))


def hour_as_written(text: Column) -> Column:
    """The hour in an ISO timestamp text as it stands there (an offset does not move it); null if unparsable."""
    hour = F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}[T ](\d{2})", 1)
    plain = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(F.try_to_timestamp(text).isNotNull(), F.when(plain, 0).otherwise(hour.try_cast("int")))


def attack_hours(events: DataFrame, stamp: str = "observed_text", levels: list[str] = SERIOUS) -> DataFrame:
    return counts_of(serious(events, levels).withColumn("__h", hour_as_written(F.col(stamp))).where("__h is not null"), "__h")


def trend_counts(events: DataFrame, stamp: str = "observed_text", levels: list[str] = SERIOUS, arrival: Column | None = None) -> DataFrame:
    """(kind, key, n, first_seen) for kinds attacker, attack and hour of the serious rows, and one row of kind event for all rows.

    Every event becomes a few (kind, key) pairs, so that one partially aggregated exchange counts all of them.
    """
    ip, hour = F.col("source_ip"), hour_as_written(F.col(stamp))
    chosen = ip.isNotNull() & (ip != "") & F.col("threat_level").isin(levels) & ~is_private(ip)
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    any_event = F.array(pair("event", F.lit(None)))
    none = F.slice(any_event, 1, 0)
    attacks = F.coalesce(F.transform("alerts", lambda x: pair("attack", F.coalesce(x["type"], F.lit("unknown")))), none)
    hours = F.when(hour.isNotNull(), F.array(pair("hour", hour))).otherwise(none)
    pairs = F.when(chosen, F.concat(any_event, F.array(pair("attacker", ip)), hours, attacks)).otherwise(any_event)
    rows = events.select("t_us", "packet_id", F.explode(pairs).alias("k"))
    return rows.groupBy("k.kind", "k.key").agg(F.count("*").alias("n"), F.min(_arrival(arrival)).alias("first_seen"))


def trend_report(events: DataFrame, stamp: str = "observed_text", levels: list[str] = SERIOUS, arrival: Column | None = None) -> DataFrame:
    """(metric, key, n): unique attackers, top attacker, most common attack, peak hour, top five attackers.

    No events at all give no rows; events without a serious one give unique_attackers 0 alone.  Both parts read
    the same columns of the same counts, so Spark reuses their exchange and scores the events once.
    """
    counted = trend_counts(events, stamp, levels, arrival)
    is_kind = lambda kind: (F.col("kind") == kind) & (F.col("n") > 0) & F.col("first_seen").isNotNull()
    unique = counted.agg(F.count_if(is_kind("attacker")).alias("n"), F.count_if(is_kind("event")).alias("events")).where("events > 0")
    unique = unique.select(F.lit("unique_attackers").alias("metric"), F.lit(None).cast("string").alias("key"), "n")
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), F.asc("first_seen"), F.asc("key")))).where("rank <= 5")
    metric = {"attacker": "top_attacker", "attack": "most_common_attack", "hour": "peak_attack_hour"}
    first = F.array(*(F.when((F.col("kind") == kind) & (F.col("rank") == 1), name) for kind, name in metric.items()), F.when(F.col("kind") == "attacker", "top_5_attackers"))
    tops = ranked.select(F.explode(F.array_compact(first)).alias("metric"), "key", "n")
    return unique.unionByName(tops)


def trend_summary(events: DataFrame, stamp: str = "observed_text", levels: list[str] = SERIOUS) -> DataFrame:
    """The report as one row: unique_attackers, top_attacker, most_common_attack, peak_attack_hour, top_5_attackers (array of key and n).

    No events at all give no row; without a serious event the number is 0, the keys are null and the list is empty.
    """
    is_metric = lambda name: F.col("metric") == name
    only = lambda name, c: F.max(F.when(is_metric(name), F.col(c)))
    # Ties keep the order of the report; at most eight rows arrive here.
    five = F.collect_list(F.when(is_metric("top_5_attackers"), F.struct((-F.col("n")).alias("less"), "rank", "key", "n")))
    rows = trend_report(events, stamp, levels).withColumn("rank", F.monotonically_increasing_id())
    out = rows.groupBy().agg(
        only("unique_attackers", "n").alias("unique_attackers"), *(only(m, "key").alias(m) for m in ("top_attacker", "most_common_attack", "peak_attack_hour")),
        F.transform(F.array_sort(five), lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n"))).alias("top_5_attackers"),
    )
    return out.where("unique_attackers is not null")


def unique_attackers(events: DataFrame, levels: list[str] = SERIOUS, error: float | None = None) -> DataFrame:
    """n: how many sources have a serious event, exactly or (with ``error``) within that relative standard deviation by a sketch."""
    ip = F.col("source_ip")
    return serious(events, levels).agg((F.count_distinct(ip) if error is None else F.approx_count_distinct(ip, error)).alias("n"))


def exact_sum(value: Column) -> Column:
    """The sum of doubles as they are written, in decimals; a plain sum where a value has no place there (NaN, infinite, very large)."""
    exact = value.try_cast("decimal(38, 18)")
    return F.coalesce(F.when(F.count(exact) == F.count(value), F.try_sum(exact)).cast("double"), F.sum(value))


def risk_profiles(events: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Per source: count, total, largest (at least 0) and mean risk, latest level and time of the rows with a time, else of the first row.

    The total is the exact sum of the risks as they are written, so that the order of the rows changes no digit of it or of the mean.
    """
    rows = events.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
    risk, level, order = F.coalesce("risk_score", F.lit(0.0)), F.coalesce("threat_level", F.lit("LOW")), _arrival(arrival)
    timed = F.when(F.col("timestamp").isNotNull(), order)
    total = exact_sum(risk)
    return rows.groupBy("source_ip").agg(
        F.count("*").alias("count"), total.alias("total_risk"), F.greatest(F.lit(0.0), F.max(risk)).alias("max_risk"), (total / F.count("*")).alias("avg_risk"),
        F.coalesce(F.max_by(level, timed), F.min_by(level, order)).alias("latest_threat"), F.max_by(F.col("timestamp"), timed).alias("last_seen"), F.min(order).alias("first_seen"),
    )


#: Microseconds of a source's time whose risks are packed into one row.
SLOT_US = 1_000_000


def risk_profiles_in_order(events: DataFrame, arrival: Column | None = None) -> DataFrame:
    """The same profiles with the total as the reference and a single-threaded SQL have it: doubles added one by one, by (t_us, packet_id).

    Such a sum cannot be taken in parts. Each slot of a source's time is reduced to a row with its risks in order, apart from the others;
    the rows of a source are then read as a stream of packed risks (eight bytes for an event) that carries the sum from slot to slot.
    """
    rows = events.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
    risk, level, order = F.coalesce("risk_score", F.lit(0.0)), F.coalesce("threat_level", F.lit("LOW")), _arrival(arrival)
    timed = F.when(F.col("timestamp").isNotNull(), order)
    slot = F.coalesce(F.floor(F.col("t_us") / SLOT_US), F.lit(-(1 << 62)))
    packed = F.sort_array(F.collect_list(F.struct("t_us", "packet_id", risk.alias("risk"))))
    slots = rows.groupBy("source_ip", slot.alias("slot")).agg(
        F.count("*").alias("n"), F.max(risk).alias("most"), F.max_by(F.struct(timed.alias("o"), level.alias("level"), "timestamp"), timed).alias("last"),
        F.min_by(F.struct(order.alias("o"), level.alias("level")), order).alias("first"), F.transform(packed, lambda x: x["risk"]).alias("risks"),
    )
    kept = [c for c in slots.columns if c != "risks"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0.0
        for batch in batches:
            sources, risks = batch.column("source_ip"), batch.column("risks")
            values, ends = risks.flatten().to_numpy(zero_copy_only=False), risks.offsets.to_numpy() - risks.offsets[0].as_py()
            totals = np.zeros(len(sources))
            begins = [0, *(np.flatnonzero(pc.not_equal(sources[1:], sources[:-1]).to_numpy(zero_copy_only=False)) + 1), len(sources)] if len(sources) else []
            for i, j in zip(begins, begins[1:]):
                source = sources[int(i)].as_py()
                sums = np.add.accumulate(np.append(total if source == now else 0.0, values[ends[i] : ends[j]]))
                totals[i:j] = sums[ends[i + 1 : j + 1] - ends[i]]
                now, total = source, totals[j - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(totals)], names=[*kept, "total"])

    schema = StructType([*(f for f in slots.schema.fields if f.name in kept), StructField("total", DoubleType())])
    added = slots.repartition("source_ip").sortWithinPartitions("source_ip", "slot").mapInArrow(add, schema)
    total, count = F.max_by("total", "slot"), F.sum("n")
    return added.groupBy("source_ip").agg(
        count.alias("count"), total.alias("total_risk"), F.greatest(F.lit(0.0), F.max("most")).alias("max_risk"), (total / count).alias("avg_risk"),
        F.coalesce(F.max_by("last.level", "last.o"), F.min_by("first.level", "first.o")).alias("latest_threat"), F.max_by("last.timestamp", "last.o").alias("last_seen"), F.min("first.o").alias("first_seen"),
    )


def top_profiles(events: DataFrame, n: int = 5, arrival: Column | None = None) -> DataFrame:
    """Sources of the largest risk, with badge and the risk cut to an integer; ties in order of arrival."""
    best = risk_profiles(events, arrival).orderBy(F.desc("max_risk"), F.asc("first_seen")).limit(n)
    return best.withColumns({"badge": badge(F.col("latest_threat")), "risk": F.col("max_risk").cast("int")})


def threat_table(events: DataFrame, rdns: DataFrame, geo: DataFrame, n: int = 5, arrival: Column | None = None) -> DataFrame:
    """The top sources with host name and country. The n rows are fetched once; the dimensions are cut to their addresses."""
    ranked = top_profiles(events, n, arrival)
    best = events.sparkSession.createDataFrame(ranked.collect(), ranked.schema)  # n rows
    few = F.broadcast(best.select(F.col("source_ip").alias("__k")))  # n rows
    names = rdns.join(few, F.col("ip") == F.col("__k"), "left_semi").dropDuplicates(["ip"]).select(F.col("ip").alias("__name_ip"), "hostname")
    places = geo.join(few, F.col("ip") == F.col("__k"), "left_semi")
    out = with_location(best.join(names, F.col("source_ip") == F.col("__name_ip"), "left"), places)
    return out.select(F.col("source_ip").alias("ip"), F.coalesce("hostname", F.lit("Unknown")).alias("domain"), "country", "count", "risk", F.col("latest_threat").alias("severity"), "badge", "lat", "lon")


def map_points(table: DataFrame) -> DataFrame:
    return table.where(F.col("lat") != 0).select("ip", "lat", "lon")
