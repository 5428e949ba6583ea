"""Flow sessions and running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetrisk.config import DEFAULTS, RiskConfig
from packetrisk.operators.chunks import deal

FLOW = ["source_ip", "destination_ip"]
ORDER = ["t_us", "packet_id"]


def by_source(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Hash on the source once (into ``parts`` tasks): every later window on source or flow reuses the exchange."""
    return deal(df, parts, "source_ip")


def _sessions(df: DataFrame, key: list[str], config: RiskConfig) -> DataFrame:
    """``df`` with the session number within ``key``, from 0: a new one after a gap of more than the timeout."""
    flow = Window.partitionBy(*key).orderBy(*ORDER)
    gap = F.col("t_us") - F.lag("t_us").over(flow)
    df = df.withColumn("__new", (F.coalesce(gap, F.lit(0)) > config.flow_timeout_s * 1_000_000).cast("int"))
    return df.withColumn("session", F.sum("__new").over(flow.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def _new_port(key: list[str]):
    """Whether a row is the first of its session within ``key`` to a port."""
    port = Window.partitionBy(*key, "session", "dst_port").orderBy(*ORDER)
    return (F.row_number().over(port) == 1) & F.coalesce(F.col("dst_port") != 0, F.lit(False))


def flow_snapshots(packets: DataFrame, config: RiskConfig = DEFAULTS, chunk_s: int | None = None, chunked: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Per packet: ``session`` (a new one after a gap of more than the timeout), packet_count and unique_ports so far.

    unique_ports counts distinct non-zero destination ports: each port's first packet in the session adds one.  With ``chunk_s``
    a flow's time is cut into chunks of that length, which are counted apart, so that one busy flow spreads over
    many tasks with the same values.  With ``chunked`` (t_us, packet_id, dst_port, addresses and ``__c`` of the same rows) the chunks are those of
    the column ``__c``, which stays.  ``parts``: the number of tasks.
    """
    if chunk_s:
        packets = packets.withColumn("__c", F.coalesce(F.floor(F.col("t_us") / (chunk_s * 1_000_000)), F.lit(-(1 << 62))))
        return _chunked(packets, packets, config, parts).drop("__c")
    if chunked is not None:
        return _chunked(packets, chunked, config, parts)
    df = _sessions(packets, FLOW, config).withColumn("__port", _new_port(FLOW).cast("int"))
    session = Window.partitionBy(*FLOW, "session").orderBy(*ORDER)
    df = df.withColumn("packet_count", F.row_number().over(session).cast("long"))
    return df.withColumn("unique_ports", F.sum("__port").over(session.rowsBetween(Window.unboundedPreceding, 0))).drop("__port")


def _chunked(packets: DataFrame, light: DataFrame, config: RiskConfig, parts: int | None) -> DataFrame:
    """Counters by (flow, chunk), and on top of them what the session that reaches into a chunk brings along."""
    key = ["__f", "__c"]  # as a struct a flow with a null address equals itself in the join
    dealt = lambda rows, *columns: deal(rows.select(*columns, F.struct(*FLOW).alias("__f")), parts, *key)
    brought = _brought(_sessions(dealt(light, "t_us", "packet_id", "dst_port", "__c"), key, config), config)
    rows = _sessions(dealt(packets, *packets.columns), key, config).withColumn("__port", _new_port(key)).join(brought, key)
    head = F.col("session") == 0
    session = Window.partitionBy(*key, "session").orderBy(*ORDER)
    known = F.when(F.col("__port") & head, F.array_contains("__old", F.col("dst_port"))).otherwise(False)
    rows = rows.withColumn("packet_count", F.row_number().over(session) + F.when(head, F.col("__count")).otherwise(0))
    ports = F.sum((F.col("__port") & ~known).cast("int")).over(session.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("unique_ports", ports + F.when(head, F.col("__ports")).otherwise(0)).withColumn("session", F.col("session") + F.col("__base"))
    return rows.select(*packets.columns, "session", "packet_count", "unique_ports")


def _brought(rows: DataFrame, config: RiskConfig) -> DataFrame:
    """For each (flow, chunk): the number of its first session (__base), and the packets (__count), ports (__ports, how many) and
    those of its own ports (__old) that this session has from earlier chunks.

    A chunk is reduced to its sessions; only these are chained by flow.  A session has at most one part in each chunk.
    """
    parts = rows.groupBy("__f", "__c", "session").agg(
        F.count("*").alias("n"), F.min("t_us").alias("first"), F.max("t_us").alias("last"), F.collect_set(F.when(F.col("dst_port") != 0, F.col("dst_port"))).alias("own")
    )
    flow = Window.partitionBy("__f").orderBy("__c", "session")
    parts = parts.withColumn("new", (F.coalesce(F.col("first") - F.lag("last").over(flow), F.lit(0)) > config.flow_timeout_s * 1_000_000).cast("int"))
    parts = parts.withColumn("whole", F.sum("new").over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    # a session within one chunk brings nothing along; else each port counts in the first chunk of the session that has it
    several = F.count("*").over(Window.partitionBy("__f", "whole")) > 1
    ports = parts.withColumn("own", F.when(several, F.col("own"))).select("__f", "__c", "session", "whole", "n", F.explode_outer("own").alias("port")).repartition("__f", "whole", "port")
    ports = ports.withColumn("old", F.col("__c") > F.min("__c").over(Window.partitionBy("__f", "whole", "port")))
    parts = ports.groupBy("__f", "__c", "session", "whole", "n").agg(F.count_if(~F.col("old") & F.col("port").isNotNull()).alias("fresh"), F.collect_list(F.when(F.col("old"), F.col("port"))).alias("__old"))
    before = Window.partitionBy("__f", "whole").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__count": F.coalesce(F.sum("n").over(before), F.lit(0)), "__ports": F.coalesce(F.sum("fresh").over(before), F.lit(0))})
    return parts.where("session = 0").select("__f", "__c", F.col("whole").alias("__base"), "__count", "__ports", "__old")


def flow_sessions(snapshots: DataFrame, at_us: int, config: RiskConfig = DEFAULTS) -> DataFrame:
    """Final counters of each session, and whether it is active at ``at_us``."""
    out = snapshots.groupBy(*FLOW, "session").agg(
        F.max("packet_count").alias("packet_count"), F.max("unique_ports").alias("unique_ports"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")
    )
    return out.withColumn("active", F.lit(at_us) - F.col("last_us") <= config.flow_timeout_s * 1_000_000)
