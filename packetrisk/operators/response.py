"""Alerts with a cooldown, and the block ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetrisk.config import DEFAULTS, SERIOUS, RiskConfig
from packetrisk.functions.addresses import is_ipv4_shape, is_private
from packetrisk.functions.numbers import ip_or_unknown
from packetrisk.operators.suppress import suppress


def alert_candidates(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("threat_level").isin(SERIOUS))


def alerts(scored: DataFrame, config: RiskConfig = DEFAULTS, chunk_holds: int | None = None) -> DataFrame:
    """Emitted alerts of the serious rows: at most one per source in the cooldown; ``chunk_holds`` spreads busy sources (see ``suppress``).

    A missing address is 'unknown', a missing risk 0.
    """
    rows = alert_candidates(scored).select("packet_id", "t_us", ip_or_unknown(F.col("source_ip")).alias("source_ip"), "threat_level", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"))
    kept = suppress(rows, config.alert_cooldown_s, inclusive=True, carry=("threat_level", "risk_score"), chunk_holds=chunk_holds).where("emitted")
    message = F.concat(F.lit("Threat detected from "), "source_ip", F.lit(" with risk "), F.col("risk_score").cast("string"))
    return kept.select(
        "packet_id", "t_us", F.lit("SECURITY_ALERT").alias("alert_type"), "source_ip", "threat_level", "risk_score", message.alias("message")
    )


def with_refusals(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``refused`` (why a source is not blocked, or null) and ``held``: the source, or a key of its own for a refused one."""
    ip = F.col("source_ip")
    refused = F.when(~is_ipv4_shape(ip), "Invalid IP").when(is_private(ip), "Skipped (Local/Private IP)")
    return candidates.withColumn("refused", refused).withColumn("held", F.when(F.col("refused").isNull(), ip).otherwise(F.concat(F.lit("refused:"), F.coalesce(ip, F.lit("")))))


def block_events(ledger: DataFrame, at_us: int, config: RiskConfig = DEFAULTS) -> DataFrame:
    """The ledger's rows up to ``at_us`` and a release (status 'Released IP: ...') of each block that had run out by then, at its first free microsecond.

    A release carries the packet of its block.
    """
    ended = ledger.where(F.col("expires_us") < at_us)
    released = ended.select("packet_id", (F.col("expires_us") + 1).alias("t_us"), "source_ip", F.concat(F.lit("Released IP: "), "source_ip").alias("status"), F.lit(None).cast("long").alias("expires_us"))
    return ledger.where(F.col("t_us") <= at_us).unionByName(released)


def block_ledger(candidates: DataFrame, config: RiskConfig = DEFAULTS, chunk_holds: int | None = None) -> DataFrame:
    """(packet_id, t_us, source_ip, status, expires_us) of every candidate; a block lasts while no more than the hold has passed.

    Each candidate is judged by itself first: one that is refused never holds back another.  Repeated packet ids are
    rows of their own.  ``chunk_holds`` spreads busy sources over tasks (see ``suppress``).
    """
    ip = F.col("source_ip")
    rows = with_refusals(candidates.select("packet_id", "t_us", "source_ip"))
    judged = suppress(rows, config.block_hold_s, inclusive=False, key="held", carry=("source_ip", "refused"), chunk_holds=chunk_holds)
    blocked = F.col("refused").isNull() & F.col("emitted")
    status = F.coalesce("refused", F.when(blocked, F.concat(F.lit("Blocked IP: "), ip)).otherwise("Already Blocked"))
    return judged.select("packet_id", "t_us", "source_ip", status.alias("status"), F.when(blocked, F.col("t_us") + config.block_hold_s * 1_000_000).alias("expires_us"))


def block_status(ledger: DataFrame, at_us: int, recent: int = 10) -> DataFrame:
    """(total_blocked, recent_blocks): blocks active at ``at_us`` and the ``recent`` latest blocks by then, newest first.

    One pass: every task counts its active blocks and keeps its latest ones, and these few are put together.  An empty ledger
    gives 0 and no blocks.
    """
    blocks = ledger.where(F.col("expires_us").isNotNull() & (F.col("t_us") <= at_us)).select("t_us", "packet_id", "source_ip", (F.col("expires_us") >= at_us).alias("active"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, latest = 0, None
        for batch in batches:
            active += pc.sum(batch.column("active").cast(pa.int64())).as_py() or 0
            rows = pa.Table.from_batches([batch.select(["t_us", "packet_id", "source_ip"])])
            rows = rows if latest is None else pa.concat_tables([latest, rows])
            latest = rows.take(pc.select_k_unstable(rows, recent, [("t_us", "descending"), ("packet_id", "descending")]))
        if latest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([active]), pa.array([latest.to_pylist()], pa.list_(latest.schema.empty_table().to_struct_array().type))], names=["active", "latest"])

    parts = blocks.mapInArrow(run, "active long, latest array<struct<t_us: long, packet_id: long, source_ip: string>>")
    last = F.slice(F.sort_array(F.flatten(F.collect_list("latest")), asc=False), 1, recent)
    return parts.agg(F.coalesce(F.sum("active"), F.lit(0)).alias("total_blocked"), F.transform(last, lambda x: x["source_ip"]).alias("recent_blocks"))
