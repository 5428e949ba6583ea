"""Raw and normalised flow features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = ["packet_count", "protocol", "src_port", "dst_port"]
#: The scale of each feature.
SCALES = {"packet_count": 100.0, "protocol": 255.0, "src_port": 65535.0, "dst_port": 65535.0}


def raw_features() -> list[Column]:
    return [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]


def normalised_features(prefix: str = "") -> list[Column]:
    """packet_count / 100 capped at 1; protocol / 255; ports / 65535; null counts as 0."""
    out = []
    for c in FEATURES:
        x = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) / F.lit(SCALES[c])
        out.append((F.least(x, F.lit(1.0)) if c == "packet_count" else x).alias(prefix + c))
    return out
