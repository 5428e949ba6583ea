"""State expiry of the live processors, the live tables and the forms of the trend report."""

import pandas as pd
import pytest

from packetrisk.operators import analytics
from packetrisk.plans.streams import state_store
from packetrisk.streaming.live import ActivityProcessor, CooldownProcessor, live_activity

EVENTS = "t_us long, packet_id long, source_ip string, threat_level string, risk_score double, alerts array<struct<type:string>>, observed_text string"


class Store:
    """One state of one key: a value, a list or a map."""

    def __init__(self, kind):
        self.kind, self.data = kind, None

    def exists(self):
        return bool(self.data) if self.kind != "value" else self.data is not None

    def get(self):
        return iter(self.data) if self.kind == "list" else self.data

    def update(self, value):
        self.data = value

    def put(self, rows):
        assert rows
        self.data = list(rows)

    def appendList(self, rows):
        self.data = [*(self.data or []), *rows]

    def clear(self):
        self.data = None

    def containsKey(self, key):
        return key in (self.data or {})

    def getValue(self, key):
        return self.data[key]

    def updateValue(self, key, value):
        self.data = {**(self.data or {}), key: value}

    def removeKey(self, key):
        del self.data[key]

    def iterator(self):
        return iter(list((self.data or {}).items()))


class Handle:
    """The states of one key, and the timers asked for."""

    def __init__(self):
        self.states, self.timers = {}, []

    def _state(self, name, kind):
        return self.states.setdefault(name, Store(kind))

    def getValueState(self, name, schema):
        return self._state(name, "value")

    def getListState(self, name, schema):
        return self._state(name, "list")

    def getMapState(self, name, key, value):
        return self._state(name, "map")

    def registerTimer(self, at):
        self.timers.append(at)

    def rows(self, name):
        return 0 if not self.states[name].exists() else len(self.states[name].data)

    def kept(self):
        return {n for n, s in self.states.items() if s.exists()}


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def fed(processor, seconds, watermark_s, destination="d", port=80):
    rows = pd.DataFrame([
        {"packet_id": i, "t_us": s * 1_000_000, "timestamp": pd.Timestamp(s, unit="s"), "destination_ip": destination, "protocol": 6, "src_port": 1, "dst_port": port + i, "packet_length": 1, "anomaly_detected": False, "threat_level": "HIGH", "risk_score": 1.0}
        for i, s in enumerate(seconds)
    ])
    return list(processor.handleInputRows(("a",), iter([rows]), Clock(watermark_s * 1000)))


def test_an_idle_source_keeps_its_history_only():
    processor = ActivityProcessor()
    handle = started(processor)
    assert sum(map(len, fed(processor, [100, 101, 102], 110))) == 3
    assert handle.timers[-1] == 162_001
    assert list(processor.handleExpiredTimer(("a",), Clock(162_000), None)) == []
    assert handle.rows("times") == 3 and handle.kept() == {"seen", "flows", "ports", "times", "counts", "swept"}
    assert list(processor.handleExpiredTimer(("a",), Clock(162_001), None)) == []
    assert handle.kept() == {"seen", "counts"} and handle.states["counts"].data == ([1, 2, 3],)


@pytest.mark.parametrize("gap", [61, 500])
def test_expiry_changes_no_value(gap):
    kept, freed = ActivityProcessor(), ActivityProcessor()
    outputs = []
    for processor, expire in ((kept, False), (freed, True)):
        started(processor)
        fed(processor, list(range(100, 130)), 131)
        if expire:
            list(processor.handleExpiredTimer(("a",), Clock((129 + gap) * 1000), None))
        outputs.append(pd.concat(fed(processor, [129 + gap, 130 + gap], 140 + gap)))
    pd.testing.assert_frame_equal(*outputs)


def test_a_forgotten_source_leaves_nothing():
    processor = ActivityProcessor(forget_s=300)
    handle = started(processor)
    fed(processor, [100], 110)
    list(processor.handleExpiredTimer(("a",), Clock(170_000), None))
    assert handle.kept() == {"seen", "counts"} and handle.timers[-1] == 400_001
    list(processor.handleExpiredTimer(("a",), Clock(400_001), None))
    assert not handle.kept()
    assert list(processor.handleExpiredTimer(("a",), Clock(500_000), None)) == []


def test_waiting_rows_outlive_the_timer():
    processor = ActivityProcessor()
    handle = started(processor)
    fed(processor, [100, 300], 200)
    assert handle.timers[-1] == 300_001 and handle.rows("waiting") == 1


def test_a_batch_writes_what_it_touches():
    """Waiting rows are added to, ports are written where a new one comes, old times and flows go while a source is busy."""
    processor = ActivityProcessor()
    handle = started(processor)
    for second in range(100, 400):
        fed(processor, [second], second + 1, destination=f"d{second // 20}", port=80)
        assert handle.rows("times") <= 2 * 61 + 1 and handle.rows("flows") <= 3 and handle.rows("ports") <= 3
    written = []
    handle.states["ports"].updateValue = lambda k, v: written.append(k)
    fed(processor, [400, 400], 401, destination="d19", port=80)
    assert written == [("d19",)]  # the second port is new
    assert handle.rows("waiting") == 0
    fed(processor, [500], 402)
    fed(processor, [501], 402)
    assert handle.rows("waiting") == 2


def test_missing_values_stay_missing():
    processor = ActivityProcessor()
    started(processor)
    rows = pd.DataFrame({"packet_id": [1, 2], "t_us": [5, 6], "timestamp": pd.to_datetime([5, 6], unit="s"), "destination_ip": ["d", None], "protocol": [6.0, None], "src_port": [1.0, None], "dst_port": [None, 5.0], "packet_length": [1, 2], "anomaly_detected": [None, True]})
    out = pd.concat(processor.handleInputRows(("a",), iter([rows]), Clock(60_000)))
    assert out["dst_port"].isna().tolist() == [True, False] and out["unique_ports"].tolist() == [0, 1] and out["packet_count"].tolist() == [1, 1]


def test_cooldown_state_goes_with_the_cooldown():
    processor = CooldownProcessor()
    handle = started(processor)
    assert sum(map(len, fed(processor, [100, 110], 115))) == 1
    list(processor.handleExpiredTimer(("a",), Clock(130_000), None))
    assert handle.kept() == {"seen", "last"}
    list(processor.handleExpiredTimer(("a",), Clock(140_001), None))
    assert not handle.kept()


@pytest.mark.parametrize(("forget_s", "left"), [(None, 2), (120, 0)])
def test_expiry_on_a_stream(spark, tmp_path, forget_s, left):
    """State rows of a real stream, counted after each batch: an idle source keeps two values, or nothing where it is forgotten."""
    schema = "packet_id long, t_us long, timestamp timestamp, source_ip string, destination_ip string, protocol int, src_port int, dst_port int, packet_length int, anomaly_detected boolean"
    source, number = str(tmp_path / "in"), iter(range(1000))

    def put(name, *seconds):
        rows = [(next(number), s * 1_000_000, pd.Timestamp(s, unit="s").to_pydatetime(), name, "d", 6, 1, 80, 60, False) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    put("busy", *range(100, 130))
    with state_store(spark):
        stream = live_activity(spark.readStream.schema(schema).parquet(source), forget_s=forget_s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            rows = []
            for second in (131, 150, 400, 401, 402):
                stream.processAllAvailable()
                rows.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
                put("other" if second < 400 else f"late{second}", second)
            stream.processAllAvailable()
            put("last", 403)
            stream.processAllAvailable()
            rows.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
            states = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "times").load()
            names = {r.key.source_ip for r in states.select("key").collect()}
        finally:
            stream.stop()
    assert max(rows) >= 13 and rows[3] == 1 + 2 * left  # states of the two idle sources, and the row that waits
    assert not names & {"busy", "other"}, names
    counts = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "counts").load()
    assert ({"busy", "other"} <= {r.key.source_ip for r in counts.select("key").collect()}) == (left > 0)
    assert spark.read.parquet(str(tmp_path / "out")).where("source_ip = 'busy'").count() == 30


def test_report_as_one_row_and_sketch(spark):
    rows = [(i, i, f"8.8.{i % 9}.1", "HIGH", 1.0, [("X",), ("Y",)][: 1 + i % 2], f"2024-01-01T{i % 4:02d}:00:00") for i in range(40)]
    df = spark.createDataFrame([*rows, (50, 50, "9.9.9.9", "LOW", 0.0, None, None)], EVENTS)
    row = analytics.trend_summary(df).first()
    assert (row.unique_attackers, row.top_attacker, row.most_common_attack, row.peak_attack_hour) == (9, "8.8.0.1", "X", "0")
    assert [tuple(x) for x in row.top_5_attackers] == [(f"8.8.{i}.1", n) for i, n in enumerate([5, 5, 5, 5, 4])]
    quiet = analytics.trend_summary(df.where("threat_level = 'LOW'")).first()
    assert (quiet.unique_attackers, quiet.top_attacker, quiet.top_5_attackers) == (0, None, [])
    assert analytics.trend_summary(df.limit(0)).count() == 0
    assert analytics.unique_attackers(df).first().n == 9
    assert abs(analytics.unique_attackers(df, error=0.01).first().n - 9) <= 1


def test_report_scores_its_events_once(spark, small):
    from packetrisk.plans.queries import QUERIES

    report = QUERIES["trend_summary"](spark, small)
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "InMemoryTableScan" not in plan
