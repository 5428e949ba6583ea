"""JSON messages: packets, and bad records with their reasons."""

import json

import pytest

from packetrisk.sources.messages import judged, packets_of, read_messages, rejected_of

GOOD = {"packet_id": 1, "src_ip": "8.8.8.8", "dst_ip": "9.9.9.9", "protocol": 6, "src_port": 1000, "dst_port": 80, "packet_length": 60, "timestamp": "2024-01-01T00:00:00.5", "more": [1]}


def frame(spark, *texts):
    return spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "key string, value string, reason string")


@pytest.mark.parametrize(
    ("text", "reason"),
    [(None, "no text"), ("", "no text"), ("  ", "no text"), ("{", "not JSON"), ("{'a': 1}", "not JSON"), (json.dumps(GOOD)[:-3], "not JSON"), (json.dumps(GOOD) + " x", "not JSON"), ("[1]", "not an object"), (json.dumps([GOOD]), "not an object"),
     ("5", "not an object"), ("null", "not an object"), ('"x"', "not an object"), ("{}", "no IP layer"), ('{"src_ip": null}', "no IP layer"), ('{"src_ip": "a"}', "no time"), ('{"protocol": 6, "timestamp": "x"}', "no time"), ('{"dst_ip": "a", "timestamp": null}', "no time")],
)
def test_reasons(spark, text, reason):
    rows = judged(frame(spark, text))
    assert [tuple(r) for r in rejected_of(rows).collect()] == [("0", text, reason)] and packets_of(rows).count() == 0


def test_packets(spark):
    texts = [json.dumps(GOOD | x) for x in ({}, {"src_ip": ""}, {"src_ip": None, "dst_ip": None}, {"protocol": "17", "src_port": " 5 ", "dst_port": "x", "packet_length": 60.9}, {"src_port": None, "dst_port": 1e3, "packet_id": None})]
    rows = judged(frame(spark, *texts))
    assert rejected_of(rows).count() == 0
    got = packets_of(rows).collect()
    assert [r.source_ip for r in got] == ["8.8.8.8", "unknown", "unknown", "8.8.8.8", "8.8.8.8"] and got[2].destination_ip == "unknown"
    assert (got[3].protocol, got[3].src_port, got[3].dst_port, got[3].packet_length) == (17, 5, 0, 60)
    assert (got[4].src_port, got[4].dst_port, got[4].packet_id) == (0, 1000, None)
    assert got[0].t_us == 1704067200500000 and "reason" not in packets_of(rows).columns


def test_lines_and_binary_values(spark, tmp_path):
    (tmp_path / "lines.txt").write_text(json.dumps(GOOD) + "\nbroken\n")
    rows = judged(read_messages(spark, "text", path=str(tmp_path)))
    assert [(r.key, r.text, r.reason) for r in rejected_of(rows).collect()] == [(None, "broken", "not JSON")] and packets_of(rows).count() == 1
    binary = frame(spark, json.dumps(GOOD)).selectExpr("cast(key as binary) key", "cast(value as binary) value")
    assert packets_of(judged(binary)).first().dst_port == 80


def test_empty(spark):
    assert judged(frame(spark)).count() == 0
