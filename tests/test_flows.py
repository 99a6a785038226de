"""Binary flow exports against a packet-by-packet reader, in batch and as a stream."""

import ipaddress
import json
import random
import struct

import pytest

from pyspark.sql import functions as F

from logweave.functions import ip
from logweave.sources import flows
from logweave.streaming.flows import flow_stream

NAMES = {1: "bytes", 2: "packets", 4: "protocol_number", 7: "src_port", 8: "src_ip", 11: "dst_port", 12: "dst_ip", 27: "src_ip", 56: "src_mac", 96: "application_name", 152: "flow_start_ms", 153: "flow_end_ms", 21: "last_switched", 22: "first_switched"}
LENGTHS = {1: [4, 8, 3], 2: [4, 8], 4: [1], 7: [2], 8: [4], 11: [2], 12: [4], 27: [16], 56: [6], 96: [flows.VARIABLE, 12], 152: [8], 153: [8], 21: [4], 22: [4], 210: [1, 3], 999: [2, 10]}


def sets_of(kind, ipfix, templates):
    body = b""
    for template_id, elements in templates:
        specs = b"".join(struct.pack("!HH", e, n) for e, n in elements)
        if kind == "template":
            body += struct.pack("!HH", template_id, len(elements)) + specs
        elif ipfix:
            body += struct.pack("!HHH", template_id, len(elements), 1) + specs
        else:
            body += struct.pack("!HHH", template_id, 4, len(specs) - 4) + specs
    number = {("template", False): 0, ("options", False): 1, ("template", True): 2, ("options", True): 3}[kind, ipfix]
    return struct.pack("!HH", number, 4 + len(body)) + body


def record(rng, elements):
    out, values = b"", {}
    for e, n in elements:
        size = rng.choice([0, 3, 9, 300]) if n == flows.VARIABLE else n
        raw = bytes(rng.randrange(97, 123) for _ in range(size)) if e == 96 else bytes(rng.randrange(256) for _ in range(size))
        if n == flows.VARIABLE:
            out += bytes([size]) if size < 255 else b"\xff" + struct.pack("!H", size)
        out += raw
        if e == 210:
            continue
        if e in (8, 12, 27):
            values[NAMES[e]] = str(ipaddress.ip_address(raw))
        elif e == 56:
            values[NAMES[e]] = ":".join(f"{b:02x}" for b in raw)
        elif e == 96:
            if raw:
                values[NAMES[e]] = raw.decode()
        else:
            values[NAMES.get(e, f"ie_{e}")] = int.from_bytes(raw, "big") if size <= 8 else raw.hex()
    return out, values


def traffic(rng, count):
    """(packets (exporter, n, data), flows (exporter, n, index): values, unknown sets by exporter)."""
    packets, wanted, unknown, cache = [], {}, {}, {}
    for i in range(count):
        exporter, n, ipfix, domain = rng.choice(["a", "b"]), i * 3, rng.random() < 0.5, rng.randrange(2)
        body, index = b"", 0
        for _ in range(rng.randrange(1, 4)):
            template_id = rng.choice([256, 257, 300])
            key = exporter, domain, template_id
            if rng.random() < 0.25:
                elements = [(e, rng.choice([x for x in LENGTHS[e] if ipfix or x != flows.VARIABLE])) for e in rng.sample(list(LENGTHS), rng.randrange(1, 7))]
                kind = "options" if rng.random() < 0.15 else "template"
                if kind == "template" and all(n == 0 for _, n in elements):
                    continue
                cache[key] = (kind, elements)
                body += sets_of(kind, ipfix, [(template_id, elements)])
            elif key not in cache:
                body += struct.pack("!HH", template_id, 12) + bytes(8)
                unknown[exporter] = unknown.get(exporter, 0) + 1
            else:
                kind, elements = cache[key]
                data = b""
                for _ in range(rng.randrange(1, 5)):
                    raw, values = record(rng, elements)
                    if not raw:
                        break
                    data += raw
                    if kind == "template":
                        wanted[exporter, n, index] = values
                        index += 1
                body += struct.pack("!HH", template_id, 4 + len(data)) + data
        head = struct.pack("!HHIII", 10, 16 + len(body), 1704164645, i, domain) if ipfix else struct.pack("!HHIIII", 9, 1, 1000, 1704164645, i, domain)
        packets.append((exporter, n, bytearray(head + body)))
    return packets, wanted, unknown


SCHEMA = "exporter string, n long, data binary"
DERIVED = {"flow_version", "flow_sequence", "exporter", "observation_domain", "protocol", "export_time", "start_time", "end_time", "duration_ms", "flow_index"}


@pytest.mark.parametrize("block", [4096, 7])
def test_flows_equal_a_reading_packet_by_packet(spark, monkeypatch, block):
    monkeypatch.setattr(flows, "BLOCK", block)
    packets, wanted, unknown = traffic(random.Random(5), 150)
    df = spark.createDataFrame(packets + [("a", 9999, bytearray(b"\0\5")), ("c", 1, None), ("c", 2, bytearray(b""))], SCHEMA)
    got = {}
    for r in flows.flows(flows.with_templates(flows.sets(df))).collect():
        values = json.loads(r.value)
        key = r.exporter, r.n, values["flow_index"]
        assert key not in got
        got[key] = {k: v for k, v in values.items() if k not in DERIVED}
    assert got == wanted
    counts = {r.exporter: r for r in flows.accounting(df).collect()}
    assert {e: counts[e].unknown_sets for e in ("a", "b")} == {e: unknown.get(e, 0) for e in ("a", "b")}
    assert (counts["c"].packets, counts["c"].undecodable, counts["a"].undecodable) == (2, 2, 1 + sum(1 for e, n, d in packets if e == "a" and len(d) <= 20 and d[1] == 9 or e == "a" and len(d) == 16))
    assert counts["a"].redefined > 0


def test_a_stream_of_packets_equals_the_batch(spark, tmp_path):
    packets, wanted, _ = traffic(random.Random(8), 60)
    for at in range(0, 60, 30):
        spark.createDataFrame(packets[at : at + 30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "all" / f"p{at}"))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "all"))
    out = str(tmp_path / "out")
    query = flow_stream(rows, lambda batch, number: batch.write.mode("append").parquet(out), str(tmp_path / "mark"))
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive
    batch = flows.flow_events(spark.createDataFrame(packets, SCHEMA))
    plain = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in df.collect())
    assert plain(spark.read.schema(batch.schema).parquet(out)) == plain(batch) and batch.count() == len(wanted)


def test_the_first_format_and_claims_beyond_the_bytes(spark):
    one = struct.pack("!4s4s4sHHIIIIHHBBBBHHBBH", bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]), bytes(4), 1, 2, 3, 400, 1000, 4500, 1234, 443, 0, 16, 6, 0, 65000, 65001, 24, 16, 0)
    head = struct.pack("!HHIIIIBBH", 5, 30, 5000, 1704164645, 500_000_000, 7, 1, 2, 0x4003)
    rows = [json.loads(r.value) for r in flows.flows(flows.with_templates(flows.sets(spark.createDataFrame([("e", 1, bytearray(head + one + b"tail"))], SCHEMA)))).collect()]
    assert len(rows) == 1
    want = {"flow_version": "v5", "flow_sequence": 7, "exporter": "e", "engine_type": 1, "engine_id": 2, "sampling_mode": 1, "sampling_interval": 3, "protocol": "tcp", "start_time": "2024-01-02T03:04:01.500Z", "end_time": "2024-01-02T03:04:05.000Z", "duration_ms": 3500, "src_as": 65000, "dst_mask": 16, "next_hop": "0.0.0.0", "flow_index": 0}
    assert want.items() <= rows[0].items()


def test_definitions_that_cannot_be_read():
    assert flows.definitions("template", 9, struct.pack("!HH", 300, 0)) == [(300, None)]
    assert flows.definitions("template", 9, struct.pack("!HHHH", 300, 2, 1, 4)) == [(300, None)]
    assert flows.definitions("template", 9, struct.pack("!HHHH", 300, 1, 1, 0) + struct.pack("!HHHH", 301, 1, 1, 4))[0] == (300, None)
    assert [t for t, x in flows.definitions("template", 10, struct.pack("!HHHHI", 300, 1, 0x8001, 4, 9)) if x["fields"][0]["key"] == "ie_9_1"] == [300]
    assert flows.definitions("template", 9, bytes(6)) == [] and flows.walk(b"\0\x0a\0\3") == ((0, 0, None, None, None, None), [])


def test_addresses_are_written_as_usual(spark):
    rng = random.Random(2)
    samples = [ipaddress.IPv6Address(bytes(rng.choice([0, 0, 0, 1, 255]) for _ in range(16))) for _ in range(200)] + [ipaddress.IPv6Address(x) for x in ("::", "::1", "1::", "::ffff:1.2.3.4", "1:0:0:2:0:0:3:4", "0:1::", "1:2:3:4:5:6:7:8", "10::10:0:0:100")]
    rows = spark.createDataFrame([(a.packed.hex(), str(a)) for a in samples] + [("0a000001", "10.0.0.1"), ("0a", None)], "h string, want string")
    assert rows.where(~ip.text_of(F.col("h")).eqNullSafe(F.col("want"))).collect() == []


def test_fixed_records_do_not_carry_their_fields(spark):
    """A record of a fixed layout has no copy of the layout's fields; they are taken from the set's layout."""
    what = flows.layout([(8, 4, 0), (1, 4, 0)], False)
    met = spark.createDataFrame([("e", 1, 0, bytearray(range(16)), what)], f"exporter string, n long, k int, body binary, layout {flows._LAYOUT}")
    row = flows._records(met).select("records").first()
    assert [(bytes(x["rec"]), x["fields"]) for x in row["records"]] == [(bytes(range(8)), None), (bytes(range(8, 16)), None)]
