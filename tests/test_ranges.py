"""Layouts of range files, trie files against a writer of their format, and precedence of sources."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.sources import ranges


def value(v):
    """A record's bytes."""
    if isinstance(v, str):
        kind, body = 2, v.encode()
    elif isinstance(v, dict):
        kind, body = 7, None
    elif isinstance(v, bool):
        return bytes([v, 7])
    elif isinstance(v, list):
        return (bytes([len(v)]) + bytes([4])) + b"".join(map(value, v))
    elif isinstance(v, float):
        kind, body = 3, struct.pack("!d", v)
    else:
        kind, body = 6, v.to_bytes(4, "big").lstrip(b"\0")
    size = len(v) if body is None else len(body)
    head = bytes([kind << 5 | size]) if size < 29 else bytes([kind << 5 | 29, size - 29])
    return head + (b"".join(value(k) + value(x) for k, x in v.items()) if body is None else body)


def write_trie(networks, version, bits, pointers=False):
    """A trie file of (network, record)."""
    nodes, leaves, data, places = [[None, None]], {}, b"", {}
    for net, record in networks:
        net = ipaddress.ip_network(net)
        number, width, length = int(net.network_address), 32 if version == 4 else 128, net.prefixlen + (96 if version == 6 and net.version == 4 else 0)
        at = 0
        for i in range(length):
            bit = number >> (width - 1 - i) & 1
            if i == length - 1:
                nodes[at][bit] = ("leaf", record)
            else:
                if nodes[at][bit] is None:
                    nodes.append([None, None])
                    nodes[at][bit] = len(nodes) - 1
                at = nodes[at][bit]
    for node in nodes:
        for side in node:
            if isinstance(side, tuple):
                key = repr(side[1])
                if key not in places:
                    raw = value(side[1])
                    if pointers:
                        at = len(data)
                        data += raw
                        places[key] = len(data)
                        data += bytes([1 << 5 | at >> 8 & 7, at & 255]) if at < 2048 else raw
                    else:
                        places[key] = len(data)
                        data += raw
                leaves[key] = places[key]
    tree = b""
    for node in nodes:
        a, b = (len(nodes) if s is None else len(nodes) + 16 + leaves[repr(s[1])] if isinstance(s, tuple) else s for s in node)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([a >> 24 << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    return tree + bytes(16) + data + ranges.MARKER + value({"node_count": len(nodes), "record_size": bits, "ip_version": version, "languages": ["en"], "x": 1.5, "b": True})


FOUR = [("10.0.0.0/8", "AA"), ("10.1.0.0/16", None), ("198.51.0.0/16", "BB"), ("198.51.100.7/32", "CC"), ("0.0.0.0/5", "DD"), ("203.0.113.128/25", "EE")]


def disjoint(networks):
    """Networks that do not meet, with a label each."""
    rng, out = random.Random(len(networks)), []
    for net, label in networks:
        net = ipaddress.ip_network(net)
        if not any(net.version == o.version and net.overlaps(o) for o, _ in out):
            out.append((net, {"country": {"iso_code": label}, "n": rng.randrange(9)} if label and rng.random() < 0.7 else {"country_code": label or "-", "autonomous_system_number": rng.randrange(1, 70000)}))
    return out


@pytest.mark.parametrize(("version", "bits", "pointers"), [(4, 24, False), (6, 28, True), (6, 32, False)])
def test_a_trie_reads_back_the_same(spark, tmp_path, version, bits, pointers):
    rng = random.Random(bits)
    made = FOUR + [(str(ipaddress.ip_network((rng.randrange(1 << 32) >> 8 << 8, rng.randrange(6, 33)), strict=False)), rng.choice(["US", "fr", None])) for _ in range(60)]
    if version == 6:
        made += [(str(ipaddress.ip_network(((0x20010DB8 << 96) + (rng.randrange(1 << 60) << 32), rng.randrange(33, 129)), strict=False)), rng.choice(["DE", "JP"])) for _ in range(60)] + [("2a00::/12", "NL"), ("8000::/1", "ZA")]
    networks = disjoint(made)
    (tmp_path / "x.mmdb").write_bytes(write_trie(networks, version, bits, pointers))
    got = {(r.prefix, r.length): (r.label.country, r.label.asn) for r in ranges.trie_networks(spark, str(tmp_path / "x.mmdb")).collect()}
    want = {}
    for net, record in networks:
        country = record["country"]["iso_code"] if "country" in record else record["country_code"]
        want[ranges.ip.network(str(net))] = (country.upper() if country != "-" else None, record.get("autonomous_system_number"))
    assert got == want
    with pytest.raises(ConfigError):
        ranges.Trie(b"no trie")


@pytest.mark.parametrize(
    ("lines", "layout"),
    [
        (["start_ip,end_ip,country,asn", "10.0.0.0,10.0.0.255,us,AS5"], ranges.Layout(",", True, 0, 1, None, 2, 3)),
        (["Network\tCountry ISO-Code", "10.0.0.0/24\tUS"], ranges.Layout("\t", True, None, None, 0, 1, None)),
        (["10.0.0.0|10.0.0.255|5|US|some, text", "2001:db8::|2001:db8::ff|0|None|x"], ranges.Layout("|", False, 0, 1, None, 3, 2)),
        (['"167772160","167772415","-"', '"167772416","167772671","US"'], ranges.Layout(",", False, 0, 1, None, 2, None)),
        (["# c", "10.0.0.0/24;US;AS12", "2001:db8::/32;zz;13"], ranges.Layout(";", False, None, None, 0, 1, 2)),
    ],
)
def test_layouts_are_inferred(spark, tmp_path, lines, layout):
    assert ranges.infer(lines) == layout
    (tmp_path / "r.csv").write_text("\n".join([*lines, "", "rubbish"]))
    rows = ranges.read_ranges(spark, str(tmp_path / "r.csv")).collect()
    assert len(rows) == len(lines) - layout.header - lines[0].startswith("#")
    first = min(rows, key=lambda r: r.low)
    assert (first.low, first.high) == ("40a000000", "40a0000ff") and {r.country for r in rows} <= {"US", None}


def test_files_without_ranges():
    for lines in ([], ["a,b", "c,d"], ["10.0.0.1,x"]):
        with pytest.raises(ConfigError):
            ranges.infer(lines)


def test_the_first_source_wins_per_field(spark, tmp_path):
    (tmp_path / "own.csv").write_text("cidr,country,asn\n10.1.0.0/16,XX,-\n10.2.0.0/16,zz,77\n2001:db8::/32,YY,\n10.0.0.0/10,,1\n")
    (tmp_path / "more.csv").write_text("start,end,country,asn\n10.0.0.5,10.3.0.9,AA,9\n2001:db8::1,2001:db8::ffff,BB,8\n")
    (tmp_path / "t.mmdb").write_bytes(write_trie(disjoint([("10.0.0.0/8", "CC"), ("2001::/16", "DD")]), 6, 24))
    sources = [ranges.range_networks(ranges.read_ranges(spark, str(tmp_path / f))) for f in ("own.csv", "more.csv")] + [ranges.trie_networks(spark, str(tmp_path / "t.mmdb"))]
    addresses = ["10.1.2.3", "10.2.0.1", "10.3.0.9", "10.3.0.10", "10.200.0.1", "2001:db8::5", "2001:db8:1::", "2001:5::", "8.8.8.8", "no", None]
    out = ranges.located(spark.createDataFrame([(a,) for a in addresses], "a string"), "a", sources)
    got = {r.a: (r.country, r.asn) for r in out.collect()}
    trie = {s: {(r.prefix, r.length): r.label for r in sources[2].collect()} for s in "x"}["x"]
    four, six = (next(v for (p, _), v in trie.items() if p.startswith(d)) for d in "46")
    assert got["10.1.2.3"] == ("XX", 1) and got["10.2.0.1"] == ("AA", 77) and got["10.3.0.9"] == ("AA", 1)
    assert got["10.3.0.10"] == (four.country, 1) and got["10.200.0.1"] == (four.country, four.asn)
    assert got["2001:db8::5"] == ("YY", 8) and got["2001:db8:1::"] == ("YY", six.asn) and got["2001:5::"] == (six.country, six.asn)
    assert got["8.8.8.8"] == got["no"] == got[None] == (None, None)


def test_ranges_become_the_networks_that_fill_them(spark):
    rng = random.Random(9)
    made = []
    for _ in range(40):
        a, b = sorted(rng.randrange(1 << 16) for _ in range(2))
        made.append((a, b))
    rows = spark.createDataFrame([(f"4{a:08x}", f"4{b:08x}", "US", i) for i, (a, b) in enumerate(made)], "low string, high string, country string, asn long")
    for i in (0, 7, 39):
        nets = ranges.range_networks(rows.where(F.col("asn") == i)).collect()
        covered = sorted((int(r.prefix[1:].ljust(8, "0"), 16), 1 << 32 - r.length) for r in nets)
        assert covered[0][0] == made[i][0] and sum(n for _, n in covered) == made[i][1] - made[i][0] + 1
        assert all(x + n == y for (x, n), (y, _) in zip(covered, covered[1:]))
