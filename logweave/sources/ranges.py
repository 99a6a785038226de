"""Address ranges with a country and an AS number: delimited files of any usual layout, and binary trie files.

A delimited file's layout is inferred from a sample of its lines: the delimiter by counting on the first line, the columns by
their names where there is a header, otherwise by what their values look like. The rows are then read as columns.

A trie file is walked from the nodes a few bits below its roots, dealt over tasks; its leaves are networks, which are joined
by prefix and length. Its bytes are broadcast behind a check of their number.

Sources are asked in order, and each field is the first source's that has it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.functions import ip
from logweave.operators.enrich import bounded, longest_prefix
from logweave.scratch import written

SAMPLE_LINES = 200
LARGEST_TRIE = 1 << 30
#: Bits below a root at which subtrees are dealt.
DEALT_BITS = 8
#: Names of columns, delimiters, and what vendors write for nothing.
START = ("start_ip", "start", "ip_from", "from", "first_ip", "begin", "start_address", "startip", "ip_start", "range_start", "network_start_ip", "min_ip", "low", "ip_range_start")
END = ("end_ip", "end", "ip_to", "to", "last_ip", "end_address", "endip", "ip_end", "range_end", "network_last_ip", "max_ip", "high", "ip_range_end")
CIDR = ("cidr", "network", "net", "prefix", "subnet", "range", "ip_range", "ip_prefix", "block")
COUNTRY = ("country", "country_iso_code", "iso_code", "country_code", "cc", "country_iso", "countrycode", "registered_country_iso_code", "country_name")
ASN = ("asn", "as", "as_number", "autonomous_system_number", "asnum", "as_num", "asn_number", "autonomous_system")
DELIMITERS = (",", "\t", ";", "|")
NOTHING = ("", "-", "none", "null", "n/a", "na", "unknown", "??", "zz")
MARKER = b"\xab\xcd\xefMaxMind.com"
METADATA_BYTES, SEPARATOR, DEEPEST, MOST_FIELDS = 128 * 1024, 16, 64, 100_000


# -- delimited files ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Places of the columns; start and end, or cidr, are there."""

    delimiter: str
    header: bool
    start: int | None = None
    end: int | None = None
    cidr: int | None = None
    country: int | None = None
    asn: int | None = None


def _cells(line: str, delimiter: str) -> list[str]:
    return [c.strip().strip('"').strip() for c in line.split(delimiter)]


def _is_address(text: str) -> bool:
    if text.isdigit():
        return True
    try:
        ip.key_of(text)
        return True
    except ValueError:
        return False


def _is_network(text: str) -> bool:
    try:
        return "/" in text and bool(ip.network(text))
    except ValueError:
        return False


def infer(lines: list[str]) -> Layout:
    """The layout of a sample of lines; ConfigError if no column tells the addresses."""
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")][:SAMPLE_LINES]
    if not lines:
        raise ConfigError("the file has no rows")
    delimiter = max(DELIMITERS, key=lambda d: (lines[0].count(d), -DELIMITERS.index(d)))
    names = [c.lower().replace(" ", "_").replace("-", "_").replace(".", "_").strip("_") for c in _cells(lines[0].lstrip("﻿"), delimiter)]
    place = lambda wanted: next((names.index(w) for w in wanted if w in names), None)
    found = {"start": place(START), "end": place(END), "cidr": place(CIDR), "country": place(COUNTRY), "asn": place(ASN)}
    if found["cidr"] is not None or (found["start"] is not None and found["end"] is not None):
        return Layout(delimiter, True, **found)
    # no header: each column by its values, addresses before AS numbers, both of which may be digits
    rows = [_cells(x, delimiter) for x in lines]
    columns = [[r[i] for r in rows if i < len(r) and r[i].lower() not in NOTHING] for i in range(max(map(len, rows)))]
    mostly = lambda test, c: 2 * sum(map(test, c)) > len(c)  # noqa: E731  a file may hold a line of rubbish
    networks = [i for i, c in enumerate(columns) if mostly(_is_network, c)]
    addresses = [i for i, c in enumerate(columns) if mostly(_is_address, c)]
    roles: dict[str, int] = {}
    if networks:
        roles["cidr"] = networks[0]
    elif len(addresses) >= 2:
        roles["start"], roles["end"] = addresses[:2]
    else:
        raise ConfigError("no column of the file is a network, and no two are addresses")
    taken = set(roles.values())
    for i, c in enumerate(columns):
        if i in taken or not c:
            continue
        if "country" not in roles and mostly(lambda v: len(v) == 2 and v.isascii() and v.isalpha(), c):
            roles["country"] = i
        elif "asn" not in roles and mostly(lambda v: (v[2:] if v[:2].lower() == "as" else v).strip().isdigit(), c):
            roles["asn"] = i
    return Layout(delimiter, False, **roles)


def _known(cell: Column) -> Column:
    return F.when(~F.lower(cell).isin(*NOTHING), cell)


def country_of(cell: Column) -> Column:
    return F.when(cell.rlike("^[A-Za-z]{2}$"), F.upper(_known(cell)))


def asn_of(cell: Column) -> Column:
    n = F.regexp_replace(F.lower(_known(cell)), r"^as\s*", "").try_cast("long")
    return F.when(n.between(1, 0xFFFFFFFF), n)


def _position(cell: Column) -> Column:
    """The key of an address, or of a number: an IPv6 one if it is above IPv4's."""
    number = cell.try_cast("decimal(38,0)")
    high, low = F.floor(number / F.lit(str(1 << 64)).cast("decimal(20,0)")), F.pmod(number, F.lit(str(1 << 64)).cast("decimal(20,0)"))
    digits = lambda n: F.lpad(F.lower(F.conv(n.cast("string"), 10, 16)), 16, "0")
    four = F.concat(F.lit("4"), F.substring(digits(low), 9, 8))
    of_number = F.when(number <= 0xFFFFFFFF, four).otherwise(F.concat(F.lit("6"), digits(high.cast("decimal(38,0)")), digits(low)))
    return F.when(cell.rlike("^[0-9]+$"), of_number).otherwise(ip.key(cell))


def read_ranges(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """Rows (low, high, country, asn) of a delimited file, as keys of addresses; rows that name no range, or two versions, go."""
    lines = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'")
    layout = layout or infer([r[0] for r in lines.limit(SAMPLE_LINES).collect()])
    cells = F.transform(F.split("value", rf"\Q{layout.delimiter}\E", -1), lambda c: F.btrim(F.btrim(F.btrim(c), F.lit('"'))))
    rows = lines.select(cells.alias("c"))
    at = lambda i: F.get("c", i) if i is not None else F.lit(None).cast("string")
    if layout.cidr is not None:
        rows = rows.select("c", ip.networked(at(layout.cidr)).alias("n"))
        net, prefix = F.col("n"), F.col("n.prefix")
        width = F.when(prefix.startswith("4"), 9).otherwise(33)
        part = F.pmod(net["length"], F.lit(4))
        # the last digit of a prefix that does not fill it stands for the least of several
        last = F.conv(F.right(prefix, F.lit(1)), 16, 10).cast("int") + F.pow(F.lit(2), 4 - part).cast("int") - 1
        filled = F.when(part == 0, prefix).otherwise(F.concat(F.substring(prefix, F.lit(1), F.length(prefix) - 1), F.lower(F.hex(last))))
        low, high = F.rpad(prefix, width, F.lit("0")), F.rpad(filled, width, F.lit("f"))
    else:
        low, high = _position(at(layout.start)), _position(at(layout.end))
    out = rows.select(low.alias("low"), high.alias("high"), country_of(at(layout.country)).alias("country"), asn_of(at(layout.asn)).alias("asn"))
    return out.where("low <= high and length(low) = length(high)")


def range_networks(ranges: DataFrame) -> DataFrame:
    """Rows (prefix, length, label) of ranges: each as the networks that fill it, label a struct (country, asn).

    A small function in Python finds a range's networks, at most 254 for any. Where ranges overlap, the longest prefix, and
    of equal ones the last by label, is what an address meets.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for low, high, country, asn in zip(pdf["low"], pdf["high"], pdf["country"], pdf["asn"], strict=True):
                bits, a, b = 4 * (len(low) - 1), int(low[1:], 16), int(high[1:], 16)
                while a <= b:
                    size = min((a & -a).bit_length() - 1 if a else bits, (b - a + 1).bit_length() - 1)
                    length = bits - size
                    out.append((low[0] + f"{a:0{bits // 4}x}"[: -(-length // 4)], length, country, asn))
                    a += 1 << size
            yield pd.DataFrame(out, columns=["prefix", "length", "country", "asn"])

    rows = ranges.select("low", "high", "country", F.col("asn").cast("string").alias("asn")).mapInPandas(split, "prefix string, length int, country string, asn string")
    label = F.struct("country", F.col("asn").cast("long").alias("asn"))
    return rows.groupBy("prefix", "length").agg(F.max(label).alias("label"))


# -- trie files --------------------------------------------------------------------------------------------------------


class Trie:
    """A binary search trie with records: reading of nodes and of what leaves point to."""

    def __init__(self, data: bytes) -> None:
        tail = data[-METADATA_BYTES:]
        at = tail.rfind(MARKER)
        if at < 0:
            raise ConfigError("no metadata: this is no trie file")
        self.data = data
        self.base = len(data) - len(tail) + at + len(MARKER)
        self.left = MOST_FIELDS
        meta = self._value(self.base, 0)[0]
        self.nodes, self.bits, self.version = meta["node_count"], meta["record_size"], meta["ip_version"]
        if self.bits not in (24, 28, 32) or self.nodes * self.bits // 4 + SEPARATOR > self.base:
            raise ConfigError("the trie's metadata does not fit its file")
        self.base = self.nodes * self.bits // 4 + SEPARATOR

    def child(self, node: int, bit: int) -> int:
        size = self.bits // 4
        raw = self.data[node * size : (node + 1) * size]
        if self.bits == 28:
            middle = raw[3] >> 4 if bit == 0 else raw[3] & 15
            return middle << 24 | int.from_bytes(raw[:3] if bit == 0 else raw[4:], "big")
        half = size // 2
        return int.from_bytes(raw[half * bit : half * (bit + 1)], "big")

    def record(self, leaf: int) -> object:
        self.left = MOST_FIELDS
        return self._value(self.base + leaf - self.nodes - SEPARATOR, 0)[0]

    def _value(self, at: int, depth: int) -> tuple[object, int]:
        self.left -= 1
        if depth > DEEPEST or self.left < 0:
            raise ConfigError("a record of the trie is nested too deep, or too large")
        control = self.data[at]
        kind, size, at = control >> 5, control & 31, at + 1
        if kind == 1:  # a pointer
            n = size >> 3 & 3
            raw = int.from_bytes(self.data[at : at + n + 1], "big")
            value = raw if n == 3 else ((size & 7) << 8 * (n + 1) | raw) + (0, 2048, 526336)[n]
            return self._value(self.base + value, depth + 1)[0], at + n + 1
        if kind == 0:
            kind, at = 7 + self.data[at], at + 1
        if size >= 29:
            n = size - 28
            size = (29, 285, 65821)[n - 1] + int.from_bytes(self.data[at : at + n], "big")
            at += n
        if kind == 7:
            out = {}
            for _ in range(size):
                key, at = self._value(at, depth + 1)
                out[key], at = self._value(at, depth + 1)
            return out, at
        if kind == 11:
            items = []
            for _ in range(size):
                item, at = self._value(at, depth + 1)
                items.append(item)
            return items, at
        if kind == 14:
            return bool(size), at
        raw, at = self.data[at : at + size], at + size
        if kind == 2:
            return raw.decode("utf-8", "replace"), at
        if kind in (3, 15):
            return struct.unpack("!d" if kind == 3 else "!f", raw)[0], at
        if kind == 8:
            return int.from_bytes(raw, "big", signed=size == 4), at
        return (raw if kind == 4 else int.from_bytes(raw, "big")), at

    def starts(self) -> list[tuple[int, int, int, int]]:
        """(node, version, bits so far, number of them): subtrees that together are all networks, IPv4's apart."""
        width = 128 if self.version == 6 else 32
        four, deep = 0, 0
        while self.version == 6 and deep < 96 and four < self.nodes:
            four, deep = self.child(four, 0), deep + 1
        out = []

        def down(node: int, version: int, bits: int, n: int, most: int) -> None:
            if version == 6 and node == four and node < self.nodes:  # IPv4's own tree, and other ways into it
                return
            if node >= self.nodes or n == most:
                out.append((node, version, bits, n))
            else:
                down(self.child(node, 0), version, bits << 1, n + 1, most)
                down(self.child(node, 1), version, bits << 1 | 1, n + 1, most)

        if width == 128:
            down(0, 6, 0, 0, DEALT_BITS)
        if four < self.nodes:
            for i in range(1 << DEALT_BITS):
                node, n = four, 0
                while n < DEALT_BITS and node < self.nodes:
                    node, n = self.child(node, i >> (DEALT_BITS - 1 - n) & 1), n + 1
                if not i & ((1 << DEALT_BITS - n) - 1):
                    out.append((node, 4, i >> DEALT_BITS - n, n))
        return [s for s in out if s[0] != self.nodes]

    def networks(self, node: int, version: int, bits: int, n: int) -> Iterator[tuple[str, int, object]]:
        """(prefix, length, record) of the leaves below a node."""
        width = 128 if version == 6 else 32
        four, deep = 0, 0
        while version == 6 and deep < 96 and four < self.nodes:
            four, deep = self.child(four, 0), deep + 1
        stack = [(node, bits, n)]
        while stack:
            node, bits, n = stack.pop()
            if node > self.nodes:
                yield f"{version}{bits << width - n:0{width // 4}x}"[: 1 + -(-n // 4)], n, self.record(node)
            elif node < self.nodes and n < width and not (version == 6 and node == four):
                stack += [(self.child(node, b), bits << 1 | b, n + 1) for b in (1, 0)]


def _fields(record: object) -> tuple[str | None, str | None]:
    """Country and AS number of a record, by the names that such files use."""
    if not isinstance(record, dict):
        return None, None
    country = record.get("country") or record.get("registered_country")
    country = country.get("iso_code") if isinstance(country, dict) else country or record.get("country_code")
    asn = record.get("autonomous_system_number", record.get("asn"))
    return (country if isinstance(country, str) else None), (None if asn is None else str(asn))


def trie_networks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (prefix, length, label) of a trie file, label a struct (country, asn)."""
    row = spark.read.format("binaryFile").load(path).select("length", "path").first()
    if row is None or row["length"] > LARGEST_TRIE:
        raise ConfigError(f"{path}: no file, or one of more than {LARGEST_TRIE} bytes")
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    starts = Trie(data).starts()
    shared = spark.sparkContext.broadcast(data)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for pdf in batches:
            for node, version, bits, n in zip(*[pdf[c] for c in ("node", "version", "bits", "n")], strict=True):
                rows = [(p, length, *_fields(r)) for p, length, r in trie.networks(int(node), int(version), int(bits), int(n))]
                yield pd.DataFrame(rows, columns=["prefix", "length", "country", "asn"])

    dealt = spark.createDataFrame(starts, "node long, version int, bits long, n int").repartition(max(1, min(len(starts), 64)))
    rows = dealt.mapInPandas(walk, "prefix string, length int, country string, asn string")
    label = F.struct(country_of(F.col("country")).alias("country"), asn_of(F.col("asn")).alias("asn"))
    return rows.select("prefix", "length", label.alias("label"))


# -- precedence --------------------------------------------------------------------------------------------------------


def located(rows: DataFrame, address: str, sources: list[DataFrame], country: str = "country", asn: str = "asn") -> DataFrame:
    """rows with the country and AS number of an address: each of the first source (prefix, length, label) that has it."""
    distinct = rows.select(F.col(address).alias("_a")).where("_a is not null").distinct()
    for i, source in enumerate(sources):
        for field in ("country", "asn"):
            known = source.where(F.col("label")[field].isNotNull()).select("prefix", "length", F.col("label")[field].alias("label"))
            distinct = longest_prefix(distinct, "_a", written(known, "networks"), f"_{field}{i}")
    each = {f: F.coalesce(*[F.col(f"_{f}{i}") for i in range(len(sources))], F.lit(None)) for f in ("country", "asn")}
    found = written(distinct.select("_a", each["country"].cast("string").alias(country), each["asn"].cast("long").alias(asn)), "located")
    return rows.join(bounded(found), rows[address] == found["_a"], "left").drop("_a")
