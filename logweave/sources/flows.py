"""Binary flow exports, of three versions, from packets to events.

A packet is a header and sets. Its walk, and the reading of template definitions and of records of variable length, are
small functions over Arrow batches; all else is columns. A template describes the data sets of its exporter and domain
that come after it: in a batch templates are carried forward in the order of the packets (operators/carry.py), in a
stream they are state (template_state()). Records are then cut out of their sets and read by column expressions, so that
a batch and a stream give the same rows.

Packets are rows (exporter, n, data): n rises with the arrival of an exporter's packets. A data set before its template is
not decoded, but counted; so are templates that cannot be read and data sets of option templates, which are no flows.
Lengths are those of the bytes that are there: what a header claims beyond them is not read. Whole numbers of more than
eight bytes are kept as hexadecimal digits.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import ip
from logweave.operators.carry import carried
from logweave.scratch import written
from logweave.sources.json_formats import netflow

LONGEST_PACKET = 65_535
LONGEST_FIELDS, LONGEST_RECORD = 255, 8192
#: Packets of an exporter that one task carries templates through.
BLOCK = 4096
VARIABLE = 0xFFFF

#: Information elements, the key of each and how it is read.
ELEMENTS = {
    1: ("bytes", "uint"), 2: ("packets", "uint"), 3: ("flows", "uint"), 4: ("protocol_number", "uint"), 5: ("tos", "uint"), 6: ("tcp_flags", "uint"),
    7: ("src_port", "uint"), 8: ("src_ip", "ip"), 9: ("src_mask", "uint"), 10: ("input_snmp", "uint"), 11: ("dst_port", "uint"), 12: ("dst_ip", "ip"),
    13: ("dst_mask", "uint"), 14: ("output_snmp", "uint"), 15: ("next_hop", "ip"), 16: ("src_as", "uint"), 17: ("dst_as", "uint"),
    21: ("last_switched", "uint"), 22: ("first_switched", "uint"), 23: ("out_bytes", "uint"), 24: ("out_packets", "uint"), 27: ("src_ip", "ip"), 28: ("dst_ip", "ip"),
    29: ("src_mask", "uint"), 30: ("dst_mask", "uint"), 31: ("flow_label", "uint"), 32: ("icmp_type_code", "uint"), 56: ("src_mac", "mac"), 58: ("src_vlan", "uint"),
    59: ("dst_vlan", "uint"), 60: ("ip_version", "uint"), 61: ("direction", "uint"), 62: ("next_hop", "ip"), 80: ("dst_mac", "mac"), 82: ("interface_name", "text"),
    95: ("application_id", "uint"), 96: ("application_name", "text"), 136: ("flow_end_reason", "uint"), 148: ("flow_id", "uint"),
    150: ("flow_start_seconds", "uint"), 151: ("flow_end_seconds", "uint"), 152: ("flow_start_ms", "uint"), 153: ("flow_end_ms", "uint"),
    154: ("flow_start_us", "uint"), 155: ("flow_end_us", "uint"), 156: ("flow_start_ns", "uint"), 157: ("flow_end_ns", "uint"),
    176: ("icmp_type", "uint"), 177: ("icmp_code", "uint"), 210: ("", "padding"), 239: ("biflow_direction", "uint"),
}
PROTOCOL_NAMES = {
    "1": "icmp", "2": "igmp", "6": "tcp", "17": "udp", "41": "ipv6", "47": "gre", "50": "esp", "51": "ah", "58": "ipv6-icmp", "89": "ospf", "103": "pim", "112": "vrrp", "132": "sctp",
}
#: Units of absolute times in nanoseconds, and the field that is relative to the exporter's start.
UNITS = (("seconds", 10**9), ("ms", 10**6), ("us", 10**3), ("ns", 1))
RELATIVE = {"start": "first_switched", "end": "last_switched"}
#: Records of version 5: information element and bytes of each field in turn.
FIRST_FORMAT = ((8, 4), (12, 4), (15, 4), (10, 2), (14, 2), (2, 4), (1, 4), (22, 4), (21, 4), (7, 2), (11, 2), (210, 1), (6, 1), (4, 1), (5, 1), (16, 2), (17, 2), (9, 1), (13, 1), (210, 2))
#: Flow times are believed from 1970 to 2100, in nanoseconds.
LAST_TIME = 4_102_444_800 * 10**9

_FIELD = "array<struct<key:string,kind:string,at:int,length:int>>"
_LAYOUT = f"struct<options:boolean,size:int,fields:{_FIELD},protocol:int,start:int,start_unit:long,end:int,end_unit:long,repeats:boolean>"
_SET = "exporter string, n long, k int, version int, domain long, sequence long, exported long, boot long, engine array<int>, kind string, set_id int, body binary"
SETS = {"template": {9: 0, 10: 2}, "options": {9: 1, 10: 3}}


# -- small functions over bytes ------------------------------------------------------------------------------------


def walk(data: bytes | None) -> tuple[tuple, list[tuple[str, int, bytes]]]:
    """((version, domain, sequence, export time, start of the exporter, engine), sets (kind, id, body)) of a packet; a
    packet that is none has the version 0 and no sets. Times are in nanoseconds."""
    none = (0, 0, None, None, None, None), []
    if not data or not 4 <= len(data) <= LONGEST_PACKET:
        return none
    version = struct.unpack_from("!H", data)[0]
    if version == 5 and len(data) >= 24:
        _, count, uptime, seconds, nanos, sequence, kind, unit, sampling = struct.unpack_from("!HHIIIIBBH", data)
        exported = seconds * 10**9 + min(nanos, 10**9 - 1)
        head = (5, 0, sequence, exported, exported - uptime * 10**6, [kind, unit, sampling >> 14, sampling & 0x3FFF])
        return head, [("first", 5, data[24 : 24 + 48 * count])]
    if version == 9 and len(data) >= 20:
        _, _, uptime, seconds, sequence, domain = struct.unpack_from("!HHIIII", data)
        head, at, end = (9, domain, sequence, seconds * 10**9, seconds * 10**9 - uptime * 10**6, None), 20, len(data)
    elif version == 10 and len(data) >= 16:
        _, length, seconds, sequence, domain = struct.unpack_from("!HHIII", data)
        head, at, end = (10, domain, sequence, seconds * 10**9, None, None), 16, min(length, len(data))
    else:
        return none
    kinds, sets = {ids[version]: name for name, ids in SETS.items()}, []
    while at + 4 <= end:
        set_id, length = struct.unpack_from("!HH", data, at)
        if length < 4 or at + length > end:
            break
        if set_id in kinds or set_id >= 256:
            sets.append((kinds.get(set_id, "data"), set_id, data[at + 4 : at + length]))
        at += length
    return head, sets


def layout(elements: list[tuple[int, int, int]], options: bool) -> dict:
    """What a template says of its records: fields with key, kind, place and length, the size (-1: varies), and where the
    protocol and the times are (-1: nowhere)."""
    fields, at, fixed = [], 0, all(length != VARIABLE for _, length, _ in elements)
    for element, length, enterprise in elements:
        key, kind = ELEMENTS.get(element, ("", "")) if not enterprise else ("", "")
        if not kind:
            key, kind = f"ie_{enterprise}_{element}" if enterprise else f"ie_{element}", "other"
        fields.append({"key": key, "kind": kind, "at": at if fixed else -1, "length": length})
        at += length if fixed else 0
    keys = [f["key"] for f in fields]
    found = {"options": options, "size": at if fixed else -1, "fields": fields, "protocol": keys.index("protocol_number") if "protocol_number" in keys else -1}
    for edge in ("start", "end"):
        known = [(f"flow_{edge}_{name}", unit) for name, unit in UNITS] + [(RELATIVE[edge], 0)]
        place, unit = next(((keys.index(k), u) for k, u in known if k in keys), (-1, -1))
        found |= {edge: place, f"{edge}_unit": unit}
    return found | {"repeats": len(set(keys) - {""}) < len([k for k in keys if k])}


def definitions(kind: str, version: int, body: bytes) -> list[tuple[int, dict | None]]:
    """(template id, layout) of each definition in a set; a layout of None cannot be read, and ends the set unless only
    its record is too long or empty."""
    out, at, ipfix, head = [], 0, version == 10, 4 if kind == "template" else 6
    while at + head <= len(body):
        template_id, *counts = struct.unpack_from("!HH" if head == 4 else "!HHH", body, at)
        at += head
        if template_id < 256:  # padding
            break
        if head == 4 or ipfix:
            count = counts[0]
            good = 0 < count <= LONGEST_FIELDS and (head == 4 or counts[1] <= count)
        else:  # bytes of the scopes' and of the options' descriptions
            count = sum(counts) // 4
            good = 0 < sum(counts) <= LONGEST_RECORD and not (counts[0] % 4 or counts[1] % 4) and count <= LONGEST_FIELDS
        elements = []
        while good and len(elements) < count:
            if at + 4 > len(body):
                good = False
                break
            element, length = struct.unpack_from("!HH", body, at)
            at, enterprise = at + 4, 0
            if ipfix and element & 0x8000:
                if at + 4 > len(body):
                    good = False
                    break
                element, enterprise, at = element & 0x7FFF, struct.unpack_from("!I", body, at)[0], at + 4
            elements.append((element, length, enterprise))
        if not good:
            out.append((template_id, None))
            break
        found = layout(elements, kind == "options")
        usable = kind == "options" or found["size"] == -1 or 0 < found["size"] <= LONGEST_RECORD
        out.append((template_id, found if usable else None))
    return out


def varying(body: bytes, fields: list[dict]) -> list[dict]:
    """Records (rec, fields) of a set whose template has fields of variable length, each with the places of its own."""
    out, at = [], 0
    while at < len(body):
        begin, own = at, []
        for f in fields:
            length = f["length"]
            if length == VARIABLE:
                if at >= len(body):
                    return out
                length, at = body[at], at + 1
                if length == 255:
                    if at + 2 > len(body):
                        return out
                    length, at = int.from_bytes(body[at : at + 2], "big"), at + 2
            if at + length > len(body):
                return out
            own.append({**f, "at": at - begin, "length": length})
            at += length
        if at <= begin:
            break
        out.append({"rec": body[begin:at], "fields": own})
    return out


# -- from packets to sets with their templates ------------------------------------------------------------------------


def sets(packets: DataFrame) -> DataFrame:
    """The sets of packets; a packet without any has one row of kind none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in _SET.split(", ")]
        for batch in batches:
            rows = []
            for exporter, n, data in zip(*[batch.column(c).to_pylist() for c in ("exporter", "n", "data")], strict=True):
                (version, domain, *head), found = walk(data)
                for k, (kind, set_id, body) in enumerate(found or [("none", 0, None)]):
                    rows.append((exporter, n, k, version, domain, *head, kind, set_id, body))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    rows = packets.select(F.coalesce(F.col("exporter").cast("string"), F.lit("")).alias("exporter"), F.col("n").cast("long").alias("n"), "data")
    return rows.mapInArrow(each, _SET)


def template_rows(found: DataFrame) -> DataFrame:
    """Rows (exporter, domain, n, k, j, template_id, layout) of the definitions in sets; layout is null if unreadable."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.exporter, r.domain, r.n, r.k, j, template_id, what)
                for r in pdf.itertuples()
                for j, (template_id, what) in enumerate(definitions(r.kind, r.version, bytes(r.body)))
            ]
            yield pd.DataFrame(rows, columns=["exporter", "domain", "n", "k", "j", "template_id", "layout"])

    some = found.where(F.col("kind").isin("template", "options")).select("exporter", "domain", "n", "k", "version", "kind", "body")
    return some.mapInPandas(each, f"exporter string, domain long, n long, k int, j int, template_id int, layout {_LAYOUT}")


def _first_layout() -> Column:
    what = layout([(element, length, 0) for element, length in FIRST_FORMAT], False)
    fields = F.array(*[F.struct(F.lit(f["key"]).alias("key"), F.lit(f["kind"]).alias("kind"), F.lit(f["at"]).alias("at"), F.lit(f["length"]).alias("length")) for f in what["fields"]])
    return F.struct(*[(fields if k == "fields" else F.lit(v)).alias(k) for k, v in what.items()]).cast(_LAYOUT)


def with_templates(found: DataFrame) -> DataFrame:
    """Data sets of sets() with the layout of the last template of their id before them, or null."""
    first = found.where("kind = 'first'").withColumn("layout", _first_layout())
    data = found.where("kind = 'data'")
    body = F.struct(*[c for c in data.columns if c not in ("exporter", "domain")])
    rows = data.select("exporter", "domain", F.col("set_id").alias("template_id"), "n", "k", F.lit(-1).alias("j"), F.lit(None).cast(_LAYOUT).alias("layout"), body.alias("body"))
    known = template_rows(found).where("layout is not null").withColumn("body", F.lit(None).cast(rows.schema["body"].dataType))
    rows = rows.unionByName(known).withColumns({"block": F.expr(f"n div {BLOCK}"), "place": F.struct("n", "k", "j")})
    met = carried(rows, ["exporter", "domain", "template_id"], "block", "place", ["layout"]).where("body is not null")
    return met.select("exporter", "domain", "body.*", "layout").unionByName(first, allowMissingColumns=True)


# -- from sets to flows ------------------------------------------------------------------------------------------------


def _records(met: DataFrame) -> DataFrame:
    """Sets with their records, an array of structs (rec, fields); fields are the layout's where they are null."""
    fixed = met.where("layout.size > 0")
    size, n = F.col("layout.size"), F.expr("octet_length(body) div layout.size")
    each = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.substring("body", i * size + 1, size).alias("rec"), F.lit(None).cast(_FIELD).alias("fields")))
    fixed = fixed.withColumn("records", F.when(n > 0, each).otherwise(F.array().cast(f"array<struct<rec:binary,fields:{_FIELD}>>")))

    @F.pandas_udf(f"array<struct<rec:binary,fields:{_FIELD}>>")
    def cut(bodies: pd.Series, fields: pd.Series) -> pd.Series:
        return pd.Series([varying(bytes(b), list(f)) for b, f in zip(bodies, fields, strict=True)])

    vary = met.where("layout.size = -1")
    return fixed.unionByName(vary.withColumn("records", cut("body", "layout.fields")))


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _whole(digits: Column) -> Column:
    """Up to eight bytes in hexadecimal digits as decimal ones."""
    return F.when(F.length(digits).between(2, 16), F.conv(digits, 16, 10))


def _json_value(rec: Column, f: Column) -> Column:
    """A field as JSON; null where there is no value."""

    def of(b: Column) -> Column:
        return ip.bind(F.hex(b), lambda digits: spelled(b, digits))

    def spelled(b: Column, digits: Column) -> Column:
        text = F.nullif(F.btrim(F.rtrim(F.make_valid_utf8(b.cast("string")), F.lit("\0")), F.lit(" \t\r\n\f\x0b")), F.lit(""))
        mac = F.when(F.length(digits) == 12, F.regexp_replace(F.lower(digits), "(..)(?!$)", "$1:"))
        quoted = F.when(f["kind"] == "ip", ip.text_of(digits)).when(f["kind"] == "mac", mac)
        quoted = quoted.when(F.length(digits) > 16, F.lower(digits))
        return F.when(f["kind"] == "text", _quoted(text)).when(f["kind"].isin("uint", "other") & (F.length(digits) <= 16), _whole(digits)).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))

    return ip.bind(F.substring(rec, f["at"] + 1, f["length"]), of)


def _number(place: Column, rec: Column, fields: Column) -> Column:
    """The whole number at a place of the fields, or null."""
    digits = lambda f: F.hex(F.substring(rec, f["at"] + 1, f["length"]))
    return ip.bind(F.get(fields, F.when(place >= 0, place)), lambda f: ip.bind(digits(f), _whole))


def _edge(edge: str) -> Column:
    """A flow's start or end in nanoseconds; a time outside belief is the export's."""
    number = _number(F.col(f"layout.{edge}"), F.col("rec"), F.col("fields")).try_cast("decimal(38,0)")
    unit = F.col(f"layout.{edge}_unit")
    relative = lambda value: F.col("boot").cast("decimal(38,0)") + value * 1_000_000
    time = lambda value: F.when(unit == 0, relative(value)).otherwise(F.try_multiply(value, unit.cast("decimal(20,0)")))
    export = F.when(F.col("exported").between(0, LAST_TIME), F.col("exported"))
    believed = lambda t: F.when(t.between(0, LAST_TIME), t.cast("long")).when(t.isNotNull(), export)
    return ip.bind(number, lambda value: ip.bind(time(value), believed))


def _iso(nanos: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.call_function("div", nanos, F.lit(1_000_000))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def flows(met: DataFrame) -> DataFrame:
    """Rows (exporter, n, value): each flow as a JSON record, of data sets with layouts that are not options."""
    rows = _records(met.where("layout is not null and not layout.options"))
    before = Window.partitionBy("exporter", "n").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.size("records")).over(before), F.lit(0)))
    return _as_json(rows)


def _as_json(rows: DataFrame) -> DataFrame:
    kept = ["exporter", "n", "version", "domain", "sequence", "exported", "boot", "engine", "before", "layout"]
    rows = rows.select(*kept, F.posexplode_outer("records").alias("i", "x")).where("x is not null").select(*kept, "i", "x.rec", F.coalesce("x.fields", "layout.fields").alias("fields"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k") if isinstance(k, str) else k.alias("k"), v.cast("string").alias("v"))
    own = F.transform(F.filter("fields", lambda f: f["kind"] != "padding"), lambda f: pair(f["key"], _json_value(F.col("rec"), f)))
    own = F.filter(own, lambda e: e["v"].isNotNull())
    last = lambda every: F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda o: o["k"] == e["k"]))
    own = F.when(F.col("layout.repeats"), ip.bind(own, last)).otherwise(own)
    rows = rows.withColumns({"own": own, "start": _edge("start"), "stop": _edge("end"), "proto": _number(F.col("layout.protocol"), F.col("rec"), F.col("fields"))})
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROTOCOL_NAMES.items() for x in kv]), F.col("proto")), F.col("proto"))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    version = F.when(F.col("version") == 10, "ipfix").otherwise(F.concat(F.lit("v"), F.col("version").cast("string")))
    span = F.when(F.col("stop") >= F.col("start"), F.round((F.col("stop") - F.col("start")) / 1_000_000).cast("long"))
    engine = [pair(k, F.get("engine", i)) for i, k in enumerate(("engine_type", "engine_id", "sampling_mode", "sampling_interval"))]
    more = F.array(
        pair("flow_version", text(version)), pair("flow_sequence", F.col("sequence")), pair("exporter", F.when(F.col("exporter") != "", _quoted(F.col("exporter")))),
        pair("observation_domain", F.when(F.col("version") != 5, F.col("domain"))), *engine, pair("protocol", text(name)),
        pair("export_time", text(_iso(F.col("exported")))), pair("start_time", text(_iso(F.col("start")))), pair("end_time", text(_iso(F.col("stop")))),
        pair("duration_ms", span), pair("flow_index", F.col("before") + F.col("i")),
    )
    every = F.concat(F.filter(more, lambda e: e["v"].isNotNull()), F.col("own"))
    body = F.array_join(F.transform(every, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ",")
    return rows.select("exporter", "n", F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def flow_events(packets: DataFrame) -> DataFrame:
    """Events of recorded packets (exporter, n, data)."""
    met = with_templates(written(sets(packets), "flow-sets"))
    return netflow(flows(written(met, "flow-layouts")).select("value"))


def accounting(packets: DataFrame) -> DataFrame:
    """What became of each exporter's packets: packets, undecodable ones, templates learnt, redefined and malformed, data
    sets without a template, of options, and with flows."""
    found = written(sets(packets), "flow-sets")
    heads = found.groupBy("exporter").agg(F.count_if(F.col("k") == 0).alias("packets"), F.count_if(F.col("kind") == "none").alias("undecodable"))
    known = template_rows(found).withColumns({"block": F.expr(f"n div {BLOCK}"), "place": F.struct("n", "k", "j")})
    group = ["exporter", "domain", "template_id"]
    # a definition's predecessor is what is carried to just before it: the places of predecessors are shifted by half a step
    shape = F.xxhash64("layout.options", "layout.fields")
    now = known.where("layout is not null").select(*group, "block", F.struct("n", "k", "j", F.lit(1).alias("s")).alias("place"), shape.alias("shape"), F.lit(None).cast("long").alias("own"))
    ask = now.select(*group, "block", F.struct("place.n", "place.k", "place.j", F.lit(0).alias("s")).alias("place"), F.lit(None).cast("long").alias("shape"), F.col("shape").alias("own"))
    told = carried(now.unionByName(ask), group, "block", "place", ["shape"]).where("own is not null")
    told = told.groupBy("exporter").agg(F.count(F.lit(1)).alias("learned"), F.count_if(F.col("shape").isNotNull() & (F.col("shape") != F.col("own"))).alias("redefined"))
    bad = known.where("layout is null").groupBy("exporter").agg(F.count(F.lit(1)).alias("malformed"))
    met = with_templates(found).where("kind = 'data'").groupBy("exporter").agg(
        F.count_if(F.col("layout").isNull()).alias("unknown_sets"), F.count_if(F.col("layout.options")).alias("options_sets"), F.count_if(~F.col("layout.options")).alias("flow_sets")
    )
    out = heads.join(told, "exporter", "left").join(bad, "exporter", "left").join(met, "exporter", "left")
    return out.fillna(0)
