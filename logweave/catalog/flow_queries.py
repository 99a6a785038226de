"""Binary flow exports made of every event, decoded, against the events themselves.

Ten events are a packet, and every fifth packet is one exporter's. Its packets are of the three versions in turn. In periods
of twelve packets the templates of the two younger versions come with their first packet of the period, in one layout or
another; exporter 3 sends none in the first period, so that its packets there are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.catalog.adapter import SQL, events
from logweave.sources import flows

RECORDS, EXPORTERS, PERIOD = 10, 5, 12
SECONDS, UPTIME = 1_704_164_645, 3_600_000
#: Element and bytes of the fields of a record in both layouts, for the two younger versions.
LAYOUTS = {
    9: (((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4), (22, 4), (21, 4)), ((7, 2), (11, 2), (12, 4), (8, 4), (4, 1), (1, 8), (2, 2), (22, 4), (21, 4), (210, 3))),
    10: (((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 8), (2, 4), (152, 8), (153, 8)), ((27, 16), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4), (150, 4), (151, 4))),
}
IDS = {9: 300, 10: 400}


def _h(value: Column | int, size: int) -> Column:
    """A number as size bytes of hexadecimal digits."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def _address(column: str) -> Column:
    return F.concat(*[_h(F.split_part(F.col(column), F.lit("."), F.lit(i)).cast("int"), 1) for i in (1, 2, 3, 4)])


def _field(element: int, size: int) -> Column:
    seconds = F.col("id") % 1000
    whole = {
        7: F.col("src_port"), 11: F.col("dst_port"), 4: F.when(F.col("protocol") == "tcp", 6).otherwise(17), 1: F.col("bytes_total"), 2: F.col("id") % 60_000,
        22: F.col("id") % 100_000, 21: F.col("id") % 100_000 + 1500, 152: (seconds + SECONDS) * 1000 + 7, 153: (seconds + SECONDS) * 1000 + 1507, 150: seconds + SECONDS,
        151: seconds + SECONDS + 2, 10: F.lit(1), 14: F.lit(2), 15: F.lit(0), 210: F.lit(0), 6: F.lit(16), 5: F.lit(0), 16: F.lit(65000), 17: F.lit(65001), 9: F.lit(24), 13: F.lit(16),
    }
    if element in (8, 12):
        return _address("src_ip" if element == 8 else "dst_ip")
    if element == 27:
        return F.concat(F.lit("20010db8" + "0" * 16), _address("src_ip"))
    return _h(whole[element], size)


def _template(version: int, layout: int) -> Column:
    fields = LAYOUTS[version][layout]
    head = f"{0 if version == 9 else 2:04x}{8 + 4 * len(fields):04x}{IDS[version]:04x}{len(fields):04x}"
    return F.lit(head + "".join(f"{e:04x}{n:04x}" for e, n in fields))


def packets(spark, sf_dir) -> DataFrame:
    """Rows (exporter, n, data): the events as packets."""
    rows = events(spark, sf_dir).withColumn("p", F.expr(f"id div {RECORDS}"))
    rows = rows.withColumns({"e": F.col("p") % EXPORTERS, "m": F.expr(f"p div {EXPORTERS}")})
    rows = rows.withColumns({"version": F.element_at(F.array(F.lit(5), F.lit(9), F.lit(10)), (F.col("m") % 3 + 1).cast("int")), "layout": F.expr(f"m div {PERIOD} % 2")})
    record = F.when(F.col("version") == 5, F.concat(*[_field(e, n) for e, n in flows.FIRST_FORMAT]))
    for version, both in LAYOUTS.items():
        for k, fields in enumerate(both):
            record = record.when((F.col("version") == version) & (F.col("layout") == k), F.concat(*[_field(e, n) for e, n in fields]))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", record.alias("r")))), lambda x: x["r"]), "")
    made = rows.groupBy("p", "e", "m", "version", "layout").agg(listed.alias("records"), F.count(F.lit(1)).alias("c"))
    told = (F.col("m") % PERIOD < 3) & ~((F.col("e") == 3) & (F.col("m") < PERIOD))
    body = F.lit("")
    for version, both in LAYOUTS.items():
        for k in range(len(both)):
            mine = (F.col("version") == version) & (F.col("layout") == k)
            data = F.concat(_h(IDS[version], 2), _h(F.length("records") / 2 + 4, 2), F.col("records"))
            body = F.when(mine, F.concat(F.when(told, _template(version, k)).otherwise(""), data)).otherwise(body)
    first = F.concat(_h(5, 2), _h(F.col("c"), 2), _h(UPTIME, 4), _h(SECONDS, 4), _h(0, 4), _h(F.col("m"), 4), _h(0, 4), F.col("records"))
    ninth = F.concat(_h(9, 2), _h(F.col("c"), 2), _h(UPTIME, 4), _h(SECONDS, 4), _h(F.col("m"), 4), _h(F.col("e"), 4), "body")
    tenth = F.concat(_h(10, 2), _h(F.length("body") / 2 + 16, 2), _h(SECONDS, 4), _h(F.col("m"), 4), _h(F.col("e"), 4), "body")
    made = made.withColumn("body", body)
    data = F.unhex(F.when(F.col("version") == 5, first).when(F.col("version") == 9, ninth).otherwise(tenth))
    return made.select(F.concat(F.lit("10.9.0."), F.col("e").cast("string")).alias("exporter"), F.col("m").alias("n"), data.alias("data"))


def _binary(spark, sf_dir) -> DataFrame:
    found = flows.flow_events(packets(spark, sf_dir))
    kept = [F.get_json_object("raw", f"$.{k}").cast("long").alias(k) for k in ("flow_index", "duration_ms", "observation_domain")]
    return found.select("event_time", "product", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "host_name", "bytes_total", "message", *kept)


_MADE = f"SELECT *, id // {RECORDS} AS p, id // {RECORDS} % {EXPORTERS} AS e, id // {RECORDS} // {EXPORTERS} AS m, m % 3 AS v, m // {PERIOD} % 2 AS layout, e = 3 AND m < {PERIOD} AND v > 0 AS lost FROM ({SQL})"
_BINARY_SQL = f"""
WITH made AS ({_MADE}), f AS (SELECT *, CASE WHEN v = 2 AND layout = 1 THEN concat('2001:db8::', printf('%x', CAST(string_split(src_ip, '.')[1] AS INT) * 256 + CAST(string_split(src_ip, '.')[2] AS INT)),
    ':', printf('%x', CAST(string_split(src_ip, '.')[3] AS INT) * 256 + CAST(string_split(src_ip, '.')[4] AS INT))) ELSE src_ip END AS s FROM made WHERE NOT lost)
SELECT CASE WHEN v = 2 AND layout = 0 THEN make_timestamp((id % 1000 + {SECONDS}) * 1000000 + 1507000) WHEN v = 2 THEN make_timestamp((id % 1000 + {SECONDS} + 2) * 1000000)
    ELSE make_timestamp(CAST({SECONDS} AS BIGINT) * 1000000 - {UPTIME} * 1000::BIGINT + (id % 100000 + 1500) * 1000) END AS event_time,
    ['v5', 'v9', 'ipfix'][v + 1] AS product, s AS src_ip, dst_ip, src_port, dst_port, protocol, concat('10.9.0.', e) AS host_name, bytes_total,
    concat(protocol, ' ', s, ':', src_port, ' -> ', dst_ip, ':', dst_port, ' ', id % 60000, ' pkts ', bytes_total, ' bytes') AS message,
    CAST(id % {RECORDS} AS BIGINT) AS flow_index, CAST(CASE WHEN v = 2 AND layout = 1 THEN 2000 ELSE 1500 END AS BIGINT) AS duration_ms, CAST(CASE WHEN v > 0 THEN e END AS BIGINT) AS observation_domain
FROM f
"""
_ACCOUNTING_SQL = f"""
WITH made AS ({_MADE}), p AS (SELECT DISTINCT e, m, v, layout, lost FROM made),
t AS (SELECT e, v, m, layout, lag(layout) OVER (PARTITION BY e, v ORDER BY m) AS was FROM p WHERE v > 0 AND m % {PERIOD} < 3 AND NOT lost),
told AS (SELECT e, count(*) AS learned, count(*) FILTER (was <> layout) AS redefined FROM t GROUP BY e)
SELECT concat('10.9.0.', e) AS exporter, count(*) AS packets, 0 AS undecodable, coalesce(max(learned), 0) AS learned, coalesce(max(redefined), 0) AS redefined, 0 AS malformed,
    count(*) FILTER (lost) AS unknown_sets, 0 AS options_sets, count(*) FILTER (v > 0 AND NOT lost) AS flow_sets
FROM p LEFT JOIN told USING (e) GROUP BY e
"""


def queries() -> dict:
    return {"q_netflow_binary": _binary, "q_netflow_accounting": lambda spark, sf_dir: flows.accounting(packets(spark, sf_dir))}


def oracle_sql() -> dict[str, str]:
    return {"q_netflow_binary": _BINARY_SQL, "q_netflow_accounting": _ACCOUNTING_SQL}
