"""The normalised event: schema, typed cleaners and the building of events from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions import ip
from logweave.functions.text import token_array

EVENT_SCHEMA = T.StructType(
    [T.StructField("event_time", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in "vendor product log_type severity action src_ip dst_ip".split()]
    + [T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in "protocol app user_name host_name rule_name".split()]
    + [T.StructField("bytes_total", T.LongType()), T.StructField("message", T.StringType()), T.StructField("raw", T.StringType())]
)
TIME_FORMATS = (
    "yyyy/MM/dd HH:mm:ss",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "MMM d yyyy HH:mm:ss[.SSS]",
    "MMM dd yyyy HH:mm:ss[.SSS]",
    "M/d/yyyy h:mm:ss a",
    "MM/dd/yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss Z",
    "yyyy-MM-dd HH:mm:ss,SSS",
    "yyyy-MM-dd HH:mm:ss:SSS",
)


def when_set(value: Column) -> Column:
    """Null for empty text. The value is computed once: it is often a search, and nullif() would repeat it."""
    return ip.bind(F.btrim(value.cast("string")), lambda t: F.when(t != "", t))


def first_set(*values: Column) -> Column:
    return F.coalesce(*[when_set(v) for v in values])


def to_long(value: Column) -> Column:
    """A whole number within 64 bits, or null."""
    return F.floor(value.try_cast("decimal(38,3)")).try_cast("long")


def to_port(value: Column) -> Column:
    return ip.bind(to_long(value), lambda n: F.when(n.between(0, 65535), n.cast("int")))


def timestamp(value: Column, year: int | None = None) -> Column:
    """Epoch seconds, milliseconds or microseconds, ISO 8601, or a vendor's spelling, as UTC; else null.

    A date without a year takes the given one, or the current one.
    """
    text = F.regexp_replace(F.btrim(value.cast("string"), F.lit(' "*:')), r"\s+", " ")
    text = F.regexp_replace(text, r" (UTC|GMT|Z)$|^[A-Z][a-z]{2}, ", "")
    y = F.lit(str(year)) if year else F.date_format(F.current_date(), "yyyy")

    def dated(t: Column) -> Column:
        """"Jan 2 03:04:05" with a year."""
        parts = F.split(t, " ")
        spelled = F.concat_ws(" ", F.get(parts, 0), F.get(parts, 1), y, F.get(parts, 2))
        return F.when(t.rlike(r"^[A-Z][a-z]{2} \d{1,2} \d{2}:\d{2}:\d{2}"), spelled).otherwise(t)

    def epoch(n: Column) -> Column:
        micros = F.when(n > 1e14, n).when(n > 1e11, n * 1e3).otherwise(n * 1e6)
        return F.timestamp_micros(micros.cast("long"))

    def read(t: Column) -> Column:
        vendor = lambda d: F.coalesce(*[F.try_to_timestamp(d, F.lit(f)) for f in TIME_FORMATS])
        number = t.rlike(r"^\d{9,}(\.\d+)?$|^\d\.\d+E\d+$")
        return F.when(number, ip.bind(t.try_cast("double"), epoch)).when(
            ~t.rlike(r"^\d+$"), F.coalesce(t.try_cast("timestamp"), ip.bind(dated(t), vendor))
        )

    return ip.bind(text, read)


def host_port(value: Column) -> tuple[Column, Column]:
    """Address and port of "a.b.c.d:p", "[v6]:p" or a bare address."""
    text = F.btrim(value)
    bracket = F.regexp_extract(text, r"^\[([0-9A-Fa-f:.]+)\](?::(\d+))?$", 1)
    four = F.regexp_extract(text, r"^(\d+\.\d+\.\d+\.\d+)(?::(\d+))?$", 1)
    port = F.coalesce(when_set(F.regexp_extract(text, r"^\[[0-9A-Fa-f:.]+\]:(\d+)$", 1)), when_set(F.regexp_extract(text, r"^\d+\.\d+\.\d+\.\d+:(\d+)$", 1)))
    return ip.clean(F.coalesce(when_set(bracket), when_set(four), text)), to_port(port)


#: IANA numbers of transport protocols and syslog severities.
PROTOCOLS = {"1": "icmp", "6": "tcp", "17": "udp", "47": "gre", "50": "esp", "58": "ipv6-icmp", "89": "ospf", "132": "sctp"}
SYSLOG_SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")


def lookup(table: dict, key: Column, otherwise: Column | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def syslog_severity(level: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SYSLOG_SEVERITIES]), level.try_cast("int"))


def events(rows: DataFrame, vendor, product=None, **columns: Column) -> DataFrame:
    """Events with the given columns, cleaned to their types; the others are null. raw defaults to rows' column raw."""
    given = {"vendor": vendor, "product": product, "raw": F.col("raw") if "raw" in rows.columns else None} | columns
    out = []
    for f in EVENT_SCHEMA.fields:
        value = given.get(f.name)
        c = F.lit(value) if value is None or isinstance(value, str) else value
        if f.name in ("src_ip", "dst_ip") and value is not None:
            c = ip.clean(c.cast("string"))
        elif f.name in ("src_port", "dst_port") and value is not None:
            c = to_port(c)
        elif f.name == "bytes_total" and value is not None:
            c = to_long(c)
        elif isinstance(f.dataType, T.StringType) and f.name != "raw" and value is not None:
            c = when_set(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def search_tokens(df: DataFrame) -> DataFrame:
    text = [c for c in "vendor product log_type severity action src_ip dst_ip protocol app user_name host_name rule_name message raw".split() if c in df.columns]
    return df.withColumn("search_tokens", token_array(F.concat_ws(" ", *text)))
