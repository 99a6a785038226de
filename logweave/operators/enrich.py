"""Enrichment joins: longest-prefix networks, disjoint ranges, assets and identities, indicators.

Registries are configuration-sized, yet they are broadcast only below a checked number of rows; beyond it the joins
are equi-joins on prefixes or bins that shuffle.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import ip
from logweave.operators import severity as severities
from logweave.operators.sigma import flat_raw
from logweave.scratch import written

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def networks(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(cidr, label) to (prefix, length, cidr, label)."""
    data = []
    for cidr, label in rows:
        prefix, length = ip.network(cidr)
        data.append((prefix, length, cidr, label))
    return spark.createDataFrame(data, "prefix string, length int, cidr string, label string")


def longest_prefix(rows: DataFrame, address: str, nets: DataFrame, out: str) -> DataFrame:
    """rows with the label of the narrowest network that holds the address: an equi-join per prefix length in use.

    Addresses are matched once each; lengths are at most 33 + 129. Labels are stored and then joined back, broadcast or
    else as a bare shuffle, so that an address, or none, that many rows have can be split.
    """
    lengths = [(r["f"], r["length"]) for r in nets.select(F.substring("prefix", 1, 1).alias("f"), "length").distinct().collect()]
    if not lengths:
        return rows.withColumn(out, F.lit(None).cast(nets.schema["label"].dataType))
    k = ip.key(F.col("address"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(n).alias("length")) for f, n in sorted(lengths)]))
    distinct = rows.select(F.col(address).alias("address")).where("address is not null").distinct().withColumn("k", k).where("k is not null")
    tried = distinct.select("address", "k", each.alias("l")).where(F.substring("k", 1, 1) == F.col("l.f"))
    tried = tried.select("address", F.col("l.length").alias("length"), ip.masked(F.col("k"), F.col("l.length")).alias("prefix"))
    best = tried.join(bounded(nets), ["prefix", "length"]).groupBy("address").agg(F.max_by("label", "length").alias(out))
    return rows.join(bounded(written(best.withColumnRenamed("address", address), "labels")), address, "left")


def flatten_ranges(ranges: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping ranges as disjoint ones: the narrowest wins, ties by order; equal neighbours are merged."""
    import heapq

    starts = sorted((low, high - low, i) for i, (low, high, _) in enumerate(ranges) if low <= high)
    cuts = sorted({x for low, high, _ in ranges if low <= high for x in (low, high + 1)})
    out: list[tuple[int, int, str]] = []
    live: list[tuple[int, int, int]] = []
    at = 0
    for a, b in zip(cuts, cuts[1:]):
        while at < len(starts) and starts[at][0] <= a:
            low, width, i = starts[at]
            heapq.heappush(live, (width, i, low + width))
            at += 1
        while live and live[0][2] < a:
            heapq.heappop(live)
        if not live:
            continue
        label = ranges[live[0][1]][2]
        if out and out[-1][1] == a - 1 and out[-1][2] == label:
            out[-1] = (out[-1][0], b - 1, label)
        else:
            out.append((a, b - 1, label))
    return out


#: Positions of IPv6 addresses among those of both versions: IPv4 comes first.
V6 = 1 << 32


def range_table(spark: SparkSession, segments: list[tuple[int, int, str]]) -> DataFrame:
    """Disjoint segments for range_label(): of IPv4 cut at the borders of /16 bins, of IPv6 into aligned blocks of whole
    hexadecimal digits, at most 960 for any segment."""
    data = []
    for low, high, label in segments:
        if high >= V6:
            low, high = max(low - V6, 0), high - V6
            while low <= high:
                digits = 0  # of the block's addresses
                while digits < 32 and low % 16 ** (digits + 1) == 0 and low + 16 ** (digits + 1) - 1 <= high:
                    digits += 1
                end = low + 16**digits - 1
                data.append((f"6{low:032x}"[: 33 - digits], f"6{low:032x}", f"6{end:032x}", label))
                low = end + 1
            continue
        while low <= high:
            end = min(high, low | 0xFFFF)
            data.append((f"4{low:08x}"[:5], f"4{low:08x}", f"4{end:08x}", label))
            low = end + 1
    return spark.createDataFrame(data, "bin string, low string, high string, label string")


def range_label(rows: DataFrame, address: str, table: DataFrame, out: str) -> DataFrame:
    """rows with the label of the segment that holds the address: an equi-join on the bin, for each length of bins in use,
    at most 33 beside IPv4's, then a comparison."""
    distinct = rows.select(F.col(address).alias("_a")).where("_a is not null").distinct().withColumn("_k", ip.key(F.col("_a")))
    sizes = [(r["f"], r["n"]) for r in table.select(F.substring("bin", 1, 1).alias("f"), F.length("bin").alias("n")).distinct().collect()]
    if not sizes:
        return rows.withColumn(out, F.lit(None).cast(table.schema["label"].dataType))
    each = F.array(*[F.when(F.col("_k").startswith(f), F.substring("_k", 1, n)) for f, n in sorted(sizes)])
    hits = distinct.select("_a", "_k", F.explode_outer(each).alias("bin")).where("bin is not null").join(bounded(table), "bin")
    hits = hits.where((F.col("_k") >= F.col("low")) & (F.col("_k") <= F.col("high"))).select(F.col("_a").alias(address), F.col("label").alias(out))
    return rows.join(bounded(written(hits, "labels")), address, "left")


def csv_ranges(lines: list[str], sep: str = ",") -> list[tuple[int, int, str]]:
    """Ranges of "start,end,label" or "cidr,label" lines as positions: IPv4 addresses as numbers, IPv6 ones behind them,
    from V6 on; a header and lines that name no address, or two versions, are passed over."""
    out = []
    at = lambda a: int(a) + (V6 if a.version == 6 else 0)
    for line in lines:
        parts = [p.strip().strip('"') for p in line.split(sep)]
        try:
            if "/" in parts[0]:
                net = ipaddress.ip_network(parts[0], strict=False)
                first, last, label = net.network_address, net.broadcast_address, parts[1]
            else:
                first, last, label = ipaddress.ip_address(parts[0]), ipaddress.ip_address(parts[1]), parts[2]
        except (ValueError, IndexError):
            continue
        if label and label.lower() not in ("-", "null", "none", "n/a", "zz"):
            if first.version == last.version:
                out.append((at(first), at(last), label))
    return out


# -- assets and identities -----------------------------------------------------------------------------------------


def host_candidates(host: Column) -> list[Column]:
    """The full name, then the short one; an address stays whole."""
    low = F.regexp_replace(F.lower(F.btrim(host)), r"\.$", "")
    short = F.when(ip.key(low).isNull() & low.contains("."), F.split_part(low, F.lit("."), F.lit(1)))
    return [low, short]


def identity_candidates(user: Column) -> list[Column]:
    """An e-mail as a whole, never its local part; DOMAIN\\user qualified, then bare."""
    low = F.lower(F.btrim(user))
    bare = F.when(low.contains("\\"), F.split_part(low, F.lit("\\"), F.lit(-1)))
    return [low, bare]


def _resolve(rows: DataFrame, ranked: list[Column], aliases: DataFrame, id_: str, out: str) -> DataFrame:
    """The target of the first candidate that is an alias. Candidate lists are matched once each; what was found is stored
    and then joined back, broadcast or else as a bare shuffle, so that a list that many rows have can be split."""
    keyed = rows.withColumn("_c", F.array(*ranked))
    lists = keyed.select("_c").distinct().select("_c", F.posexplode("_c").alias("rank", "alias")).where("alias is not null and alias <> ''")
    best = lists.join(bounded(aliases.select("alias", F.col(id_).alias("_id"))), "alias").groupBy("_c").agg(F.min_by("_id", "rank").alias(out))
    return keyed.join(bounded(written(best, "targets")), "_c", "left").drop("_c")


def assets(events: DataFrame, aliases: DataFrame, nets: DataFrame | None = None, out: str = "asset_id") -> DataFrame:
    """The asset by host name, then source, then destination address; exact aliases before networks."""
    candidates = [*host_candidates(F.col("host_name")), F.lower("src_ip"), F.lower("dst_ip")]
    found = _resolve(events, candidates, aliases, "asset_id", out)
    if nets is None:
        return found
    for column in ("src_ip", "dst_ip"):
        found = longest_prefix(found, column, nets, "_net").withColumn(out, F.coalesce(out, "_net")).drop("_net")
    return found


def identities(events: DataFrame, aliases: DataFrame, out: str = "identity_id") -> DataFrame:
    return _resolve(events, identity_candidates(F.col("user_name")), aliases, "identity_id", out)


def context_tags(columns: dict[str, Column]) -> Column:
    """Sorted, lower-cased set of role-prefixed labels; null where there is none."""


    def labelled(role: str, labels: Column) -> Column:
        return F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{role}:"), F.lower(v)))

    each = [labelled(role, c) for role, c in columns.items()]
    found = F.array_sort(F.array_distinct(F.concat(*each)))
    return F.when(F.size(found) > 0, found)


# -- indicators ----------------------------------------------------------------------------------------------------

#: How addresses, digests, links and domains are found in texts. They begin and end where words do, so that
#: a domain is found behind the "@" of a mail address; addresses of IPv6 are looked for in address columns only.
_BEGIN, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_KINDS = {
    "ip": _BEGIN + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _END,
    "hash": "(?i)" + _BEGIN + "(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})" + _END,
    "url": r"(?i)https?://[^\s\"'<>\\]+",
    "domain": "(?i)" + _BEGIN + r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}" + _END,
}
_DOMAIN = r"(?:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?\.)+[a-z]{2,}"


def classify(indicator: str) -> str | None:
    """ip, cidr, domain, hash or url by an indicator's shape."""
    import re

    s = indicator.strip()
    if s.lower().startswith(("http://", "https://")):
        return "url"
    for kind, parse in (("cidr", ipaddress.ip_network), ("ip", ipaddress.ip_address)):
        if (kind == "cidr") == ("/" in s):
            try:
                parse(s, strict=False) if kind == "cidr" else parse(s)
                return kind
            except ValueError:
                if kind == "cidr":
                    return None
    if re.fullmatch(r"(?i)[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", s):
        return "hash"
    return "domain" if len(s) <= 253 and re.fullmatch(_DOMAIN, s, re.I) else None


def feed(lines: DataFrame, source: str, column: str = "value") -> DataFrame:
    """Indicators of a line feed: comments and blanks go, the first of equal ones stays; types by shape."""
    text = F.btrim(F.split_part(F.col(column), F.lit("#"), F.lit(1)))
    low = F.lower(text)
    kind = (
        F.when(low.rlike(r"^https?://"), "url")
        .when(low.contains("/") & ip.key(F.split_part(low, F.lit("/"), F.lit(1))).isNotNull(), "cidr")
        .when(ip.key(low).isNotNull(), "ip")
        .when(low.rlike(r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), "hash")
        .when(low.rlike(f"^{_DOMAIN}$") & (F.length(low) <= 253), "domain")
    )
    rows = lines.select(low.alias("indicator"), kind.alias("ioc_type"), F.lit(source).alias("source"), F.lit("high").alias("severity"))
    return rows.where("ioc_type is not null").dropDuplicates(["indicator", "ioc_type"])


def replace_feed(store: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """The store with one source's indicators replaced."""
    return store.where(~F.col("source").eqNullSafe(source)).unionByName(new)


def observables(rows: DataFrame, id_: str, text: Column) -> DataFrame:
    """Distinct (id, ioc_type, value) of what a text mentions."""
    found = _found(text)
    # explode_outer: for explode() the optimizer would compute all patterns a second time, for a filter on the size
    return rows.select(F.col(id_), F.explode_outer(found).alias("o")).where("o is not null").select(id_, "o.ioc_type", "o.value")


def _found(text: Column) -> Column:
    """All mentions; the text is computed once for all patterns."""
    return ip.bind(text, lambda t: F.concat(*[_mentions(t, kind, pattern) for kind, pattern in _KINDS.items()]))


def _mentions(text: Column, kind: str, pattern: str) -> Column:
    ends = ".,);" if kind == "url" else ""
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.rtrim(F.lower(v), F.lit(ends)) if ends else F.lower(v))
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value")))


def ioc_matches(rows: DataFrame, id_: str, text: Column, iocs: DataFrame) -> DataFrame:
    """One row per row and indicator that its text mentions: exact values, and networks for addresses."""
    seen = written(observables(rows, id_, text), "observables")
    exact = iocs.where("ioc_type <> 'cidr'").select("ioc_type", F.col("indicator").alias("value"), "severity")
    hits = seen.join(bounded(exact), ["ioc_type", "value"]).select(id_, F.col("value").alias("indicator"), "ioc_type", "severity")
    label = F.struct("indicator", "severity").alias("label")
    nets = iocs.where("ioc_type = 'cidr'").select(ip.networked(F.col("indicator")).alias("n"), label)
    nets = nets.where("n is not null").select("n.prefix", "n.length", "label")
    inside = longest_prefix(seen.where("ioc_type = 'ip'"), "value", nets, "_n").where("_n is not null")
    return hits.unionByName(inside.select(id_, "_n.indicator", F.lit("cidr").alias("ioc_type"), "_n.severity").distinct())


#: Columns of an event that indicators are looked for in, and the rule that an alert names.
OBSERVED = ("src_ip", "dst_ip", "host_name", "app", "user_name", "rule_name", "message")
TI_RULE = ("ti-ioc-match", "Threat Intelligence Match")


def event_observables(events: DataFrame, id_: str = "id") -> DataFrame:
    """Distinct (id, ioc_type, value) of what an event's columns and the values of its raw record mention; its own
    addresses count whatever their version."""
    return _observed(events, id_).distinct()


def _observed(events: DataFrame, id_: str) -> DataFrame:
    """event_observables(), distinct within each row of events: no shuffle of them all."""
    leaves = F.array_join(F.transform(flat_raw(F.col("raw")), lambda e: e["v"]), " ") if "raw" in events.columns else F.lit("")
    text = F.concat_ws(" ", *[F.col(c) for c in OBSERVED if c in events.columns], leaves)
    found = _found(text)
    own = F.array(*[F.struct(F.lit("ip").alias("ioc_type"), F.lower(c).alias("value")) for c in ("src_ip", "dst_ip") if c in events.columns])
    rows = events.select(F.col(id_), F.explode_outer(F.array_distinct(F.concat(found, own))).alias("o")).where("o.value is not null")
    return rows.select(id_, "o.ioc_type", "o.value")


def ti_matches(events: DataFrame, iocs: DataFrame, id_: str = "id") -> DataFrame:
    """Rows (id, indicator, ioc_type, source, severity, observed), one for each event and indicator that it touches: an
    address that is an indicator itself is not looked for in networks, others match the narrowest network."""
    seen = _observed(events, id_)  # equal rows of several events with one id end in the last grouping
    address = F.col("ioc_type") == "ip"
    seen = written(seen.select(id_, "ioc_type", "value", F.when(address, ip.key(F.col("value"))).otherwise(F.col("value")).alias("k")), "observables")
    label = F.struct("indicator", "source", "severity").alias("label")
    exact = iocs.where("ioc_type <> 'cidr'").withColumn("indicator", F.lower("indicator"))
    exact = exact.select("ioc_type", F.when(address, ip.key(F.col("indicator"))).otherwise(F.col("indicator")).alias("k"), label)
    exact = written(exact.where("k is not null").dropDuplicates(["ioc_type", "k"]), "indicators")
    hits = seen.join(bounded(exact), ["ioc_type", "k"]).select(id_, "label", "ioc_type", "value")
    nets = iocs.where("ioc_type = 'cidr'").select(ip.networked(F.col("indicator")).alias("n"), label)
    nets = nets.where("n is not null").select("n.prefix", "n.length", "label")
    others = seen.where(address).join(bounded(exact.where(address).select("k")), "k", "left_anti")
    inside = longest_prefix(others.select(id_, "value"), "value", nets, "label").where("label is not null")
    every = hits.unionByName(inside.select(id_, "label", F.lit("cidr").alias("ioc_type"), "value"))
    every = every.groupBy(id_, "label.indicator", "ioc_type").agg(F.min(F.struct("label.source", "label.severity", "value")).alias("x"))
    return every.select(id_, "indicator", "ioc_type", "x.source", "x.severity", F.col("x.value").alias("observed"))


#: Indicators that a message names, and the length of a feed's name and of a message.
SHOWN, FEED_CHARS, MESSAGE_CHARS = 5, 40, 1000


def _feed_name(source: Column) -> Column:
    """The host of a feed's address, or the beginning of its name."""
    host = F.substring(F.split_part(F.regexp_replace(source, "^https?://", ""), F.lit("/"), F.lit(1)), 1, FEED_CHARS)
    return F.when(host != "", host).otherwise(F.substring(source, 1, FEED_CHARS))


def ti_alerts(matches: DataFrame, events: DataFrame | None = None, id_: str = "id") -> DataFrame:
    """One alert for each event that touches an indicator: its id, the rule, the highest severity, the sorted indicators,
    the message and the identity by rule and event; with events, also their time, vendor, addresses, user and host."""
    kind = F.array_position(F.array(*[F.lit(k) for k in ("ip", "cidr", "hash", "url", "domain")]), F.col("ioc_type"))
    hits = F.array_sort(F.collect_set(F.struct(kind.alias("k"), "indicator", "ioc_type", _feed_name(F.col("source")).alias("feed"))))
    out = matches.groupBy(id_).agg(severities.highest(F.col("severity")).alias("level"), hits.alias("_hits"))
    named = F.transform(F.slice("_hits", 1, SHOWN), lambda h: F.concat(h["indicator"], F.lit(" ("), h["ioc_type"], F.lit(")")))
    more = F.when(F.size("_hits") > SHOWN, F.concat(F.lit(" [+"), (F.size("_hits") - SHOWN).cast("string"), F.lit(" more]"))).otherwise("")
    feeds = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["feed"]))), ", ")
    message = F.concat(F.lit("Threat-intel match: "), F.array_join(named, ", "), more, F.lit(" — source: "), feeds)
    none = F.array().cast("array<string>")
    out = out.select(
        id_,
        F.lit(TI_RULE[0]).alias("rule_id"),
        F.lit(TI_RULE[1]).alias("rule_title"),
        "level",
        none.alias("tactics"),
        none.alias("techniques"),
        F.substring(message, 1, MESSAGE_CHARS).alias("message"),
        F.sha2(F.concat_ws("|", F.lit(TI_RULE[0]), F.col(id_).cast("string")), 256).alias("dedup_hash"),
        F.lit("open").alias("status"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["indicator"]))).alias("indicators"),
    )
    if events is None:
        return out
    own = [c for c in ("event_time", "vendor", "src_ip", "dst_ip", "user_name", "host_name") if c in events.columns]
    return out.join(events.select(id_, *own), id_)
