"""Addresses without an inet type: a canonical, sortable key as text, and prefixes of it.

A key is "4" or "6" and the address in hexadecimal (8 or 32 digits), so that ranges compare as text and a network is a
prefix of bits. Everything is a column expression. IPv4 parts with leading zeros are refused; IPv4 in IPv6
(::ffff:a.b.c.d) is the IPv4 address.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
_V4_PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4_WHOLE = rf"{_V4_PART}(?:\.{_V4_PART}){{3}}"
_GROUP = "[0-9a-f]{1,4}"
#: IPv4, eight groups (the last two may be dotted), or fewer around one "::"; a zone may follow.
_ADDRESS = (
    rf"^(?:{_V4_WHOLE}|(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{6}}{_V4_WHOLE}|::(?:{_GROUP}:){{6}}{_GROUP}"
    rf"|(?=.*::)(?!.*::.*::)(?!.*:::)(?!:[^:])(?:(?:{_GROUP})?:){{1,7}}(?:{_GROUP}|:|{_V4_WHOLE})?(?<!(?<!:):))(?:%\S+)?)$"
)
_MAPPED = "00000000000000000000ffff"

#: Special-purpose ranges of the IANA registries and their scopes.
V4_SCOPES = [
    ("0.0.0.0/8", "reserved"),
    ("10.0.0.0/8", "private"),
    ("100.64.0.0/10", "cgnat"),
    ("127.0.0.0/8", "loopback"),
    ("169.254.0.0/16", "link-local"),
    ("172.16.0.0/12", "private"),
    ("192.0.0.0/24", "reserved"),
    ("192.0.2.0/24", "documentation"),
    ("192.88.99.0/24", "reserved"),
    ("192.168.0.0/16", "private"),
    ("198.18.0.0/15", "reserved"),
    ("198.51.100.0/24", "documentation"),
    ("203.0.113.0/24", "documentation"),
    ("224.0.0.0/4", "multicast"),
    ("240.0.0.0/4", "reserved"),
]
V6_SCOPES = [
    ("::/128", "reserved"),
    ("::1/128", "loopback"),
    ("64:ff9b::/96", "reserved"),
    ("64:ff9b:1::/48", "reserved"),
    ("100::/64", "reserved"),
    ("2001::/23", "reserved"),
    ("2001:db8::/32", "documentation"),
    ("2002::/16", "reserved"),
    ("3fff::/20", "documentation"),
    ("fc00::/7", "private"),
    ("fe80::/10", "link-local"),
    ("fec0::/10", "private"),
    ("ff00::/8", "multicast"),
]


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: expressions are trees, and a large one that is used often explodes."""
    return F.get(F.transform(F.array(value), use), 0)


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def _v4_hex(text: Column) -> Column:
    return bind(F.split(text, r"\."), lambda p: F.concat(*[_hex(F.get(p, i).try_cast("int"), 2) for i in range(4)]))


def _groups(text: Column) -> Column:
    """The colon-separated groups of a part of an IPv6 address, four digits each; a dotted tail is two groups."""
    parts = F.array_remove(F.split(text, ":"), "")
    four = lambda g: bind(_v4_hex(g), lambda h: F.array(F.substring(h, 1, 4), F.substring(h, 5, 4)))
    return F.flatten(F.transform(parts, lambda g: F.when(g.rlike(_V4), four(g)).otherwise(F.array(F.lpad(g, 4, "0")))))


def _v6_hex(text: Column) -> Column:
    clean = text.rlike(r"^[0-9a-f:.]+$") & ~text.rlike(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$")
    none = F.array().cast("array<string>")

    def joined(sides: Column, head: Column, tail: Column) -> Column:
        missing = 8 - F.size(head) - F.size(tail)
        fill = F.when(missing > 0, F.array_repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))).otherwise(none)
        good = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
        return F.when(good, F.array_join(F.concat(head, fill, tail), ""))

    whole = bind(
        F.split(text, "::", -1),
        lambda s: bind(
            _groups(F.get(s, 0)), lambda h: bind(_groups(F.coalesce(F.get(s, 1), F.lit(""))), lambda t: joined(s, h, t))
        ),
    )
    return F.when(clean, bind(whole, lambda w: F.when(F.length(w) == 32, w)))


def key(address: Column) -> Column:
    """The sortable key; null if the text is no address. A zone (%eth0) is dropped."""

    def six(text: Column) -> Column:
        mapped = lambda h: F.when(h.startswith(_MAPPED), F.concat(F.lit("4"), F.substring(h, 25, 8))).otherwise(F.concat(F.lit("6"), h))
        return bind(_v6_hex(text), mapped)

    return bind(
        F.lower(F.btrim(F.split_part(address, F.lit("%"), F.lit(1)))),
        lambda t: F.when(t.rlike(_V4), F.concat(F.lit("4"), _v4_hex(t))).when(t.contains(":"), six(t)),
    )


def key_of(address: str) -> str:
    """The same key for a constant; raises ValueError for text that is no address."""
    ip = ipaddress.ip_address(address.strip())
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return f"{ip.version}{int(ip):0{8 if ip.version == 4 else 32}x}"


def bounds(cidr: str) -> tuple[str, str]:
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    return key_of(str(net.network_address)), key_of(str(net.broadcast_address))


def inside(address_key: Column, cidr: str) -> Column:
    return within(address_key, [cidr])


def within(address_key: Column, cidrs: list[str]) -> Column:
    """Whether any of the networks holds the address; no address is in none."""
    limits = [bounds(c) for c in cidrs]
    test = lambda k: reduce(lambda a, b: a | b, [k.between(low, high) & (F.length(k) == len(low)) for low, high in limits])
    return F.coalesce(bind(address_key, test), F.lit(False))


def masked(address_key: Column, length: Column) -> Column:
    """The first length bits: whole digits, and a digit with its lower bits cleared where they do not fill one."""
    rest = F.pmod(length, F.lit(4))
    whole = F.floor(length / 4).cast("int")
    digit = F.conv(F.substring(address_key, whole + 2, F.lit(1)), 16, 10).cast("int")
    clear = F.floor(digit / F.pow(F.lit(2), 4 - rest)) * F.pow(F.lit(2), 4 - rest)
    partial = F.when(rest > 0, F.lower(F.hex(clear.cast("int")))).otherwise(F.lit(""))
    return F.concat(F.substring(address_key, F.lit(1), whole + 1), partial)


def text_of(digits: Column) -> Column:
    """The usual text of an address of 8 or 32 hexadecimal digits: the first of the longest runs of zero groups of IPv6 is
    left out, and IPv4 in IPv6 is dotted. Null for other texts."""
    dotted = lambda h: F.concat_ws(".", *[F.conv(F.substring(h, i, 2), 16, 10) for i in (1, 3, 5, 7)])

    def shortened(t: Column) -> Column:
        out = F.when(F.lit(False), t)
        for n in range(8, 1, -1):
            run = rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
            sides = F.concat(F.regexp_replace(F.regexp_extract(t, run, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(t, run, 2), "^:", ""))
            out = out.when(t.rlike(run), sides)
        return out.otherwise(t)

    def six(h: Column) -> Column:
        groups = F.concat_ws(":", *[F.regexp_replace(F.substring(h, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)])
        return F.when(h.startswith(_MAPPED), F.concat(F.lit("::ffff:"), dotted(F.substring(h, 25, 8)))).otherwise(bind(groups, shortened))

    return bind(F.lower(digits), lambda h: F.when(F.length(h) == 8, dotted(h)).when(F.length(h) == 32, six(h)))


def network(cidr: str) -> tuple[str, int]:
    """(masked key, prefix length) of a network, as masked() gives for the addresses inside."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    text = key_of(str(net.network_address))
    return text[: 1 + -(-net.prefixlen // 4)], net.prefixlen


def networked(cidr: Column) -> Column:
    """network() of a column, as a struct (prefix, length); null if the text is no network. A network of IPv4 in IPv6 is
    the IPv4 network. Lengths may be written as IPv4 net or host masks, a missing one is the whole address."""

    def length(t: Column, bits: Column) -> Column:
        size = F.split_part(t, F.lit("/"), F.lit(2))
        mask = F.lpad(F.conv(F.substring(F.when(size.rlike(_V4), F.concat(F.lit("4"), _v4_hex(size))), 2, 8), 16, 2), 32, "0")
        ones = lambda m: F.when(m.rlike("^1*0*$"), F.length(F.regexp_extract(m, "^1*", 0)))
        zeros = lambda m: F.when(m.rlike("^0*1+$"), F.length(F.regexp_extract(m, "^0*", 0)))
        masks = F.when(bits == 32, bind(mask, lambda m: F.coalesce(ones(m), zeros(m))))
        n = F.when(~t.contains("/"), bits).when(size.rlike("^[0-9]+$"), size.try_cast("int")).otherwise(masks)
        return bind(n, lambda n: F.when((n <= bits) & ~t.rlike(r"/.*/|^[^:]*%"), n))

    def net(t: Column, k: Column, n: Column) -> Column:
        mapped = t.contains(":") & k.startswith("4")
        of = lambda key_, n_: F.struct(masked(key_, n_).alias("prefix"), n_.cast("int").alias("length"))
        wide = F.concat(F.lit("6" + _MAPPED), F.substring(k, 2, 8))
        return F.when(k.isNotNull() & n.isNotNull(), F.when(~mapped, of(k, n)).when(n >= 96, of(k, n - 96)).otherwise(of(wide, n)))

    def read(t: Column) -> Column:
        bits = F.when(t.contains(":"), 128).otherwise(32)
        return bind(key(F.split_part(t, F.lit("/"), F.lit(1))), lambda k: bind(length(t, bits), lambda n: net(t, k, n)))

    return bind(F.lower(F.btrim(cidr)), read)


def scope(address: Column) -> Column:
    """private, loopback, link-local, cgnat, multicast, documentation, reserved or public; null if no address."""


    def named(k: Column) -> Column:
        out = F.when(k.isNull(), F.lit(None).cast("string"))
        for cidr, label in [*V4_SCOPES, *V6_SCOPES]:
            low, high = bounds(cidr)
            out = out.when(k.between(low, high) & (F.length(k) == len(low)), label)
        return out.otherwise("public")

    return bind(key(address), named)


def clean(address: Column) -> Column:
    """Lower-cased text of an address or null; unspecified addresses are null. A pattern is enough here: no key is made."""
    return bind(F.lower(F.btrim(address)), lambda t: F.when(t.rlike(_ADDRESS) & ~t.rlike(r"^(?:0\.0\.0\.0|[0:]+)$"), t))
