"""IP addresses as native expressions, for both families.

Functions take a column name or SQL expression. Addresses become fixed-width
text keys (IPv6: 32 hex digits; bits: family digit plus 32 or 128 bits), so
that range checks and prefix joins are plain comparisons and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = f"(?:{OCTET}[.]){{3}}{OCTET}"
IPV4 = f"^{DOTTED}$"


def _ipv6_pattern() -> str:
    """Eight groups of 1 to 4 hex digits, or fewer around one '::'.

    A dotted IPv4 tail stands for the last two groups, a zone may follow after '%'.
    """
    group = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{DOTTED}"]
    for left in range(8):
        room = 7 - left
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        tails = ([f"(?:{group}:){{0,{room - 1}}}{group}"] if room else []) + (
            [f"(?:{group}:){{0,{room - 2}}}{DOTTED}"] if room > 1 else []
        )
        forms.append(f"{head}::" + (f"(?:{'|'.join(tails)})?" if tails else ""))
    return f"^(?:{'|'.join(forms)})(?:%[^%]+)?$"


IPV6 = _ipv6_pattern()

# Address ranges that are not globally reachable, and the parts
# of them that are.
PRIVATE_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_IPV4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_IPV6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
)
PUBLIC_IPV6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)
# End of fixed values.


def is_ipv4_sql(text: str) -> str:
    return f"coalesce({text} RLIKE '{IPV4}', false)"


def ipv4_long_sql(text: str) -> str:
    parts = [f"try_cast(split_part({text}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
    return "(" + " + ".join(parts) + ")"


def is_ipv6_sql(text: str) -> str:
    return f"coalesce({text} RLIKE '{IPV6}', false)"


def ipv6_hex_sql(text: str) -> str:
    """32 hex digits of an IPv6 text, null when it is not one."""
    bare = f"split_part({text}, '%', 1)"
    tail = ipv4_long_sql(f"substring_index({bare}, ':', -1)")
    digits = f"lpad(hex({tail}), 8, '0')"
    folded = (
        f"concat(left({bare}, length({bare}) - length(substring_index({bare}, ':', -1))), left({digits}, 4), ':', right({digits}, 4))"
    )
    groups = f"CASE WHEN contains({bare}, '.') THEN {folded} ELSE {bare} END"
    # '::' becomes as many zero groups as are missing; then every group is padded.
    missing = "8 - size(filter(split(b, ':'), g -> g != ''))"
    filled = f"filter(split(replace(b, '::', concat(':', repeat('0:', {missing}))), ':'), g -> g != '')"
    full = f"lower(array_join(transform({filled}, g -> lpad(g, 4, '0')), ''))"
    # The one-element array gives the groups a name inside the lambda.
    return f"CASE WHEN {is_ipv6_sql(text)} THEN transform(array({groups}), b -> {full})[0] END"


def validate_ip_sql(text: str) -> str:
    return f"({is_ipv4_sql(text)} OR {is_ipv6_sql(text)})"


def ip_bits_sql(text: str) -> str:
    """'4' + 32 bits or '6' + 128 bits; null for anything else.

    The first 1 + n characters are the key of the enclosing /n network.
    """
    v4 = f"concat('4', lpad(bin({ipv4_long_sql(text)}), 32, '0'))"
    nibbles = "transform(sequence(0, 3), i -> lpad(conv(substr(h, i * 8 + 1, 8), 16, 2), 32, '0'))"
    v6 = f"transform(array({ipv6_hex_sql(text)}), h -> IF(h IS NULL, NULL, concat('6', array_join({nibbles}, ''))))[0]"
    return f"CASE WHEN {is_ipv4_sql(text)} THEN {v4} WHEN {text} LIKE '%:%' THEN {v6} END"


def _ipv4_range(cidr: str) -> tuple[int, int]:
    address, length = cidr.split("/")
    start = 0
    for part in address.split("."):
        start = start * 256 + int(part)
    return start, start + 2 ** (32 - int(length)) - 1


def _ipv6_range(cidr: str) -> tuple[str, str]:
    address, length = cidr.split("/")
    left, _, right = address.partition("::")
    head = [g for g in left.split(":") if g]
    tail = [g for g in right.split(":") if g]
    groups = head + ["0"] * (8 - len(head) - len(tail)) + tail
    start = int("".join(g.zfill(4) for g in groups), 16)
    return f"{start:032x}", f"{start + 2 ** (128 - int(length)) - 1:032x}"


def _v4_in_sql(number: str, cidrs: tuple[str, ...]) -> str:
    return "(" + " OR ".join("{} BETWEEN {} AND {}".format(number, *_ipv4_range(c)) for c in cidrs) + ")"


def _v6_in_sql(digits: str, cidrs: tuple[str, ...]) -> str:
    return "(" + " OR ".join("{} BETWEEN '{}' AND '{}'".format(digits, *_ipv6_range(c)) for c in cidrs) + ")"


def ip_is_private_sql(text: str) -> str:
    number = ipv4_long_sql(text)
    v4 = f"transform(array({number}), n -> {_v4_in_sql('n', PRIVATE_IPV4)} AND NOT {_v4_in_sql('n', PUBLIC_IPV4)})[0]"
    # An IPv4 address inside IPv6 (::ffff:0:0/96) counts as that IPv4 address.
    mapped = "conv(right(h, 8), 16, 10)"
    mapped_private = (
        f"transform(array(try_cast({mapped} AS BIGINT)), n -> "
        f"{_v4_in_sql('n', PRIVATE_IPV4)} AND NOT {_v4_in_sql('n', PUBLIC_IPV4)})[0]"
    )
    own = f"{_v6_in_sql('h', PRIVATE_IPV6)} AND NOT {_v6_in_sql('h', PUBLIC_IPV6)}"
    v6 = f"CASE WHEN h LIKE '00000000000000000000ffff%' THEN {mapped_private} ELSE {own} END"
    return (
        f"CASE WHEN {is_ipv4_sql(text)} THEN {v4} "
        f"WHEN {text} LIKE '%:%' THEN coalesce(transform(array({ipv6_hex_sql(text)}), h -> {v6})[0], false) "
        f"ELSE false END"
    )


def validate_ip_address(text: str) -> Column:
    return F.expr(validate_ip_sql(text))


def ip_is_private(text: str) -> Column:
    return F.expr(ip_is_private_sql(text))


def ip_bits(text: str) -> Column:
    return F.expr(ip_bits_sql(text))


def ip_port_sql(text: str) -> str:
    return f"coalesce(substring_index({text}, ':', 1), 'ip_port2ip_error')"


def ip_port2ip(text: str, compat: bool = False) -> Column:
    """Text before the first ':'. `compat` drops the last character when there is none."""
    if not compat:
        return F.expr(ip_port_sql(text))
    whole = f"CASE WHEN {text} NOT LIKE '%:%' THEN left({text}, greatest(length({text}) - 1, 0)) ELSE {ip_port_sql(text)} END"
    return F.expr(f"CASE WHEN {text} IS NULL THEN 'ip_port2ip_error' ELSE {whole} END")
