"""Network lookups: deepest enclosing prefix, allow-lists, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.columns import attach, col, cols, quote
from tracewell.functions.network import ip_bits
from tracewell.session import cut_lineage


def prefix_keys(prefixes: DataFrame, prefix: str) -> DataFrame:
    """Add __key (the first 1 + length bits) and __length of every valid network.

    Host bits must be 0. The bits are bound by a lambda and come out of a
    generator, so that no filter copies the parsing expression.
    """
    bits = ip_bits(f"split_part({quote(prefix)}, '/', 1)")
    written = F.expr(f"try_cast(nullif(split_part({quote(prefix)}, '/', 2), '') AS INT)")

    def network(b: Column) -> Column:
        width = F.length(b) - 1
        length = F.coalesce(written, width)
        valid = length.between(0, width) & ~F.contains(b.substr(length + 2, F.lit(128)), F.lit("1"))
        return F.when(valid, F.struct(b.substr(F.lit(1), length + 1).alias("__key"), length.alias("__length")))

    networks = F.filter(F.transform(F.array(bits), network), lambda n: n.isNotNull())
    # Kept, because the lengths are looked at before the join.
    return cut_lineage(prefixes.select("*", F.inline(networks)))


def enclosing_networks(df: DataFrame, address: str, keyed: DataFrame) -> DataFrame:
    """(address, prefix columns) for every network that holds each distinct address.

    Addresses are made distinct first. Each gets one key per prefix length that
    occurs (at most 33 + 129, the only thing collected here), so the range test
    is an equi-join of any size on both sides.
    """
    found = keyed.select(F.left("__key", F.lit(1)).alias("family"), "__length").distinct().collect()
    lengths = {f: sorted(r["__length"] for r in found if r["family"] == f) for f in ("4", "6")}
    distinct = df.select(col(address)).where(col(address).isNotNull()).distinct()

    def keys(b: Column) -> Column:
        of_family = [F.array(*[F.lit(n) for n in lengths[f]]).cast("array<int>") for f in ("4", "6")]
        tried = F.when(F.startswith(b, F.lit("4")), of_family[0]).otherwise(of_family[1])
        return F.when(b.isNotNull(), F.transform(tried, lambda n: b.substr(F.lit(1), n + 1)))

    bits = ip_bits(quote(address))
    asked = distinct.select(col(address), F.explode(F.get(F.transform(F.array(bits), keys), F.lit(0))).alias("__key"))
    return asked.join(keyed, "__key")


def longest_prefix(
    df: DataFrame,
    address: str,
    prefixes: DataFrame,
    prefix: str = "prefix",
    depth: str | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Each row with the columns of its deepest network; rows without one are left out."""
    keyed = prefix_keys(prefixes, prefix)
    deepest = F.struct(col(depth) if depth else F.col("__length"), -col(tie) if tie else F.lit(0))
    best = (
        enclosing_networks(df, address, keyed)
        .groupBy(col(address))
        .agg(F.max_by(F.struct(*cols(prefixes.columns)), deepest).alias("row"))
        .select(col(address), *[F.col("row").getField(n).alias(n) for n in prefixes.columns])
    )
    return attach(df, best, [address], "inner")


def in_networks(df: DataFrame, address: str, networks: DataFrame, network: str, allow: str) -> DataFrame:
    """Rows whose address is in any allowed network; bad addresses are not."""
    keyed = prefix_keys(networks.where(col(allow).cast("int") != 0), network)
    inside = enclosing_networks(df, address, keyed).select(col(address)).distinct()
    return df.join(inside, address, "left_semi")


def resolve_names(df: DataFrame, name: str, resolutions: DataFrame) -> DataFrame:
    """{domain, address} rows for every name asked for; unknown names give none."""
    asked = df.select(col(name).alias("domain"))
    return asked.join(resolutions.select("domain", "address"), "domain")


def subnet_paths(df: DataFrame, address: str, prefixes: DataFrame, prefix: str, description: str) -> DataFrame:
    """(address, path): enclosing networks from widest to narrowest, as lower-case text.

    At most one network per length, so a path has at most 129 parts.
    """
    label = F.concat(
        col(prefix), F.lit(" ("), F.coalesce(F.when(col(description) != "", col(description)), F.lit("No info")), F.lit(")")
    )
    held = enclosing_networks(df, address, prefix_keys(prefixes, prefix))
    parts = F.sort_array(F.collect_set(F.struct("__length", label.alias("label"))))
    return (
        held.groupBy(col(address))
        .agg(parts.alias("parts"))
        .select(col(address), F.lower(F.array_join("parts.label", " -> ")).alias("description_of_subnet"))
    )


# Custom fields shown for a device or a virtual machine.
CUSTOM_FIELDS = (
    "owner", "Service owner", "team", "product", "project", "cluster", "ssh_custom_key", "ssh_keys_groups",
    "project_name", "env",
)
# End of fixed values.


def enrich_assets(
    targets: DataFrame,
    target: str,
    addresses: DataFrame,
    devices: DataFrame,
    contacts: DataFrame | None = None,
    prefixes: DataFrame | None = None,
    custom_fields: Sequence[str] = CUSTOM_FIELDS,
    fast: bool = False,
) -> DataFrame:
    """What is known about each target address, empty values as null.

    addresses(address, ordinal, description, hostname), devices(hostname,
    device_id, description, custom_fields map), contacts(device_id, contact),
    prefixes(prefix, description). `fast` leaves out contacts and subnets.
    """
    blank = lambda c: F.when(c != "", c)
    first = addresses.groupBy("address").agg(
        F.min_by(F.struct("description", "hostname"), F.col("ordinal")).alias("hit")
    )
    asked = targets.select(col(target).alias("target")).distinct()
    hit = asked.join(first, asked["target"] == first["address"]).select(
        "target", blank(F.col("hit.description")).alias("description"), blank(F.col("hit.hostname")).alias("hostname")
    )
    # A host has one device: the first by its id.
    device = devices.groupBy("hostname").agg(F.min_by(F.struct(*devices.columns), F.col("device_id")).alias("d")).select("d.*")
    known = device.select(
        F.col("hostname").alias("__host"),
        "device_id",
        blank(F.col("description")).alias("description_of_assignment"),
        *[blank(F.col("custom_fields")[f]).alias(f.lower()) for f in custom_fields],
    )
    out = hit.join(known, F.col("hostname") == F.col("__host"), "left").drop("__host")
    if not fast and contacts is not None:
        people = contacts.groupBy("device_id").agg(
            F.array_join(F.sort_array(F.collect_set("contact")), ", ").alias("potential_contacts")
        )
        out = out.join(people, "device_id", "left")
    if not fast and prefixes is not None:
        paths = subnet_paths(asked, "target", prefixes, "prefix", "description")
        out = out.join(paths, "target", "left")
    return out.drop("device_id")
