"""Network lookups, enrichment, names and process trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.hierarchy import ProcessColumns, ancestors, descendants, roots, siblings, subtree_labels
from tracewell.operators.lookup import enrich_assets, in_networks, longest_prefix, resolve_names
from tracewell.plans.catalogue import Registry
from tracewell.plans.catalogue.derived import (
    ADDRESSES, PREFIXES, PROCESSES, addresses, prefixes, processes, table,
)

R = Registry()
NAMES = ProcessColumns()


@R.query(
    "cidr_lpm",
    f"""WITH {ADDRESSES}, {PREFIXES}
    SELECT a.c_custkey, a.address, h.prefix, h.description, h.depth FROM addresses a
    JOIN (SELECT * FROM holding QUALIFY row_number() OVER (PARTITION BY address ORDER BY depth DESC) = 1) h
      ON a.address = h.address""",
)
def cidr_lpm(spark, folder):
    out = longest_prefix(addresses(spark, folder), "address", prefixes(spark, folder), depth="depth")
    return out.select("c_custkey", "address", "prefix", "description", "depth")


@R.query(
    "cidr_semi",
    f"""WITH {ADDRESSES}, {PREFIXES}
    SELECT c_custkey, address FROM addresses WHERE address IN (SELECT address FROM holding WHERE depth IN (2, 3) AND NOT ends_with(description, '_1'))""",
)
def cidr_semi(spark, folder):
    """Addresses in an allowed network; networks named ..1 are switched off."""
    networks = prefixes(spark, folder).where("depth IN (2, 3)").selectExpr(
        "prefix AS ip_network", "NOT endswith(description, '_1') AS allow"
    )
    return in_networks(addresses(spark, folder), "address", networks, "ip_network", "allow").select("c_custkey", "address")


def asset_tables(spark, folder):
    """Addresses of suppliers' devices, with contacts and networks."""
    known = addresses(spark, folder)
    suppliers = table(spark, folder, "supplier")
    listed = known.selectExpr(
        "address", "c_custkey AS ordinal", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS description",
        "concat('Supplier#', lpad(c_custkey % 200, 9, '0')) AS hostname",
    )
    devices = suppliers.selectExpr(
        "s_name AS hostname", "s_suppkey AS device_id", "concat('rack ', s_nationkey) AS description",
        "map('owner', concat('owner-', s_suppkey % 7), 'team', CASE WHEN s_suppkey % 2 = 0 THEN 'blue' ELSE '' END) AS custom_fields",
    )
    contacts = suppliers.selectExpr("s_suppkey AS device_id", "explode(array(concat('person-', s_nationkey), 'duty', 'duty')) AS contact")
    return listed, devices, contacts


@R.query(
    "enrich_asset",
    f"""WITH {ADDRESSES}, {PREFIXES},
    hit AS (SELECT address, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS description,
                   concat('Supplier#', lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0')) AS hostname
            FROM addresses QUALIFY row_number() OVER (PARTITION BY address ORDER BY c_custkey) = 1),
    path AS (SELECT address, lower(string_agg(concat(prefix, ' (', CASE WHEN description = '' THEN 'No info' ELSE description END, ')'), ' -> ' ORDER BY depth)) AS description_of_subnet
             FROM holding GROUP BY address)
    SELECT hit.address AS target, hit.description, hit.hostname,
           CASE WHEN s_suppkey IS NOT NULL THEN concat('rack ', s_nationkey) END AS description_of_assignment,
           CASE WHEN s_suppkey IS NOT NULL THEN concat('owner-', s_suppkey % 7) END AS owner,
           CASE WHEN s_suppkey % 2 = 0 THEN 'blue' END AS team,
           CASE WHEN s_suppkey IS NOT NULL THEN concat('duty, person-', s_nationkey) END AS potential_contacts,
           path.description_of_subnet
    FROM hit LEFT JOIN supplier ON s_name = hostname LEFT JOIN path ON path.address = hit.address""",
)
def enrich_asset(spark, folder):
    listed, devices, contacts = asset_tables(spark, folder)
    return enrich_assets(
        listed.select("address"), "address", listed, devices, contacts, prefixes(spark, folder), custom_fields=("owner", "team")
    )


@R.query(
    "lookup_name",
    """WITH hosts AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages),
            known AS (SELECT DISTINCT host, length(host) AS n FROM hosts)
       SELECT h.page_id, k.host AS domain, concat('10.9.', k.n, '.', u.i) AS address
       FROM hosts h JOIN known k ON h.host = k.host, LATERAL (SELECT unnest(range(1, k.n % 4 + 1)) AS i) u""",
)
def lookup_name(spark, folder):
    """Addresses of page hosts; hosts have none to three."""
    hosts = table(spark, folder, "pages").selectExpr("page_id", "split_part(split_part(url, '://', 2), '/', 1) AS host")
    known = hosts.select("host").distinct().where("length(host) % 4 > 0")
    resolutions = known.selectExpr("host AS domain", "explode(sequence(1, length(host) % 4)) AS i").selectExpr(
        "domain", "concat('10.9.', length(domain), '.', i) AS address"
    )
    # A name asked for many times is looked up once.
    found = resolve_names(hosts.select("host").distinct(), "host", resolutions)
    return hosts.join(found, F.col("host") == F.col("domain")).select("page_id", "domain", "address")


def seeds(spark, folder):
    """Every process is a seed of its own."""
    return processes(spark, folder).withColumn("seed_id", F.col("_id"))


@R.query(
    "hier_parents",
    f"""WITH RECURSIVE {PROCESSES},
    up AS (SELECT id AS seed_id, id, parent, ts, 0 AS position FROM processes
           UNION ALL SELECT u.seed_id, p.id, p.parent, p.ts, u.position - 1 FROM up u JOIN processes p
             ON p.pid = u.parent AND p.ts <= u.ts WHERE u.position > -3)
    SELECT seed_id, id AS row_id, position AS hierarchy_position FROM up""",
)
def hier_parents(spark, folder):
    return ancestors(processes(spark, folder), seeds(spark, folder), 3, NAMES)


@R.query(
    "hier_children",
    f"""WITH RECURSIVE {PROCESSES},
    down AS (SELECT id AS seed_id, pid, id, ts, 0 AS position FROM processes
             UNION ALL SELECT d.seed_id, p.pid, p.id, p.ts, d.position + 1 FROM down d JOIN processes p
               ON p.parent = d.pid AND p.ts >= d.ts
             -- Process 0 is its own parent: it is listed again but opened once.
             WHERE d.position < 3 AND NOT (d.position > 0 AND d.pid = 0))
    SELECT seed_id, id AS row_id, position AS hierarchy_position FROM down""",
)
def hier_children(spark, folder):
    return descendants(processes(spark, folder), seeds(spark, folder), 3, NAMES)


@R.query(
    "hier_siblings",
    f"""WITH {PROCESSES}
    SELECT parent AS family, id AS row_id, true AS is_seed FROM processes
    UNION ALL SELECT parent, id, false FROM processes WHERE parent IN (SELECT parent FROM processes)""",
)
def hier_siblings(spark, folder):
    return siblings(processes(spark, folder), seeds(spark, folder), NAMES)


# Chains of up to some hundred processes: each has the one before it as parent, if that is on the same host and was there in time.
CHAINED = "chained AS (SELECT event_id AS id, event_id - 1 - event_id % 3 AS parent, ts, value FROM events)"
LINKS = """links AS (SELECT c.id, c.ts, c.value, p.id AS parent FROM chained c LEFT JOIN chained p
  ON p.id = c.parent AND (p.ts < c.ts OR (p.ts = c.ts AND p.id < c.id)) AND c.id % 200 > 0)"""


def chained(spark, folder):
    parent = F.when(F.col("event_id") % 200 > 0, F.col("event_id") - 1 - F.col("event_id") % 3)
    return table(spark, folder, "events").select(
        F.col("event_id").alias("_id"), F.col("event_id").alias("process.pid"), parent.alias("process.parent.pid"), F.col("ts").alias("@timestamp"), "value"
    )


@R.query(
    "hier_roots",
    f"""WITH RECURSIVE {CHAINED}, {LINKS},
    down AS (SELECT id, id AS root, 0 AS depth FROM links WHERE parent IS NULL
             UNION ALL SELECT l.id, d.root, d.depth + 1 FROM down d JOIN links l ON l.parent = d.id)
    SELECT id AS row_id, root AS root_id, CAST(depth AS BIGINT) AS depth FROM down""",
)
def hier_roots(spark, folder):
    """Root and depth of every process, however deep it lies."""
    return roots(chained(spark, folder), NAMES)


@R.query(
    "hier_subtree_stats",
    f"""WITH RECURSIVE {CHAINED}, {LINKS},
    down AS (SELECT id, id AS root, [(ts, id)] AS path FROM links WHERE parent IS NULL
             UNION ALL SELECT l.id, d.root, list_append(d.path, (l.ts, l.id)) FROM down d JOIN links l ON l.parent = d.id),
    placed AS (SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS enter FROM down),
    up AS (SELECT id, value, id AS above, parent FROM links
           UNION ALL SELECT u.id, u.value, l.id, l.parent FROM up u JOIN links l ON l.id = u.parent),
    sums AS (SELECT above AS id, count(*) AS size, round(sum(value), 2) AS total FROM up GROUP BY 1)
    SELECT id AS row_id, root AS root_id, enter, enter + size - 1 AS leave, size, total FROM placed JOIN sums USING (id)""",
)
def hier_subtree_stats(spark, folder):
    """Place, size and summed value of the subtree of every process."""
    found = subtree_labels(chained(spark, folder), "value", NAMES)
    return found.select("row_id", "root_id", "enter", "leave", "size", F.round("total", 2).alias("total"))
