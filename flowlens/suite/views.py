"""Flow tables derived from the ``events`` table, for the registered queries and the tests.

The flow and packet views are one SQL text that Spark and the checking engine both read; everything scored
is built by the package on the Spark side and by SQL on the other.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.scalar import flow_id
from flowlens.operators.augment import classified_flows, security_events
from flowlens.operators.scoring import score
from flowlens.plans.catalog import Catalog

FLOWS_SQL = """
SELECT cast(ts AS timestamp) AS collected_at,
 concat(src_ip, ':', cast(src_port AS string), '->', dst_ip, ':', cast(dst_port AS string), ':',
        cast(protocol AS string)) AS flow_id,
 src_ip, dst_ip, cast(src_port AS int) AS src_port, cast(dst_port AS int) AS dst_port,
 cast(protocol AS smallint) AS protocol, cast(4 AS smallint) AS ip_version,
 first_ms AS bidirectional_first_seen_ms, first_ms + dur AS bidirectional_last_seen_ms,
 dur AS bidirectional_duration_ms, pk AS bidirectional_packets, pk * psize AS bidirectional_bytes,
 pk - d2s AS src2dst_packets, (pk - d2s) * psize AS src2dst_bytes,
 d2s AS dst2src_packets, d2s * psize AS dst2src_bytes,
 application_name, split_part(application_name, '.', 1) AS application_category_name,
 cast(event_id % 2 AS smallint) AS application_is_guessed,
 cast(event_id % 7 AS float) AS application_confidence,
 concat('host', cast(user_id % 100 AS string), '.example') AS requested_server_name,
 CASE WHEN dur > 0 THEN pk / (dur / 1000.0e0) ELSE 0.0e0 END AS packets_per_second,
 CASE WHEN dur > 0 THEN pk * psize / (dur / 1000.0e0) ELSE 0.0e0 END AS bytes_per_second,
 cast(40 + user_id % 10 AS float) AS bidirectional_min_ps, cast(psize AS float) AS bidirectional_mean_ps,
 cast(event_id % 13 AS float) AS bidirectional_stddev_ps,
 cast(psize + event_id % 13 AS float) AS bidirectional_max_ps,
 cast(event_id % 5 AS float) AS bidirectional_min_piat_ms,
 cast(event_id % 17 AS float) AS bidirectional_mean_piat_ms,
 cast(event_id % 11 AS float) AS bidirectional_stddev_piat_ms,
 cast(event_id % 23 AS float) AS bidirectional_max_piat_ms,
 CASE WHEN protocol = 6 THEN 1 + event_id % 2 ELSE 0 END AS bidirectional_syn_packets,
 pk % 8 AS bidirectional_ack_packets, pk % 4 AS bidirectional_psh_packets,
 event_id % 3 AS bidirectional_rst_packets, event_id % 2 AS bidirectional_fin_packets
FROM (SELECT ts, event_id, user_id, 1704067200000 + event_id * 1000 AS first_ms,
 40 + user_id % 1000 AS psize,
 concat('10.0.0.', cast(user_id % 200 AS string)) AS src_ip,
 concat('192.168.1.', cast(event_id % 50 AS string)) AS dst_ip,
 1024 + event_id % 60000 AS src_port,
 CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8443
      WHEN 'signup' THEN 22 ELSE 53 END AS dst_port,
 CASE WHEN event_type = 'error' THEN 17 ELSE 6 END AS protocol,
 CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'TLS' WHEN 'purchase' THEN 'TLS.Shop'
      WHEN 'signup' THEN 'SSH' ELSE 'DNS.Query' END AS application_name,
 event_id % 7 * 250 AS dur, 1 + event_id % 40 AS pk, event_id % 40 % 5 AS d2s FROM {events}) e
"""

PACKETS_SQL = """
SELECT cast(ts AS timestamp) AS ts, event_id AS seq,
 CASE WHEN event_id % 2 = 0 THEN client ELSE server END AS src_ip,
 CASE WHEN event_id % 2 = 0 THEN server ELSE client END AS dst_ip,
 cast(CASE WHEN event_id % 2 = 0 THEN client_port ELSE 443 END AS int) AS src_port,
 cast(CASE WHEN event_id % 2 = 0 THEN 443 ELSE client_port END AS int) AS dst_port,
 cast(6 AS smallint) AS protocol, cast(4 AS smallint) AS ip_version,
 40 + cast(floor(value) AS bigint) AS size,
 event_type = 'signup' AS syn, event_type = 'view' AS ack, event_type = 'click' AS psh,
 event_type = 'error' AS rst, event_type = 'purchase' AS fin
FROM (SELECT *, concat('10.1.0.', cast(user_id % 250 AS string)) AS client,
 concat('172.16.0.', cast(user_id % 9 AS string)) AS server,
 1024 + user_id AS client_port FROM {events}) e
"""


def _hash(text: str) -> str:
    return f"cast(('0x' || substr(md5({text}), 1, 8)) AS bigint)"


_LABEL_CASE = (
    "CASE label_idx WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'DoS' WHEN 2 THEN 'DDoS' WHEN 3 THEN 'PortScan' "
    "WHEN 4 THEN 'BruteForce' WHEN 5 THEN 'WebAttack' WHEN 6 THEN 'Botnet' ELSE 'Malware' END"
)


def _scored_sql(flows: str) -> str:
    return f"""
SELECT *, {_LABEL_CASE} AS label, cast(label_idx <> 0 AS smallint) AS is_threat,
 cast(0.72e0 + ({_hash("flow_id || ':' || cast(label_idx AS varchar)")} % 100) * 0.0026e0 AS float)
   AS confidence, collected_at AS classified_at
FROM (SELECT *, {_hash("flow_id || ':label'")} % 8 AS label_idx FROM {flows}) s
"""


# Views of the checking engine, in dependency order.
ORACLE_VIEWS = {
    "flows": FLOWS_SQL.format(events="events"),
    "packets": PACKETS_SQL.format(events="events"),
    "repeat_flows": """
SELECT * EXCLUDE (flow_id, src_port), cast(1024 + src_port % 4 AS int) AS src_port,
 concat(src_ip, ':', cast(1024 + src_port % 4 AS varchar), '->', dst_ip, ':', cast(dst_port AS varchar),
        ':', cast(protocol AS varchar)) AS flow_id FROM flows
""",
    "classified_flows": _scored_sql("flows"),
    "security_events": "SELECT *, collected_at AS detected_at FROM classified_flows WHERE is_threat = 1",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it mentions (and those they mention) as common table expressions."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in ORACLE_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    ctes = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in ORACLE_VIEWS if n in needed)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def flows_of(self, events: DataFrame) -> DataFrame:
        return self.spark.sql(FLOWS_SQL, events=events)

    def packets_of(self, events: DataFrame) -> DataFrame:
        return self.spark.sql(PACKETS_SQL, events=events)

    def event_stream(self) -> DataFrame:
        """The events table as a file stream."""
        schema = self.table("events").schema
        return (
            self.spark.readStream.schema(schema)
            .option("pathGlobFilter", "events.parquet")
            .parquet(self.sf_dir)
        )

    @cached_property
    def flows(self) -> DataFrame:
        return self.flows_of(self.table("events"))

    @cached_property
    def packets(self) -> DataFrame:
        return self.packets_of(self.table("events"))

    @cached_property
    def repeat_flows(self) -> DataFrame:
        """Flows whose ids repeat: the source port takes four values only."""
        ports = self.flows.withColumn("src_port", (F.lit(1024) + F.col("src_port") % 4).cast("int"))
        return ports.withColumn("flow_id", flow_id())

    @cached_property
    def scored(self) -> DataFrame:
        return score(self.flows)

    @cached_property
    def classified_flows(self) -> DataFrame:
        return classified_flows(self.scored, now=F.col("collected_at"))

    @cached_property
    def security_events(self) -> DataFrame:
        return security_events(self.scored, now=F.col("collected_at"))

    def catalog(self, row_cap: int | None = None) -> Catalog:
        """All views; without a cap unless one is asked for, so that requests run whole."""
        tables = ("region", "nation", "customer", "supplier", "orders", "lineitem", "embeddings")
        views = {f"net.{n}": (lambda n=n: getattr(self, n))
                 for n in ("flows", "classified_flows", "security_events", "repeat_flows")}
        views |= {f"shop.{n}": (lambda n=n: self.table(n)) for n in tables}
        return Catalog(views, allowed=list(views), row_cap=row_cap)
