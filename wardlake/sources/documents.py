"""JSON sources: schemas of exported findings, indicator bundles, webhook bodies, agent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions.indicators import confidence_severity
from wardlake.schema import blank

WAZUH = ("timestamp string, id string, rule struct<id:string,description:string,level:string,groups:array<string>,mitre:struct<id:array<string>,tactic:array<string>,technique:array<string>>>, "
         "agent struct<id:string,name:string,ip:string,os:struct<name:string>>, data struct<srcip:string,dstip:string,dstuser:string,srcuser:string,win:struct<eventdata:map<string,string>>>")
SURICATA = ("timestamp string, event_type string, src_ip string, src_port int, dest_ip string, dest_port int, proto string, flow_id string, "
            "alert struct<signature_id:string,signature:string,severity:string,action:string,metadata:struct<mitre_technique_id:array<string>>>, "
            "dns struct<rrname:string,rrtype:string,rcode:string,answers:array<string>>, http map<string,string>, tls map<string,string>, flow map<string,string>")
PROWLER = ("id string, check_id string, check_metadata struct<CheckID:string,CheckTitle:string,ServiceName:string,Severity:string>, status string, status_extended string, severity string, "
           "resource_uid string, resource_name string, resource_type string, region string, account_uid string, provider string, inserted_at string")
VELOCIRAPTOR = ("_artifact_name string, System struct<EventID:string,TimeCreated:string,Computer:string>, EventData map<string,string>, EventID string, TimeCreated string, Computer string, "
                "Pid string, PPid string, Name string, Exe string, Cmdline string, CommandLine string, Username string, Hostname string, Timestamp string, "
                "client_id string, flow_id string, artifacts array<string>, state string, create_time string")
SCHEMAS = {"wazuh": WAZUH, "suricata": SURICATA, "prowler": PROWLER, "velociraptor": VELOCIRAPTOR}
# the text a checkpoint is compared with
CHECKPOINT = {"wazuh": "timestamp", "suricata": "timestamp", "prowler": "inserted_at", "velociraptor": "create_time"}


def parse_documents(df: DataFrame, source: str, value: str = "value") -> DataFrame:
    """JSON texts of a source as typed columns; texts that are no object are skipped."""
    from wardlake.functions.text import once

    out = once(df.where(F.ltrim(value).startswith("{")), _d=F.from_json(value, SCHEMAS[source], {"mode": "PERMISSIVE"}))
    return out.select(*[c for c in df.columns if c != value], "_d.*")


def since(df: DataFrame, source: str, checkpoint: str | None) -> DataFrame:
    """Only rows newer than the checkpoint (ISO texts compare in time order)."""
    return df if checkpoint is None else df.where(F.col(CHECKPOINT[source]) > checkpoint)


def parse_webhook(df: DataFrame, source: str, received_at: str, value: str = "value") -> DataFrame:
    """Bodies that are an object or an array: one row per object; other items come back as rejected."""
    body = F.try_parse_json(value)
    kind = F.schema_of_variant(body)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(body, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array(body))
    rows = df.select(*[c for c in df.columns if c != value], F.explode(items).alias("_v"))
    ok = F.schema_of_variant("_v").startswith("OBJECT")
    return rows.select(*[c for c in rows.columns if c != "_v"], F.to_json("_v").alias("event"), ok.alias("accepted"), F.lit(source).alias("_webhook_source"), F.lit(received_at).alias("_received_at"))


STIX = ("objects array<struct<type:string,pattern:string,confidence:int,description:string,name:string,labels:array<string>,valid_from:string,modified:string,valid_until:string>>")


def parse_stix(df: DataFrame, feed: str, value: str = "value") -> DataFrame:
    """Indicators of bundles: every value every extractor finds in a pattern."""
    objs = df.select(F.explode(F.from_json(value, STIX)["objects"]).alias("o")).select("o.*").where((F.col("type") == "indicator") & (F.length("pattern") > 0))
    def found(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("pattern", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("ioc_type"), F.trim(v).alias("value")))

    pairs = F.concat(*[found(kind, rx) for kind, rx in fixed.STIX_EXTRACTORS])
    conf = F.greatest(F.least(F.coalesce("confidence", F.lit(50)), F.lit(100)), F.lit(0))
    text = F.coalesce(blank(F.col("description")), blank(F.col("name")))
    out = objs.withColumn("_p", F.explode(pairs)).where(F.length("_p.value") > 0)
    return out.select(
        "_p.ioc_type", "_p.value", F.lit(feed).alias("source"), conf.alias("confidence"), confidence_severity(conf).alias("severity"), text.alias("description"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("tags"), F.try_to_timestamp("valid_from").alias("first_seen"), F.try_to_timestamp("modified").alias("last_seen"),
        F.try_to_timestamp("valid_until").alias("expires_at"), F.lit(True).alias("is_active"))
