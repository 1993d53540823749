"""The normalised event and the flat event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDPOINT = "struct<uid:string,hostname:string,ip:string,port:int,domain:string,os_name:string>"
ATTACK = "struct<tactic:struct<name:string,uid:string>,technique:struct<name:string,uid:string,sub_technique:string>>"
EVENT = {
    "class_uid": "int", "class_name": "string", "category_uid": "int", "time": "timestamp", "severity_id": "int",
    "metadata_product": "string", "metadata_version": "string", "metadata_uid": "string",
    "src_endpoint": ENDPOINT, "dst_endpoint": ENDPOINT,
    "actor_user": "struct<name:string,uid:string,domain:string,is_privileged:boolean>",
    "process": "struct<pid:int,name:string,cmd_line:string,path:string,parent_pid:int,parent_name:string,hash_sha256:string>",
    "network_traffic": "map<string,string>", "file": "map<string,string>",
    "finding_info": f"struct<title:string,analytic:struct<uid:string,name:string,type_id:int>,attacks:array<{ATTACK}>,severity_id:int>",
    "raw": "string", "unmapped": "map<string,string>",
}
CATEGORY = {1001: 1, 1007: 1, 2001: 2, 2003: 2, 3002: 3, 4001: 4, 4002: 4, 4003: 4}


def blank(c: Column) -> Column:
    """'' counts as missing."""
    return F.nullif(c, F.lit(""))


def record(kind: str, **fields: Column) -> Column:
    """A struct of the given type from named fields; the rest is NULL."""
    parts, depth, cur = [], 0, ""
    for ch in kind[len("struct<"):-1]:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts.append(cur)
    out = []
    for p in parts:
        name, _, typ = p.partition(":")
        out.append(fields.get(name, F.lit(None)).cast(typ).alias(name))
    return F.struct(*out)


def endpoint(**f: Column) -> Column:
    return record(ENDPOINT, **f)


def user(**f: Column) -> Column:
    return record(EVENT["actor_user"], **f)


def process(**f: Column) -> Column:
    return record(EVENT["process"], **f)


def finding(**f: Column) -> Column:
    return record(EVENT["finding_info"], **f)


def analytic(uid: Column, name: Column) -> Column:
    return F.struct(uid.cast("string").alias("uid"), name.alias("name"), F.lit(1).alias("type_id"))


def attack(uid: Column, name: Column, tactic_uid: Column, tactic: Column) -> Column:
    sub = F.when(uid.contains("."), F.substring_index(uid, ".", -1))
    return F.struct(F.struct(tactic.alias("name"), tactic_uid.alias("uid")).alias("tactic"), F.struct(name.alias("name"), uid.alias("uid"), sub.alias("sub_technique")).alias("technique"))


def traffic(**f: Column) -> Column:
    """String map without NULL values."""
    full = F.create_map(*[x for k, v in f.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(full, lambda k, v: v.isNotNull())


def event(df: DataFrame, keep: list[str] | None = None, **cols: Column) -> DataFrame:
    """Rows of the event schema; unnamed fields are NULL."""
    cols.setdefault("metadata_version", F.lit("1.1.0"))
    cols.setdefault("raw", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.select(*(keep or []), *[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVENT.items()])


def flatten(ev: DataFrame) -> DataFrame:
    """The flat event table: source host before destination host, summary before title."""
    return ev.select(
        F.sha2(F.concat_ws("|", "metadata_product", "metadata_uid", "raw"), 256).alias("id"), F.col("metadata_uid").alias("event_uid"), "time", "class_name", "class_uid", "severity_id",
        F.col("src_endpoint.ip").alias("src_ip"), F.col("dst_endpoint.ip").alias("dst_ip"),
        F.coalesce(blank(F.col("src_endpoint.hostname")), F.col("dst_endpoint.hostname")).alias("hostname"), F.col("actor_user.name").alias("username"),
        F.col("process.hash_sha256").alias("process_hash"), F.col("metadata_product").alias("source"),
        F.coalesce(blank(F.try_element_at("unmapped", F.lit("summary"))), F.col("finding_info.title")).alias("summary"), "raw")


def rule_event(ev: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A normalised event with the columns that rules, detectors and enrichment read beside its nested fields.

    Rules reach structs and maps by path (process.cmd_line, network_traffic.query, unmapped.status) and the
    short names of the process and of the source endpoint; alerts need the id, host, addresses, names and hashes.
    The id is the sensor's, or a hash of the record where it has none.
    """
    def sent(name: str) -> Column:
        return F.try_element_at("network_traffic", F.lit(name))

    def of_file(name: str) -> Column:
        return F.try_element_at("file", F.lit(name))

    record_hash = F.sha2(F.concat_ws("|", "metadata_product", F.unix_micros("time").cast("string"), "raw"), 256)
    return ev.select(
        *(keep or []), F.coalesce(blank(F.col("metadata_uid")), record_hash).alias("id"), *EVENT, F.unix_micros("time").alias("time_us"), F.col("metadata_product").alias("source"),
        F.col("src_endpoint.ip").alias("src_ip"), F.col("dst_endpoint.ip").alias("dst_ip"), F.col("src_endpoint.port").alias("src_port"), F.col("dst_endpoint.port").alias("dst_port"),
        F.coalesce(blank(F.col("src_endpoint.hostname")), blank(F.col("dst_endpoint.hostname"))).alias("hostname"), F.col("actor_user.name").alias("username"),
        *[F.col(f"process.{c}").alias(c) for c in ("name", "pid", "cmd_line", "path", "parent_pid", "parent_name", "hash_sha256")], F.col("process.name").alias("process_name"),
        F.col("src_endpoint.ip").alias("ip"), F.col("src_endpoint.port").alias("port"), F.coalesce(sent("query"), sent("server_name"), F.col("src_endpoint.domain"), F.col("dst_endpoint.domain")).alias("domain"),
        sent("query").alias("query"), F.coalesce(sent("url"), sent("uri")).alias("url"),
        F.coalesce("process.hash_sha256", of_file("hash_sha256"), of_file("hash_md5")).alias("process_hash"), of_file("hash_md5").alias("hash_md5"),
        F.coalesce(blank(F.try_element_at("unmapped", F.lit("summary"))), F.col("finding_info.title")).alias("summary"))


def to_flow(ev: DataFrame, every: bool = False) -> DataFrame:
    """Flow records of network events that have both addresses, or of every event, whatever it lacks."""
    def get(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at("network_traffic", F.lit(n)) for n in names])

    src, dst = F.col("src_endpoint.ip"), F.col("dst_endpoint.ip")
    proto = F.upper(F.coalesce(get("protocol", "proto"), F.lit("TCP")))
    named = F.when(proto == "6", "TCP").when(proto == "17", "UDP").when(proto == "1", "ICMP").when(proto.rlike("^[0-9]+$"), "OTHER").otherwise(proto)
    return (ev if every else ev.where((F.length(src) > 0) & (F.length(dst) > 0))).select(
        F.col("metadata_uid").alias("flow_id"), src.alias("src_ip"), dst.alias("dst_ip"), F.coalesce("src_endpoint.port", F.lit(0)).alias("src_port"),
        F.coalesce("dst_endpoint.port", F.lit(0)).alias("dst_port"), named.alias("protocol"), F.coalesce(get("bytes_in", "resp_bytes").try_cast("long"), F.lit(0)).alias("bytes_in"),
        F.coalesce(get("bytes_out", "orig_bytes").try_cast("long"), F.lit(0)).alias("bytes_out"),
        F.coalesce(get("duration_ms").try_cast("int"), F.round(get("duration").try_cast("double") * 1000).cast("int"), F.lit(0)).alias("duration_ms"), F.unix_micros("time").alias("time_us"))
