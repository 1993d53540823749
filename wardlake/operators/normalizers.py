"""Sensor records -> normalised events. Each is one projection: no shuffle, no row-at-a-time code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed, schema
from wardlake.functions.net import any_of
from wardlake.functions.scoring import lookup
from wardlake.functions.text import exe_name, hex_or_int, once, sha256_of
from wardlake.schema import analytic, attack, blank, endpoint, event, finding, process, traffic, user


def _class(uid: Column) -> dict[str, Column]:
    return {"class_uid": uid, "class_name": lookup(uid, fixed.CLASS_NAME), "category_uid": lookup(uid, schema.CATEGORY)}


def iso_time(text: Column) -> Column:
    """ISO 8601 with any fraction; NULL (a dead letter later) when it is no time."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))


def _table(rows, key: int = 0) -> Column:
    """Fixed rows as a map from key to the array of the other cells."""
    return F.create_map(*[x for r in rows for x in (F.lit(r[key]), F.array(*[F.lit(c) for c in r[key + 1:]]))])


# ------------------------------------------------------------------------------------- host agent

_TACTIC_BY_SLUG = {s: [n, u] for s, n, u in fixed.TACTICS} | {n: [n, u] for _, n, u in fixed.TACTICS}


def wazuh_attacks(mitre: Column) -> Column:
    """Technique ids zipped with their tactics (the first where there are fewer) and names."""
    tactics = F.create_map(*[x for k, (n, u) in _TACTIC_BY_SLUG.items() for x in (F.lit(k), F.array(F.lit(n), F.lit(u)))])

    def one(tid: Column, i: Column) -> Column:
        raw = F.coalesce(F.get(mitre["tactic"], i), F.get(mitre["tactic"], F.lit(0)), F.lit(""))
        known = F.try_element_at(tactics, raw)
        return attack(tid, F.coalesce(F.get(mitre["technique"], i), tid), F.coalesce(F.get(known, F.lit(1)), F.lit("")), F.coalesce(F.get(known, F.lit(0)), raw))

    return F.coalesce(F.transform(mitre["id"], one), F.array().cast(f"array<{schema.ATTACK}>"))


def wazuh(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    groups = F.coalesce("rule.groups", F.array().cast("array<string>"))

    def has(*parts: str) -> Column:
        return F.exists(groups, lambda g: any_of([g.contains(p) for p in parts]))

    uid = (F.when(has("process"), 1007).when(has("network", "firewall", "connection"), 4001)
           .when(has("authentication", "login", "logon"), 3002).when(has("file", "syscheck"), 1001).otherwise(2001))
    level = F.coalesce(F.col("rule.level").try_cast("int"), F.lit(5))
    sev = F.when(level >= 14, 5).when(level >= 11, 4).when(level >= 7, 3).when(level >= 4, 2).otherwise(1)

    def win(name: str) -> Column:
        d = F.col("data.win.eventdata")
        return F.coalesce(blank(F.try_element_at(d, F.lit(name))), blank(F.try_element_at(d, F.lit(name[0].upper() + name[1:]))))

    title = F.coalesce("rule.description", F.lit("Unknown Alert"))
    out = once(df, _uid=uid, _sev=sev)
    return event(
        out, keep, **_class(F.col("_uid")), time=iso_time(F.col("timestamp")), severity_id=F.col("_sev"), metadata_product=F.lit("Wazuh"), metadata_uid=F.col("id"),
        src_endpoint=endpoint(ip=F.col("data.srcip")),
        dst_endpoint=endpoint(uid=F.col("agent.id"), hostname=F.col("agent.name"), ip=F.coalesce(blank(F.col("agent.ip")), F.col("data.dstip")), os_name=F.col("agent.os.name")),
        actor_user=user(name=F.coalesce(blank(F.col("data.dstuser")), F.col("data.srcuser"))),
        process=process(cmd_line=win("commandLine"), path=win("image"), pid=win("processId").try_cast("int"), parent_pid=win("parentProcessId").try_cast("int"),
                        name=exe_name(win("image")), parent_name=exe_name(win("parentImage")), hash_sha256=sha256_of(win("hashes"))),
        finding_info=finding(title=title, severity_id=F.col("_sev"), analytic=analytic(F.col("rule.id"), F.coalesce("rule.description", F.lit(""))), attacks=wazuh_attacks(F.col("rule.mitre"))),
        raw=F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), unmapped=F.create_map().cast("map<string,string>"))


# ------------------------------------------------------------------------------------- network sensor

# fixed values
CONN_STATE_SEVERITY = {"REJ": 3, "S0": 2, "RSTO": 2, "RSTR": 2}
ZEEK_TRAFFIC = {
    "conn": {k: k for k in "service duration orig_bytes resp_bytes conn_state missed_bytes history orig_pkts resp_pkts orig_ip_bytes resp_ip_bytes local_orig local_resp vlan".split()} | {"protocol": "proto"},
    "dns": {k: k for k in "proto trans_id rtt query qclass qclass_name AA TC RD RA Z rejected".split()} | {"qtype": "qtype_name", "query_type": "qtype_name", "qtype_id": "qtype", "rcode": "rcode_name", "rcode_id": "rcode"},
    "http": {k: k for k in "method uri version status_code status_msg user_agent referrer request_body_len response_body_len trans_depth username".split()},
    "ssl": {k: k for k in "version cipher curve server_name established resumed next_protocol ssl_history subject issuer not_valid_before not_valid_after ja3 ja3s validation_status".split()},
}


#: what zeek() reads of a conn record
ZEEK_CONN = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", *ZEEK_TRAFFIC["conn"].values()]


def zeek(df: DataFrame, log_type: str = "conn", keep: list[str] | None = None) -> DataFrame:
    """conn, dns, http or ssl records; any other type is read as conn."""
    kind = log_type if log_type in ZEEK_TRAFFIC else "conn"
    uid = {"dns": 4003, "http": 4002}.get(kind, 4001)
    state = F.coalesce("conn_state", F.lit("OTH"))
    sev = lookup(state, CONN_STATE_SEVERITY, 1) if kind == "conn" else F.lit(1)
    fields = {k: F.col(v) for k, v in ZEEK_TRAFFIC[kind].items()}
    if kind == "conn":
        fields["conn_state"] = state
    if kind == "dns":
        fields["answers"] = F.array_join("answers", ",")
    host = {"http": F.col("host"), "ssl": F.col("server_name")}.get(kind, F.lit(None))
    return event(
        df, keep, **_class(F.lit(uid)), time=F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")), severity_id=sev, metadata_product=F.lit("Zeek"), metadata_uid=F.col("uid"),
        src_endpoint=endpoint(ip=F.col("`id.orig_h`"), port=F.col("`id.orig_p`")), dst_endpoint=endpoint(ip=F.col("`id.resp_h`"), port=F.col("`id.resp_p`"), hostname=host), network_traffic=traffic(**fields))


# ------------------------------------------------------------------------------------- network alerts


def suricata_attacks(ids: Column) -> Column:
    known = _table(fixed.TECHNIQUES)

    def one(raw: Column) -> Column:
        tid = F.trim(raw)
        row = F.try_element_at(known, tid)
        named = row.isNotNull()
        return attack(tid, F.coalesce(F.get(row, F.lit(0)), tid), F.get(row, F.lit(1)), F.get(row, F.lit(2))).withField(
            "technique.sub_technique", F.when(named & tid.contains("."), F.substring_index(tid, ".", -1)))

    return F.coalesce(F.transform(ids, one), F.array().cast(f"array<{schema.ATTACK}>"))


def suricata(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    kind = F.coalesce("event_type", F.lit("alert"))
    alert = kind == "alert"
    sev = lookup(F.coalesce(F.col("alert.severity").try_cast("int"), F.lit(2)), {1: 4, 2: 3, 3: 2, 4: 1}, 3)
    title = F.coalesce("alert.signature", F.lit("Unknown Suricata Alert"))
    dns = traffic(query=F.col("dns.rrname"), qtype=F.col("dns.rrtype"), query_type=F.col("dns.rrtype"), answers=F.array_join("dns.answers", ","), rcode=F.col("dns.rcode"))
    net = F.map_concat(F.create_map(F.lit("event_type"), kind), F.coalesce(F.when(kind == "http", F.col("http")).when(kind == "tls", F.col("tls")).when(kind == "flow", F.col("flow")), F.create_map().cast("map<string,string>")))
    return event(
        df, keep, **_class(F.when(alert, 2001).when(kind == "dns", 4003).otherwise(4001)), time=iso_time(F.regexp_replace("timestamp", r"\+0000$", "+00:00")), severity_id=F.when(alert, sev).otherwise(1),
        metadata_product=F.lit("Suricata"), metadata_uid=F.col("flow_id"), src_endpoint=endpoint(ip=F.col("src_ip"), port=F.col("src_port")), dst_endpoint=endpoint(ip=F.col("dest_ip"), port=F.col("dest_port")),
        network_traffic=F.when(alert, traffic(proto=F.col("proto"), action=F.col("alert.action"))).when(kind == "dns", dns).otherwise(net),
        finding_info=F.when(alert, finding(title=title, severity_id=sev, analytic=analytic(F.coalesce("alert.signature_id", F.lit("")), title), attacks=suricata_attacks(F.col("alert.metadata.mitre_technique_id")))))


# ------------------------------------------------------------------------------------- cloud checks


def check_attack(check_id: Column) -> Column:
    """[technique, name, tactic id, tactic] of a check: exact id, else the longest prefix."""
    prefixes = sorted(fixed.CLOUD_CHECK_PREFIXES, key=lambda r: -len(r[0]))
    by_prefix = F.coalesce(*[F.when(check_id.startswith(p), F.array(*map(F.lit, rest))) for p, *rest in prefixes])
    return F.coalesce(F.try_element_at(_table(fixed.CLOUD_CHECKS), check_id), by_prefix)


def _one_attack(row: Column) -> Column:
    a = attack(F.get(row, F.lit(0)), F.get(row, F.lit(1)), F.get(row, F.lit(2)), F.get(row, F.lit(3)))
    return F.when(row.isNotNull(), F.array(a)).otherwise(F.array().cast(f"array<{schema.ATTACK}>"))


def prowler(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    check = F.coalesce(blank(F.col("check_id")), F.col("check_metadata.CheckID"), F.lit("unknown"))
    title = F.coalesce(blank(F.col("check_metadata.CheckTitle")), check)
    level = F.lower(F.coalesce(blank(F.col("severity")), F.col("check_metadata.Severity"), F.lit("")))
    sev = lookup(level, {k: v for k, v in fixed.SEVERITY_ID.items() if k != "unknown"}, 0)
    out = once(df, _row=check_attack(check))
    rest = "status status_extended provider region account_uid resource_uid resource_name resource_type".split()
    return event(
        out, keep, **_class(F.lit(2003)), time=iso_time(F.col("inserted_at")), severity_id=sev, metadata_product=F.lit("Prowler"), metadata_uid=F.col("id"),
        src_endpoint=endpoint(uid=blank(F.col("account_uid")), hostname=blank(F.col("provider")), domain=blank(F.col("region"))),
        finding_info=finding(title=title, severity_id=sev, analytic=analytic(check, title), attacks=_one_attack(F.col("_row"))),
        raw=F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), unmapped=traffic(**{c: F.col(c) for c in rest}, service=blank(F.col("check_metadata.ServiceName"))))


# ------------------------------------------------------------------------------------- forensic artifacts


def velociraptor(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Windows event logs, process listings and flow records by artifact family."""
    art = F.coalesce("_artifact_name", F.lit(""))
    windows, listing = art.startswith("Windows.EventLogs."), art.startswith("Linux.Sys.") | art.startswith("Generic.")
    eid_text = F.coalesce("System.EventID", "EventID")
    eid = F.coalesce(F.get_json_object(eid_text, "$.Value").try_cast("int"), eid_text.try_cast("int"))
    when_ = F.coalesce(F.get_json_object("System.TimeCreated", "$.SystemTime"), F.nullif(F.regexp_replace("System.TimeCreated", r"^\{.*\}$", ""), F.lit("")), F.col("TimeCreated"))
    out = once(
        df, _art=art, _win=windows, _list=listing, _eid=eid,
        _row=F.when(windows, F.try_element_at(_table(fixed.WINDOWS_EVENTS), eid.cast("string"))).when(listing, F.try_element_at(_table(fixed.ARTIFACTS), art)), _when=when_)
    d = lambda n: blank(F.try_element_at("EventData", F.lit(n)))
    win, lst, row = F.col("_win"), F.col("_list"), F.col("_row")
    sev = F.when(win, F.coalesce(F.get(row, F.lit(4)).cast("int"), F.lit(1))).otherwise(1)
    path = F.when(win, F.coalesce(d("NewProcessName"), blank(F.col("Exe")))).otherwise(F.coalesce(blank(F.col("Exe")), F.when(F.col("_art").startswith("Generic."), blank(F.col("CommandLine")))))
    cmd = F.when(win, F.coalesce(d("CommandLine"), blank(F.col("Cmdline")))).otherwise(F.coalesce(F.when(F.col("_art").startswith("Generic."), blank(F.col("CommandLine"))), blank(F.col("Cmdline"))))
    seconds = lambda c: F.timestamp_micros((c.try_cast("double") * 1_000_000).cast("long"))
    named = F.concat(F.lit("Velociraptor flow "), "flow_id")
    flow_title = F.concat(F.coalesce(named, F.lit("Velociraptor event")), F.when(F.size(F.coalesce("artifacts", F.array().cast("array<string>"))) > 0, F.concat(F.lit(": "), F.array_join("artifacts", ", "))).otherwise(""))
    title = (F.when(win & F.col("_eid").isNull(), F.concat(F.lit("Velociraptor Windows event: "), "_art"))
             .when(win, F.concat(F.lit("Windows EventID "), F.col("_eid").cast("string"), F.lit(": "), F.coalesce(F.get(row, F.lit(1)), F.col("_art"))))
             .when(lst, F.concat(F.lit("Velociraptor artifact: "), "_art")).otherwise(flow_title))
    auid = F.when(win, F.col("_eid").cast("string")).when(lst, F.col("_art")).otherwise(blank(F.col("flow_id")))
    return event(
        out, keep, **_class(F.when(lst, 1007).otherwise(2001)), severity_id=sev, metadata_product=F.lit("Velociraptor"), metadata_uid=blank(F.col("flow_id")),
        time=F.when(win, iso_time(F.col("_when"))).when(lst, F.coalesce(seconds(F.col("Timestamp")), iso_time(F.col("Timestamp")), iso_time(F.col("TimeCreated")))).otherwise(F.coalesce(seconds(F.col("create_time")), iso_time(F.col("create_time")))),
        src_endpoint=endpoint(uid=F.when(~win & ~lst, blank(F.col("client_id")))),
        dst_endpoint=endpoint(hostname=F.when(win, F.coalesce(blank(F.col("System.Computer")), blank(F.col("Computer")))).when(lst, blank(F.col("Hostname")))),
        actor_user=user(name=F.when(win, F.coalesce(d("SubjectUserName"), d("TargetUserName"), blank(F.col("Username")))).otherwise(blank(F.col("Username"))),
                        domain=F.when(win, F.coalesce(d("SubjectDomainName"), d("TargetDomainName")))),
        process=process(name=F.when(win, exe_name(path)).otherwise(blank(F.col("Name"))), path=path, cmd_line=cmd,
                        pid=F.when(win, hex_or_int(F.coalesce(d("NewProcessId"), F.col("Pid")))).otherwise(F.col("Pid").try_cast("int")),
                        parent_pid=F.when(win, hex_or_int(F.coalesce(d("ProcessId"), F.col("PPid")))).otherwise(F.col("PPid").try_cast("int"))),
        finding_info=finding(title=title, severity_id=sev, analytic=analytic(auid, F.when(win | lst, F.col("_art")).otherwise(title)), attacks=_one_attack(row)),
        raw=F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), unmapped=traffic(state=F.col("state"), artifacts=F.array_join("artifacts", ","), create_time=F.col("create_time"), Timestamp=F.col("Timestamp")))


# ------------------------------------------------------------------------------------- overrides


def mapping_from_config(config) -> dict[str, str]:
    """Overrides from a YAML text, a wrapped mapping or a flat one; anything else means none."""
    if isinstance(config, str):
        try:
            import yaml

            config = yaml.safe_load(config)
        except Exception:
            return {}
        config = {"field_mappings": config.get("field_mappings")} if isinstance(config, Mapping) else {}
    if not isinstance(config, Mapping):
        return {}
    inner = config.get("field_mappings", config)
    return {k: v for k, v in inner.items() if isinstance(k, str) and isinstance(v, str)} if isinstance(inner, Mapping) else {}


def apply_field_mapping(ev: DataFrame, config) -> DataFrame:
    """'event.path <- raw.path' overrides; a missing raw value keeps the default."""
    for dest, source in mapping_from_config(config).items():
        value = F.get_json_object("raw", "$." + source)
        top, _, rest = dest.partition(".")
        if top not in schema.EVENT:
            continue
        if not rest:
            ev = ev.withColumn(top, F.coalesce(value.try_cast(schema.EVENT[top]), F.col(top)))
        elif schema.EVENT[top].startswith("map"):
            ev = ev.withColumn(top, F.when(value.isNull(), F.col(top)).otherwise(F.map_concat(F.map_filter(F.coalesce(top, F.create_map().cast("map<string,string>")), lambda k, v: k != rest), F.create_map(F.lit(rest), value))))
        else:
            kind = dict(ev.select(f"{top}.*").dtypes).get(rest)
            if kind:
                ev = ev.withColumn(top, F.col(top).withField(rest, F.coalesce(value.try_cast(kind), F.col(f"{top}.{rest}"))))
    return ev


def event_checks() -> list[tuple[str, Column, str]]:
    """No time or class is a schema error, an out-of-range severity a normalisation error."""
    return [
        ("schema_validation", F.col("time").isNull(), "time missing or unreadable"), ("schema_validation", F.col("class_uid").isNull(), "class missing"),
        ("normalization_error", ~F.coalesce(F.col("severity_id").between(0, 6), F.lit(False)), "severity out of range")]


def split_valid(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) by event_checks."""
    from wardlake.operators.normalize import split_dead_letters

    return split_dead_letters(ev, event_checks(), F.col("metadata_product"))


def mark_valid(ev: DataFrame) -> DataFrame:
    """The events with error_type and error beside them, both null where an event is valid."""
    from wardlake.operators.normalize import mark_dead_letters

    return mark_dead_letters(ev, event_checks())
