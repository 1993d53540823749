"""Detection rules as data: each rule compiles to one boolean Column over the event table.

Rules are configuration, read once on the driver. All compiled rules are evaluated in one scan
with no shuffle; each is guarded by its log-source class so that most rules cost one integer
comparison per event.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions.net import all_of, any_of, in_networks
from wardlake.functions.text import once

# fixed values: rule field names -> event columns, per rule category
ALIASES = {
    "process_creation": {"Image": "process.path", "CommandLine": "process.cmd_line", "ParentImage": "process.parent_name", "ParentCommandLine": "process.parent_cmd_line",
                         "User": "actor_user.name", "ProcessId": "process.pid", "ParentProcessId": "process.parent_pid", "Hashes": "process.hash_sha256"},
    "network_connection": {"DestinationIp": "dst_endpoint.ip", "DestinationPort": "dst_endpoint.port", "DestinationHostname": "dst_endpoint.hostname",
                           "SourceIp": "src_endpoint.ip", "SourcePort": "src_endpoint.port", "Protocol": "network_traffic.protocol",
                           "User": "actor_user.name", "Image": "process.path"},
    "dns_query": {"QueryName": "network_traffic.query", "QueryType": "network_traffic.query_type", "QueryResults": "network_traffic.answers",
                  "Image": "process.path", "User": "actor_user.name"},
    "authentication": {"TargetUserName": "actor_user.name", "IpAddress": "src_endpoint.ip", "WorkstationName": "src_endpoint.hostname",
                       "LogonType": "unmapped.logon_type", "Status": "unmapped.status"},
    "file_event": {"TargetFilename": "file.path", "FileName": "file.name", "Image": "process.path", "User": "actor_user.name", "Hashes": "file.hash_sha256"},
}
CATEGORY_CLASS = {v: k for k, v in fixed.LOGSOURCE_CATEGORY.items()}
# dotted event paths -> columns of the flat table
FLAT = {"process.path": "process_name", "process.name": "process_name", "process.cmd_line": "cmd_line", "actor_user.name": "username",
        "process.hash_sha256": "process_hash", "dst_endpoint.ip": "dst_ip", "dst_endpoint.port": "dst_port", "dst_endpoint.hostname": "hostname",
        "src_endpoint.ip": "src_ip", "src_endpoint.hostname": "hostname", "network_traffic.query": "domain", "network_traffic.query_type": "qtype"}


@dataclass
class Rule:
    id: str
    title: str
    detection: Mapping
    level: str = "medium"
    status: str = "stable"
    enabled: bool = True
    product: str | None = None
    category: str | None = None
    service: str | None = None
    techniques: list[str] = field(default_factory=list)
    tactics: list[str] = field(default_factory=list)


def rule_from_dict(doc: Mapping) -> Rule:
    """Rule document -> Rule; 'attack.tXXXX' tags are techniques, 'attack.taXXXX' tactics."""
    source, tags = doc.get("logsource") or {}, [str(t).lower() for t in doc.get("tags") or []]
    return Rule(
        id=str(doc["id"]), title=str(doc.get("title", "")), detection=doc["detection"], level=str(doc.get("level", "medium")),
        status=str(doc.get("status", "stable")), enabled=bool(doc.get("enabled", True)), product=source.get("product"),
        category=source.get("category"), service=source.get("service"),
        techniques=[t[7:].upper() for t in tags if re.fullmatch(r"attack\.t\d+(\.\d+)?", t)],
        tactics=[t[7:].upper() for t in tags if re.fullmatch(r"attack\.ta\d+", t)])


def load_rules(documents: Iterable[str | Mapping]) -> list[Rule]:
    """YAML texts or parsed documents; broken ones are left out, later ones replace earlier ids."""
    return read_rules(documents)[0]


def read_rules(documents: Iterable[str | Mapping]) -> tuple[list[Rule], list[str]]:
    """The rules of load_rules, and what is wrong with each document left out."""
    out: dict[str, Rule] = {}
    problems = []
    for at, doc in enumerate(documents):
        try:
            if isinstance(doc, str):
                import yaml

                doc = yaml.safe_load(doc)
            rule = rule_from_dict(doc)
        except Exception as e:
            problems.append(f"document {at}: {type(e).__name__}: {e}")
            continue
        out[rule.id] = rule
    return list(out.values()), problems


# ------------------------------------------------------------------------------- field matching


class Fields:
    """Resolves rule field names to columns of one event schema.

    ``lowered`` names columns that already have a lower-cased copy beside them.
    """

    def __init__(self, columns: Iterable[str], category: str | None = None, flat: Mapping[str, str] = FLAT, lowered: Iterable[str] = ()):
        self.columns, self.flat, self.lowered = set(columns), flat, set(lowered)
        self.alias = ALIASES.get("file_event" if (category or "").startswith("file_") else category or "", {})

    def name(self, field_name: str) -> str | None:
        for n in (field_name, self.alias.get(field_name)):
            if n is None:
                continue
            if n in self.columns:
                return n
            if "." in n and n.split(".")[0] in self.columns:  # a nested event: structs and maps are read by path
                return NESTED + n if NESTED + n in self.columns else n
            if self.flat.get(n) in self.columns:
                return self.flat[n]
        return None

    def __call__(self, field_name: str) -> Column | None:
        n = self.name(field_name)
        return None if n is None else _column(n)

    def low(self, field_name: str) -> Column | None:
        n = self.name(field_name)
        if n is None:
            return None
        return _column(LOW + n) if n in self.lowered else F.lower(_column(n).cast("string"))


LOW, NESTED = "_low_", "_of_"  # copies of columns: lower-cased, taken out of a struct or map


def _column(name: str) -> Column:
    return F.col(f"`{name}`" if name.startswith((LOW, NESTED)) else name)


def nested_fields(rules: Iterable[Rule], columns: Iterable[str]) -> list[str]:
    """Paths into structs and maps that the rules read, each once."""
    columns, found = list(columns), set()

    def visit(sel, fields: Fields) -> None:
        if isinstance(sel, Mapping):
            found.update(n for n in (fields.name(str(key).split("|")[0]) for key in sel) if n is not None and "." in n)
        elif isinstance(sel, (list, tuple)):
            for one in sel:
                visit(one, fields)

    for rule in rules:
        fields = Fields(columns, rule.category)
        for name, sel in rule.detection.items() if isinstance(rule.detection, Mapping) else ():
            if name != "condition":
                visit(sel, fields)
    return sorted(found)


@lru_cache(maxsize=100_000)
def _is_regex(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it; a rule with a broken one matches nothing and ends no job."""
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (Py4JJavaError, IllegalArgumentException):
        return False


def match_field(col: Column | None, modifiers: list[str], values, low: Column | None = None) -> Column:
    """One 'field|modifiers: values' entry; never NULL."""
    items = values if isinstance(values, (list, tuple)) else [values]
    if col is None:
        return F.lit(False)
    if values is None:
        return col.isNull()
    text = col.cast("string")
    low = F.lower(text) if low is None else low
    mods = [m for m in modifiers if m != "all"]
    join = all_of if "all" in modifiers else any_of

    def one(v) -> Column:
        s = str(v)
        if mods and mods[0] == "re":
            return low.rlike("(?i)" + s) if _is_regex(s) else F.lit(False)
        if mods and mods[0] == "cidr":
            return in_networks(text, [s])
        if mods and mods[0] == "base64":
            s64 = base64.b64encode(s.encode()).decode()
            kind = mods[1] if len(mods) > 1 else ""
            return {"contains": text.contains(s64), "startswith": text.startswith(s64), "endswith": text.endswith(s64)}.get(kind, text == s64)
        if mods and mods[0] in ("contains", "startswith", "endswith"):
            needle = F.lit(s.lower())
            return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[mods[0]](low, needle)
        if mods and mods[0] in ("gt", "gte", "lt", "lte"):  # numeric extension
            number, x = text.try_cast("double"), F.lit(float(s))
            return {"gt": number > x, "gte": number >= x, "lt": number < x, "lte": number <= x}[mods[0]]
        return low == s.lower()

    if not modifiers and len(items) > 1:
        return F.coalesce(low.isin(*[str(v).lower() for v in items]), F.lit(False))
    return F.coalesce(join([one(v) for v in items]), F.lit(False))


def match_keywords(words, columns: Iterable[str]) -> Column:
    """Any keyword is a substring of any value of the event."""
    items = words if isinstance(words, (list, tuple)) else [words]
    blob = F.lower(F.concat_ws("\x01", *[F.col(c).cast("string") for c in columns]))
    # bound once: the joined text is built one time however many keywords there are
    return F.exists(F.array(blob), lambda b: any_of([F.contains(b, F.lit(str(w).lower())) for w in items]))


def match_selection(sel, fields: Fields) -> Column:
    """A mapping is an AND of fields, a list of mappings an OR, anything else keywords."""
    if isinstance(sel, Mapping):
        preds = []
        for key, values in sel.items():
            name, *mods = key.split("|")
            preds.append(match_field(fields(name), mods, values, fields.low(name)))
        return all_of(preds)
    if isinstance(sel, (list, tuple)) and sel and all(isinstance(x, Mapping) for x in sel):
        return any_of([match_selection(x, fields) for x in sel])
    return match_keywords(sel, sorted(c for c in fields.columns if not c.startswith(NESTED)))


def read_condition(condition: str, names: Iterable[str]) -> tuple:
    """A condition as nested (operator, parts): ('and' | 'or', [...]), ('not', [one]), ('is', [selection]).

    Not binds closer than and, and closer than or; '1 of' and 'all of' take a name pattern or 'them', and are
    ('or', []), which is false, where no selection fits. Any name is read, 'from' and 'tool-1' too.
    """
    names = list(names)
    words = re.findall(r"[()]|[^\s()]+", condition)[::-1]

    def take() -> str:
        if not words:
            raise ValueError(f"condition ends early: {condition}")
        return words.pop()

    def joined(op: str, part) -> tuple:
        parts = [part()]
        while words and words[-1] == op:
            words.pop()
            parts.append(part())
        return parts[0] if len(parts) == 1 else (op, parts)

    def either() -> tuple:
        return joined("or", lambda: joined("and", single))

    def single() -> tuple:
        word = take()
        if word == "not":
            return "not", [single()]
        if word == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"parenthesis left open: {condition}")
            return inner
        if word in ("1", "all") and words and words[-1] == "of":
            words.pop()
            wanted = take()
            pattern = re.compile(".*" if wanted == "them" else re.escape(wanted).replace(r"\*", ".*"), re.IGNORECASE)
            fitting = [("is", [n]) for n in names if pattern.match(n)]
            return ("or" if word == "1" or not fitting else "and"), fitting
        if word not in names:
            raise ValueError(f"no selection named {word}: {condition}")
        return "is", [word]

    tree = either()
    if words:
        raise ValueError(f"cannot read {words[-1]}: {condition}")
    return tree


def match_condition(condition: str, selections: Mapping[str, Column]) -> Column:
    """Boolean algebra over selection names: not, and, or, parentheses, '1 of p*', 'all of p*', 'them'."""

    def build(tree: tuple) -> Column:
        op, parts = tree
        if op == "is":
            return selections[parts[0]]
        if op == "not":
            return ~build(parts[0])
        return (all_of if op == "and" else any_of)([build(p) for p in parts])

    return build(read_condition(condition, selections))


def compile_rule(rule: Rule, columns: Iterable[str], lowered: Iterable[str] = ()) -> Column:
    fields = Fields(columns, rule.category, lowered=lowered)
    names = {n: match_selection(sel, fields) for n, sel in rule.detection.items() if n != "condition"}
    return match_condition(str(rule.detection["condition"]), names)


def logsource_guard(rule: Rule) -> Column:
    """Events a rule is a candidate for: its product or its category's class; neither means all.

    A rule that names only a service is filed under a key no event carries, so it never fires.
    """
    guards = []
    if rule.product:
        guards.append(F.coalesce(F.lower("source") == rule.product.lower(), F.lit(False)))
    if rule.category in CATEGORY_CLASS:
        guards.append(F.coalesce(F.col("class_uid") == CATEGORY_CLASS[rule.category], F.lit(False)))
    return any_of(guards) if guards else F.lit(not (rule.product or rule.category or rule.service))


_COMPILED: dict[tuple, Column] = {}
_KEPT = 50_000  # compiled rules a driver keeps


def content_hash(rule: Rule) -> str:
    """The same for rules that compile to the same predicate."""
    return hashlib.sha256(json.dumps([rule.detection, rule.category], sort_keys=True, default=str).encode()).hexdigest()


def compiled(rule: Rule, columns: Iterable[str], lowered: Iterable[str] = ()) -> Column:
    """compile_rule, kept by the rule's content and the columns it was compiled for, so an unchanged rule is compiled once in a driver's life."""
    key = (content_hash(rule), tuple(columns), tuple(lowered))
    if key not in _COMPILED:
        if len(_COMPILED) >= _KEPT:
            _COMPILED.clear()
        _COMPILED[key] = compile_rule(rule, key[1], key[2])
    return _COMPILED[key]


def usable(rules: Iterable[Rule], columns: Iterable[str], lowered: Iterable[str] = ()) -> list[tuple[Rule, Column]]:
    """Enabled rules with their compiled predicate; a rule that does not compile is left out."""
    cols, out = list(columns), []
    for r in rules:
        if not r.enabled:
            continue
        try:
            out.append((r, compiled(r, cols, lowered)))
        except Exception:
            continue
    return out


def detect(ev: DataFrame, rules: Iterable[Rule], per_block: int = 200) -> DataFrame:
    """One row per (event, matching rule), from one scan.

    Rules are grouped by log source: a group's predicates are skipped whole for events of other
    sources. Fields of structs and maps are taken out and texts lower-cased once per event. The scan emits rule numbers; titles,
    levels and techniques are joined to the matches afterwards.
    """
    rules, own = list(rules), ev.columns
    ev = ev.withColumns({NESTED + path: F.col(path) for path in nested_fields((r for r in rules if r.enabled), own)})
    text = [f.name for f in ev.schema if f.dataType.typeName() == "string"]
    compiled = usable(rules, ev.columns, text)
    if not compiled:
        raise ValueError("no rule compiled")
    groups: dict[tuple, list[int]] = {}
    for i, (r, _) in enumerate(compiled):
        groups.setdefault((r.product, r.category, bool(r.service)), []).append(i)
    blocks = []
    for members in groups.values():
        guard = logsource_guard(compiled[members[0]][0])
        for at in range(0, len(members), per_block):
            hits = F.array_compact(F.array(*[F.when(compiled[i][1], F.lit(i)) for i in members[at:at + per_block]]))
            blocks.append(F.when(guard, hits).otherwise(F.array().cast("array<int>")))
    numbers = blocks[0] if len(blocks) == 1 else F.concat(*blocks)
    # outer: keeps the planner from deriving a filter that would evaluate every rule a second time
    hit = once(ev, **{LOW + c: F.lower(_column(c)) for c in text}).select(*own, F.explode_outer(numbers).alias("_rule")).where("_rule IS NOT NULL")
    return described(hit, [r for r, _ in compiled])


def described(hit: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches with the number of a rule in ``_rule`` -> with the rule's id, title, level, techniques and tactics."""
    about = hit.sparkSession.createDataFrame(
        [(i, r.id, r.title, r.level, fixed.SEVERITY_ID.get(r.level, 3), r.techniques, r.tactics) for i, r in enumerate(rules)],
        "_rule int, rule_id string, rule_title string, level string, alert_severity int, technique_ids array<string>, tactic_ids array<string>")
    return hit.join(about, "_rule").drop("_rule")


def backtest(ev: DataFrame, document: str | Mapping) -> tuple[DataFrame | None, list[str]]:
    """(matched events, problems) of one rule text over any event table."""
    try:
        if isinstance(document, str):
            import yaml

            document = yaml.safe_load(document)
        rule = rule_from_dict(document)
    except Exception as e:
        return None, [f"document: {e}"]
    try:
        pred = compile_rule(rule, ev.columns)
    except Exception as e:
        return None, [f"detection: {e}"]
    return ev.where(logsource_guard(rule) & pred), []


def candidate_counts(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidate rules per kind of event (source, class), each rule once.

    Rules are filed under product, category and, without a log source, the global key. Only the
    distinct kinds of events meet the rule keys, never the events themselves.
    """
    def key(kind: str, value: Column) -> Column:
        return F.concat(F.lit(kind + ":"), F.lower(value))

    no_source = F.when(F.coalesce("logsource_product", "logsource_category", "logsource_service").isNull(), F.lit("*"))
    filed = F.filter(F.array(key("product", F.col("logsource_product")), key("category", F.col("logsource_category")), no_source), lambda x: x.isNotNull())
    cat = F.create_map(*[x for k, v in fixed.LOGSOURCE_CATEGORY.items() for x in (F.lit(k), F.lit(v))])
    asked = F.filter(F.array(key("product", F.col("source")), key("category", F.try_element_at(cat, F.col("class_uid"))), F.lit("*")), lambda x: x.isNotNull())
    kinds = ev.groupBy("source", "class_uid").agg(F.count("*").alias("events"))
    # rules filed alike are counted first, so what meets the kinds grows with the log sources, not with the rules
    own = rules.where(F.col("id").isNotNull()).select("id", F.explode(filed).alias("key")).groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("_filed"))
    alike = own.groupBy("_filed").agg(F.count("*").alias("_n")).select("_filed", "_n", F.explode("_filed").alias("key"))
    pairs = kinds.withColumn("key", F.explode(asked)).join(alike, "key", "left")
    each = pairs.groupBy("source", "class_uid", "_filed").agg(F.max("events").alias("events"), F.max("_n").alias("_n"))
    return each.groupBy("source", "class_uid").agg(F.max("events").alias("events"), F.coalesce(F.sum("_n"), F.lit(0)).alias("candidates"))
