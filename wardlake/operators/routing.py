"""Which channels an alert goes to: routing rules as an inverted index over the values alerts carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import scoring
from wardlake.session import settle

FIELDS = ("severity", "tactic", "technique_id", "host", "rule_name")
OPERATORS = ("eq", "ne", "in", "contains", "regex")
_RULES = "array<struct<field: string, operator: string, value: string>>"
_PROFILE = "_profile"


def routing_tests(channels: DataFrame, rules: str = "routing_rules") -> DataFrame:
    """(channel_id, field, operator, values): one row per usable rule of a channel.

    ``rules`` holds a JSON list of objects with field, operator and value. A list of values belongs
    to ``in`` alone, and ``in`` takes nothing else. A channel without rules takes every alert: it
    gets one row with the operator ``any``. Rules with an unknown field or operator, without a value
    or with a pattern that does not compile never match, so they give no row; a channel that has
    only such rules gets nothing, and neither does one whose rules are not a JSON list.
    """
    parsed = channels.select(F.col("id").alias("channel_id"), F.col(rules).alias("_text"), F.from_json(rules, _RULES).alias("_rules"))
    open_to_all = F.coalesce(F.trim("_text"), F.lit("")).isin("", "null", "[]")
    every = parsed.where(open_to_all).select(
        "channel_id", F.lit("severity").alias("field"), F.lit("any").alias("operator"), F.array().cast("array<string>").alias("values"))
    rule = parsed.where(~open_to_all).select("channel_id", F.explode("_rules").alias("r")).select("channel_id", "r.*")
    listed = F.from_json("value", "array<string>")
    values = F.when(F.col("operator") == "in", listed).otherwise(F.array("value"))
    # an unparsable pattern makes the call fail, which try_reflect turns into NULL
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("value")).isNotNull()
    usable = F.col("field").isin(*FIELDS) & F.col("operator").isin(*OPERATORS) & F.col("value").isNotNull()
    rule = rule.where(usable & ((F.col("operator") != "regex") | compiles)).withColumn("values", F.filter(values, lambda v: v.isNotNull()))
    return every.unionByName(rule.where(F.size("values") > 0).select("channel_id", "field", "operator", "values"))


def _facets(tactics: Column, techniques: Column) -> Column:
    """The values of each routing field of a profile, in the case rules compare them in; a field without values is left out."""
    def one(name: str, values: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), values.alias("vals"))

    def many(values: Column, fold) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: fold(F.coalesce(v, F.lit(""))))))

    single = [one(n, F.array(F.lower(F.coalesce(F.col(n), F.lit(""))))) for n in ("severity", "host", "rule_name")]
    return F.filter(F.array(*single, one("tactic", many(tactics, F.lower)), one("technique_id", many(techniques, F.upper))), lambda f: F.size(f["vals"]) > 0)


def match_facets(facets: DataFrame, tests: DataFrame, block: int = 256, salts: int = 16) -> DataFrame:
    """(field, vals, channel_id) for distinct facets (field, vals) that meet a test of the channel.

    Equality and list tests are an index: values of facets meet values of tests by an equality join.
    The other tests have no key to look up, so they lie in rows of ``block`` tests per field which
    each distinct facet of the field reads once; only matching channels leave a row. The rows are
    repeated over ``salts`` so that a field's facets spread over that many keys.
    """
    value = F.explode("vals").alias("value")
    # rules are compared in lower and in upper case, whichever the field is kept in
    keyed = tests.where(F.col("operator").isin("eq", "in")).select(
        "channel_id", "field", F.explode(F.flatten(F.transform("values", lambda v: F.array(F.lower(v), F.upper(v))))).alias("value")).distinct()
    by_value = facets.select("field", "vals", value).join(keyed, ["field", "value"]).select("field", "vals", "channel_id")

    scanned = tests.where(F.col("operator").isin("ne", "contains", "regex", "any")).select(
        "field", "channel_id", F.struct("channel_id", "operator", F.get("values", F.lit(0)).alias("value")).alias("t"))
    # channels are dealt to as many blocks as keep each near the wanted size
    sizes = scanned.groupBy("field").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    blocks = scanned.join(sizes, "field").groupBy("field", F.pmod(F.xxhash64("t"), F.col("_blocks")).alias("_block")).agg(F.collect_list("t").alias("_tests"))
    blocks = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def meets(t: Column) -> Column:
        v = t["value"]
        return (F.when(t["operator"] == "any", F.lit(True))
                .when(t["operator"] == "ne", F.forall("vals", lambda x: (x != F.lower(v)) & (x != F.upper(v))))
                .when(t["operator"] == "contains", F.exists("vals", lambda x: F.contains(x, F.lower(v))))
                .otherwise(F.exists("vals", lambda x: F.rlike(x, F.concat(F.lit("(?i)"), v)))))

    salted = facets.withColumn("_salt", F.pmod(F.xxhash64("vals"), F.lit(salts)))
    scan = salted.join(blocks, ["field", "_salt"]).select("field", "vals", F.explode(F.filter("_tests", meets)).alias("t")).select("field", "vals", "t.channel_id")
    return by_value.unionByName(scan).distinct()


def route(alerts: DataFrame, channels: DataFrame, tactics: str = "tactic_ids", techniques: str = "technique_ids", rules: str = "routing_rules") -> DataFrame:
    """alerts x channel_id: every enabled channel at or under the alert's severity of which one routing rule matches.

    Alerts are reduced to distinct profiles (severity, host, rule, tactics, techniques) and those to
    distinct facets, the values of one field; tests meet facets only. The way back joins by equality.
    Profiles and tests are settled, as both are read several times: alerts are read twice in all.
    ``ne`` holds when no value equals; a field without values fails every test. As published,
    ``contains`` looks for the lower-cased text, so letters never match in technique ids, and
    patterns ignore case. Unknown severities rank lowest. Columns used of alerts: severity, host,
    rule_name and the two arrays.
    """
    live = channels.where("enabled")
    tests = settle(routing_tests(live, rules))
    floors = live.select(F.col("id").alias("channel_id"), scoring.level_rank(F.col("min_severity")).alias("_floor"))
    fields = ["severity", "host", "rule_name", tactics, techniques]
    key = F.md5(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\x00")).alias(f"_{i}") for i, f in enumerate(fields)])))
    keyed = alerts.withColumn(_PROFILE, key)
    profiles = keyed.select(_PROFILE, *fields).distinct()
    profiles = profiles.select(_PROFILE, scoring.level_rank(F.col("severity")).alias("_rank"), F.explode(_facets(F.col(tactics), F.col(techniques))).alias("f"))
    profiles = settle(profiles.select(_PROFILE, "_rank", "f.field", "f.vals"))
    matched = match_facets(profiles.select("field", "vals").distinct(), tests).join(floors, "channel_id")
    pairs = profiles.join(matched, ["field", "vals"]).where("_rank >= _floor").select(_PROFILE, "channel_id").distinct()
    return keyed.join(pairs, _PROFILE).drop(_PROFILE)
