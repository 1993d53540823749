"""Endpoint severities and exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.net import any_of

# fixed values
SENSITIVE_PATHS = ["/etc/passwd", "/etc/shadow", "/etc/sudoers", "/etc/ssh/", "/usr/bin/", "/usr/sbin/"]
BACKDOOR_PORTS = [4444, 5555, 6666, 8888, 1337, 31337]
SENSITIVE_KEYS = ["currentversion/run", "image file execution options", "control/lsa", "knowndlls"]


def severity_file(path: Column) -> Column:
    return F.when(any_of([path.startswith(p) for p in SENSITIVE_PATHS]), "high").otherwise("low")


def severity_conn(port: Column, state: Column) -> Column:
    return F.when(port.isin(*BACKDOOR_PORTS), "high").when((state == "ESTABLISHED") & (port > 10000), "medium").otherwise("informational")


def severity_registry(key: Column) -> Column:
    low = F.lower(F.translate(key, "\\", "/"))
    return F.when(any_of([low.contains(k) for k in SENSITIVE_KEYS]), "high").otherwise("medium")


def severity_auth(status: Column, method: Column) -> Column:
    return F.when(status == "Failure", "medium").when(method.isin("sudo", "su"), "low").otherwise("informational")


def auth_activity(outcome: Column) -> Column:
    return F.when(outcome == "Logoff", F.struct(F.lit("Logoff").alias("name"), F.lit(2).alias("id"))).otherwise(F.struct(F.lit("Logon").alias("name"), F.lit(1).alias("id")))


def excluded(name: Column, patterns: list[str]) -> Column:
    """'*suffix' or exact name."""
    return any_of([name.endswith(p[1:]) if p.startswith("*") else name == p for p in patterns])
