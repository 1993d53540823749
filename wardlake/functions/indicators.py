"""Indicator format checks and severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.net import is_ipv4

_DOMAIN = r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"


def is_valid_ioc(kind: Column, value: Column) -> Column:
    ok = (
        F.when(kind == "hash_md5", value.rlike("^[0-9a-fA-F]{32}$"))
        .when(kind == "hash_sha256", value.rlike("^[0-9a-fA-F]{64}$"))
        .when(kind == "url", value.rlike(r"^https?://\S+$"))
        .when(kind == "email", value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))
        .when(kind == "ip", is_ipv4(value) | value.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]+$"))
        .when(kind == "domain", value.rlike(_DOMAIN))
    )
    return F.coalesce(ok, F.lit(True))


def confidence_severity(confidence: Column) -> Column:
    return F.when(confidence >= 76, "critical").when(confidence >= 51, "high").when(confidence >= 26, "medium").otherwise("low")
