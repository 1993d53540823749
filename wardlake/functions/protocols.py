"""Predicates over protocol logs: web, TLS, SSH, RDP, SMB, payload signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions.net import any_of, is_ipv4


def _has(col: Column, parts: list[str]) -> Column:
    return F.coalesce(any_of([F.contains(col, F.lit(p)) for p in parts]), F.lit(False))


def http_suspicious_request(uri: Column, agent: Column, method: Column, extra: list[str] | None = None) -> Column:
    bad_uri = _has(uri, fixed.URI_FRAGMENTS + ["\x00"] + (extra or [])) | _has(F.upper(uri), fixed.URI_UPPER_FRAGMENTS)
    bad_agent = F.coalesce(agent == "", F.lit(False)) | _has(F.lower(agent), fixed.SCANNER_AGENTS)
    return bad_uri | bad_agent | (agent.isNull() & F.coalesce(method == "POST", F.lit(False)))


def http_suspicious_response(length: Column, content_type: Column, server: Column) -> Column:
    large = (length > 10_000_000) & content_type.isNotNull() & ~_has(F.lower(content_type), fixed.MEDIA_TYPES)
    return F.coalesce(large, F.lit(False)) | _has(F.lower(server), fixed.OBSOLETE_SERVERS)


def tls_suspicious_sni(sni: Column, blocklist: list[str]) -> Column:
    blocked = any_of([(sni == b) | sni.endswith("." + b) for b in blocklist]) if blocklist else F.lit(False)
    return F.coalesce((sni == "") | (F.octet_length(sni) > 253) | sni.contains(":") | is_ipv4(sni) | blocked, F.lit(False))


def ssh_suspicious(proto_version: Column, software: Column, blocklist: list[str]) -> Column:
    listed = _has(F.lower(software), [b.lower() for b in blocklist]) if blocklist else F.lit(False)
    return F.coalesce(proto_version.startswith("1."), F.lit(False)) | F.coalesce(software == "", F.lit(False)) | listed


def rdp_suspicious(protocols: Column) -> Column:
    """Legacy security only, or TLS without network level authentication (bits 1 = TLS, 2 and 8 = NLA)."""
    tls_only = (protocols.bitwiseAND(1) != 0) & (protocols.bitwiseAND(2 | 8) == 0)
    return F.coalesce((protocols == 0) | tls_only, F.lit(False))


def smb_suspicious(version: Column, session_id: Column, command: Column, unsigned: Column) -> Column:
    """SMB1; a null session beyond negotiate (0); unsigned create 5, write 9, ioctl 11 or set-info 17."""
    null_session = (session_id == 0) & (F.coalesce(command, F.lit(-1)) != 0)
    return F.coalesce(version == "SMB1", F.lit(False)) | F.coalesce(null_session, F.lit(False)) | F.coalesce(unsigned & command.isin(5, 9, 11, 17), F.lit(False))


def expected_protocol(port: Column) -> Column:
    return F.coalesce(*[F.when(port.isin(*ports), F.lit(name)) for name, ports in fixed.EXPECTED_PROTOCOL.items()])


def observed_protocol(payload: Column) -> Column:
    """Protocol by the first bytes of a BINARY payload, in order TLS, HTTP, SSH, SMTP, FTP, DNS."""
    head = F.hex(F.substring(payload, 1, 16))

    def byte(i: int) -> Column:
        return F.conv(F.substring(head, 2 * i + 1, 2), 16, 10).try_cast("int")

    def starts(*texts: str) -> Column:
        return any_of([head.startswith(t.encode().hex().upper()) for t in texts])

    n = F.octet_length(payload)
    tls = (n >= 3) & byte(0).between(20, 24) & (byte(1) == 3)
    # flags: opcode in bits 3..6 of byte 2; question count in bytes 4 and 5
    opcode = F.shiftright(byte(2), 3).bitwiseAND(15)
    dns = (n >= 12) & (opcode <= 5) & ((byte(4) > 0) | (byte(5) > 0))
    return (
        F.when(tls, "tls")
        .when(starts("GET ", "POST ", "PUT ", "DELETE ", "HEAD ", "OPTIONS ", "PATCH ", "CONNECT ", "TRACE ", "HTTP/"), "http")
        .when(starts("SSH-"), "ssh").when(starts("220 ", "EHLO", "HELO", "MAIL FROM"), "smtp")
        .when(starts("USER ", "PASS ", "LIST", "RETR "), "ftp").when(dns, "dns")
    )


def proto_anomaly(port: Column, observed: Column) -> Column:
    """Severity of a payload that is not what its port stands for; NULL when nothing is wrong."""
    expected = expected_protocol(port)
    return F.when(expected.isNull() | (observed == expected), F.lit(None).cast("string")).when(observed.isNotNull(), "high").when(port.isin(*fixed.STRICT_PORTS), "medium")
