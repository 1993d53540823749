"""String helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shannon_entropy(text: Column) -> Column:
    """Bits per character over the whole string; 0 for ''."""
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    # occurrences by native string replacement rather than by comparing characters one by one
    parts = F.transform(chars, lambda c: n - F.length(F.replace(text, c)))
    bits = F.aggregate(parts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    return F.when(F.length(text) > 0, bits).otherwise(F.lit(0.0))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters and columns may use many times.

    They come out of a generator, which the optimizer does not merge into what follows, so a
    costly expression is neither repeated nor grown into code too large to compile.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def first_label(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def human_bytes(value: Column) -> Column:
    """Units by integer division: 1536 -> '1.0 KB'."""
    out = F.when(F.abs(value) < 1024, F.concat(value.cast("string"), F.lit(".0 B")))
    rest = value
    for unit in ("KB", "MB", "GB"):
        rest = F.floor(rest / 1024).cast("long")
        out = out.when(F.abs(rest) < 1024, F.concat(rest.cast("string"), F.lit(f".0 {unit}")))
    rest = F.floor(rest / 1024).cast("long")
    return out.otherwise(F.concat(rest.cast("string"), F.lit(".0 TB")))


def exe_name(path: Column) -> Column:
    return F.when(F.length(path) > 0, F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))


def sha256_of(hashes: Column) -> Column:
    """The SHA256 part of 'SHA1=..,MD5=..,SHA256=..'."""
    found = F.regexp_extract(hashes, r"(?i)(?:^|,)\s*SHA256=([^,]*)", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def hex_or_int(text: Column) -> Column:
    t = text.cast("string")
    return F.when(F.lower(t).startswith("0x"), F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("long")).otherwise(t.try_cast("long"))


def glob_regex(glob: Column) -> Column:
    """fnmatch glob (* and ?) -> anchored regular expression."""
    quoted = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))
