"""Scalar expressions on the values of events: entities, addresses, names, numbers, times."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
# Letters of an IPv6 address with its one double colon; enough to tell it from a name.
IPV6 = r"^(?=.*:.*:)(?!.*::.*::)(?!.*:::)[0-9A-Fa-f:]{2,39}(%[0-9A-Za-z]+)?$"
HOST_KINDS = ["host", "Computer", "WorkstationName", "Workstation"]
HEX_FIELDS = ["GrantedAccess", "AccessMask", "Status", "SubStatus", "FailureCode", "TicketEncryptionType", "TicketOptions", "UserAccountControl"]
IP_FIELDS = ["IpAddress", "SourceIp", "DestinationIp", "SourceAddress", "DestAddress", "ClientAddress"]
DASHES = "[‐-―−]"


def strip(column: Column) -> Column:
    """Without white space at the ends, tabs and line breaks too."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def filled(column: Column) -> Column:
    """Null for what counts as empty: null, "" and "-"."""
    return F.when(~column.isin("", "-"), column)


def pick(columns: list[Column]) -> Column:
    """The first that holds something, else ""."""
    return F.coalesce(*[filled(c.cast("string")) for c in columns], F.lit(""))


def is_ip(column: Column) -> Column:
    return F.coalesce(column.rlike(IPV4) | column.rlike(IPV6), F.lit(False))


def ip_version(column: Column) -> Column:
    return F.when(is_ip(column), F.when(column.contains(":"), 6).otherwise(4))


def canon_hex(column: Column) -> Column:
    """0x numbers in small letters without padding; anything else as it is."""
    bare = strip(column)
    return F.when(bare.rlike("(?i)^0x[0-9a-f]+$"), F.regexp_replace(F.lower(bare), "^0x0*(?=.)", "0x")).otherwise(bare)


def unmapped_ip(column: Column) -> Column:
    return F.regexp_replace(column, "(?i)^::ffff:", "")


def without_port(column: Column) -> Column:
    """`:port` dropped where there is one colon."""
    one = F.length(column) - F.length(F.replace(column, F.lit(":"), F.lit(""))) == 1
    return F.when(one, F.split_part(column, F.lit(":"), F.lit(1))).otherwise(column)


def plain_text(column: Column) -> Column:
    """Unicode dashes to `-`, runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, DASHES, "-"), r"\s+", " "))


def entity(column: Column, host: Column | bool = False) -> Column:
    """The form in which entities are compared: small letters, the account of `DOMAIN\\user` and `user@domain`, hosts without DNS suffix; `cn=` names whole."""
    low = F.lower(strip(column))
    name = F.substring_index(F.substring_index(low, "\\", -1), "@", 1)
    is_host = F.lit(host) if isinstance(host, bool) else host
    short = F.when(is_host & ~is_ip(name), F.split_part(name, F.lit("."), F.lit(1))).otherwise(name)
    return F.when(low.startswith("cn="), low).otherwise(short)


def short_host(column: Column) -> Column:
    """Text before the first dot unless it is digits and dots."""
    return F.when(column.rlike("^[0-9.]*$"), column).otherwise(F.split_part(column, F.lit("."), F.lit(1)))


def show_hidden(column: Column) -> Column:
    return F.replace(column, F.lit("‮"), F.lit("[U+202E]"))


def indicator_kind(column: Column) -> Column:
    return F.when(is_ip(column), "IP Address").when(column.contains("\\") | F.lower(column).endswith(".exe"), "Process").when(F.upper(column).startswith("CN="), "Directory Object").otherwise("Workstation/Domain")


def domains(host: Column, principals: list[Column]) -> Column:
    """The domains an event belongs to: the host's suffix if it has two dots and isn't digits, and those of user@domain names; sorted, small letters."""
    low = F.lower(strip(host))
    suffix = F.when((F.size(F.split(low, r"\.")) >= 3) & ~low.rlike(r"^[0-9.]+$"), F.regexp_extract(low, r"^[^.]*\.(.+)$", 1))
    upn = [F.nullif(F.regexp_extract(F.lower(strip(p)), r"@(.+)$", 1), F.lit("")) for p in principals]
    return F.sort_array(F.array_distinct(F.array_compact(F.array(suffix, *upn))))


def slug(kind: Column, norm: Column) -> Column:
    """A stable page name of an entity."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(F.lower(norm), "[^a-z0-9._-]+", "_"), "^_+|_+$", ""), 1, 60)
    return F.concat(kind, F.lit("-"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("x")), F.lit("-"), F.substring(F.sha1(norm), 1, 6))


def level_rank(column: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ["informational", "low", "medium", "high", "critical"])), column).cast("int")


@F.pandas_udf(StringType())
def uuid5(names: pd.Series) -> pd.Series:
    """Deterministic UUIDs of the project's namespace."""
    space = uuid.uuid5(uuid.NAMESPACE_DNS, "lanternlog.example")
    return names.map(lambda n: None if n is None else str(uuid.uuid5(space, n)))


@F.pandas_udf(StringType())
def _repaired(values: pd.Series) -> pd.Series:
    """normalize.fix_mojibake for SQL users."""

    def one(text: str | None) -> str | None:
        if not text or not re.search("â€|Ã|Â", text):
            return text
        try:
            return str(bytes(text, "cp1252"), "utf-8")
        except UnicodeError:
            return text

    return values.map(one)


def register(spark) -> None:
    """The functions that SQL users need, under `ll_` names."""
    spark.udf.register("ll_fix_mojibake", _repaired)
    spark.udf.register("ll_uuid5", uuid5)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ll_norm_entity(v STRING, host BOOLEAN) RETURNS STRING RETURN CASE WHEN lower(trim(v)) LIKE 'cn=%' THEN lower(trim(v)) WHEN host AND NOT substring_index(substring_index(lower(trim(v)), '\\\\', -1), '@', 1) RLIKE '^[0-9.]+$' THEN split_part(substring_index(substring_index(lower(trim(v)), '\\\\', -1), '@', 1), '.', 1) ELSE substring_index(substring_index(lower(trim(v)), '\\\\', -1), '@', 1) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ll_canon_hex(v STRING) RETURNS STRING RETURN CASE WHEN trim(v) RLIKE '(?i)^0x[0-9a-f]+$' THEN concat('0x', regexp_replace(lower(substring(trim(v), 3)), '^0+(?=.)', '')) ELSE trim(v) END")
