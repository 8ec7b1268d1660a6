"""Identity: tenants, artifacts, chunks, and the mandatory tenant scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.text import col

_UUID = r"^\{?(urn:)?(uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def _dashed(hex32: Column) -> Column:
    return F.concat_ws(
        "-",
        F.substring(hex32, 1, 8),
        F.substring(hex32, 9, 4),
        F.substring(hex32, 13, 4),
        F.substring(hex32, 17, 4),
        F.substring(hex32, 21, 12),
    )


def tenant_id(value: Column | str, prefix: str = fv.TENANT_PREFIX) -> Column:
    """A UUID passes through in canonical form; a name maps to its version-5 UUID."""
    v = col(value)
    digest = F.sha1(
        F.concat(
            F.unhex(F.lit(fv.DNS_NAMESPACE.replace("-", ""))),
            F.concat(F.lit(prefix), v).cast("binary"),
        )
    )
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))
    )
    named = F.concat(
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        variant,
        F.substring(digest, 18, 15),
    )
    bare = F.regexp_replace(F.lower(v), r"urn:|uuid:|[{}-]", "")
    return F.when(F.lower(v).rlike(_UUID), _dashed(bare)).otherwise(_dashed(named))


def joined_key(*parts) -> Column:
    """The parts in one text that no other parts give: separators inside them are escaped, null is marked."""
    def safe(part):
        return F.coalesce(F.replace(F.replace(col(part).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))

    return F.concat_ws("|", *[safe(p) for p in parts])


def ask_keys(*frames: DataFrame) -> list[str]:
    """What names a query: its tenant as well, wherever all the frames carry it."""
    return ["tenant_id", "query_id"] if all("tenant_id" in f.columns for f in frames) else ["query_id"]


def artifact_id(tenant="tenant_id", source_kind="source_kind", external_id="external_id") -> Column:
    return F.md5(joined_key(tenant, source_kind, external_id))


def chunk_id(artifact_id="artifact_id", content_hash="content_hash", ordinal="ordinal") -> Column:
    """Deterministic, and new whenever the artifact's content changes."""
    return F.md5(joined_key(artifact_id, content_hash, ordinal))


def scoped(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant.  No tenant, or an empty one, gives no rows at all."""
    return df.filter(F.col(column) == F.nullif(F.lit(tenant).cast("string"), F.lit("")))


def of_kinds(df: DataFrame, kinds, column: str = "source_kind") -> DataFrame:
    """Optional membership in ``kinds``; empty or None means every kind."""
    return df.filter(F.col(column).isin(list(kinds))) if kinds else df
