"""References to records that do not exist, no longer exist or do not exist yet.

Scale: a reference table of any size is reduced to its distinct non-null keys (map-side combine) before
it meets the parents; orphan keys come from a left anti-join of these, late and deleted ones from an inner
join that keeps only keys some reference can be judged by. The flagged keys, few and unique, are joined
back to the references. A key that holds a large part of all references is one row in the first two joins
and is split by AQE's skew handling in the last, an inner join whose other side has it once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class References:
    """A table that refers to parents by ``scope`` and each of ``fields``."""

    name: str
    frame: DataFrame
    ref_id: str
    scope: str
    fields: Sequence[str]
    seen_at: str


@dataclass(frozen=True)
class Parents:
    frame: DataFrame
    scope: str
    key: str
    seen_at: str
    deleted_at: str | None = None


def gather(tables: Sequence[References]) -> DataFrame:
    """Every reference once, at its earliest arrival: (ref_table, ref_id, ref_field, scope, key, seen_at).
    Null keys are no references. A later delivery under the same id that names another key is another reference."""
    out = None
    for t in tables:
        df = t.frame
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), df[f].alias("key")) for f in t.fields]))
        part = df.select(F.lit(t.name).alias("ref_table"), df[t.ref_id].alias("ref_id"), df[t.scope].alias("scope"), df[t.seen_at].alias("seen_at"), pairs.alias("p"))
        part = part.select("ref_table", "ref_id", "p.ref_field", "scope", "p.key", "seen_at").where("key is not null")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("ref_table", "ref_id", "ref_field", "scope", "key").agg(F.min("seen_at").alias("seen_at"))


def find_orphans(tables: Sequence[References], parents: Parents) -> DataFrame:
    """(ref_table, ref_id, ref_field, scope, key, seen_at, reason) of every reference that does not hold.

    reason is ``missing`` if no parent has the scope and key (a null scope never matches), else ``late`` if the
    reference arrived before the parent's first delivery, else ``deleted`` if the parent's earliest deletion is
    at or before the reference's arrival. An unknown time proves neither. Repeated parents count once; empty
    parents make all references ``missing``.
    """
    # scope and key as one value that is never null: no join adds a filter of its own, so all three uses of the
    # references share one shuffle
    both = lambda: F.struct("scope", "key").alias("id")
    refs = gather(tables).select("ref_table", "ref_id", "ref_field", both(), "seen_at")
    p = parents.frame
    never = F.lit(None).cast(p.schema[parents.seen_at].dataType)
    deleted = p[parents.deleted_at] if parents.deleted_at else never
    held = p.select(p[parents.scope].alias("scope"), p[parents.key].alias("key"), p[parents.seen_at].alias("s"), deleted.alias("d"))
    held = held.where("scope is not null and key is not null").groupBy(both()).agg(F.min("s").alias("first_seen"), F.min("d").alias("first_deleted"))
    keys = refs.groupBy("id").agg(F.min("seen_at").alias("from"), F.max("seen_at").alias("to"))
    missing = keys.join(held, "id", "left_anti").select("id", "from", "to", F.lit(True).alias("absent"), never.alias("first_seen"), never.alias("first_deleted"))
    doubtful = keys.join(held, "id").where("`from` < first_seen or `to` >= first_deleted").select("id", "from", "to", F.lit(False).alias("absent"), "first_seen", "first_deleted")
    flagged = missing.unionByName(doubtful)
    reason = F.when(F.col("absent"), "missing").when(F.col("seen_at") < F.col("first_seen"), "late").when(F.col("first_deleted") <= F.col("seen_at"), "deleted")
    joined = refs.join(flagged, "id")
    return joined.select("ref_table", "ref_id", "ref_field", "id.scope", "id.key", "seen_at", reason.alias("reason")).where("reason is not null")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per table, field, reason and month: (ref_table, ref_field, reason, ref_month, n_references, n_keys)."""
    month = F.date_format("seen_at", "yyyy-MM").alias("ref_month")
    per_key = orphans.groupBy("ref_table", "ref_field", "reason", month, "scope", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "ref_field", "reason", "ref_month").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
