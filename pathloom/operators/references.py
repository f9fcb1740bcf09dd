"""References to records that do not exist, and what hangs on the records that make them.

A reference names a key of a parent table at a time. It is a direct orphan if no span of existence
of that key covers the time. A record with an orphaned reference is an orphaned record; references
to it are inherited orphans, and so are the records that make those. The cascade follows the
foreign-key graph by semi-joins from the newly orphaned records only, until a round finds none.

Long tables are used throughout:

* references (child, rec, field, parent, ref, at): ``rec`` names the record of table ``child``;
* spans (parent, key, added_at, removed_at): ``removed_at`` null means not removed;
* identity (table, parent, key, rec): the record of ``table`` that a key of ``parent`` names, for
  tables that are children too (``parent`` is the name under which references know the key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ensure_checkpoint_dir


def direct_orphans(references: DataFrame, spans: DataFrame) -> DataFrame:
    """The references without a living parent, with ``reason``.

    missing: no span has the key. deleted: a span of it has ended by ``at``. late: all begin later.
    A null ``ref`` is no reference. A null ``at`` asks for the key at any time, so it can only be
    missing. Spans with null ``added_at`` never begin. Repeated references stay repeated, repeated
    spans change nothing. A key that many references share is split by the adaptive skew join;
    the spans of a key are never gathered.
    """
    spans = spans.where("key is not null").select("parent", F.col("key").alias("ref"), "added_at", "removed_at").distinct()
    ends = spans.groupBy("parent", "ref").agg(F.min("removed_at").alias("first_end"), F.lit(True).alias("known"))
    refs = references.where("ref is not null").alias("r")
    s = spans.alias("s")
    alive = (
        (F.col("r.parent") == F.col("s.parent"))
        & (F.col("r.ref") == F.col("s.ref"))
        & (F.col("r.at").isNull() | ((F.col("s.added_at") <= F.col("r.at")) & (F.col("s.removed_at").isNull() | (F.col("s.removed_at") > F.col("r.at")))))
    )
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("first_end") <= F.col("at"), "deleted").otherwise("late")
    return refs.join(s, alive, "left_anti").join(ends, ["parent", "ref"], "left").select("child", "rec", "field", "parent", "ref", "at", reason.alias("reason"))


def orphan_cascade(references: DataFrame, spans: DataFrame, identity: DataFrame) -> DataFrame:
    """All orphaned references, each once: (child, rec, field, parent, ref, at, reason, kind, depth).

    ``kind`` is direct (depth 0) or inherited (the depth is the round that reached it; ``reason``
    is then parent). A reference, with its parent and time, that is a direct orphan is not an
    inherited one too; another reference of the same record may be. A cycle of tables or of records
    ends, since a record starts no second round. References are stored once in the shared checkpoint
    folder, and so are the records that each round newly reaches; a round reads the records of the
    rounds before by their keys alone.
    """
    ensure_checkpoint_dir(references.sparkSession)
    references = references.checkpoint().where("ref is not null")
    columns = ["child", "rec", "field", "parent", "ref", "at"]
    direct = direct_orphans(references, spans).checkpoint()
    found = direct.withColumn("depth", F.lit(0))
    seen = frontier = direct.select("child", "rec").distinct()
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        keys = identity.join(frontier, (identity.table == frontier.child) & (identity.rec == frontier.rec), "left_semi").select("parent", F.col("key").alias("ref")).distinct()
        reached = references.join(keys, ["parent", "ref"], "left_semi").select(*columns, F.lit("parent").alias("reason"), F.lit(depth).alias("depth")).checkpoint()
        frontier = reached.select("child", "rec").distinct().join(seen, ["child", "rec"], "left_anti").checkpoint()
        found, seen = found.unionByName(reached), seen.unionByName(frontier)
    # exchanged explicitly: the children of a union may not be aligned
    first = F.min(F.struct("depth", "reason")).alias("first")
    each = found.repartition("ref", "rec").groupBy(*columns).agg(first)
    kind = F.when(F.col("first.depth") == 0, "direct").otherwise("inherited").alias("kind")
    return each.select(*columns, "first.reason", kind, "first.depth")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphaned references per table, field, month and kind; a null time has a null month."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return orphans.groupBy(F.col("child").alias("table"), "field", month, "kind", "reason").agg(F.count("*").alias("refs"), F.countDistinct("rec").alias("records"))
