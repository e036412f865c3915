"""History tables: every version of a row with its validity, as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scan import block_column, last_before, windowed

# Fixed value: stands in for minus infinity, the start of rows that exist before history begins
# (a day into year 1, so that no local time zone moves it out of the range of Python dates).
BEGINNING = "0001-01-02 00:00:00"
HISTORY_COLUMNS = ("valid_from", "valid_to", "changed_by")


def _time(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


def init_history(df: DataFrame, key: str | list[str], user: str | None = None) -> DataFrame:
    """Add the surrogate key, start, end and user; rows count as open since ever.

    Exactly one key column is needed.  The surrogate is a hash of key and start, so it survives a re-run."""
    keys = [key] if isinstance(key, str) else list(key)
    if len(keys) != 1:
        raise ValueError("a history table needs exactly one key column")
    if keys[0] not in df.columns:
        raise ValueError(f"no column {keys[0]!r}")
    out = (df.withColumn("valid_from", F.lit(BEGINNING).cast("timestamp")).withColumn("valid_to", F.lit(None).cast("timestamp"))
           .withColumn("changed_by", F.lit(user).cast("string")))
    return with_surrogate(out, keys[0])


def with_surrogate(h: DataFrame, key: str) -> DataFrame:
    return h.withColumn("version_id", F.xxhash64(key, "valid_from"))


def current(h: DataFrame) -> DataFrame:
    return h.where(F.col("valid_to").isNull())


def at_time(h: DataFrame, t) -> DataFrame:
    """State of the table at a time: start included, end excluded."""
    t = _time(t)
    return h.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def apply_changes(h: DataFrame, changes: DataFrame, key: str, op: str = "op", ts: str = "ts", seq: list[str] = (), user: Column | str | None = None) -> DataFrame:
    """New state of a history table after a batch of changes.

    ``changes`` holds the key, ``op`` (I, U or D), ``ts`` and the payload columns of
    the table.  Changes of one key apply in the order of ``ts`` and ``seq``.  An
    insert or update closes the open version at its time and opens a new one; a
    delete closes the open version.  An update or delete of a key without an open
    version is ignored.  Closed rows and open rows of keys without changes pass through
    unsorted; a key with very many changes is cut into pieces of its timeline."""
    payload = [c for c in h.columns if c not in (*HISTORY_COLUMNS, "version_id", key)]
    who = F.lit(user).cast("string") if user is None or isinstance(user, str) else user
    new = changes.select(F.col(key), *[F.col(c) for c in payload], F.col(op).alias("_op"), F.lit(1).alias("_o"), F.col(ts).cast("timestamp").alias("_t"),
                         *[F.col(c).alias(f"_s{i}") for i, c in enumerate(seq)], who.alias("changed_by"))
    closed = h.where(F.col("valid_to").isNotNull())
    changed = new.select(F.col(key).alias("_k")).distinct()
    still = current(h).join(changed, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    # open versions come before all changes of their key
    touched = current(h).join(changed, F.col(key).eqNullSafe(F.col("_k")), "left_semi").select(key, *payload, F.lit("B").alias("_op"), F.lit(0).alias("_o"), F.col("valid_from").alias("_t"),
                                *[F.lit(None).cast(changes.schema[c].dataType).alias(f"_s{i}") for i, c in enumerate(seq)], "changed_by")
    log = touched.unionByName(new)
    order = ["_o", "_t", *[f"_s{i}" for i in range(len(seq))]]
    # a version is open before a change when the last insert / base row has not been deleted since
    # (an update keeps what it finds, so only I, B and D decide)
    block = block_column(new, [key], order)   # an open version adds one row to a key
    log = last_before(log, [key], order, F.when(F.col("_op") != "U", F.col("_op")), "_state", block)
    live = log.where(F.col("_op").isin("I", "B") | F.coalesce(F.col("_state").isin("I", "B"), F.lit(False)))
    # every remaining event ends the version before it
    live = windowed(live, [key], order, {"valid_to": lambda w: F.lead("_t").over(w)}, after=1, block=block)
    out = live.where(F.col("_op") != "D").select(key, *payload, F.col("_t").alias("valid_from"), "valid_to", "changed_by")
    return with_surrogate(closed.select(out.columns).unionByName(still.select(out.columns)).unionByName(out), key)


def changes_between(h: DataFrame, t1, t2, key: str) -> DataFrame:
    """Keys inserted, updated or deleted between two times, from the two states; a NULL key is a key like any other."""
    a = at_time(h, t1).select(F.col(key).alias("_k1"), F.col("valid_from").alias("_f1"), F.lit(True).alias("_in1"))
    b = at_time(h, t2).select(F.col(key).alias("_k2"), F.col("valid_from").alias("_f2"), F.lit(True).alias("_in2"))
    j = a.join(b, F.col("_k1").eqNullSafe(F.col("_k2")), "full")
    kind = F.when(F.col("_in1").isNull(), "inserted").when(F.col("_in2").isNull(), "deleted").when(~F.col("_f1").eqNullSafe(F.col("_f2")), "updated")
    return j.select(F.when(F.col("_in1"), F.col("_k1")).otherwise(F.col("_k2")).alias(key), kind.alias("change")).where(F.col("change").isNotNull())
