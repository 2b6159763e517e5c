"""Finding new rows by several alternative keys, in arrival order, without collecting groups.

The rule is sequential: a row is taken if none of its keys belongs to an existing row or to
a row taken before it. Only taken rows claim their keys. The result equals a greedy
independent set in arrival order, which is found here in rounds of keyed aggregates:

1. rows that arrive first on every one of their keys are taken;
2. rows that share a key with a taken row are duplicates;
3. the rest goes on to the next round.

Every step is a map-side combined aggregate or an equi-join on narrow (row, key) pairs, so a
key shared by a third of all rows is one more aggregate buffer, not one huge group.

A chain of rows that wait for one another would take a round for each link. What is open after a few rounds is therefore
parted into connected components, by smallest labels and pointer jumping, so in a number of steps that grows with the
logarithm of the chain. Components of a bounded size are settled in arrival order, each inside one group; only larger ones
go on in rounds.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.operators.merge import left_lookup
from wayfolio.operators.ordered import first_per_key
from wayfolio.session import materialize

ACCEPTED = "accepted"
KNOWN = "duplicate_existing"
REPEATED = "duplicate_batch"


SEPARATOR = "\u0001"
#: Rounds before what is open is parted into components, and the (row, key) pairs of a component that one group settles.
ROUNDS = 3
GROUP_PAIRS = 200_000


def _key_set(keys: dict[str, Column]) -> Column:
    """All keys of a row as one text, each with its kind as prefix; null keys are left out."""
    return F.concat_ws(SEPARATOR, *[F.concat(F.lit(f"{kind}:"), keys[kind]) for kind in sorted(keys)])


def _each(key_set: str = "_set") -> Column:
    return F.split(key_set, SEPARATOR)


def _round(edges: DataFrame) -> DataFrame:
    """One round over the open (_row, _all, _key) pairs: the same pairs with a ``_state``."""
    # min over (row, number of its keys) says in one aggregate who leads a key.
    leads = edges.groupBy("_key").agg(F.min(F.struct("_row", "_all")).alias("_lead")).select("_key", "_lead.*")
    winners = leads.groupBy("_row", "_all").agg(F.count(F.lit(1)).alias("_leads")).filter("_leads = _all").select("_row")
    claimed = leads.join(winners, "_row", "left_semi").select("_key", F.col("_row").alias("_owner"))
    beaten = edges.join(claimed, "_key").filter("_row <> _owner").select("_row").distinct()
    decided = winners.withColumn("_state", F.lit(ACCEPTED)).unionByName(beaten.withColumn("_state", F.lit(REPEATED)))
    return edges.join(decided, "_row", "left")


def _components(edges: DataFrame) -> DataFrame:
    """(_row, _label) of the open rows: the smallest row that can be reached over shared keys.

    In a step a row takes the smallest label of the rows it shares a key with, then the label of that label, twice over.
    """
    pairs = edges.select("_row", "_key")
    labels = pairs.select("_row").distinct().withColumn("_label", F.col("_row"))
    while True:
        near = pairs.join(labels, "_row").groupBy("_key").agg(F.min("_label").alias("_near"))
        low = pairs.join(near, "_key").groupBy("_row").agg(F.min("_near").alias("_to")).join(labels, "_row")
        low = materialize(low.select("_row", F.col("_label").alias("_old"), "_to"))

        def jumped(far: DataFrame) -> DataFrame:
            next_one = far.select(F.col("_row").alias("_to"), F.col("_to").alias("_beyond"))
            return far.join(next_one, "_to").select("_row", "_old", F.col("_beyond").alias("_to"))

        low = materialize(jumped(jumped(low)))
        labels = low.select("_row", F.col("_to").alias("_label"))
        if low.filter("_to <> _old").isEmpty():
            return labels


def _in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule over one component."""
    claimed, rows, states = set(), [], []
    for row, keys in pairs.sort_values("_row").groupby("_row", sort=False)["_key"]:
        own = set(keys)
        states.append(REPEATED if own & claimed else ACCEPTED)
        rows.append(row)
        if states[-1] == ACCEPTED:
            claimed |= own
    return pd.DataFrame({"_row": rows, "_state": states})


def _settled(edges: DataFrame) -> DataFrame:
    """The open (_row, _all, _key) pairs with a ``_state``, where their component is small enough for one group."""
    labels = _components(edges)
    labelled = edges.select("_row", "_key").join(labels, "_row")
    small = labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= GROUP_PAIRS).select("_label")
    row = next(f.dataType.simpleString() for f in edges.schema if f.name == "_row")
    decided = labelled.join(small, "_label", "left_semi").groupBy("_label").applyInPandas(_in_order, f"_row {row}, _state string")
    return edges.join(decided, "_row", "left")


def claimed_keys(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The distinct keys of stored rows, as one narrow column."""
    return df.select(_key_set(keys).alias("_set")).select(F.explode(_each()).alias("_key")).filter("_key <> ''").distinct()


def dedupe_incoming(
    new: DataFrame, existing: DataFrame | None, keys: dict[str, Column], order: str = "arrival",
    max_rounds: int | None = None, claimed: DataFrame | None = None,
) -> DataFrame:
    """``new`` with an ``outcome`` column: accepted, duplicate_existing or duplicate_batch.

    ``order`` must be unique. ``keys`` are expressions valid on both sides; a caller that keeps
    the keys of stored rows passes them as ``claimed`` instead of the rows.
    """
    if existing is not None:
        stored = claimed_keys(existing, keys)
        claimed = stored if claimed is None else claimed.unionByName(stored)
    keyed = new.withColumn("_set", _key_set(keys))
    # Rows with the same keys share one fate after the first of them, so one row speaks for all.
    firsts = keyed.groupBy("_set").agg(F.min(order).alias("_row"))
    edges = firsts.select("_row", F.size(_each()).alias("_all"), F.explode(_each()).alias("_key")).filter("_key <> ''")
    state = F.lit(None).cast("string")
    if claimed is not None:
        known = edges.join(claimed, "_key", "left_semi").select("_row").distinct().withColumn("_state", F.lit(KNOWN))
        marked = edges.join(known, "_row", "left")
    else:
        marked = edges.withColumn("_state", state)

    # Each round stores its outcome once; lost executors re-read it instead of replaying the rounds.
    marked = materialize(marked)
    outcomes = [marked.filter("_state is not null")]
    open_edges, rounds = marked.filter("_state is null").drop("_state"), 0
    while not open_edges.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        marked = materialize(_settled(open_edges) if rounds == ROUNDS else _round(open_edges))
        rounds += 1
        outcomes.append(marked.filter("_state is not null"))
        open_edges = marked.filter("_state is null").drop("_state")

    decided = reduce(DataFrame.unionByName, outcomes)
    spoken = decided.groupBy("_row", "_state").agg(F.sort_array(F.collect_list("_key")).alias("_keys")).select(
        F.concat_ws(SEPARATOR, "_keys").alias("_set"), F.col("_row").alias("_first"), "_state"
    )
    outcome = (
        F.when(F.col("_set") == "", F.lit(ACCEPTED))
        .when((F.col("_state") == KNOWN) | (F.col(order) == F.col("_first")), F.col("_state"))
        .otherwise(F.lit(REPEATED))
    )
    return left_lookup(keyed, spoken, "_set").withColumn("outcome", outcome).drop("_set", "_first", "_state")


def accepted_rows(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("outcome") == ACCEPTED).drop("outcome")


def insert_ignore(new: DataFrame, existing: DataFrame, on: list[str], order: str = "arrival") -> DataFrame:
    """Rows to insert: first per lower-cased key in the batch, then not present under the exact key."""
    # Missing parts read as one fixed word inside the batch, as text joining does.
    folded = [F.lower(F.coalesce(F.col(c), F.lit("null"))) for c in on]
    keyed = new.withColumn("_fold", F.concat_ws("|", *folded))
    firsts = first_per_key(keyed, ["_fold"], [order]).drop("_fold")
    return firsts.join(existing.select(*on).distinct(), on, "left_anti")
