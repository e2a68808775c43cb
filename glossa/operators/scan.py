"""Running values over ordered rows of a key, in blocks: no key's rows meet in one task or one array, however many there are.

A state is told by two columns: where it starts anew (``reset``) and what it takes (``value``). After a row it is the first value given since the last
reset. Such steps compose - (r1, v1) then (r2, v2) is (true, v2) if r2, else (r1, coalesce(v1, v2)) - and composing is associative, so rows are
cut into blocks by their order: each block is scanned alone, then the blocks of a key (``size`` times fewer), and what enters a block
is added to its rows. "The last value so far" is the state that a given value resets. Sums run the same way.

All states of a block are told in one sorted pass: a value is taken if no other was given since the last reset, and the last value taken
is the state unless a reset came behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources.work import settle

BLOCK = 4096


def blocks(rows: DataFrame, order: str, size: int = BLOCK) -> DataFrame:
    """``rows`` with the ``_block`` they are in. Rows that have one keep it through ``running``, and the order they were dealt in with it."""
    return rows.withColumn("_block", F.floor(F.col(order) / size).cast("long"))


def _scan(rows: DataFrame, by: Sequence[str], order: str, states: dict[str, tuple[Column | None, Column]], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, of what stands before each row, ``_since_`` and ``_took_`` of each state and ``_sum_``; all over one order. What a row makes of it follows from its own columns."""
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col
    found = {f"_sum_{s}": F.coalesce(F.sum(v).over(over), F.lit(0)) for s, v in sums.items()}
    plain = {s: value for s, (reset, value) in states.items() if reset is None}
    states = {s: given for s, given in states.items() if s not in plain}
    found |= {f"_took_{s}": F.last(value, ignorenulls=True).over(over) for s, value in plain.items()}
    for s, (reset, value) in states.items():
        found |= {f"_since_{s}": F.max(F.when(reset, n(order))).over(over), f"_given_{s}": F.max(F.when(value.isNotNull(), n(order))).over(over)}
    out, took = rows.withColumns(found), {}
    for s, (reset, value) in states.items():
        since = F.when(reset, n(order)).otherwise(n(f"_since_{s}"))
        takes = value.isNotNull() & (n(f"_given_{s}").isNull() | F.coalesce(n(f"_given_{s}") < since, F.lit(False)))
        took[f"_took_{s}"] = F.last(F.when(takes, F.struct(n(order).alias("at"), value.alias("value"))), ignorenulls=True).over(over)
    return out.withColumns(took).drop(*[f"_given_{s}" for s in states])


def _told(state: str, reset: Column | None) -> Column:
    """The state before a row by its own block's rows."""
    since, took = F.col(f"_since_{state}"), F.col(f"_took_{state}")
    return took if reset is None else F.when(since.isNull() | (took["at"] >= since), took["value"])


def _after(before: Column, reset: Column | None, value: Column) -> Column:
    return F.coalesce(value, before) if reset is None else F.when(reset, value).otherwise(F.coalesce(before, value))


def running(
    rows: DataFrame, by: Sequence[str], order: str, states: dict[str, tuple[Column | None, Column]] | None = None, sums: dict[str, Column] | None = None, size: int = BLOCK, store: str | None = None,
) -> DataFrame:
    """``rows`` with ``name`` and ``name``_before for each of ``states`` (reset, value), after and before each row; ``name`` for each of ``sums``, before each row.

    ``order`` is a whole number and no two rows of a key share one; rows without a key are left out. A state that no row has given is null, a sum starts at 0.
    Where ``reset`` is None every value given is one: the state is the last of them, which is told with less work.
    With ``store`` what enters the blocks, a row each, is written under that name: a later scan of the rows does not find it out again. Rows are not written, and dealt once for all scans by one block.
    """
    states, sums = states or {}, sums or {}
    n = F.col
    inside = [*by, "_block"]
    out = rows if "_block" in rows.columns else blocks(rows, order, size)
    out = _scan(out.where(" and ".join(f"`{c}` is not null" for c in by)), inside, order, states, sums)
    out = out.withColumn("_end", F.lead(order).over(Window.partitionBy(*inside).orderBy(order)).isNull())
    news = {f"_new_{s}": reset | n(f"_since_{s}").isNotNull() for s, (reset, _) in states.items() if reset is not None}
    leaves = out.where("_end").select(*inside, *[c.alias(k) for k, c in news.items()], *[_after(_told(s, states[s][0]), *states[s]).alias(f"_own_{s}") for s in states], *[(n(f"_sum_{s}") + v).alias(f"_all_{s}") for s, v in sums.items()])
    enters = _scan(leaves, by, "_block", {s: (n(f"_new_{s}") if f"_new_{s}" in news else None, n(f"_own_{s}")) for s in states}, {s: n(f"_all_{s}") for s in sums})
    enters = enters.select(*inside, *[_told(s, states[s][0]).alias(f"_in_{s}") for s in states], *[n(f"_sum_{s}").alias(f"_in_{s}") for s in sums])
    enters = enters.where(" or ".join([f"_in_{s} is not null" for s in states] + [f"_in_{s} <> 0" for s in sums]))
    enters = settle(enters, store) if store else enters
    # A row a block and key: many keys make it large, so it is no side for a broadcast; a hash of it leaves the rows where they lie.
    out = out.join(enters.hint("shuffle_hash"), inside, "left")
    entered = lambda s, told: F.coalesce(told, f"_in_{s}") if f"_new_{s}" not in news else F.when(n(f"_since_{s}").isNotNull(), told).otherwise(F.coalesce(f"_in_{s}", told))
    out = out.withColumns({f"{s}_before": entered(s, _told(s, states[s][0])) for s in states})
    out = out.withColumns({s: _after(n(f"{s}_before"), *states[s]) for s in states} | {s: F.coalesce(f"_in_{s}", F.lit(0)) + n(f"_sum_{s}") for s in sums})
    own = [] if "_block" in rows.columns else ["_block"]
    return out.drop("_end", *own, *[f"_{p}_{s}" for s in states for p in ("since", "took", "in") if f"_{p}_{s}" in out.columns], *[f"_{p}_{s}" for s in sums for p in ("sum", "in")])
