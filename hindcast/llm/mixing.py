"""Mixing sources to target weights by Pfair scheduling.

A source with weight w must have its block k in the mix no earlier than slot floor(k / w) (release)
and before slot ceil((k + 1) / w) (deadline). One block per slot, always the released one with the
earliest deadline, meets all of them, so at every slot each source is less than one block away from
its share.

Weights are whole parts of a cycle of D slots. After D slots every source has its parts exactly and
the schedule repeats, so only one cycle is computed: one row of built-in array functions, bounded by
the parts. A block's slot then follows from its number by arithmetic and a join with the cycle.

NULL sources are a source of their own. Repeated rows are further rows of their source. An empty
table gives no rows. Rows are taken from a source in md5 order of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import numbered

PARTS = 1_000
BLOCK_ROWS = 4
# The cycle has at most PARTS + 1.5 x sources rows of about 60 bytes; with more sources than this it
# is not broadcast.
BROADCAST_SOURCES = 10_000


def _parts(parts: int) -> Column:
    """Whole parts of a source's weight rows^(3/4): large sources are damped, each has at least one."""
    weight = F.sqrt("_rows") * F.sqrt(F.sqrt("_rows"))
    everything = Window.partitionBy(F.lit(1))
    return F.greatest(
        F.lit(1), F.floor(F.lit(float(parts)) * weight / F.sum(weight).over(everything) + 0.5)
    ).cast("int")


def _cycle(sources: DataFrame) -> DataFrame:
    """Per source its parts, its slots in a cycle of _d, and _end, the slot at which the mix ends.

    The sequential choice happens inside `aggregate` on one row that holds sources, not documents.
    """
    row = sources.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("_group", "_parts", "_blocks"))).alias("s"),
        F.sum("_parts").cast("int").alias("_d"),
    ).where("_d > 0")
    chosen = F.expr(
        """
        aggregate(
          sequence(0, _d - 1),
          named_struct('c', array_repeat(0, size(s)), 'p', cast(array() as array<int>)),
          (a, t) -> transform(array(array_min(transform(a.c, (k, i) ->
              if(k * _d div s[i]._parts <= t,
                 named_struct('due', ceil((k + 1) * _d / s[i]._parts), 'i', i), null))).i),
            x -> named_struct('c', transform(a.c, (k, i) -> if(i = x, k + 1, k)),
                              'p', array_append(a.p, x)))[0],
          a -> a.p)
        """
    )
    picks = row.withColumn("p", chosen).select("s", "_d", F.posexplode("p").alias("_slot", "i"))
    source = F.col("s")[F.col("i")]
    return picks.groupBy(source["_group"].alias("_source_group")).agg(
        F.first(source["_parts"]).alias("target_parts"),
        F.first(source["_blocks"]).alias("_blocks"),
        F.first("_d").alias("_d"),
        F.sort_array(F.collect_list("_slot")).alias("_slots"),
    ).withColumn(
        # The first slot whose source has no block left ends the mix.
        "_end",
        F.min(
            F.expr("_blocks div target_parts * _d + _slots[cast(_blocks % target_parts as int)]")
        ).over(Window.partitionBy(F.lit(1))),
    )


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    ties: list[str] | None = None,
    parts: int = PARTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`docs` with target_parts, cycle_parts, block, release, deadline, position and mixed.

    position is the slot of the row's block; mixed is true below the first slot whose source has run
    out, up to which every prefix keeps the target weights. Later rows stay in the result, unmixed;
    ordered by position they go on with the weights of the sources that are left.
    One exchange of `docs`; the counts of sources are a few small aggregates.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    counts = docs.groupBy(group.alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    sources = counts.select(
        "_group",
        _parts(parts).alias("_parts"),
        F.ceil(F.col("_rows") / block_rows).cast("long").alias("_blocks"),
    )
    cycle = _cycle(sources)
    if counts.count() <= BROADCAST_SOURCES:
        cycle = F.broadcast(cycle)
    ranked = numbered(docs, "_row", F.col(key), ties or [key], F.col(source)).withColumn("_group", group)
    joined = ranked.join(cycle, F.col("_group") == F.col("_source_group")).withColumn(
        "block", F.expr(f"_row div {int(block_rows)}")
    )
    slot = "block div target_parts * _d + _slots[cast(block % target_parts as int)]"
    return joined.withColumns(
        {
            "cycle_parts": F.col("_d"),
            "release": F.expr("block * _d div target_parts"),
            "deadline": F.expr("((block + 1) * _d + target_parts - 1) div target_parts"),
            "position": F.expr(slot),
            "mixed": F.expr(f"{slot} < _end"),
        }
    ).drop("_row", "_group", "_source_group", "_slots", "_d", "_end", "_blocks")
