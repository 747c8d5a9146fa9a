"""Benchmark decontamination by templates: windows of typed tokens, hash-joined, slots checked.

Tokens are numbers and words. A token becomes a slot if it is a number, a unit after a number, or a
name (a capitalised word in the middle of a sentence); any other is taken in lower case. Windows of
WINDOW such tokens are matched by hash, so an item whose numbers or names were exchanged still
matches. The exchange must be consistent: within one occurrence an item's value always becomes the
same other value in the document (or stays), or only its windows of equal values count. A window of mostly slots says nothing as
a template and is matched with its values as they are. Any window also matches by its own tokens in
lower case, whatever was taken for a name, so verbatim copies are found in any case and layout.

NULL or short texts have no window and match nothing, as do items of fewer than MIN_TOKENS tokens.
Items between MIN_TOKENS and WINDOW tokens are one window of their own length. Repeated items are
reported each; repeated documents (same id) once. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.common import bind

WINDOW = 8
MIN_TOKENS = 5
MIN_COVERAGE = 0.5
# Windows of the benchmark are held on every executor up to this many, of about 100 bytes each;
# beyond it the join is left to the optimizer, which shuffles both sides by the window's hash.
BROADCAST_WINDOWS = 300_000

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft mi g kg mg t lb oz ml l s sec min h hr hours days weeks years "
    "kb mb gb usd eur dollars euros cents percent % $ €"
).split()

MARK = ""
_NAME = r"(?<=[\p{L}\p{N},;)] )\p{Lu}\p{Ll}\p{L}*"
_TOKEN = rf"[0-9]+(?:[.,][0-9]+)*|{MARK}?[\p{{L}}\p{{M}}]+|[%$€]"


def _tokens(text: Column) -> Column:
    """Raw tokens in lower case, names marked."""
    clean = F.translate(F.coalesce(text, F.lit("")), MARK, "")
    return F.regexp_extract_all(F.lower(F.regexp_replace(clean, _NAME, MARK + "$0")), F.lit(f"({_TOKEN})"), 1)


def _is_number(token: Column) -> Column:
    return F.ascii(token).between(48, 57)


def _typed(raw: Column) -> Column:
    def kind(token: Column, i: Column) -> Column:
        after_number = F.coalesce(_is_number(F.get(raw, i - 1)), F.lit(False))
        return (
            F.when(_is_number(token), "<number>")
            .when(token.startswith(MARK), "<name>")
            .when(after_number & token.isin(*UNITS), "<unit>")
            .otherwise(token)
        )

    return F.transform(raw, kind)


def _windows(text: Column, lengths: list[int]) -> Column:
    """array<struct<pos, h, slots>>; slots holds the raw values of the slots in order, or NULL.

    A window with slots is there twice: as a template, and without slots by its own tokens.
    """

    def cut(raw: Column, typed: Column, size: int, slotted: bool) -> Column:
        def window(i: Column) -> Column:
            part = F.slice(typed, i, size)
            if slotted:
                values = F.filter(
                    F.slice(raw, i, size),
                    lambda token, k: F.get(part, k).startswith("<"),
                )
                slots = F.when(F.size(values) > 0, values)
            else:
                slots = F.lit(None).cast("array<string>")
            return F.struct(
                (i - 1).alias("pos"), F.xxhash64(F.lit(size), part).alias("h"), slots.alias("slots")
            )

        def has_slots(i: Column) -> Column:
            return F.exists(F.slice(typed, i, size), lambda token: token.startswith("<"))

        def verbatim(i: Column) -> Column:
            own = F.transform(F.slice(raw, i, size), lambda token: F.translate(token, MARK, ""))
            return F.struct(
                (i - 1).alias("pos"), F.xxhash64(F.lit(size), own).alias("h"),
                F.lit(None).cast("array<string>").alias("slots"),
            )

        last = F.size(typed) - size + 1
        starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        found = F.transform(starts, window)
        if slotted:
            found = F.concat(found, F.transform(F.filter(starts, has_slots), verbatim))
        return F.when(last > 0, found).otherwise(
            F.array().cast("array<struct<pos:int,h:bigint,slots:array<string>>>")
        )

    def every(raw: Column, typed: Column, slotted: bool) -> Column:
        parts = [cut(raw, typed, size, slotted) for size in lengths]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def of(raw: Column) -> Column:
        has_slots = F.exists(raw, lambda token: _is_number(token) | token.startswith(MARK))
        return F.when(has_slots, bind(_typed(raw), lambda typed: every(raw, typed, True))).otherwise(
            every(raw, raw, False)
        )

    return bind(_tokens(text), of)


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, i_pos, h, i_slots, templated, n_windows, n_templates, size) of every item that has
    enough tokens; n_templates of its n_windows are templated."""
    sized = items.select(F.col(key).alias("item_id"), F.col(text).alias("t")).withColumn(
        "size", F.least(F.lit(WINDOW), F.size(_tokens(F.col("t"))))
    )
    parts = [
        sized.where(F.col("size") == size).select(
            "item_id", "size", F.explode(_windows(F.col("t"), [size])).alias("w")
        )
        for size in range(MIN_TOKENS, WINDOW + 1)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    # A window of slots alone says nothing: most of it must be literal, or its values must be equal.
    slots = F.max(F.coalesce(F.size("w.slots"), F.lit(0))).over(Window.partitionBy("item_id", "w.pos"))
    rows = rows.withColumn("_slots", slots).withColumn(
        "templated", F.col("size") - F.col("_slots") >= F.col("size") / 2 + 0.5
    )
    rows = rows.where(F.col("w.slots").isNull() | F.col("templated"))
    counted = rows.groupBy(F.col("item_id").alias("_i")).agg(
        F.count_distinct("w.pos").alias("n_windows"),
        F.count_distinct(F.when(F.col("templated"), F.col("w.pos"))).alias("n_templates"),
    )
    return rows.join(counted, F.col("item_id").eqNullSafe(F.col("_i"))).select(
        "item_id", F.col("w.pos").alias("i_pos"), "w.h", F.col("w.slots").alias("i_slots"), "templated",
        "n_windows", "n_templates", "size",
    )


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage, changed_slots) of leaked items.

    An item leaks into a document if the document has at least `min_coverage` of its windows, or of
    its templates, in consistent occurrences; an occurrence is a run with one offset between the two
    texts. coverage is the larger share of the two. Of an inconsistent occurrence the windows with
    equal values count.
    """
    wanted = item_windows(items)
    shape = wanted.groupBy("size").count().collect()  # at most WINDOW rows
    lengths = sorted(row["size"] for row in shape) or [WINDOW]
    if sum(row["count"] for row in shape) <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    found = docs.select(
        F.col(key).alias("doc_id"), F.explode(_windows(F.col(text), lengths)).alias("w")
    ).select("doc_id", "w.pos", "w.h", "w.slots")
    hits = found.join(wanted, "h").select(
        "doc_id", "item_id", "n_windows", "n_templates", (F.col("pos") - F.col("i_pos")).alias("offset"),
        F.struct("i_pos", "templated").alias("window"),
        F.filter(
            F.arrays_zip(F.col("i_slots").alias("i"), F.col("slots").alias("d")), lambda p: p["i"] != p["d"]
        ).alias("pairs"),
    )
    # Equal windows meet by their own tokens, without slots.
    equal = F.size(F.coalesce("pairs", F.array())) == 0
    runs = hits.groupBy("doc_id", "item_id", "n_windows", "n_templates", "offset").agg(
        F.collect_set("window").alias("at"),
        F.collect_set(F.when(equal, F.col("window"))).alias("equal"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs")
    return (
        runs.withColumn("changed", F.when(consistent, F.size("pairs")).otherwise(0))
        .withColumn("at", F.when(consistent, F.col("at")).otherwise(F.col("equal")))
        .where(F.size("at") > 0)
        .groupBy("doc_id", "item_id", "n_windows", "n_templates")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
            F.min("changed").cast("long").alias("changed_slots"),
        )
        .withColumn("matched_windows", F.size("at").cast("long"))
        .withColumn(
            "coverage",
            F.greatest(
                F.col("matched_windows") / F.col("n_windows"),
                F.size(F.filter("at", lambda w: w["templated"]))
                / F.when(F.col("n_templates") > 0, F.col("n_templates")),
            ),
        )
        .where(F.col("coverage") >= min_coverage)
        .select(
            "doc_id", "item_id", "matched_windows", F.col("n_windows").alias("item_windows"),
            "coverage", "changed_slots",
        )
    )
