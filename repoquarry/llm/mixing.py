"""Mixing of sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in a shuffled order, are one stream, cut into blocks
of equal size. Slot k of the schedule has the point frac(k * golden ratio); the point falls
into the share of one source, and the r-th slot of a source takes the source's r-th block,
starting over at its end. So every stretch of the schedule holds the sources at their
weights, and nothing is drawn at random. A source that the points leave short of its target
by a block or so gets the missing slots after the last.

Defined cases: null and empty texts have no words, are never taken and are returned with
zeros; a null source is a source of its own, after the others. Repeated rows are different
documents that follow each other in the order. An empty table, or one without words, gives
targets of zero. Other columns pass through `mix_documents`, whatever their names.

Sources are never gathered in one task: streams are numbered by `running_totals`, slots by
their aligned runs of `RUN` slots, and shares of the unit interval are found through bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.llm.common import WORD, word_count
from repoquarry.operators.numbering import running_totals
from repoquarry.session import explode_all, materialise

GOLDEN = 0.6180339887498949
RUN = 1 << 12  # slots ranked by one task at most
BINS = 4096


def stream_positions(docs: DataFrame, size: Column, source: str, identity: list[str], seed: int):
    """Add `_n` (size), `_start` (words of the source before this document in a shuffled
    order) and `_of` (words of the source); `_row` tells rows apart. `docs` should be slim
    and is written twice."""
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity])
    rows = docs.select("*", size.alias("_n"), F.col(source).alias("_source"), order.alias("_order"))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    return running_totals(
        rows, ["_source"], ["_order", "_n", "_row"], F.col("_n"), "_start", "_of"
    )


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2
) -> DataFrame:
    """(_source, _of, _rank, _target, _take, _from) for a table of (_source, _of).

    Sources by code point, null last, get the weights in turn and share `share` times all
    words by weight. A target stops at `repeat` times its source; what it leaves goes to the
    others by weight until none is above. `_take` is the target in whole words, `_from` the
    sum of those before. Only two sums a round reach the driver.
    """
    keyed = sources.withColumn("_null", F.col("_source").isNull())
    ranked = running_totals(keyed, [], ["_null", "_source"], before="_rank").drop("total", "_null")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("_rank") % len(weights) + 1).cast("int"),
    )
    ranked = materialise(
        ranked.withColumn("_weight", weight).withColumn("_most", F.col("_of") * float(repeat)),
        "mix-sources",
    )
    total = ranked.agg(F.sum("_of")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("_most") <= F.col("_weight") * level
        room, open_weight = ranked.agg(
            F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))
        ).first()
        if not open_weight:
            break
        raised = (share * total - (room or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("_most"), F.col("_weight") * level)
    ranked = ranked.withColumn("_target", target)
    ranked = ranked.withColumn("_take", F.floor(F.col("_target") + 0.5).cast("bigint"))
    return running_totals(ranked, [], ["_rank"], F.col("_take"), "_from", "_all")


def slot_schedule(targets: DataFrame, block: int) -> DataFrame:
    """(_slot, _rank, _turn): the source of each slot, and the slot's number in it."""
    spark = targets.sparkSession
    words = targets.agg(F.sum("_take")).first()[0] or 0
    count = -(-words // block)
    points = spark.range(count).select(
        F.col("id").alias("_slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("_u")
    )
    word = F.floor(F.col("_u") * F.lit(float(words)))
    points = points.withColumn("_word", F.least(word, F.lit(words - 1)))
    width = max(1, -(-words // BINS))
    bins = F.sequence(
        F.floor(F.col("_from") / width), F.floor((F.col("_from") + F.col("_take") - 1) / width)
    )
    shares = targets.where("_take > 0").select(
        "_rank", "_from", "_take", F.explode(bins).alias("_bin")
    )
    inside = (F.col("_word") >= F.col("_from")) & (F.col("_word") < F.col("_from") + F.col("_take"))
    drawn = (
        points.withColumn("_bin", F.floor(F.col("_word") / width))
        .join(shares, "_bin")
        .where(inside)
        .select("_slot", "_rank", F.floor(F.col("_slot") / RUN).alias("_run"))
    )
    per_run = drawn.groupBy("_rank", "_run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_rank").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_run.select(
        "_rank", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    in_run = Window.partitionBy("_rank", "_run").orderBy("_slot")
    scheduled = (
        drawn.withColumn("_nth", F.row_number().over(in_run) - 1)
        .join(offsets, ["_rank", "_run"])
        .select("_slot", "_rank", (F.col("_before") + F.col("_nth")).alias("_turn"))
    )
    got = per_run.groupBy("_rank").agg(F.sum("_n").alias("_got"))
    need = F.ceil(F.col("_take") / block)
    short = (
        targets.where("_take > 0")
        .join(got, "_rank", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .where(need > F.col("_got"))
    )
    turns = F.explode(F.sequence(F.col("_got"), need - 1))
    late = short.select("_rank", turns.alias("_turn")).select(
        (F.lit(count) + F.col("_turn")).alias("_slot"), "_rank", "_turn"
    )
    return scheduled.unionByName(late)


def taken_pieces(placed: DataFrame, targets: DataFrame, schedule: DataFrame, block: int):
    """A row per document, pass over its source and block: `_slot` and the words `_a` to
    `_b` of the document that the slot takes. Documents of which nothing is taken keep one
    row with nulls."""
    of_source = targets.select(
        F.col("_source").alias("_s"), "_rank", "_target", F.col("_take").alias("_end")
    )
    known = placed.join(of_source, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")

    def one_pass(number: int) -> Column:
        start = F.col("_start") + F.col("_of") * number
        stop = F.least(start + F.col("_n"), F.col("_end"))
        blocks = F.sequence(F.floor(start / block), F.floor((stop - 1) / block))
        pieces = F.transform(
            blocks,
            lambda b: F.struct(
                F.lit(number).alias("pass"),
                b.alias("turn"),
                (F.greatest(start, b * block) - start).alias("a"),
                (F.least(stop, (b + 1) * block) - start).alias("b"),
            ),
        )
        return F.when(stop > start, pieces).otherwise(F.array())

    both = F.flatten(F.array(one_pass(0), one_pass(1)))
    cut = known.select("*", explode_all(both).alias("_i", "_p")).drop("_i")
    cut = cut.select(
        "*", F.col("_p.pass").alias("_pass"), F.col("_p.turn").alias("_t"),
        F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"),
    ).drop("_p")
    slots = schedule.select(F.col("_rank").alias("_r"), F.col("_turn"), "_slot")
    met = (F.col("_rank") == F.col("_r")) & (F.col("_t") == F.col("_turn"))
    return cut.join(slots, met, "left").drop("_r", "_turn")


def mixed_words(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, block: int = 256,
                seed: int = 7) -> DataFrame:
    """(id, size, source_size, target, taken) for every document."""
    slim = docs.select(
        F.col(id).alias("_id"), F.col(source).alias("_src"), word_count(F.col(text)).alias("_size"),
        F.xxhash64(F.col(id), F.col(text)).alias("_content"),
    )
    placed = stream_positions(slim, F.col("_size"), "_src", ["_content"], seed)
    sources = placed.groupBy("_source").agg(F.max("_of").alias("_of"))
    targets = source_targets(sources, weights, share)
    pieces = taken_pieces(placed, targets, slot_schedule(targets, block), block)
    words = F.when(F.col("_slot").isNotNull(), F.col("_b") - F.col("_a")).otherwise(0)
    return (
        pieces.groupBy("_row", "_id", "_n", "_of", "_target")
        .agg(F.sum(words).cast("bigint").alias("taken"))
        .select(
            F.col("_id").alias(id), F.col("_n").alias("size"), F.col("_of").alias("source_size"),
            F.col("_target").alias("target"), "taken",
        )
    )


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
                  weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, block: int = 256,
                  seed: int = 7) -> DataFrame:
    """The documents of the mix: a row for each time one is taken, with the columns of
    `docs`. At the end of its source's target a document is cut at a word, with its white
    space kept; all others are whole."""
    whole = materialise(
        docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_key")),
        "mix-rows",
    )
    slim = whole.select(
        "_key", F.col("_doc")[source].alias("_src"),
        word_count(F.col("_doc")[text]).alias("_size"),
        F.xxhash64(F.col("_doc")[id], F.col("_doc")[text]).alias("_content"),
    )
    placed = stream_positions(slim, F.col("_size"), "_src", ["_content"], seed)
    sources = placed.groupBy("_source").agg(F.max("_of").alias("_of"))
    targets = source_targets(sources, weights, share)
    pieces = taken_pieces(placed, targets, slot_schedule(targets, block), block)
    taken = (
        pieces.where("_slot IS NOT NULL")
        .groupBy("_key", "_pass", "_n")
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
        .withColumnRenamed("_key", "_k")
    )
    rows = whole.join(taken, F.col("_key") == F.col("_k"))
    words = F.regexp_extract_all(F.col("_doc")[text], F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    first = (F.col("_a") + 1).cast("int")
    part = F.array_join(F.slice(words, first, (F.col("_b") - F.col("_a")).cast("int")), "")
    cut = F.when(F.col("_b") - F.col("_a") < F.col("_n"), part).otherwise(F.col("_doc")[text])
    return rows.select(*[cut.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
