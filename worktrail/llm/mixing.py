"""Mixing sources to target weights by a low-discrepancy schedule.

A source's target is its weight's share of all words, up to `most_epochs`
times its size; what is over is shared again by weight until none is above.
Weights repeat over the sources in code point order, null last.

Each source's documents are laid end to end in a shuffled order (by a digest
of the id) and cut into blocks of equally many words. Slot i of the mix has
the golden-ratio point frac(i * phi), which cumulative block counts map to a
source; the k-th slot of a source takes its k-th block, starting over after
the last. Every source gets as many slots as its target needs, its last block
cut to the word: what the points leave open is added at the end of the mix.

Offsets and ranks are sums over chunks of a digest or of slot numbers, so no
source is ever one task; single-task windows see one row per source. All is
in DataFrame operations and depends on the rows alone, so reruns agree.

Null texts have no words, null ids count as empty text, null sources are a
source. Rows without words are never taken. Rows that repeat an id are taken
each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrail.llm.common import WORD_PATTERN, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 1024
LEAST_SLOTS = 65_536
SLOT_CHUNK = 65_536
POINT_CELLS = 1024
# Fixed value: the golden ratio's fraction to 18 digits.
GOLDEN = Decimal("0.618033988749894848")


@dataclass
class Mixture:
    sources: DataFrame  # source_no, source, source_size, weight, target, quota (words taken), blocks, slots, first_slot
    rows: DataFrame  # id, own (text hash), source_no, size, off (of the first word in the source's order)
    slots: DataFrame  # slot, source_no, block, first, last (words of the source's order)
    block_words: int

    def pieces(self) -> DataFrame:
        """(slot, source_no, off, first, last): word ranges of documents that a slot takes."""
        b = F.lit(self.block_words)
        parts = self.rows.where("size > 0").select(
            "source_no", "off", "size",
            F.explode(F.sequence(F.floor(F.col("off") / b), F.floor((F.col("off") + F.col("size") - 1) / b))).alias("block"),
        )
        first, last = F.greatest("off", "first"), F.least(F.col("off") + F.col("size"), "last")
        return parts.join(self.slots, ["source_no", "block"]).where(first < last).select(
            "slot", "source_no", "off", (first - F.col("off")).alias("first"), (last - F.col("off")).alias("last"),
        )

    def taken(self) -> DataFrame:
        """(id, own, size, source_size, target, taken) of every row."""
        return self.taken_by_place().select("id", "own", "size", "source_size", "target", "taken")

    def taken_by_place(self) -> DataFrame:
        """The same with `source` and the row's place in it, `off`, which tells repeated rows apart."""
        sums = self.pieces().groupBy("source_no", "off").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
        rows = self.rows.where("size > 0").join(sums, ["source_no", "off"], "left").unionByName(self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
        return rows.join(self.sources.select("source_no", "source", "source_size", "target"), "source_no").select(
            "id", "own", "source", "off", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source_no, source, source_size, weight, target, quota) from rows (source, size)."""
    big = "decimal(38,0)"
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    table = totals.withColumn("source_no", F.row_number().over(by_name))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1))
    table = table.withColumn("most", F.col("source_size") * most_epochs)
    everything = Window.partitionBy()
    smaller = Window.orderBy(F.col("most").cast("double") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("most").over(smaller), F.lit(0)).alias("most_before"), F.coalesce(F.sum("weight").over(smaller), F.lit(0)).alias("weight_before"),
    )
    full = F.col("most").cast(big) * (F.col("all_weight") - F.col("weight_before")).cast(big) < F.col("weight").cast(big) * (F.col("total") - F.col("most_before")).cast(big)
    table = table.withColumn("full", full).select(
        "*", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything).alias("full_words"),
        F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(everything).alias("open_weight"),
    )
    shared = (F.col("weight") * (F.col("total") - F.col("full_words"))).cast("double") / F.col("open_weight")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(shared)
    return table.withColumn("target", target).select(
        "source_no", "source", "source_size", "n", "weight", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"),
    )


def _slots(sources: DataFrame, n_slots: int, block_words: int) -> DataFrame:
    """The schedule: (slot, source_no, block, first, last)."""
    spark = sources.sparkSession
    cells = F.lit(POINT_CELLS)
    n = F.lit(max(n_slots, 1))
    upper = F.col("first_slot") + F.col("slots")
    spans = sources.where("slots > 0").select(
        "source_no", F.col("first_slot").alias("low"), upper.alias("high"),
        F.explode(F.sequence(F.floor(F.col("first_slot") * cells / n), F.floor(upper * cells / n))).alias("cell"),
    )
    point = (F.col("slot").cast("decimal(19,0)") * F.lit(GOLDEN)) % 1
    points = spark.range(1, n_slots + 1).select(F.col("id").alias("slot"), point.alias("point"))
    at = F.col("point") * F.lit(n_slots).cast("decimal(19,0)")
    dealt = points.withColumn("cell", F.floor(F.col("point") * cells)).join(spans, "cell").where((at >= F.col("low")) & (at < F.col("high")))
    dealt = stored(dealt.select("slot", "source_no", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk")))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = dealt.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(chunks.select("source_no", "chunk", "before"), ["source_no", "chunk"])
    ranked = ranked.select("slot", "source_no", (F.col("before") + F.col("within")).alias("turn"))
    got = chunks.groupBy("source_no").agg(F.sum("n").alias("got"))
    open_turns = sources.where("slots > 0").join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = open_turns.where("got < slots").select("source_no", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("turn"))
    late = late.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("turn", "source_no"))).alias("slot"), "source_no", "turn")
    facts = sources.select("source_no", "source_size", "quota", "blocks", "slots")
    b = F.lit(block_words)
    block = F.col("turn") % F.col("blocks")
    epoch = F.floor(F.col("turn") / F.col("blocks"))
    left_over = F.col("quota") - epoch * F.col("source_size")
    return ranked.union(late).join(facts, "source_no").where("turn < slots").select(
        "slot", "source_no", block.alias("block"), (block * b).alias("first"), F.least((block + 1) * b, "source_size", left_over).alias("last"),
    )


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, most_block_words: int = BLOCK_WORDS,
) -> Mixture:
    """The mix of all rows of `df`."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    turn = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), turn.alias("turn"), F.xxhash64(text_col).alias("own")))
    sources = source_targets(sized, weights, most_epochs)
    total = sized.agg(F.sum("size")).first()[0] or 0
    block_words = max(1, min(most_block_words, total // LEAST_SLOTS))
    b = F.lit(block_words)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / b))
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("quota") / F.col("source_size")).otherwise(0))
    sources = sources.withColumn("slots", whole * F.col("blocks") + F.ceil((F.col("quota") - whole * F.col("source_size")) / b))
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = stored(sources.withColumn("first_slot", F.coalesce(F.sum("slots").over(earlier), F.lit(0))))
    n_slots = sources.agg(F.sum("slots")).first()[0] or 0

    numbered = sized.join(sources.select(F.col("source").alias("name"), "source_no"), F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "own", "source_no", "size", "turn", F.left("turn", F.lit(3)).alias("chunk"),
    )
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = numbered.groupBy("source_no", "chunk").agg(F.sum("size").alias("n")).select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source_no", "chunk").orderBy("turn", "id", "size", "own").rowsBetween(Window.unboundedPreceding, -1)
    rows = numbered.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(chunks, ["source_no", "chunk"])
    rows = stored(rows.select("id", "own", "source_no", "size", (F.col("before") + F.col("within")).alias("off")))
    return Mixture(sources, rows, _slots(sources, n_slots, block_words), block_words)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, source_col: str = "source", **options) -> DataFrame:
    """The rows of `df` as often as the mix takes them.

    The one document of a source where the mix stops is cut to its first
    words, joined by one space; `length_col` then gets its new length. Rows
    that share id, text and source each get the count of one of their places,
    in order of a hash of all their columns. Rows without words are not taken.
    Columns may have any names.
    """
    names = {c: f"own {i}" for i, c in enumerate(df.columns)}
    own = df.select(*[F.col(c).alias(n) for c, n in names.items()])
    id_, text_, source = names[id_col], names[text_col], names[source_col]
    places = mix(own, id_, text_, source, **options).taken_by_place()
    turn = F.row_number().over(Window.partitionBy("id", "own", "source").orderBy("off"))
    taken = places.where("size > 0").select("id", "own", "source", "size", "taken", turn.alias("nth")).where("taken > 0")
    marked = own.withColumn("hash", F.xxhash64(text_)).withColumn(
        "place", F.row_number().over(Window.partitionBy(id_, "hash", source).orderBy(F.xxhash64(*names.values())))
    )
    same = F.col(id_).eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")) & F.col(source).eqNullSafe(F.col("source")) & (F.col("place") == F.col("nth"))
    rows = marked.join(taken, same)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    rows = rows.withColumn("words", F.least("size", F.col("taken") - F.col("size") * F.col("copy")))
    cut = F.array_join(F.slice(F.regexp_extract_all(text_, F.lit(WORD_PATTERN), F.lit(0)), 1, F.col("words").cast("int")), " ")
    is_cut = F.col("words") < F.col("size")
    out = rows.withColumn(text_, F.when(is_cut, cut).otherwise(F.col(text_)))
    if length_col:
        length = names[length_col]
        out = out.withColumn(length, F.when(is_cut, F.char_length(text_).cast(df.schema[length_col].dataType)).otherwise(F.col(length)))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
