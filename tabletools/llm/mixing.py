"""Sources mixed to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source is a stream: its documents in the order of a hash, cut into blocks of equally many words (the last may be
shorter) and repeated as often as its target asks. Slot n of the schedule has the van der Corput point of n (the
bits of n behind the binary point, reversed). The cumulative target shares map that point to a source, and the rank of the slot
among those of its source tells the block. So any run of slots holds the sources at nearly their shares,
and no state passes from slot to slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletools.functions.joins import fits_broadcast, join_group_facts
from tabletools.sources.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5             # words of the mix for each word of the input
MOST = 2.0              # times that a source may be repeated
BLOCK_WORDS = 256
BUCKET_DIGITS = 3       # hex digits of the hash that make the ranges in which a source is numbered
CELLS = 1024            # equal parts of the unit interval, to find the source of a point by an equality
CHUNK_SLOTS = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
_POINT_BITS = 52


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``src, source_size, target`` per source. Sources in the order of ``src`` take the weights in turn. What a
    source cannot take is shared among the others by weight: with the sources in the order of size / weight, those below one level are full
    and the others get weight times that level."""
    sizes = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = sizes.withColumn("weight", weight.cast("double")).withColumn("full", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("full") / F.col("weight"), "src")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = sources.withColumn("level", level)
    open_ = F.when(F.col("full") >= F.col("level") * F.col("weight"), F.struct(F.col("full") / F.col("weight"), "level"))
    level = F.coalesce(F.min(open_).over(everything)["level"], F.lit(0.0))
    return leveled.withColumn("level", level).select(
        "src", "source_size", F.least("full", F.col("level") * F.col("weight")).alias("target"))


def stream_positions(sized: DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``sized`` (doc_id, src, size) with ``start``, the words of the source before the document in its stream."""
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    marked = sized.withColumn("mark", mark).withColumn("range", F.substring("mark", 1, digits))
    ranges = marked.groupBy("src", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("src", "range", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("src", "range").orderBy("mark", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return marked.join(ranges, ["src", "range"]).select(
        *sized.columns, (F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))


def _blocks_needed(block: int):
    """Per source: whole rounds of its stream, words of the last round, blocks of a round, slots in all."""
    words = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    per_round = F.ceil(F.col("source_size") / block).cast("long")
    rest = words - rounds * F.col("source_size")
    return {"rounds": rounds, "rest": rest, "per_round": per_round,
            "slots": rounds * per_round + F.ceil(rest / block).cast("long")}


def schedule(plan: DataFrame, total_slots: int) -> DataFrame:
    """``src, rank, position`` of every slot that the sources need. ``plan``: src, target, slots."""
    spark = plan.sparkSession
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    high = F.sum("target").over(upto) / F.sum("target").over(all_)
    shares = plan.where("target > 0").withColumn("high", high)
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0.0))) \
        .withColumn("high", F.when(F.lead("src").over(Window.orderBy("src")).isNull(), 1.0).otherwise(F.col("high")))
    cells = shares.select("src", "low", "high", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    cells = stage(cells, "mix-cells")
    bits = F.reverse(F.lpad(F.bin("position"), _POINT_BITS, "0"))
    points = spark.range(total_slots).select(F.col("id").alias("position")) \
        .withColumn("point", F.conv(bits, 2, 10).cast("double") / F.lit(2.0 ** _POINT_BITS)) \
        .withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = points.join(_small(cells), (points["cell"] == cells["cell"]) & (F.col("point") >= F.col("low"))
                        & (F.col("point") < F.col("high"))) \
        .select("src", "position", F.floor(F.col("position") / CHUNK_SLOTS).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), "n")
    inside = Window.partitionBy("src", "chunk").orderBy("position")
    ranked = drawn.join(counts.drop("n"), ["src", "chunk"]).select(
        "src", "position", (F.col("ahead") + F.row_number().over(inside) - 1).alias("rank"))
    given = counts.groupBy("src").agg(F.sum("n").alias("given"))
    in_time = ranked.join(_small(plan.select("src", "slots")), "src").where("rank < slots")
    short = plan.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    late = short.select("src", F.explode(F.expr("sequence(given, slots - 1)")).alias("rank")) \
        .withColumn("position", F.lit(total_slots) + F.col("rank"))
    return in_time.select("src", "rank", "position").unionByName(late.select("src", "rank", "position"))


def _stream(source):
    """The name of a source's stream; that of null sorts after every other."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def _small(facts: DataFrame) -> DataFrame:
    """A staged table of facts about sources, to be broadcast if a count shows that it is small."""
    return F.broadcast(facts) if fits_broadcast(facts) else facts


def mix(sized: DataFrame, block: int = BLOCK_WORDS, **settings) -> tuple[DataFrame, DataFrame]:
    """The mix of ``sized`` (doc_id, source, size; any of them may be null, a null size counts as 0).

    Returns the documents with ``src, start, source_size, target`` and any further columns of ``sized``, and the parts of the mix: ``position`` of the slot, ``round`` of the
    source's stream, ``src, start`` (which name the document), ``words``. A source's parts add up to its target, rounded
    down; within a round only the last document of the stream can be cut. Repeated rows are documents
    of their own; documents without words have no part.
    """
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    sized = sized.select("doc_id", _stream(F.col("source")).alias("src"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), *more)
    docs = stage(stream_positions(stage(sized, "mix-sizes")), "mix-streams")      # texts are read once
    plan = stage(source_targets(docs, **settings).withColumns(_blocks_needed(block)), "mix-plan")
    total_slots = plan.agg(F.sum("slots")).first()[0] or 0
    slots = schedule(plan, total_slots).join(_small(plan.drop("slots", "target")), "src").select(
        "src", "position", F.expr("rank div per_round").alias("round"), F.expr("rank % per_round").alias("block"),
        F.expr("CASE WHEN rank div per_round < rounds THEN source_size ELSE rest END").alias("limit"))
    low, high = F.col("block") * block, (F.col("block") + 1) * block
    blocks = docs.where("size > 0").select("src", "start", "size", F.explode(F.expr(
        f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    words = F.least(F.col("start") + F.col("size"), high, "limit") - F.greatest("start", low)
    parts = slots.join(blocks, ["src", "block"]).withColumn("words", words).where("words > 0")
    docs = join_group_facts(docs, plan.select("src", "source_size", "target"), ["src"], "doc_id")
    return docs, parts.select("position", "round", "src", "start", "words")


def sized_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: the number of words of each whole text (null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("size"))


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each document, and the ``position`` of the first slot that takes words of it; in the
    order of the schedule, those that are not taken last."""
    streams, parts = mix(sized_documents(docs), **settings)
    taken = parts.groupBy("src", "start").agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    mixed = streams.where("size > 0").join(taken, ["src", "start"], "left") \
        .unionByName(streams.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
                     .withColumn("position", F.lit(None).cast("long")))
    order = [F.col("position").asc_nulls_last(), F.col("start"), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "position")


def _whole(plan_words, size):
    """A document that the end of its source's last round would cut is taken whole if that is nearer to the target, else not."""
    return 2 * plan_words >= size


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows with the columns of ``docs``, whatever other columns they are: a document once for each round of its source that takes
    it, in the order of the first slots that do: ranges of slots in the order of the partitions, sorted in each.

    Documents are whole: the one at the end of a source's last round is taken or left, whichever is nearer to the target, so a source
    is off its target by half a document at most. Documents that the mix has no room for, and those without words (null and
    empty texts), are left out. Rows that agree in doc_id, source and text count as one document: one row of them, any, is taken. Null doc_ids
    and sources are values like others; an empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]          # ours are told apart from any that the table has
    of = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    doc_id, source, text = (F.col(of[c]) for c in ("doc_id", "source", "text"))
    key = F.xxhash64(doc_id, source, text)
    keyed = rows.select(doc_id.alias("doc_id"), source.alias("source"), key.alias("key"),
                        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).alias("size"))
    keyed = stage(keyed.groupBy("doc_id", "source", "key", "size").agg((F.count("*") > 1).alias("repeated")), "mix-keys")
    streams, parts = mix(keyed, **settings)
    rounds = parts.groupBy("src", "start", "round").agg(F.sum("words").alias("words"), F.min("position").alias("position"))
    taken = streams.where("size > 0").join(rounds, ["src", "start"]).where(_whole(F.col("words"), F.col("size"))) \
        .groupBy("doc_id", "src", "key", "repeated").agg(F.sort_array(F.collect_list(F.struct("position", "start"))).alias("taken"))
    same = key.eqNullSafe(F.col("key")) & doc_id.eqNullSafe(F.col("doc_id")) & (_stream(source) == F.col("src"))
    once = rows.join(taken, same).select(*names, "taken", "repeated")
    if not keyed.where("repeated").isEmpty():                    # texts are written once more only where some rows repeat
        once = stage(once, "mix-documents")
        again = once.where("repeated").dropDuplicates([of[c] for c in ("doc_id", "source", "text")])
        once = once.where("NOT repeated").unionByName(again)
    slots = once.withColumn("slot", F.explode("taken"))
    order = [F.col("slot.position"), F.col("slot.start"), doc_id]
    return slots.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(n).alias(c) for c, n in of.items()])
