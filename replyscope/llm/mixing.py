"""Mixing sources to target weights by a low-discrepancy schedule.

The points ``n * A mod 2**64``, A being 2**64 over the golden ratio, fall evenly on the 64-bit numbers; each source owns a part of them as long as
its share, so slot ``n`` of the mix belongs to the source whose part its point hits. A source's texts, shuffled once, form one stream of
words, repeated as often as ``most`` allows, and cut into blocks of equally many words; a source's slots are ranked and the r-th takes
its r-th block. So the schedule decides how many words of a source the mix takes: as many as its slots hold, which is its target but for a few
blocks, and never more than its stream has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replyscope.llm.common import keyed, row_key, save

WORD = r"[^\x20\x09-\x0D]+"
#: 2**64 over the golden ratio, as the next odd number, and the length of the circle of points.
GOLDEN, CIRCLE = 11400714819323198485, 1 << 64
#: Words of a block at most; a smaller mix is cut into about SLOTS blocks, so that a few blocks more or less are little.
BLOCK, SLOTS = 1024, 1 << 18
#: Rows of one group that a prefix sum orders in one task.
RUN = 4096
#: Cells of the circle, for joining points with the parts of it.
CELLS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, no, rows, source_size, target) per source of ``sizes`` (source, size). Sources in code point order, null last, weigh
    ``weights`` repeating and share ``share`` times all sizes; a target stops at ``most`` times its source's size and
    its excess goes to the others by weight, until none is above. One row per source passes one window."""
    rows = F.sum("copies") if "copies" in sizes.columns else F.count(F.lit(1))
    per = sizes.groupBy("source").agg(rows.alias("rows"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("no", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("no") % len(weights) + 1)).withColumn("cap", F.col("source_size") * most)
    full = W.orderBy(F.col("cap") / F.col("w"), "no")
    before, after = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(after))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every)
    target = F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))
    return per.select("source", "no", "rows", "source_size", target.alias("target"))


def prefix_sums(df: DataFrame, group: str, run: Column, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``group`` that come before. ``run`` numbers consecutive
    stretches of the order, so that only the stretches' sums of a group meet in one task."""
    df = df.withColumn("run", run)
    sums = df.groupBy(group, "run").agg(F.sum(value).alias("s"))
    before = W.partitionBy(group).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(group, "run", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy(group, "run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(offsets, [group, "run"]).withColumn(name, (F.col("offset") + F.col("inside")).cast("long")).drop("offset", "inside", "run")


def placed(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """Every row of ``docs`` as (doc_id, k, k2, source, no, size, source_size, target, at): ``at`` is its first word's place in its
    source's shuffled stream. Rows equal in all are one row with a count until they have their places, one after the other."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    r = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.col("source").cast("string").alias("source"), size.alias("size"), r.alias("r"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    sizes = save(rows.withColumn("words", F.col("size") * F.col("copies")))
    per = targets(sizes.select("source", "copies", F.col("words").alias("size")), weights, share, most).withColumnRenamed("source", "s")
    rows = sizes.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    runs = F.ceil(F.col("rows") / RUN)
    run = F.floor(F.conv(F.substring("r", 1, 8), 16, 10).cast("double") * runs / float(1 << 32)).cast("long")
    rows = prefix_sums(rows, "no", run, ["r", "k", "k2"], "words", "at").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return save(rows.withColumn("at", F.col("at") + F.col("copy") * F.col("size")).drop("rows", "r", "copies", "copy", "words"))


def block_words(total: float) -> int:
    """The words of a block, from the targets' sum."""
    return int(min(max(total // SLOTS, 1), BLOCK))


def schedule(per: DataFrame, block: int, multiplier: int = GOLDEN) -> DataFrame:
    """(no, block, slot): which block of which source each slot of the mix takes, for ``per`` (no, target). There are as many slots as the sources
    need blocks. All in whole numbers: a source's part of the circle is its blocks over all blocks, to the last point."""
    spark = per.sparkSession
    need = F.ceil(F.col("target") / F.lit(block)).cast("long")
    every = W.partitionBy()
    before = W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("no", need.alias("need")).where("need > 0")
    per = per.withColumn("total", F.sum("need").over(every)).withColumn("lo", F.coalesce(F.sum("need").over(before), F.lit(0)))

    def edge(blocks: str) -> Column:
        x, total = f"(cast({blocks} as decimal(17,0)) * cast({CIRCLE} as decimal(20,0)))", "cast(total as decimal(17,0))"
        return F.expr(f"cast(({x} - {x} % {total}) / {total} as decimal(20,0))")

    per = per.select("no", edge("lo").alias("a"), edge("lo + need").alias("b"), "need")
    n = per.agg(F.sum("need")).first()[0] or 0
    point = F.expr(f"cast(cast(id as decimal(17,0)) * cast({multiplier} as decimal(20,0)) % cast({CIRCLE} as decimal(20,0)) as decimal(20,0))")
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("u"))
    width = CIRCLE // CELLS
    cell = lambda x: F.expr(f"cast({x} div {width} as long)")
    parts = per.select("no", "a", "b", F.explode(F.sequence(cell("a"), cell("b"))).alias("cell"))
    hit = points.withColumn("cell", cell("u")).join(parts, "cell").where("u >= a and u < b").select("no", "slot", F.lit(1).alias("one"))
    return prefix_sums(hit, "no", F.floor(F.col("slot") / F.lit(RUN)), ["slot"], "one", "block").select("no", "block", "slot")


def mix_pieces(rows: DataFrame, most: float, block: int | None, multiplier: int = GOLDEN) -> DataFrame:
    """The mix, from ``placed`` rows: (slot, no, block, at, pass, doc_id, k, k2, first, words), one row per stretch of a document in a
    block: ``words`` words from word ``first`` on, in the given pass over the source."""
    per = save(rows.groupBy("no").agg(F.max("target").alias("target"), F.max("source_size").alias("source_size")))
    block = block or block_words(per.agg(F.sum("target")).first()[0] or 0)
    slots = save(schedule(per, block, multiplier))
    end = F.least(F.col("hits") * block, F.floor(F.col("source_size") * most)).cast("long")
    ends = slots.groupBy("no").agg(F.count(F.lit(1)).alias("hits")).join(per, "no").select("no", end.alias("end"))
    passes = -int(-most // 1)
    lo = F.col("at") + F.col("pass") * F.col("source_size")
    p = rows.where("size > 0").join(save(ends), "no").select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")).withColumn("lo", lo)
    p = p.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("end"))).where("lo < hi")
    first, last = F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)
    p = p.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("lo"), F.col("block") * block)
    p = p.withColumn("first", start - F.col("lo")).withColumn("words", F.least(F.col("hi"), (F.col("block") + 1) * block) - start)
    return p.join(slots, ["no", "block"]).select("slot", "no", "block", "at", "pass", "doc_id", "k", "k2", "first", "words")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int | None = None, seed: int = 7,
    multiplier: int = GOLDEN,
) -> tuple[DataFrame, DataFrame]:
    """The placed rows of ``docs`` (doc_id, text, source, any further columns) and the mix in pieces.

    A row's size is its number of words, parted at ASCII white space; null and empty texts have size 0 and no piece. A null source
    is a source of its own, ordered last. Rows without an id, or with one that others have, are rows of their own; rows equal
    in all are placed one after the other. The order depends on ids, texts and ``seed`` alone. An empty table gives none. ``block`` is by default
    BLOCK words, less for a mix of fewer than SLOTS such blocks; ``multiplier`` makes the points."""
    rows = placed(docs, weights, share, most, seed)
    return rows, mix_pieces(rows, most, block, multiplier)


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per row of ``rows``: doc_id, size, source_size, target, the words the mix takes of it, the first slot that takes some (null if none does) and
    the number of slots that do (one that takes words of two passes counts twice)."""
    got = pieces.groupBy("no", "at").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    some = F.col("size") > 0
    none = lambda c: F.when(some, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    return rows.join(got, ["no", "at"], "left").select(
        "doc_id", "size", "source_size", "target", none("taken"), F.when(some, F.col("first_slot")).alias("first_slot"), none("n_slots")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``'s columns, in the order of the slots: a row for each pass that takes words of it, at its first slot. A row taken
    in part, one per source, keeps its first words, joined by single spaces, and n_chars follows the text. Rows without words have no place in the
    mix."""
    rows, pieces = mix_sources(docs, **options)
    got = pieces.groupBy("no", "at", "pass", "k", "k2").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    sized = got.join(rows.select("no", "at", "size", "k", "k2").where("size > 0"), ["no", "at", "k", "k2"])
    copies = rows.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("copies"))
    takes = save(sized.select("k", "k2", "slot", "words", "size").join(copies, ["k", "k2"]))
    # Rows that agree in key are equal in id and text: where there are several, one of them carries the text to all takes of the key.
    single, several = takes.where("copies = 1"), takes.where("copies > 1")
    one = keyed(docs).join(several.select("k", "k2").distinct(), ["k", "k2"], "left_semi").groupBy("k", "k2").agg(F.any_value("doc").alias("doc"))
    cols = ["slot", "words", "size", "doc"]
    kept = keyed(docs).join(single, ["k", "k2"]).select(cols).unionByName(several.join(save(one), ["k", "k2"]).select(cols))
    first = F.slice(F.regexp_extract_all("doc.text", F.lit(f"({WORD})"), F.lit(1)), 1, F.col("words").cast("int"))
    text = F.when(F.col("words") < F.col("size"), F.array_join(first, " ")).otherwise(F.col("doc.text"))
    # The old text stays behind, so that the sort moves each text once.
    out = kept.select("slot", F.col("doc").dropFields("text").alias("doc"), text.alias("text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    cols = {"text": F.col("text"), "n_chars": n_chars}
    return out.orderBy("slot").select(*[(cols[c] if c in cols else F.col("doc").getField(c)).alias(c) for c in docs.columns])
