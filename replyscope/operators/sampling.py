"""History sampling (W2, J2, J3): for every row, n distinct other rows of a pool (the same writer, or a cohort),
drawn uniformly without replacement, joined with ', '.

No pair of pool rows is ever materialised. Each pool gets dense positions (two phases: a window over
(pool, hash bucket) plus per-bucket offsets, so a hot pool is spread over many tasks); each row then draws n
positions with Floyd's algorithm from seeded 60-bit md5 hashes (uniform to within 2^-60 of the pool size, reproducible,
portable to SQL);
draws meet positions as keys, without texts. The rows of a pool are dealt to groups; a text then moves once to its key and once to each group that
drew it, however many of the group's rows did. Cost is linear in rows: n draws per row, at most n moves per text drawn n times.
Where few rows of a group draw the same text, a row's texts can meet at the first of them instead, which is at its key already and need not move on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyscope.functions import fixed, text
from replyscope.operators.cohorts import NATIVE, native_label

BUCKET_ROWS = 4096
#: Rows of a writer that are given their texts together. The fewer groups a pool has, the fewer times a text moves; a group's drawn texts are
#: sorted in one task.
GROUP_ROWS = 24576
#: Rows whose texts meet at one copy of a text, on average at most. A text of a pool that is small beside the rows has several copies.
HOME_ROWS = 1024


def hash60(*parts) -> Column:
    """An unsigned 60-bit integer from the first 15 hex digits of md5(parts joined by ':')."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def pool_positions(pool_rows: DataFrame, pool: str, key: str = "row_id", bucket_rows: int = BUCKET_ROWS,
                   size: Column | None = None) -> DataFrame:
    """Dense positions ``__pos`` 0..size-1 within each pool, ordered by (hash bucket, key), the pool's ``__size``, and ``__nth``, the row's number
    (from 0) among those of its pool with the same key. ``size`` is given when there is one pool only.

    A pool has a bucket for every ``bucket_rows`` of its rows. The window runs per (pool, bucket), never over a whole
    pool; the offset table has one row per bucket and is the only table that moves for the join back."""
    if size is None:
        sized = pool_rows.join(pool_rows.groupBy(pool).agg(F.count(F.lit(1)).alias("__size")), pool)
    else:
        sized = pool_rows.withColumn("__size", size)
    buckets = F.ceil(F.col("__size") / F.lit(bucket_rows)).cast("bigint")
    b = sized.withColumn("__b", F.pmod(hash60(F.col(key)), buckets)).drop("__size")
    ranked = b.withColumn("__r", F.row_number().over(Window.partitionBy(pool, "__b").orderBy(key)) - 1)
    ranked = ranked.withColumn("__nth", F.row_number().over(Window.partitionBy(pool, "__b", key).orderBy("__r")) - 1)
    counts = b.groupBy(pool, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(pool).orderBy("__b")
    offsets = counts.select(
        pool, "__b",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy(pool)).alias("__size"),
    )
    # ``ranked`` is already hash-partitioned by (pool, bucket) by its window, so only the small offset table moves.
    return ranked.join(offsets, [pool, "__b"]).select(
        *pool_rows.columns, (F.col("__off") + F.col("__r")).alias("__pos"), "__size", "__nth"
    )


def floyd_draws(m: Column, n: int, seed, row_id: Column) -> list[Column]:
    """n distinct integers in [0, m) by Floyd's algorithm: step i (j = m - n + i) draws t in [0, j] and keeps t,
    or j if t was already chosen. Hashes are md5 of ``seed:row_id:i``."""
    chosen: list[Column] = []
    for i in range(n):
        j = m - F.lit(n) + F.lit(i)
        t = F.pmod(hash60(F.lit(str(seed)), row_id, F.lit(i)), j + F.lit(1))
        c = F.when(t.isin(*chosen), j).otherwise(t) if chosen else t
        chosen.append(c)
    return chosen


def _pool(df: DataFrame, pool: str, user: str) -> tuple[DataFrame, Column]:
    """The rows of ``df`` that texts are drawn from, and the pool that a row of ``df`` draws from."""
    if pool == "user":
        return df.where(F.col(user).isNotNull()), F.col(user)
    if pool in ("native", "non_native"):
        labelled = F.col(NATIVE) if NATIVE in df.columns else native_label("nat_lang")
        return df.where(labelled == pool), F.lit(pool)
    raise ValueError("pool must be user, native or non_native")


def has_history(df: DataFrame, pool: str, n: int = 5, key: str = "row_id") -> Column:
    """Whether ``sample_history`` gives a row of ``df`` a history from the cohort ``pool``, told from the row's key and n + 1 keys of the pool, so that the
    row need not move. A row with a key has one if more than n rows are in the pool; if n are, unless it has the key of one of them."""
    if pool == "user":
        raise ValueError("pool must be native or non_native")
    few = _pool(df, pool, "")[0].limit(n + 1).agg(F.struct(F.count(F.lit(1)).alias("n"), F.collect_set(key).alias("keys"))).scalar()
    return F.col(key).isNotNull() & ((few["n"] > n) | ((few["n"] == n) & ~F.array_contains(few["keys"], F.col(key))))


def sample_history(df: DataFrame, pool: str = "user", n: int = 5, seed=fixed.SEED, text_col: str = "prompt_en",
                   key: str = "row_id", user: str = "user_id", bucket_rows: int = BUCKET_ROWS,
                   out: str = "history", keep: Sequence[str] | None = None, group_rows: int = GROUP_ROWS,
                   meet: str = "group", home_rows: int = HOME_ROWS) -> DataFrame:
    """The columns ``keep`` of ``df`` (default: all) with ``out`` (n texts of other pool rows joined with ', ') and ``out + '_error'``.

    ``pool``: ``user`` (other rows of the same writer), ``native`` or ``non_native`` (other rows of that cohort,
    whatever the row's own cohort). A row with fewer than n candidates gets a NULL history and an error text. Rows equal in key and pool
    share all their texts; a row without a key or a writer draws none. A writer's rows are dealt to groups of about ``group_rows``, all rows
    to groups of a quarter of that if the pool is a cohort.

    ``meet``: ``group`` (a row's texts meet in the row's group) or ``text`` (they meet where the first of them is, so that one text fewer moves for each
    row; but the columns to keep move twice, and a text moves again for almost every row that drew it). The result is the same. A text of a cohort has
    a copy for every ``home_rows`` rows that draw it first."""
    if meet not in ("group", "text"):
        raise ValueError("meet must be group or text")
    pool_rows, pool_expr = _pool(df, pool, user)

    # Places are found from keys alone: no text moves for them.
    members = pool_rows.select(F.col(key).alias("__k"), pool_expr.alias("__pool"))
    # A cohort is one pool, whose size is a scalar subquery of the plan.
    whole = None if pool == "user" else F.coalesce(members.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    positioned = pool_positions(members, "__pool", "__k", bucket_rows, whole)
    own = positioned.select("__k", "__pool", F.col("__pos").alias("__own"), "__size")

    def groups(size: Column) -> Column:
        return F.greatest(F.ceil(size / F.lit(group_rows)).cast("bigint"), F.lit(1))

    if pool == "user":
        # Every row with a writer is a row of its pool: its position and pool size are there already.
        rows, size = own, F.col("__size")
        parts = groups(size)
        # A row for each pool of more than one group, one per ``group_rows`` rows at most.
        large = members.groupBy("__pool").agg(groups(F.count(F.lit(1))).alias("__parts")).where("__parts > 1")
        asking = df.join(F.broadcast(large), df[user] == large["__pool"], "left")
        asking_parts = F.coalesce("__parts", F.lit(1))
    else:
        # Rows outside the pool have no own position.
        rows = df.select(F.col(key).alias("__k"), F.lit(pool).alias("__pool")).join(own, ["__k", "__pool"], "left")
        size = whole
        # Few rows of a group draw the same text of a large cohort, so larger groups would save little.
        parts = groups(F.lit(4) * df.agg(F.count(F.lit(1))).scalar())
        asking, asking_parts = df, parts
    m = size - F.when(F.col("__own").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("__m", m).where(F.col("__k").isNotNull() & (F.col("__m") >= n))
    draws = floyd_draws(F.col("__m"), n, seed, F.col("__k"))
    skip = [d + F.when(F.col("__own").isNotNull() & (d >= F.col("__own")), 1).otherwise(0) for d in draws]

    copies = F.lit(1).cast("bigint")
    if meet == "text" and pool != "user":
        copies = F.greatest(F.ceil(df.agg(F.count(F.lit(1))).scalar() / (F.greatest(whole, F.lit(1)) * F.lit(home_rows))).cast("bigint"), copies)

    def member(k, copy: Column) -> Column:
        """A member of a pool; a NULL key equals itself inside."""
        # Never NULL by its type either: keys of two types would be cast for a join, and texts that lie by one of them would move once more.
        which = [F.coalesce(copy, F.lit(0).cast("bigint")).alias("copy")] if meet == "text" else []
        return F.struct(F.col("__pool").alias("pool"), F.col(k).alias("k"), *which)

    if meet == "text":
        place = positioned.select("__pool", "__pos", F.col("__k").alias("__of"), "__nth")
        # All draws of a key in one row; the first of them is where the others go.
        all_draws = F.array(*[F.struct(F.lit(i).alias("__i"), p.alias("__pos")) for i, p in enumerate(skip)])
        homes = rows.withColumn("__draws", all_draws).groupBy("__k", "__pool").agg(F.sort_array(F.flatten(F.collect_list("__draws"))).alias("__draws"))
        homes = homes.withColumn("__pos", F.col("__draws")[0]["__pos"]).join(place, ["__pool", "__pos"])
        homes = homes.select("__k", "__pool", "__draws", member("__of", F.pmod(F.xxhash64("__k"), copies)).alias("__to"), F.col("__nth").alias("__nth0"))
        drawn = homes.select("__k", "__pool", "__to", F.explode(F.slice("__draws", F.lit(2), F.size("__draws"))).alias("__x"))
        drawn = drawn.select("__k", "__pool", "__to", F.col("__x.__i").alias("__i"), F.col("__x.__pos").alias("__pos"))
        drawn = drawn.join(place, ["__pool", "__pos"]).withColumn("__by", member("__of", F.col("__to.copy")))
    else:
        drawn = rows.select("__k", "__pool", F.pmod(F.xxhash64("__k"), parts).alias("__to"), F.posexplode(F.array(*skip)).alias("__i", "__pos"))
        drawn = drawn.join(positioned.select("__pool", "__pos", member("__k", copies).alias("__by"), "__nth"), ["__pool", "__pos"])
    wanted = drawn.groupBy("__by", "__nth", "__to").agg(F.collect_list(F.struct("__k", "__i")).alias("__for"))
    texts = pool_rows.select(pool_expr.alias("__pool"), F.col(key).alias("__k"), F.col(text_col).alias("__text"))
    if meet == "text":
        texts = texts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - F.lit(1))).alias("__copy"))
        texts = texts.select(member("__k", F.col("__copy")).alias("__by"), "__text")
    else:
        texts = texts.select(member("__k", copies).alias("__by"), "__text")
    texts = texts.withColumn("__at", F.row_number().over(Window.partitionBy("__by").orderBy("__by")) - 1)

    # The rows themselves, and each text once for all rows of a group that drew it, come together group by group.
    kept = df.select(F.struct(*(keep or df.columns)).alias("__row"))
    none = F.lit(None).cast(kept.schema["__row"].dataType)
    no_text = F.lit(None).cast(df.schema[text_col].dataType)
    # ``between``, not ``==``: the texts stay where their window put them, by ``__by`` alone.
    sent = texts.join(wanted, "__by").where(F.col("__at").between(F.col("__nth"), F.col("__nth")))

    def itself(k: str) -> Column:
        return F.array(F.struct(F.col(k).alias("__k"), F.lit(None).cast("int").alias("__i")))

    if meet == "text":
        sent = sent.select(F.col("__to").alias("__g"), "__for", "__text", none.alias("__row"), F.lit(None).cast("int").alias("__nth0"))
        asked = df.select(F.col(key).alias("__k"), pool_expr.alias("__pool"), F.struct(*(keep or df.columns)).alias("__row"))
        asked = asked.join(homes.select("__k", "__pool", "__to", "__nth0"), ["__k", "__pool"], "left")
        asked = asked.select(F.coalesce("__to", member("__k", F.lit(0).cast("bigint"))).alias("__g"), itself("__k").alias("__for"),
                             no_text.alias("__text"), "__row", "__nth0")
    else:
        sent = sent.select(F.struct(F.col("__by.pool").alias("pool"), F.col("__to").alias("part")).alias("__g"), "__for", "__text", none.alias("__row"))
        part = F.when(pool_expr.isNull(), F.xxhash64(key)).otherwise(F.pmod(F.xxhash64(key), asking_parts))
        asked = asking.select(F.struct(pool_expr.alias("pool"), part.alias("part")).alias("__g"), itself(key).alias("__for"),
                              no_text.alias("__text"), F.struct(*(keep or df.columns)).alias("__row"))
    # The number is explicit: unfolding the rows of a text multiplies a partition's size, so it must not be coalesced by its size before.
    met = sent.unionByName(asked).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__g")
    first = ["__nth0"] if meet == "text" else []
    met = met.select("__g", F.explode("__for").alias("__x"), "__text", "__row", *first)
    met = met.select("__g", F.col("__x.__k").alias("__k"), F.col("__x.__i").alias("__i"), "__text", "__row", *first)
    # A window sorts a group's texts once; an aggregate would sort them before and after its (local) merge.
    picked = F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "__text"))).over(Window.partitionBy("__g", "__k"))
    result = met.withColumn("__picked", picked).where(F.col("__i").isNull())
    if meet == "text":
        # The texts at their keys once more (Spark reads the same shuffle again): the first text of each row that has come here.
        there = texts.select(F.col("__by").alias("__at_by"), "__at", F.struct(F.lit(0).alias("__i"), "__text").alias("__first"))
        here = (F.col("__g") == F.col("__at_by")) & F.col("__at").between(F.col("__nth0"), F.col("__nth0"))
        result = result.select("__g", "__nth0", "__row", "__picked").join(there, here, "left")
        result = result.withColumn("__picked", F.when(F.col("__nth0").isNull(), F.col("__picked")).otherwise(F.concat(F.array("__first"), "__picked")))
    result = result.withColumn("__picked", F.array_sort("__picked"))
    history = F.when(F.size("__picked") > 0, text.join_texts(F.col("__picked.__text")))
    error = F.when(F.size("__picked") == 0, F.lit(f"fewer than {n} other rows in the {pool} pool"))
    return result.select("__row.*", history.alias(out), error.alias(f"{out}_error"))
