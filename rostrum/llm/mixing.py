"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source's documents are to be copied ``target / size of the source`` times.
The whole part of that number is given to every document; the fractional part
is a probability that pivotal rounding makes 0 or 1: two documents exchange
words of expected mass, in a random direction that keeps both expectations,
until one of them is integral; the other goes on. As the exchange is in words,
a source's expected words never change: only the last fractional document is
drawn by itself, with its probability.

Long documents outlast short ones in exchanges, so they are rounded apart: a
source's documents form three tiers by length, each lower tier with several times
the words of the longest document above it where so many words are shorter. The longest tier goes first; what the
draw of its last document misses is spread over the copies of all shorter ones
before these are rounded, and likewise for the second. Draws miss nothing on
average, so every document keeps its expected copies, and a source misses its
target by less than one document of its shortest tier. Only where shorter
documents haven't the room for a miss (a document that makes up most of its
source, or a source of documents alike in length) does the last one go to the
nearer side: a source misses its target by half its longest document at most.

Pairs combine in a tree: buckets of about ``fan`` documents of a source each
leave one fractional document, buckets of those the next, and so on. A hot source
only has more buckets. Rows that are the same in id, text and
source are one unit with a count, however many they are. Random directions come
from hashes of the documents, so reruns agree.

Null texts have size 0, are never taken, and appear with taken 0. Null sources
are one source, last in order. An empty table gives an empty result. A long text
is one unit as any other. mix reads doc_id, text and source alone; mixed_documents
carries all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.common import WORD, checkpointed, documents, free

#: The direction of an exchange is drawn from so many values.
DRAWS = 1 << 40
#: Sources up to which their table (under 100 bytes a row) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: How many times the words of the longest document above it a lower tier should hold.
RESERVE = 4
FIELDS = ("rank", "size", "salt", "doc_id", "rows", "whole")


def targets(stats: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Adds target to (source, source_size): shares of all words by weight, at most ``most`` times a source's size.

    Ordered by size over weight, the sources held at their limit come first, so
    the level of the others follows from running sums. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("fill", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fill", "rank")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("shared", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "rank", "level"))).over(Window.partitionBy())["level"])
    return ranked.select(*stats.columns, "rank", F.when(F.col("shared").isNull() | (F.col("fill") <= F.col("shared")), F.col("cap").cast("double")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(DRAWS)) / F.lit(float(DRAWS))


def _exchange(state: Column, other: Column, seed: int) -> Column:
    """One pivotal step between the document held and the next one of a bucket."""
    own = state["held"]
    free, there = own["size"] - own["mass"], other["size"] - other["mass"]
    up, down = F.least(free, other["mass"]), F.least(own["mass"], there)
    rises = _uniform(own["salt"], other["salt"], F.lit(seed)) * (up + down) < down

    def left(row: Column, mass: Column) -> Column:
        return F.struct(*[row[k].alias(k) for k in ("size", "salt", "doc_id", "rows", "whole")], mass.alias("mass"))

    def settled(row: Column, extra: int) -> Column:
        return F.struct(*[row[k].alias(k) for k in ("size", "salt", "doc_id", "rows", "whole")], F.lit(extra).alias("extra"))

    held = F.when(rises & (free <= other["mass"]), left(other, other["mass"] - free)).when(rises, left(own, own["mass"] + other["mass"]))
    held = held.when(own["mass"] <= there, left(other, other["mass"] + own["mass"])).otherwise(left(own, own["mass"] - there))
    done = F.when(rises & (free <= other["mass"]), settled(own, 1)).when(rises, settled(other, 0)).when(own["mass"] <= there, settled(own, 0)).otherwise(settled(other, 1))
    return F.struct(held.alias("held"), F.concat(state["done"], F.array(done)).alias("done"))


def _combined(rows: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: of each bucket the document still held, and those settled."""
    fields = ("size", "salt", "doc_id", "rows", "whole", "mass")
    groups = rows.groupBy("rank", "bucket").agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("items"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    none = F.array().cast("array<struct<" + ",".join(f"{k}:{kinds[k]}" for k in fields[:-1]) + ",extra:int>>")
    start = F.struct(F.element_at("items", 1).alias("held"), none.alias("done"))
    folded = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, lambda a, x: _exchange(a, x, seed))
    return checkpointed(groups.select("rank", "bucket", folded.alias("out")).select("rank", "bucket", "out.held", "out.done"))


def tiers(units: DataFrame) -> DataFrame:
    """source, source_size, n0 to n2 (documents with words in each tier), words0 and words1 (those of the tiers up to it), top0 to top2 (the largest power of two in them).

    Sizes are taken by powers of two, so a source has few rows here.
    """
    power = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int").alias("k")
    classes = units.groupBy("source", power).agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.max("size").alias("longest"), F.count_if(F.col("size") > 0).alias("n"))
    own = Window.partitionBy("source")
    whole = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    classes = classes.withColumns({"upto": F.sum("words").over(own.orderBy("k")), "top2": F.max("k").over(whole)})
    for t in (2, 1):
        inside = F.col("k") <= F.col(f"top{t}")
        longest, below = F.max(F.when(inside, F.col("longest"))).over(whole), F.max(F.when(F.col("k") < F.col(f"top{t}"), F.col("k"))).over(whole)
        classes = classes.withColumns({"enough": RESERVE * longest, "below": below})
        reached = F.min(F.when(F.col("upto") >= F.col("enough"), F.col("k"))).over(whole)
        classes = classes.withColumn(f"top{t - 1}", F.coalesce(F.least(reached, "below"), F.col(f"top{t}")))
    low, mid = F.col("k") <= F.col("top0"), F.col("k") <= F.col("top1")
    total = lambda name, which: F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0))
    return classes.groupBy("source", "top0", "top1", "top2").agg(
        F.sum("words").alias("source_size"), total("n", low).alias("n0"), total("n", mid & ~low).alias("n1"), total("n", ~mid).alias("n2"), total("words", low).alias("words0"), total("words", mid).alias("words1")
    )


def _rounded(rows: DataFrame, room: DataFrame, largest: int, seed: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Rows (with copies and n, the number of their source's) as FIELDS and extra; and per rank the words that the last document misses.

    The last document is drawn if it isn't longer than its source's room (rank, room), else it goes to the nearer side.
    """
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("mass", (F.col("copies") - F.col("whole")) * F.col("size"))
    open_ = (F.col("size") > 0) & (F.col("mass") > 0)
    kept = [*FIELDS, "extra"]
    out = rows.filter(~open_).withColumn("extra", F.lit(0)).select(*kept)
    buckets = F.greatest(F.ceil(F.col("n") / fan), F.lit(1))
    rows = rows.filter(open_).select(*FIELDS, "mass", F.pmod(F.xxhash64("salt", "doc_id"), buckets).alias("bucket"))
    count, first = largest, True
    while first or count > 1:
        count, first = -(-count // fan), False
        level = _combined(rows, seed + count)
        out = out.unionByName(level.select("rank", F.explode("done").alias("x")).select("rank", "x.*"))
        rows = level.select("rank", F.expr(f"bucket div {fan}").alias("bucket"), "held.*")
    drawn = _uniform(F.col("salt"), F.col("doc_id"), F.lit(seed)) * F.col("size") < F.col("mass")
    drawn = rows.join(room, "rank").withColumn("extra", F.when(F.col("size") <= F.col("room"), drawn).otherwise(2 * F.col("mass") >= F.col("size")).cast("int"))
    return out.unionByName(drawn.select(*kept)), drawn.select("rank", (F.col("mass") - F.col("extra") * F.col("size")).alias("missed"))


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, fan: int = 128) -> DataFrame:
    """Of each document doc_id, salt (its key with doc_id), size, source_size, target, copies, taken."""
    sized = df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), salt().alias("salt"))
    units = checkpointed(sized.groupBy("source", "doc_id", "salt", "size").agg(F.count("*").alias("rows")))
    wanted = checkpointed(targets(tiers(units), weights, most))
    sources, *largest = wanted.agg(F.count("*"), *[F.max(f"n{t}") for t in range(3)]).first()
    small = sources <= BROADCAST_SOURCES
    told = lambda rows: F.broadcast(rows) if small else rows
    joined = units.join(told(wanted), units["source"].eqNullSafe(wanted["source"])).drop("source")
    joined = joined.withColumn("copies", F.when(F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0))
    tier = F.when(F.col("size") < F.pow(F.lit(2), F.col("top0") + 1), 0).when(F.col("size") < F.pow(F.lit(2), F.col("top1") + 1), 1).otherwise(2)
    joined = joined.withColumn("tier", tier)

    out, share = None, F.col("target") / F.greatest("source_size", F.lit(1))
    for t in (2, 1, 0):
        if t and not largest[t]:
            continue
        room = F.pow(F.lit(2), F.col("top2") - 1) if not t else F.least(share, most - share) * F.col(f"words{t - 1}") / 2
        own = joined.filter(F.col("tier") == t).withColumn("n", F.col(f"n{t}"))
        rounded, missed = _rounded(own, told(wanted.select("rank", room.alias("room"))), largest[t] or 0, seed + t, fan)
        out = rounded if out is None else out.unionByName(rounded)
        if t:
            shift = F.col("rows") * F.coalesce("missed", F.lit(0.0)) / F.greatest(F.col(f"words{t - 1}"), F.lit(1))
            moved = F.least(F.greatest(F.col("copies") + shift, F.lit(0.0)), F.col("rows") * F.lit(float(most)))
            joined = joined.filter(F.col("tier") < t).join(told(missed), "rank", "left").withColumn("copies", moved).drop("missed")

    total = F.col("whole") + F.col("extra")
    out = out.join(told(wanted.select("rank", "source_size", "target")), "rank")
    out = out.withColumn("total", total).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    own = F.expr("total div rows") + (F.col("row") <= F.col("total") % F.col("rows")).cast("long")
    return out.select("doc_id", "salt", "row", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"))


def salt() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them. The key of the join is a document's own, so no key is hot."""
    taken = mix(df, **options).filter("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("salt").alias("__salt")).agg(F.collect_list("copies").alias("__copies"))
    key, n = free(df, "__key"), free(df, "__n")
    keyed = df.withColumn(key, salt())
    numbered = keyed.withColumn(n, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy(key)))
    joined = numbered.join(taken, (numbered[key] == taken["__salt"]) & numbered["doc_id"].eqNullSafe(taken["__id"]))
    copies = F.array_repeat(F.lit(0), F.element_at(taken["__copies"], numbered[n]).cast("int"))
    return joined.filter(numbered[n] <= F.size(taken["__copies"])).select(*(numbered[c] for c in df.columns), F.explode(copies).alias(n)).select(*df.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")
