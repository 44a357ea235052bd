"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document's wanted copies are target / size of its source: a whole part that it surely gets, and a fraction. Fractions
are paired; each pair moves mass (copies times size) from one to the other, in a random direction whose odds keep every
expectation, until one of the two is integral. So a pair's words stay the same. Blocks of BLOCK documents are folded
this way, each leaving at most one fraction; those meet BLOCK by BLOCK in the next level of the reduction tree, until
each source has one fraction left, which a last draw settles. A source's words miss its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contagraph.llm.common import col, fresh, in_order, stash, table, word_count

WEIGHTS, MAX_COPIES, BLOCK, SEED = (5, 2, 1), 3, 64, 20
#: Source tables of up to so many rows are broadcast; larger ones are joined by a salted key.
BROADCAST_SOURCES, SALTS = 50_000, 32
_TINY = 1e-9


def uniform(*keys: Column | int) -> Column:
    """A number in [0, 1) that depends on keys alone."""
    h = F.xxhash64(F.lit(SEED), *[F.lit(k) if isinstance(k, int) else k for k in keys])
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def _sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each of sums, what comes before the row in the order: within its range of rows, and in all ranges before.

    Rows are dealt into ranges, so no task sorts them all; only one row a range meets in one task.
    """
    ranged = stash(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(*[F.sum(x).alias(k) for k, x in sums.items()])
    parts = parts.select("part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_ahead") for k in sums])
    rows = ranged.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"{k}_inside") for k, x in sums.items()])
    return rows.join(F.broadcast(parts), "part").select(*df.columns, *[(F.col(f"{k}_ahead") + F.col(f"{k}_inside")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """source, source_size, n, target: weights cycle over the sources by code point (null last) and share all words.

    A target stops at `most` times its source's words; the excess is shared again by weight. That level is found in one
    pass: by ascending most*size/weight, the first source that isn't capped sets the words per weight of all the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_name = F.col("source").asc_nulls_last()
    ranked = _sums_before(per, [by_name], {"place": F.lit(1).cast("long")}, "mix-places")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("per", F.col("cap") / F.col("weight"))
    leveled = stash(_sums_before(ranked, [F.col("per").asc(), by_name], {"caps": F.col("cap"), "weights": F.col("weight")}, "mix-caps"), "mix-levels")
    words, weight = leveled.agg(F.sum("source_size"), F.sum("weight")).first()
    share = (F.lit(words) - F.col("caps")) / (F.lit(weight) - F.col("weights"))
    # of equal caps a weight, the first is the one with the largest share
    level = leveled.agg((-F.min(F.when(share <= F.col("per"), F.struct("per", (-share).alias("less"))))["less"]).alias("level")).first()[0]
    return leveled.select("source", "source_size", "n", F.least("cap", F.coalesce(F.lit(level).cast("double") * F.col("weight"), F.col("cap"))).alias("target"))


def _folded(level: int) -> Column:
    """Of the sorted array `items` of structs (key, p, size, ...): those decided, with `up`, and the one left open."""
    nothing = F.expr("filter(items, x -> false)")

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"][0]
        p, s, q, t = o["p"], o["size"], x["p"], x["size"]
        to_o, to_x = F.least(1 - p, q * t / s), F.least(p, (1 - q) * t / s)  # of o's copies, gained or lost
        gains = uniform(level, o["key"], x["key"]) * (to_o + to_x) < to_x
        p2 = F.when(gains, p + to_o).otherwise(p - to_x)
        q2 = F.when(gains, q - to_o * s / t).otherwise(q + to_x * s / t)
        set_p = lambda y, v: F.struct(y["key"].alias("key"), v.alias("p"), y["size"].alias("size"), y["id"].alias("id"))
        after = F.array(set_p(o, p2), set_p(x, q2))
        whole = lambda y: (y["p"] < _TINY) | (y["p"] > 1 - _TINY)
        paired = F.struct(F.concat(acc["done"], F.filter(after, whole)).alias("done"), F.filter(after, lambda y: ~whole(y)).alias("open"))
        return F.when(F.size(acc["open"]) == 0, F.struct(acc["done"].alias("done"), F.array(x).alias("open"))).otherwise(paired)

    return F.aggregate("items", F.struct(nothing.alias("done"), nothing.alias("open")), step)


def mixing_decisions(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row a document: doc_id, source, size, copy, source_size, target, copies, taken (copies times size).

    Rows that agree in id, source and size are numbered by `copy` and decided one by one. Null text has no words; null
    sources are a source of their own; null ids are equal to each other. Documents without words never move mass: their
    fraction is drawn alone. Draws depend on id, source, size, copy and level only, so reruns and other partitionings agree.
    Of a very long text only its number of words counts; extra columns don't matter; an empty table gives no row.
    """
    sizes = docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"), word_count(col(text)).alias("size"))
    sizes = stash(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy")), "mix-sizes")
    targets = stash(source_targets(sizes, weights), "mix-targets")
    n_sources, largest = targets.agg(F.count("*"), F.max("n")).first()
    same = F.col("source").eqNullSafe(F.col("s_source"))
    named = targets.withColumnRenamed("source", "s_source")
    if n_sources <= BROADCAST_SOURCES:
        joined = sizes.join(F.broadcast(named), same)
    else:
        salted = named.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("s_salt"))).drop("salt", "s_salt")
    key = F.xxhash64(F.lit(SEED), "doc_id", "source", "size", "copy")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = joined.withColumn("wanted", wanted).withColumn("whole", F.floor(F.col("wanted") + _TINY))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole"))).withColumn("key", key)
    moves = (F.col("p") > _TINY) & (F.col("size") > 0)
    items = rows.where(moves).select("source", F.floor(F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.ceil(F.col("n") / (BLOCK * 3 // 4)))).alias("block"), "key", "p", F.col("size").cast("double").alias("size"), F.struct("doc_id", "size", "copy").alias("id"))
    blocks, decided, level = -(-int(largest or 0) // (BLOCK * 3 // 4)), [], 0
    while True:
        folded = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("key", "p", "size", "id"))).alias("items")).select("source", "block", _folded(level).alias("out"))
        folded = stash(folded.select("source", "block", "out.done", "out.open"), f"mix-level{level}")
        decided.append(folded.select("source", F.explode("done").alias("x")))
        if blocks <= 1:
            break
        items = folded.select("source", F.floor(F.col("block") / BLOCK).alias("block"), F.explode("open").alias("x")).select("source", "block", "x.*")
        blocks, level = -(-blocks // BLOCK), level + 1
    decided.append(folded.select("source", F.explode("open").alias("x")).withColumn("x", F.col("x").withField("p", F.when(uniform(level + 1, F.col("x.key")) < F.col("x.p"), 1.0).otherwise(0.0))))
    up = decided[0]
    for more in decided[1:]:
        up = up.unionByName(more)
    up = up.where(F.col("x.p") > 0.5).select(F.col("source").alias("u_source"), F.col("x.id.doc_id").alias("u_doc_id"), F.col("x.id.size").alias("u_size"), F.col("x.id.copy").alias("u_copy"), F.lit(1).alias("up"))
    found = rows.join(up, F.col("doc_id").eqNullSafe(F.col("u_doc_id")) & F.col("source").eqNullSafe(F.col("u_source")) & (F.col("size") == F.col("u_size")) & (F.col("copy") == F.col("u_copy")), "left")
    extra = F.when(moves, F.coalesce("up", F.lit(0))).otherwise((uniform(-1, F.col("key")) < F.col("p")).cast("int"))
    return found.withColumn("copies", F.least(F.col("whole") + extra, F.lit(MAX_COPIES)).cast("long")).select("doc_id", "source", "size", "copy", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: docs with every row repeated as often as decided, columns unchanged."""
    size, nth, copies, d_id, d_source, d_size, d_copy, _ = names = fresh(docs, "size", "nth", "copies", "d_id", "d_source", "d_size", "d_copy", "each")
    decided = mixing_decisions(docs, weights, doc_id, source, text).select(F.col("doc_id").alias(d_id), F.col("source").alias(d_source), F.col("size").alias(d_size), F.col("copy").alias(d_copy), F.col("copies").alias(copies))
    others = in_order(docs, doc_id, source, text)  # equal texts of one id are numbered in the order of their other columns
    numbered = docs.withColumn(size, word_count(col(text)))
    numbered = numbered.withColumn(nth, F.row_number().over(Window.partitionBy(col(doc_id), col(source).cast("string"), col(size)).orderBy(F.xxhash64(col(text)), *([] if others is None else [others]))))
    match = col(doc_id).eqNullSafe(F.col(d_id)) & col(source).cast("string").eqNullSafe(F.col(d_source)) & (F.col(size) == F.col(d_size)) & (F.col(nth) == F.col(d_copy))
    return numbered.join(decided, match).withColumn(names[-1], F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*map(col, docs.columns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing_decisions(docs).select("doc_id", "size", "source_size", "target", "taken")
