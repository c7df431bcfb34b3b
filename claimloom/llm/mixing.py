"""Mixing sources to target weights, with DataFrame operations only.

Targets: sources in code point order (null last) have the weights given, repeating, and
share `budget` times all words; a source gets at most `cap` times its own words, and what is
beyond is shared again by weight (water filling, in closed form over the sorted ratios).

Each source's documents are dealt by hash into at most BLOCKS blocks (rows that repeat one
another more than BLOCK_DOCS times, by a hash of their place too, so no block is all copies). A source is taken
floor(target / words) times whole, and once more in part: its blocks in permuted order until
the rest of the target is met. The block at the edge is dealt into finer blocks in the same
way, and of the last one documents are taken largest first while they fit.

The drawn blocks, as counts by source, are split among the output shards by a tree: at each
node the left half draws its blocks without replacement (multivariate hypergeometric, drawn
one block at a time), down to the shards, so every source's quota is met exactly. A shard
takes the next blocks of each source's permutation, disjoint from all others, and orders its
rows by hash. All randomness is a hash of the seed, so reruns agree.

A document counts its runs of other than ASCII white space; null and empty texts have size
0 and are taken with no words. Null sources are one source. Equal rows are separate rows:
every row has a number of its own, which mix() writes down with the rows before anything is
drawn, so repeated, null-shifted or map-valued columns can't confuse two of them. An empty
table gives no rows. mix() keeps all columns and adds `mix_shard` and `mix_order`, with
underscores before these names if the table has such columns; op6 ignores extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, column, cut, free, hinted, table

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
BLOCKS, BLOCK_DOCS = 4096, 64
OUT_SHARDS = 8
SEED = 20
#: Rows up to which a table of sources or blocks is broadcast; beyond, it is joined by shuffle.
SMALL_ROWS = 100_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size, docs) with sidx and target. One row per source throughout."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sidx", (F.row_number().over(order) - 1).cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sidx") % len(weights) + 1))
    s = s.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    upto = Window.orderBy("ratio", "sidx").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    s = s.withColumns({"held": F.sum("most").over(upto), "heavy": F.sum("weight").over(upto), "wanted": F.sum("source_size").over(every) * float(budget), "weights": F.sum("weight").over(every)})
    full = F.col("held") + F.col("ratio") * (F.col("weights") - F.col("heavy")) < F.col("wanted")
    s = s.withColumn("full", full)
    s = s.withColumn("level", (F.col("wanted") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return s.select("source", "sidx", "source_size", "docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _uniform(*key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _draw(n: Column, k: Column, m: Column, *key: Column) -> Column:
    """How many of m blocks drawn from n without replacement are among the k wanted."""
    step = lambda a, i: F.struct(
        (a["n"] - 1).alias("n"),
        (a["k"] - F.when(_uniform(*key, i) * a["n"] < a["k"], 1).otherwise(0)).cast("long").alias("k"),
    )
    begin = F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"))
    return F.when((m <= 0) | (k <= 0), F.lit(0).cast("long")).otherwise(k - F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long")), begin, step, lambda a: a["k"]))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(sidx, upto): for each source the running sums, by shard, of its blocks.

    quotas: (sidx, quota). shards: a power of two. The tree's rows hold one number per source.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("sidx", "quota"))).alias("q")).select(F.lit(1).alias("node"), F.transform("q", lambda x: x["sidx"]).alias("ids"), F.transform("q", lambda x: x["quota"].cast("long")).alias("q"))
    depth = shards.bit_length() - 1
    for _ in range(depth):
        def step(a, x):
            got = _draw(a["n"], x["q"], a["m"], F.col("node"), x["i"])
            return F.struct((a["n"] - x["q"]).alias("n"), (a["m"] - got).alias("m"), F.concat(a["out"], F.array(got)).alias("out"))

        total = _total(F.col("q"))
        begin = F.struct(total.alias("n"), F.floor(total / 2).cast("long").alias("m"), F.array().cast("array<bigint>").alias("out"))
        xs = F.transform(F.col("q"), lambda q, i: F.struct(i.alias("i"), q.alias("q")))
        node = node.withColumn("left", F.aggregate(xs, begin, step, lambda a: a["out"]))
        right = F.zip_with("q", "left", lambda q, x: q - x)
        node = cut(node.select("ids", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))).alias("c")).select("c.node", "ids", "c.q"))
    leaves = node.select("node", F.explode(F.arrays_zip(F.col("ids").alias("sidx"), F.col("q").alias("quota"))).alias("x")).select("node", "x.sidx", "x.quota")
    upto = F.sum("quota").over(Window.partitionBy("sidx").orderBy("node"))
    return leaves.withColumn("u", upto).groupBy("sidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "u"))), lambda x: x["u"]).alias("upto"))


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """rows (sidx, need, docs, hash, size, ...) with block, blocks, rank, and drawn.

    drawn: true for rows of blocks within need, false beyond it, null in the block at the
    edge; left: what that block has to give.
    """
    blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("docs") / BLOCK_DOCS))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("hash", F.lit(level)), F.col("blocks").cast("long")).cast("int"))
    stats = rows.groupBy("sidx", "block").agg(F.sum("size").alias("words"), F.count("*").alias("in_block"), F.first("need").alias("need"))
    permuted = Window.partitionBy("sidx").orderBy(F.xxhash64(F.lit(SEED), F.lit(level), "sidx", "block"), "block")
    stats = stats.withColumns({"rank": F.row_number().over(permuted) - 1, "upto": F.sum("words").over(permuted)})
    before = F.col("upto") - F.col("words")
    drawn = F.when(F.col("upto") <= F.col("need"), True).when(before >= F.col("need"), False)
    stats = cut(stats.select("sidx", "block", "rank", "in_block", drawn.alias("drawn"), (F.col("need") - before).alias("left")))
    return rows.join(hinted(stats, SMALL_ROWS), ["sidx", "block"])


def draws(docs: DataFrame, shards: int = OUT_SHARDS, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, row: str | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, and copies, the shards it goes to, one for each time it is taken.

    `row` tells rows apart: the column of that name, else a number made here.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), number.alias("row"), F.xxhash64(text).alias("h"))
    narrow = cut(narrow.withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id", "source", "size", "h")).drop("h"))
    many = cut(narrow.groupBy("hash").count().where(F.col("count") > BLOCK_DOCS).select("hash", F.lit(True).alias("many")))
    narrow = narrow.join(hinted(many, SMALL_ROWS), "hash", "left").withColumn("hash", F.when(F.col("many"), F.xxhash64("hash", "row")).otherwise(F.col("hash"))).drop("many")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(cut(sizes), weights, budget, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    plan = cut(plan.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size")))

    rows = narrow.join(hinted(plan.withColumnRenamed("source", "of"), SMALL_ROWS), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    coarse = cut(_deal(rows, 0).select("row", "doc_id", "sidx", "size", "hash", "source_size", "target", "times", "blocks", "block", "rank", "drawn", "left", "in_block"))
    edge = coarse.where("drawn is null").select("row", "sidx", "size", "hash", F.col("left").alias("need"), F.col("in_block").alias("docs"))
    fine = cut(_deal(edge, 1).select("row", "sidx", "size", "hash", "drawn", "left"))
    # of the finest block, largest first while they fit; a block has some BLOCK_DOCS rows
    last = fine.where("drawn is null").groupBy("sidx").agg(F.first("left").alias("left"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "hash", "row"))).alias("xs"))
    fits = lambda a, x: a["left"] >= -x["less"]
    fold = F.aggregate("xs", F.struct(F.col("left").cast("double").alias("left"), F.array().cast("array<bigint>").alias("out")), lambda a, x: F.struct(F.when(fits(a, x), a["left"] + x["less"]).otherwise(a["left"]).cast("double").alias("left"), F.when(fits(a, x), F.concat(a["out"], F.array(x["row"]))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    picked = last.select(F.explode(fold).alias("row")).unionByName(fine.where("drawn").select("row")).select("row", F.lit(True).alias("picked"))

    # quotas: whole passes over a source's blocks, then the drawn ones and the one at the edge
    passes = coarse.groupBy("sidx").agg(F.first("times").alias("times"), F.count_distinct("block").alias("has"), F.count_distinct(F.when(F.col("drawn").isNull() | F.col("drawn"), F.col("block"))).alias("part"))
    quotas = cut(passes.select("sidx", (F.col("times") * F.col("has") + F.col("part")).cast("long").alias("quota"), "has"))
    tree = cut(split_tree(quotas, shards).join(quotas.select("sidx", "has"), "sidx"))
    out = coarse.join(hinted(cut(picked), SMALL_ROWS), "row", "left").join(hinted(tree, SMALL_ROWS), "sidx")
    again = F.coalesce("picked", F.col("drawn"), F.lit(False)).cast("int")
    shard_of = lambda unit: F.size(F.filter("upto", lambda u: u <= unit)).cast("int")
    n = F.col("times") + again
    copies = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda e: shard_of(e * F.col("has") + F.col("rank")))).otherwise(F.array().cast("array<int>"))
    return out.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, shards: int = OUT_SHARDS, **how) -> DataFrame:
    """The mixture: rows of docs, repeated as often as taken, with mix_shard and mix_order.

    Within a shard the order by mix_order is the local shuffle.
    """
    row, shard, order = free("__row", docs), free("mix_shard", docs), free("mix_order", docs)
    whole = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = draws(whole, shards, **how, row=row).select(F.col("row").alias(row), F.explode("copies").alias(shard))
    taken = cut(taken.withColumn(order, F.xxhash64(F.lit(SEED), shard, row)))
    return whole.join(taken, row).select(*map(column, docs.columns), shard, order)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = draws(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")
