"""Evaluation: predictions matched with gold texts, precision and recall, micro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions import text as T
from .propose import fill

CLAIM_FLOOR, THESIS_FLOOR = 0.5, 0.35


def scores(gold: DataFrame, pred: DataFrame, floor: float = CLAIM_FLOOR) -> DataFrame:
    """(doc_id, i, j, score) of pairs of gold (doc_id, i, text) and pred (doc_id, j, text) at or above floor.

    Overlap counts distinct tokens that share a key with the other side, from both sides, so
    pairs meet by key: the counts come from one join and no pair without a common key is made.
    """
    toks = lambda df, n: df.select("doc_id", n, F.array_distinct(T.content_tokens(F.col("text"))).alias("t"))
    keyed = lambda df, n, k: df.select("doc_id", n, F.size("t").alias(f"n_{n}"), F.explode("t").alias("tok")).groupBy("doc_id", n, f"n_{n}", T.key(F.col("tok")).alias("key")).agg(F.count("*").alias(k))
    g, p = keyed(toks(gold, "i"), "i", "gi"), keyed(toks(pred, "j"), "j", "pj")
    both = g.join(p, ["doc_id", "key"]).groupBy("doc_id", "i", "j", "n_i", "n_j").agg(F.sum(F.col("gi") + F.col("pj")).alias("hits"))
    return both.select("doc_id", "i", "j", (F.col("hits") / (F.col("n_i") + F.col("n_j"))).alias("score")).where(F.col("score") >= floor)


def greedy(pairs: Column) -> Column:
    """Of array<struct<score, i, j>>, best first (ties: the larger i, then j), those with both sides free."""
    ordered = F.reverse(F.array_sort(pairs))
    taken = lambda a, x: F.exists(a, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    kind = "array<struct<score:double,i:int,j:int>>"
    return F.aggregate(ordered, F.array().cast(kind), lambda a, x: F.when(taken(a, x), a).otherwise(F.concat(a, F.array(x))))


def greedy_match(scored: DataFrame) -> DataFrame:
    """One-to-one pairs (doc_id, i, j, score) of each document."""
    row = F.struct(F.col("score").cast("double").alias("score"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    per = scored.groupBy("doc_id").agg(greedy(F.collect_list(row)).alias("m"))
    return per.select("doc_id", F.explode("m").alias("x")).select("doc_id", "x.i", "x.j", "x.score")


def unmatched(side: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return side.join(pairs.select("doc_id", key), ["doc_id", key], "left_anti")


JUDGE_TEMPLATE = """Gold statements:
{GOLD}

Other statements about the same document:
{PRED}

Which other statements say the same as which gold statements? Wording may differ; the subject,
what is said of it and how surely must not. Reply with a JSON array of pairs alone, such as
[["G0", "P3"]]; leave out what has no counterpart.
"""


def judge_prompts(pairs: DataFrame, gold: DataFrame, pred: DataFrame, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """(doc_id, prompt) of the documents in which both sides have statements left."""
    rest = lambda side, key, mark: unmatched(side, pairs, key).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: F.concat(F.lit(mark), x[key].cast("string"), F.lit(": "), x["text"])), "\n").alias(mark))
    both = rest(gold, "i", "G").join(rest(pred, "j", "P"), "doc_id")
    return both.select("doc_id", fill(template, {"GOLD": (F.col("G"), ""), "PRED": (F.col("P"), "")}).alias("prompt"))


def judge(pairs: DataFrame, gold: DataFrame, pred: DataFrame, replies: DataFrame) -> DataFrame:
    """pairs and what stored verdicts add among the unmatched, in their order; score -1 marks them."""
    said = replies.where("stage = 'judge'").withColumn("v", R.verdicts_in(F.col("reply")))
    said = said.select("doc_id", F.posexplode("v.items").alias("n", "x")).select("doc_id", "n", F.col("x.gold").alias("i"), F.col("x.pred").alias("j"))
    free = said.join(unmatched(gold, pairs, "i").select("doc_id", "i"), ["doc_id", "i"], "left_semi").join(unmatched(pred, pairs, "j").select("doc_id", "j"), ["doc_id", "j"], "left_semi")
    row = F.struct((-F.col("n").cast("double")).alias("score"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    more = free.groupBy("doc_id").agg(greedy(F.collect_list(row)).alias("m")).select("doc_id", F.explode("m").alias("x"))
    return pairs.select("doc_id", "i", "j", "score").unionByName(more.select("doc_id", "x.i", "x.j", F.lit(-1.0).alias("score")))


def ratios(gold: Column, pred: Column, matched: Column) -> dict[str, Column]:
    p, r = F.coalesce(F.try_divide(matched, pred), F.lit(0.0)), F.coalesce(F.try_divide(matched, gold), F.lit(0.0))
    return {
        "precision": F.round(p, 3),
        "recall": F.round(r, 3),
        "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 3),
        "compression": F.round(F.try_divide(pred, gold), 2),
    }


def by_document(counts: DataFrame) -> DataFrame:
    """counts (doc_id, gold, pred, matched) with precision, recall, f1, compression."""
    return counts.withColumns(ratios(F.col("gold"), F.col("pred"), F.col("matched")))


def micro(counts: DataFrame) -> DataFrame:
    """One row: sums over documents and their ratios."""
    total = counts.agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gold", "pred", "matched")])
    return total.withColumns(ratios(F.col("gold"), F.col("pred"), F.col("matched")))


def histogram(stages: DataFrame, *by: str) -> DataFrame:
    """(doc columns, stage, n): how many were rejected where."""
    return stages.where("stage is not null").groupBy(*by, "stage").agg(F.count("*").alias("n"))
