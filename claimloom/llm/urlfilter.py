"""URL filters by path-template trees, with DataFrame operations only.

Each url's path is cut into segments; segments that are only variable by form (numbers,
hexadecimal strings, file names with a number) become wildcards first. Then, level by level
from the host down, the segments that follow a common prefix are compared: a segment stays
literal only if it has `support` pages (else it varies, and joins the wildcard `*`) and if
its labelled pages are bad at another rate than those of its siblings (two-proportion test
at `z`; branches that do not differ merge into `*`). Literals that behave alike are merged in
their turn: in the order of their rates, a literal joins those before it as long as it doesn't
differ from them together, so like is merged with like first; `{a|+2}` is a and two others.
For that, literals are pooled by rate into RATES classes, so a parent of any number of
literals is a short list. Levels follow one another until no prefix has `support` pages with
a further segment; what is deeper is `*` throughout.

What remains are the host's templates. A template's purity is its share of bad labels,
smoothed towards the host's rate, itself smoothed towards the rate of all; templates of a
purity of `reject` or more are blocked, all others allowed. A page is bad if its label says
quality 0 or toxic 1.

Fixed rules (host, path) go first: a rule fits its host and all subdomains if the url's path
begins with the rule's; the longest rule wins (of equally long ones the longer host's).

The tree is grown on counts by distinct path form, never on pages; literals are rows, any
number for a parent. A null url, or one without `://`, has an empty host and
path, fits no rule and belongs to the host ''; an empty path has no segments and is its own
template. Pages without label count for support only; null labels are no labels, several
labels of a page all count. Repeated pages are judged each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, hinted, table

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SUPPORT, Z = 20, 2.6
REJECT, PRIOR = 0.6, 10.0
SMALL_ROWS = 100_000
#: Classes of rates in which literals are compared with each other.
RATES = 1000


def host_of(url: str = "url") -> Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: Column) -> Column:
    """The segments, variable ones as wildcards by form."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}")).when(s.rlike(r"(?i)^[0-9a-f-]{12,}$"), F.lit("{x}")).when(s.rlike(r"[0-9]"), F.regexp_replace(s, r"[0-9]+", "{n}")).otherwise(s),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [(r, ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])) for r in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (h, p, v), ok in reversed(fits):
        name, verdict = F.when(ok, h + p).otherwise(name), F.when(ok, v).otherwise(verdict)
    return name, verdict


def _bad(labels: DataFrame) -> DataFrame:
    """(page, lab, bad): counts of labels and of bad ones."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.select(F.col("doc_id").cast("long").alias("page"), F.coalesce(bad, F.lit(False)).cast("int").alias("bad")).where("page is not null")
    return known.groupBy("page").agg(F.count("*").alias("lab"), F.sum("bad").alias("bad"))


def _differ(bad: Column, lab: Column, bad2: Column, lab2: Column, z: float) -> Column:
    """Whether two shares of bad labels differ; no labels differ from nothing."""
    pooled = F.try_divide(bad + bad2, lab + lab2)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), lab) + F.try_divide(F.lit(1.0), lab2)))
    return F.coalesce(F.abs(F.try_divide(bad, lab) - F.try_divide(bad2, lab2)) > F.lit(z) * spread, F.lit(False))


def _alike(literal: DataFrame, z: float) -> DataFrame:
    """(host, template, seg, name): literals (with lab, bad) under the name they share with those alike."""
    rate = F.coalesce(F.floor(F.try_divide(F.col("bad"), F.col("lab")) * RATES).cast("int"), F.lit(-1))
    rated = literal.withColumn("rate", rate)
    pooled = rated.groupBy("host", "template", "rate").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.min("seg").alias("seg"), F.count("*").alias("n"))
    per = pooled.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("rate", "lab", "bad", "seg", "n"))).alias("xs"))
    kind = "struct<lab:bigint,bad:bigint,seg:string,n:bigint,rates:array<int>>"
    begin = F.array().cast(f"array<{kind}>")
    run = lambda lab, bad, seg, n, rates: F.struct(lab.alias("lab"), bad.alias("bad"), seg.alias("seg"), n.alias("n"), rates.alias("rates"))

    def step(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        joins = (F.size(a) > 0) & (x["rate"] >= 0) & F.coalesce(~_differ(last["bad"], last["lab"], x["bad"], x["lab"], z) & (last["lab"] > 0), F.lit(False))
        more = run(last["lab"] + x["lab"], last["bad"] + x["bad"], F.least(last["seg"], x["seg"]), last["n"] + x["n"], F.concat(last["rates"], F.array(x["rate"])))
        return F.when(joins, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(more))).otherwise(F.concat(a, F.array(run(x["lab"], x["bad"], x["seg"], x["n"], F.array(x["rate"])))))

    runs = per.select("host", "template", F.explode(F.aggregate("xs", begin, step)).alias("g"))
    name = F.when(F.col("g.n") == 1, F.col("g.seg")).otherwise(F.concat(F.lit("{"), F.col("g.seg"), F.lit("|+"), (F.col("g.n") - 1).cast("string"), F.lit("}")))
    named = runs.select("host", "template", name.alias("name"), F.explode("g.rates").alias("rate"))
    return rated.join(named, ["host", "template", "rate"]).select("host", "template", "seg", "name")


def grow(paths: DataFrame, support: int = SUPPORT, z: float = Z) -> DataFrame:
    """(host, form, n, lab, bad, template) for paths (host, form, n, lab, bad); form: array of segments."""
    at = cut(paths.withColumn("template", F.array().cast("array<string>")))
    done, level = [], 0
    while True:
        done.append(at.where(F.size("form") <= level))
        at, seg = at.where(F.size("form") > level), F.get("form", F.lit(level))
        open_ = cut(at.groupBy("host", "template", seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "lab", "bad")]))
        parent = open_.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "bad")]).where(F.col("all_n") >= support)
        if not parent.limit(1).count():
            break
        differs = _differ(F.col("bad"), F.col("lab"), F.col("all_bad") - F.col("bad"), F.col("all_lab") - F.col("lab"), z)
        stays = (F.col("n") >= support) & ((F.col("n") == F.col("all_n")) | differs)
        literal = cut(open_.join(parent, ["host", "template"]).where(stays).select("host", "template", "seg", "lab", "bad"))
        named = cut(_alike(literal, z))
        down = at.withColumn("seg", seg).join(hinted(named, SMALL_ROWS), ["host", "template", "seg"], "left")
        step = F.concat("template", F.array(F.coalesce("name", F.lit("*"))))
        at = cut(down.select("host", "form", "n", "lab", "bad", step.alias("template")))
        level += 1
    rest = F.array_repeat(F.lit("*"), F.size("form") - level)
    out = at.withColumn("template", F.concat("template", rest))
    for part in done:
        out = out.unionByName(part)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = REJECT, prior: float = PRIOR) -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict, template, purity."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), path_of().alias("path"))
    rows = cut(rows.withColumn("form", segments(F.col("path"))))
    counted = rows.join(_bad(labels), F.col("page_id") == F.col("page"), "left")
    paths = counted.groupBy("host", "form").agg(F.count("*").alias("n"), F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = cut(grow(cut(paths)))

    total = tree.agg(F.sum("bad"), F.sum("lab")).first()
    base = (total[0] or 0) / total[1] if total[1] else 0.0
    smooth = lambda to: (F.sum("bad") + F.lit(prior) * to) / (F.sum("lab") + F.lit(prior))
    hosts = tree.groupBy("host").agg(smooth(F.lit(base)).alias("host_rate"))
    rated = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab")).join(hosts, "host")
    rated = rated.withColumn("purity", (F.col("bad") + prior * F.col("host_rate")) / (F.col("lab") + prior))
    by_form = cut(tree.select("host", "form", "template").join(rated.select("host", "template", "purity"), ["host", "template"]))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(hinted(by_form, SMALL_ROWS), ["host", "form"])
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
