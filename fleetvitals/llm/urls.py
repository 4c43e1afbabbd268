"""URL filter: rules by host and path, and a ratio of two character models for the rest.

The models are variable-order Markov models over the characters of host and path
(digits folded to 0), one of accepted and one of rejected URLs, with contexts of up
to five characters, each order smoothed by the one below in the manner of Witten and
Bell: P(c | h) = (n(hc) + t(h) P(c | h')) / (n(h) + t(h)), t(h) being the number of
different characters seen after h. A URL's score is the difference of both log
likelihoods per character; the threshold is set on URLs that the models did not see.
All of it is DataFrame operations; equal strings are counted and scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.session import stored

ORDER = 5
FOLDS = 5
PAD, LAST = "\u0002", "\u0003"
CHARACTERS = 256
BUCKET = 0.01
BUCKETS = 400
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without "://" or for a null url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct (rule, verdict), or null; rules are (verdict, host, path)."""
    fits = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        inside = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits.append(F.when(inside & F.startswith(path, F.lit(rule_path)), F.struct(
            F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def _positions(strings: DataFrame, *others: str) -> DataFrame:
    """Every character of `string` (a mark at the end included) after its five predecessors."""
    padded = F.concat(F.lit(PAD * ORDER), "string", F.lit(LAST))
    gram = F.explode(F.transform(
        F.sequence(F.lit(1), F.length("string") + 1),
        lambda i: F.substring(padded, i, F.lit(ORDER + 1))))
    return strings.select(*others, gram.alias("gram"))


def model(strings: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Counts by order: per gram how often either class has it, per context its totals.

    `strings` has string, accepted and rejected (how many URLs of either class have it).
    Grams and contexts of all orders come from the longest ones by dropping first characters.
    """
    grams = stored(_positions(strings, "accepted", "rejected").groupBy("gram").agg(
        F.sum("accepted").alias("a"), F.sum("rejected").alias("r")), "grams")
    levels = []
    for order in range(ORDER + 1):
        cut = grams.groupBy(F.substring("gram", ORDER + 1 - order, order + 1).alias("tail")).agg(
            F.sum("a").alias("a"), F.sum("r").alias("r"))
        if order == 0:
            context = F.lit("")
        else:
            context = F.substring("tail", 1, order)
        totals = cut.groupBy(context.alias("context")).agg(
            F.sum("a").alias("n_a"), F.sum((F.col("a") > 0).cast("long")).alias("t_a"),
            F.sum("r").alias("n_r"), F.sum((F.col("r") > 0).cast("long")).alias("t_r"))
        levels.append((cut, totals))
    return levels


def scores(strings: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(string, score): log likelihood per character as accepted minus as rejected, in nats."""
    at = stored(_positions(strings, "string").groupBy("string", "gram").agg(
        F.count("*").alias("n")), "positions")
    grams = at.select("gram").distinct().select(
        "gram", F.lit(1 / CHARACTERS).alias("p_a"), F.lit(1 / CHARACTERS).alias("p_r"))
    for order, (counts, totals) in enumerate(levels):
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        context = F.substring("gram", ORDER + 1 - order, order) if order else F.lit("")
        grams = (grams.withColumn("tail", tail).withColumn("context", context)
                 .join(counts, "tail", "left").join(totals, "context", "left").select(
                     "gram", *[_smoothed(c).alias(f"p_{c}") for c in ("a", "r")]))
    ratio = stored(grams.select("gram", F.log(F.col("p_a") / F.col("p_r")).alias("ratio")), "ratios")
    return at.join(ratio, "gram").groupBy("string").agg(
        (F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))


def _smoothed(c: str) -> Column:
    seen, total, kinds = (F.coalesce(F.col(n), F.lit(0)) for n in (c, f"n_{c}", f"t_{c}"))
    lower = F.col(f"p_{c}")
    return F.when(total > 0, (seen + kinds * lower) / (total + kinds)).otherwise(lower)


def threshold(scored: DataFrame) -> float:
    """The score from which on a URL is accepted: least balanced error on unseen URLs.

    `scored` has score, accepted and rejected. At most 401 counts come to the driver.
    0 where these lack a class.
    """
    bucket = F.floor(F.least(F.greatest("score", F.lit(-BUCKETS / 2 * BUCKET)),
                             F.lit(BUCKETS / 2 * BUCKET)) / BUCKET)
    counts = scored.groupBy(bucket.alias("bucket")).agg(
        F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).orderBy("bucket").collect()
    all_a, all_r = sum(x.a for x in counts), sum(x.r for x in counts)
    if not all_a or not all_r:
        return 0.0
    edges, lost, kept = [], 0, all_r
    for x in counts:
        edges.append((lost / all_a + kept / all_r, x.bucket))
        lost, kept = lost + x.a, kept - x.r
    edges.append((lost / all_a + kept / all_r, counts[-1].bucket + 1))
    least = min(e for e, _ in edges)
    best = [i for i, (e, _) in enumerate(edges) if e == least]
    upper = edges[best[len(best) // 2]][1]
    below = [x.bucket for x in counts if x.bucket < upper]
    return BUCKET * (upper + (below[-1] + 1 if below else upper)) / 2


def judged(pages: DataFrame, rules: list[Rule], id_col: str = "page_id",
           url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `pages`.

    A rule decides where one fits, the models elsewhere. They learn from the URLs that
    rules decide; one string in five is held out for the threshold. Where rules leave
    either class without URLs, the rest is allowed. score is null where a rule decides.
    Null urls and urls without "://" have an empty host and path, and are judged as such.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("fit", ruled(F.col("host"), F.col("path"), rules)).withColumn(
        "string", F.regexp_replace(F.concat("host", "path"), "[0-9]", "0"))
    parts = stored(parts, "urls")
    counted = stored(parts.groupBy("string").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("accepted"),
        F.count_if(F.col("fit.verdict") == "block").alias("rejected"),
        F.count_if(F.col("fit").isNull()).alias("open")), "strings")
    unseen = (F.crc32(F.col("string").cast("binary")) % FOLDS) == 0
    decided = counted.where("accepted + rejected > 0")
    levels = model(decided.where(~unseen))
    wanted = counted.where(unseen & F.expr("accepted + rejected > 0") | (F.col("open") > 0))
    scored = stored(scores(wanted, levels), "scores")
    classes = decided.agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).first()
    passes = F.lit(True)
    if classes.a and classes.r:
        passes = F.col("score") >= threshold(decided.where(unseen).join(scored, "string"))
    verdict = F.coalesce("fit.verdict", F.when(passes, "allow").otherwise("block"))
    return parts.join(scored, "string", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("score")).alias("score"))
