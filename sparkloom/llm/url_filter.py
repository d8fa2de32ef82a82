"""URL filter: host and path rules first, then a character language-model ratio.

Two variable-order Markov models over the characters of host and path, one
for accepted and one for rejected URLs, are learnt from the URLs the rules
decide and from a short seed list. Every context that occurs is kept, so what
is learnt grows with the corpus; `rare` can leave out contexts in which less than that share of the training positions end. An alphabet of
32 characters bounds a table at 33**order * 32 rows, some 1.2 million for the longest contexts, whatever the corpus: that is the
proven bound under which it is broadcast. Probabilities interpolate each order
with the next lower one (Witten-Bell). A URL's score is its mean log-likelihood
difference a character; the threshold is calibrated on the URLs that rules decide.
DataFrame operations only.

Null URLs and URLs without `://` have an empty host and path and no rule; what
has no characters to score is allowed. Repeated rows are judged each; equal URLs are scored once. Of two rules that fit the longer one wins. A very long
URL is scored whole. An empty table gives no rows, and other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle

ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_~"
START = "^"

# Example URLs of kinds that a training crawl leaves out or takes.
REJECTED_SEEDS = (
    "casino-win.example/", "online-casino.example/", "poker-bonus.example/", "free-bets.example/", "bet-now.example/",
    "cheap-pills.example/", "buy-viagra.example/", "adult-x.example/", "xxx-videos.example/", "spam-farm.example/",
    "ads-track.example/", "ad-click.example/", "track-pixel.example/", "win-lottery.example/", "free-money.example/",
    "payday-loan.example/", "warez-crack.example/", "torrent-free.example/",
)
ACCEPTED_SEEDS = (
    "www.library.example/", "blog.travel.example/", "news.science.example/", "university.example/", "docs.manual.example/",
    "www.museum.example/", "m.weather.example/", "history.example/", "recipes.example/", "www.council.example/",
    "journal.example/", "blog.garden.example/",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _by_rules(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):  # a longer rule overrides a shorter one
        fits = _fits(r, host, path)
        text, allow = F.when(fits, r.text).otherwise(text), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return text, allow


def _plain(text: Column) -> Column:
    """Characters of the model's alphabet: digits as 0, anything else as ~."""
    return F.regexp_replace(F.regexp_replace(_lower(text), "[0-9]", "0"), r"[^a-z0./_\-]", "~")


def _grams(df: DataFrame, order: int, *keep: str) -> DataFrame:
    padded = F.concat(F.lit(START * order), F.col("s"))
    return df.where(F.length("s") > 0).withColumn("p", padded).select(*keep, F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"), "p").select(
        *keep, F.substring("p", F.col("i"), F.lit(order + 1)).alias("gram"))


def train(labelled: DataFrame, order: int = 3, rare: float = 0.0) -> list[DataFrame]:
    """labelled: s string, allow boolean, n double. One table an order: gram string (context and next character), ratio double."""
    counts = settle(_grams(labelled.groupBy("s", "allow").agg(F.sum("n").alias("n")), order, "allow", "n").groupBy("gram").agg(
        F.sum(F.when(F.col("allow"), F.col("n")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("allow"), F.col("n")).otherwise(0.0)).alias("r")), "url-grams")
    symbols = F.explode(F.split(F.lit(ALPHABET), "")).alias("c")
    sums = [F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")]
    tables: list[DataFrame] = []
    for k in range(order + 1):
        level = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = level.groupBy(F.substring("gram", 1, k).alias("ctx")).agg(*sums)
        total = level.agg(F.sum(F.col("a") + F.col("r")).alias("total"))
        kept = context.join(F.broadcast(total), (F.col("na") + F.col("nr")) >= F.col("total") * rare).select("ctx", "na", "nr", "ta", "tr", symbols)
        kept = kept.select("*", F.concat("ctx", "c").alias("gram"))
        table = kept.join(level, "gram", "left").fillna(0.0, ["a", "r"])
        if k == 0:
            size = len(ALPHABET)
            pa, pr = (F.col("a") + 0.5) / (F.col("na") + 0.5 * size), (F.col("r") + 0.5) / (F.col("nr") + 0.5 * size)
        else:
            below = tables[-1].select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            table = table.withColumn("tail", F.substring("gram", 2, k)).join(below, "tail")

            def mixed(n: str, total: str, types: str, lower: str) -> Column:
                return F.when(F.col(total) > 0, (F.col(n) + F.col(types) * F.col(lower)) / (F.col(total) + F.col(types))).otherwise(F.col(lower))

            pa, pr = mixed("a", "na", "ta", "qa"), mixed("r", "nr", "tr", "qr")
        tables.append(settle(table.select("gram", pa.alias("pa"), pr.alias("pr")), f"url-model-{k}"))
    return [t.select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio")) for t in tables]


def score(urls: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """s -> mean log-likelihood difference a character, by the longest kept context at each position."""
    order = len(tables) - 1
    at = _grams(urls.select("s").distinct(), order, "s")
    best = F.lit(0.0)
    for k, table in enumerate(tables):  # at most (|alphabet| + 1)**k * |alphabet| rows
        at = at.withColumn(f"g{k}", F.substring("gram", order + 1 - k, k + 1)).join(F.broadcast(table.select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))), f"g{k}", "left")
        best = F.coalesce(F.col(f"r{k}"), best)
    return at.groupBy("s").agg(F.avg(best).alias("score"))


def calibrate(scored: DataFrame, width: float = 0.01) -> float:
    """The lowest threshold whose balanced error over score bins of labelled rows (allow boolean, score double) is within 0.01 of the least, moved to the middle of the gap below it: block what looks like known rejections."""
    bin_ = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / width))).cast("int")
    bins = scored.where("score IS NOT NULL").groupBy(bin_.alias("bin")).agg(F.count_if(F.col("allow")).alias("a"), F.count_if(~F.col("allow")).alias("r"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 2001 bins at most
    all_ = Window.partitionBy(F.lit(1))
    error = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(all_), F.lit(1)) + (
        F.sum("r").over(all_) - F.coalesce(F.sum("r").over(below), F.lit(0))) / F.greatest(F.sum("r").over(all_), F.lit(1))
    bins = bins.select("bin", F.lag("bin").over(Window.orderBy("bin")).alias("under"), error.alias("error"), F.sum("a").over(all_).alias("na"), F.sum("r").over(all_).alias("nr"))
    row = bins.withColumn("least", F.min("error").over(all_)).where("error <= least + 0.01").orderBy("bin").first()
    return 0.0 if row is None or not row["na"] or not row["nr"] else (row["bin"] + (row["bin"] if row["under"] is None else row["under"] + 1)) / 2 * width


def judge(pages: DataFrame, rules: list[Rule], order: int = 3, rare: float = 0.0, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict (allow or block), score (null where a URL has no character)."""
    host, path = url_parts(F.coalesce(F.col(url), F.lit("")))
    base = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, allow = _by_rules(rules, F.col("host"), F.col("path"))
    base = base.select("*", rule.alias("rule"), allow.alias("ruled"), _plain(F.concat("host", "path")).alias("s"))
    known = base.where("ruled IS NOT NULL").groupBy("s", F.col("ruled").alias("allow")).agg(F.count("*").cast("double").alias("n"))
    spark = pages.sparkSession
    seeds = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(good).alias("allow")) for good, all_ in ((True, ACCEPTED_SEEDS), (False, REJECTED_SEEDS)) for s in all_])).alias("x")).select("x.*")
    seeds = seeds.select(_plain(F.col("s")).alias("s"), "allow")
    weight = known.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()["n"]
    labelled = known.unionByName(seeds.withColumn("n", F.lit(max(1.0, weight / (len(ACCEPTED_SEEDS) + len(REJECTED_SEEDS))))))
    scores = settle(score(base, train(labelled, order, rare)), "url-scores")
    out = base.join(scores, "s", "left")
    limit = calibrate(known.join(scores, "s").select("allow", "score"))
    verdict = F.when(F.coalesce("ruled", F.coalesce(F.col("score"), F.lit(limit)) >= limit), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
