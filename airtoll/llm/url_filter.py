"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

DataFrame functions only, training included. A rule is a host and a path prefix; it fits its host
and all subdomains, if the path of the url starts with the rule's path, and the longest fitting rule
wins. Every rule that could fit has a key among the suffixes of the url's host, so rules are found
by an equi-join per host suffix, not by comparing every url with every rule. Urls without a rule are
judged by the regression: character n-grams of host and path, hashed into a fixed number of buckets.

Training is batch gradient descent over a small labelled url table: the examples stay distributed,
each step sends the weights (a bounded array) out and brings one gradient sum per bucket back.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
judged by the bias alone; repeated rows are judged alike; an empty training table gives weights of
0 and the verdict "allow"; a very long url is judged by all its n-grams and all suffixes of its
host (whose length is the square of the host's, which is no more than 253 characters in a valid name); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airtoll.llm.common import ascii_lower
from airtoll.sources.staging import staged

#: Fixed: the rules of the query, (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Labelled urls of the query, invented; both classes use the same domains, languages and kinds of path.
BLOCKED = """
https://casino-bonus.example.com/en/100 https://free-casino.example.org/de/play http://online-casino.example.net/fr/777.html
https://casino-jackpot.example.org/en/win http://win-big.example.com/es/lottery https://jackpot-win.example.net/en/42
https://cheap-meds.example.com/en/pills http://pills-online.example.org/fr/5 https://cheap-pills-shop.example.net/de/900.html
https://cheap-watches.example.org/en/sale http://buy-cheap-viagra.example.com/es/12 https://diet-pills.example.com/en/slim
http://spam-links.example.net/en/1 https://link-farm.example.com/de/2.html http://seo-farm.example.org/en/88 https://spam-blog.example.com/fr/9
http://adult-cams.example.com/en/301 https://hot-xxx.example.org/de/44 https://xxx-videos.example.net/es/7 http://porn-tube.example.com/en/5
https://free-download-crack.example.org/en/keygen http://warez-crack.example.com/de/11 https://fast-payday-loans.example.net/en/3
http://loans-no-credit.example.com/es/66
""".split()
ALLOWED = """
https://www.example.com/en/100 https://blog.example.org/de/play http://m.example.net/fr/777.html https://news.example.org/en/win
http://www.example.com/es/lottery https://m.example.net/en/42 https://library.example.com/en/pills http://museum.example.org/fr/5
https://university.example.net/de/900.html https://shop.example.org/en/sale http://history.example.com/es/12 https://garden.example.com/en/slim
http://weather.example.net/en/1 https://science.example.com/de/2.html http://www.river.example.org/en/88 https://blog.other.example.com/fr/9
http://m.thinking.example.com/en/301 https://the-herald.example.org/de/44 https://town-hall.example.net/es/7 http://school.example.com/en/5
https://docs.example.org/en/keygen http://recipes.example.com/de/11 https://forum.example.net/en/3 http://travel.example.com/es/66
""".split()


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and everything behind each of its dots: all names whose rules fit it."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def with_letters(df: DataFrame) -> DataFrame:
    """df with the characters of host and path as arrays, framed by ^ and $: columns of their own, so that each n-gram
    takes a few of them instead of looking through the text from its start."""
    return df.withColumns({f"{c}_letters": F.split(F.concat(F.lit("^"), F.col(c), F.lit("$")), "") for c in ("host", "path")})


def grams(sizes: tuple[int, ...], buckets: int) -> Column:
    """Distinct buckets of the character n-grams of host_letters and path_letters; the two are told apart."""
    def of(letters: str, mark: str, k: int) -> Column:
        def bucket(i: Column) -> Column:
            gram = F.concat(*[F.coalesce(F.get(letters, i + j), F.lit("")) for j in range(k)])
            return F.pmod(F.xxhash64(F.lit(mark), gram), F.lit(buckets)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(letters) - k, F.lit(0))), bucket)

    return F.array_distinct(F.concat(*[of(c, mark, k) for c, mark in (("host_letters", "h"), ("path_letters", "p")) for k in sizes]))


def margin(buckets: Column, weights: list[float], bias: float) -> Column:
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(w, b))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double"))


def train(labelled: DataFrame, url: str = "url", label: str = "label", sizes: tuple[int, ...] = (3, 4, 5),
          buckets: int = 1 << 14, steps: int = 15, rate: float = 10.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """(weights, bias) of P(block) from a small labelled table (label 1: block)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    examples = staged(with_letters(labelled.where(F.col(label).isin(0, 1)).select(
        F.col(label).cast("double").alias("y"), host.alias("host"), path.alias("path"))).select("y", grams(sizes, buckets).alias("x")))
    counts = examples.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    if not counts["n"] or not 0 < counts["ones"] < counts["n"]:  # nothing to tell apart
        return [0.0] * buckets, 0.0 if not counts["n"] else (1.0 if counts["ones"] else -1.0)
    of_one, of_zero = counts["n"] / (2 * counts["ones"]), counts["n"] / (2 * (counts["n"] - counts["ones"]))
    weights, bias = [0.0] * buckets, 0.0
    speed, push = [0.0] * buckets, 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-margin(F.col("x"), weights, bias)))
        residual = (p - F.col("y")) * F.when(F.col("y") == 1, of_one).otherwise(of_zero) / counts["n"]
        sums = (examples.select(residual.alias("r"), "x").select(F.col("r"), (F.col("r") / F.sqrt(F.size("x").cast("double"))).alias("g"), "x")
                .select(F.explode(F.concat(F.array(F.lit(-1)), "x")).alias("b"), F.when(F.col("b") == -1, F.col("r")).otherwise(F.col("g")).alias("g"))
                .groupBy("b").agg(F.sum("g").alias("g")).collect())  # one row per bucket at most
        push = 0.8 * push - rate * sum(r["g"] for r in sums if r["b"] == -1)
        step = [0.0] * buckets
        for r in sums:
            if r["b"] >= 0:
                step[r["b"]] = r["g"]
        speed = [0.8 * v - rate * (g + decay * w) for v, g, w in zip(speed, step, weights)]
        weights = [w + v for w, v in zip(weights, speed)]
        bias += push
    return weights, bias


def rules_table(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(f"{h}{p}").alias("rule"),
                     F.lit(v).alias("rule_verdict")) for h, p, v in rules]
    kind = "array<struct<rule_host:string,rule_path:string,rule:string,rule_verdict:string>>"
    return df.sparkSession.range(1).select(F.inline(F.array(*rows).cast(kind)))


def match_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, rule_verdict): the longest fitting rule of each row, else nulls.

    The best rule is taken per distinct (host, path); equal lengths go to the smaller rule text.
    """
    parsed = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    names = parsed.groupBy("host", "path").agg(F.lit(1).alias("one"))
    length = F.char_length("rule_host") + F.char_length("rule_path")
    best = (names.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("rule_host"))
            .join(rules, "rule_host").where(F.startswith("path", "rule_path"))
            .groupBy("host", "path").agg(F.min(F.struct((-length).alias("l"), "rule", "rule_verdict")).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", "rule_verdict")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[list[float], float], key: str = "page_id",
          url: str = "url", sizes: tuple[int, ...] = (3, 4, 5), threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (P(block) of the regression)."""
    weights, bias = model
    matched = match_rules(pages, rules_table(pages, rules), key, url)
    score = 1 / (1 + F.exp(-margin(grams(sizes, len(weights)), weights, bias)))
    scored = with_letters(matched).withColumn("score", score)
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("rule_verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the small labelled table of the query; label 1 is block."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(k).alias("label")) for k, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls]
    return spark.range(1).select(F.inline(F.array(*rows)))
