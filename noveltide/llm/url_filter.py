"""URL filters: rules by host and path, and for all other URLs naive Bayes over the words of host and path.

Names in hosts ("freebets") are split by a unigram Viterbi: the words are those of the pages' visible text, counted over all
pages, and only substrings of the hosts that occur there are looked up, by joins. The classifier is multinomial naive Bayes
over the words of the host and the tokens of the path, learned from all URLs that a rule decides. Tokens are counted by hash
in at most 2^BITS slots, so that the model has a bound of 2^BITS pairs of numbers and can be broadcast at any size of the table.

Defined cases: a null url, or one without `://`, has an empty host and path. With no URL that a rule allows, or none that one
blocks, the method allows all. Equal odds allow. Names are runs of letters and digits of a host, in any script; of equal
splits the one whose last word is shortest is taken. Null html has no words. Repeated rows are judged alike. Long URLs are
read whole; a word of a split has at most LONGEST code points. Empty tables give an empty table. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, saved, slices

#: The contract's rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BITS = 18
LONGEST = 24
SALTS = 64  # keys that a host or substring is dealt over
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased, and what follows up to ? or #."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. A rule is a host, for itself and its subdomains, and how the path starts."""
    none = F.lit(None).cast("string")
    found = [none, none]
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = [F.when(fits, F.lit(x)).otherwise(y) for x, y in zip((rule, verdict), found, strict=True)]
    return found[0], found[1]


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n): the words of all pages' visible text, A-Z lower-cased, of at most LONGEST code points."""
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    words = pages.select(F.explode(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a name. An unknown word of k code points counts as one of 10^(1 - k) occurrences (Viterbi)."""
    best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    log_total, ten = math.log(max(total, 1)), math.log(10)
    for end in range(1, len(name) + 1):
        for start in range(end - 1, max(end - LONGEST, 0) - 1, -1):
            n = counts.get(name[start:end])
            value = best[start] + (math.log(n) if n else (1 - (end - start)) * ten) - log_total
            if value > best[end]:
                best[end], back[end] = value, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _split(total: int):
    def run(batches):
        for batch in slices(batches):
            rows = zip(as_text(batch["host"]), batch["names"].to_pylist(), batch["known"].to_pylist(), strict=True)
            hosts, words = [], []
            for host, names, known in rows:
                counts = {k["part"]: k["n"] for k in known or []}
                hosts.append(host)
                words.append([w for name in names for w in split_name(name, counts, total)])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["host", "words"])

    return run


def split_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) for each of hosts (host), all different: their names split by the unigram counts (word, n)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    names = hosts.select("host", F.filter(F.split("host", r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("names"))
    each = names.select("host", F.explode(F.array_distinct("names")).alias("name"))
    at = each.select("host", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))
    parts = at.select("host", F.explode(F.transform(sizes, lambda k: F.substring(F.col("name"), F.col("at"), k))).alias("part")).distinct()
    # a short substring stands in a large share of all hosts: dealt over salts, with the words' counts once for each that occurs
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    needed = parts.select("part", "salt").distinct().join(words.withColumnRenamed("word", "part"), "part")
    known = parts.join(needed, ["part", "salt"]).groupBy("host").agg(F.collect_list(F.struct("part", "n")).alias("known"))
    return names.join(known, "host", "left").select("host", "names", "known").mapInArrow(_split(total), "host string, words array<string>")


def _tokens(words: Column, path: Column) -> Column:
    """A URL's tokens: words of the host and tokens of the path, marked by where they stand."""
    in_path = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.concat(F.transform(words, lambda x: F.concat(F.lit("h:"), x)), F.transform(in_path, lambda x: F.concat(F.lit("p:"), x)))


def _slots(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(1 << BITS)).cast("int"))


class NaiveBayes:
    """Log odds of block against allow for each slot, with one added to each count, and of the classes."""

    def __init__(self, prior: float, odds: np.ndarray):
        self.prior, self.odds = prior, odds

    def blocks(self, slots: list[int]) -> bool:
        return bool(slots is not None and self.prior + self.odds[slots].sum() > 0)


def learn(labelled: DataFrame) -> NaiveBayes:
    """From all rows (slots, blocked): at most 2^BITS rows of counts come to the driver."""
    urls = {r["blocked"]: r["count"] for r in labelled.groupBy("blocked").count().collect()}
    counts = labelled.select(F.explode("slots").alias("slot"), "blocked").groupBy("slot").agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("good"))
    found = counts.toPandas()
    odds = np.zeros(1 << BITS)
    if len(urls) < 2:
        return NaiveBayes(-1.0, odds)
    bad, good = found["bad"].sum() + len(found), found["good"].sum() + len(found)
    odds[:] = math.log(good) - math.log(bad)  # of a token that was never seen
    odds[found["slot"].to_numpy()] = np.log(found["bad"] + 1) - math.log(bad) - np.log(found["good"] + 1) + math.log(good)
    return NaiveBayes(math.log(urls[True]) - math.log(urls[False]), odds)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, words, rule, verdict) for every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    # a host with a third of all pages is dealt over salts
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    places = saved(urls.select("host", "salt").distinct())
    split = saved(split_hosts(places.select("host").distinct(), saved(page_words(pages))))
    placed = places.join(split, "host")
    known = saved(urls.join(placed, ["host", "salt"]).select("page_id", "host", "path", "words", "rule", "by_rule", _slots(_tokens(F.col("words"), F.col("path"))).alias("slots")))
    model = spark.sparkContext.broadcast(learn(known.where("rule is not null").select("slots", (F.col("by_rule") == "block").alias("blocked"))))

    def run(batches):
        for batch in slices(batches):
            given = batch["by_rule"].to_pylist()
            own = [g or ("block" if model.value.blocks(s) else "allow") for g, s in zip(given, batch["slots"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("page_id", "host", "path", "words", "rule")), pa.array(own, pa.string())], names=["page_id", "host", "path", "words", "rule", "verdict"])

    kind = dict(pages.dtypes)["page_id"]
    return known.mapInArrow(run, f"page_id {kind}, host string, path string, words array<string>, rule string, verdict string")


