"""URL filters: allow and block rules, then naive Bayes on segmented names.

A url's host runs from after the first ``://`` up to ``/``, ``?``, ``#`` or the end;
the path follows up to ``?``, ``#`` or the end.  A rule is a host and a path
prefix; the longest fitting rule decides.  For all other urls every letter run of host
and path is cut into words by unigram Viterbi (word counts of the page texts plus the
seed words), and a multinomial naive Bayes model scores the words: the block
class holds the seed words, smoothed by the corpus distribution, the allow
class is the corpus distribution.

Distributed form: word counts are a grouped table, never gathered.  Each
distinct letter run is expanded into its substrings of up to 24 letters, which are joined
with the counts; longer counted words are found by their first 24 letters.  Viterbi then
needs only the run's own rows.  Runs and words of any length are cut and found: a run goes
through the join in overlapping blocks, under its hash where it is long.  Scores are joined back on the run with a salt,
since a run such as "com" is in most urls.

Null urls and urls without ``://`` have an empty host and path, no words, and
the prior's verdict (allow).  Null page texts hold no words.  Repeated rows get equal
verdicts.  Empty tables give no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, store

#: word -> pseudo count in the block class; ambiguous words weigh less
BLOCK_SEEDS = {w: 4 for w in (
    "ads adult banner bets betting casino clickbait escort gambling hack jackpot malware nude payday phishing pills poker "
    "popup porn sex slots spam torrent tracker viagra warez xxx").split()} | {w: 1 for w in (
        "ad bet bonus cheap click deal farm free loan loans lottery track win").split()}
#: letters of a word that the join compares; starts of substrings in one block of a run
WORD, BLOCK = 24, 256
SALTS = 8
UNSEEN = 10_000
_TAGS = re.compile(r"(?s)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;")
_WORDS = re.compile(r"[^\W\d_]+")


def host_of(after: Column) -> Column:
    """Host of what follows the first ``://``."""
    return F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(after: Column) -> Column:
    return F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) for the columns host and path; longest rule first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, how).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) over the texts of all pages, pre-counted in each task."""
    def run(rows):
        count: Counter[str] = Counter()
        for html, in rows:
            if html:
                count.update(_WORDS.findall(_TAGS.sub(" ", html).lower()))
            if len(count) > 200_000:
                yield from count.items()
                count.clear()
        yield from count.items()

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return map_rows(pages.select(html_col), run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, counts: dict[str, float], total: float) -> list[str]:
    """The most probable split; unknown pieces cost more the longer they are."""
    lengths = sorted({len(w) for w in counts if counts[w]}, reverse=True)
    # of all unknown pieces that end here, the best begins where best - 2.3 * start is least
    base, start, least = math.log(total) if total else 0.0, 0, 0.0
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    for j in range(1, len(run) + 1):
        best[j], back[j] = best[start] + base + 2.3 * (j - start), start
        for m in lengths:
            n = counts.get(run[j - m:j]) if m <= j else None
            if n and best[j - m] - math.log(n / total) < best[j]:
                best[j], back[j] = best[j - m] - math.log(n / total), j - m
        if best[j] - 2.3 * j < least:
            start, least = j, best[j] - 2.3 * j
    out, j = [], len(run)
    while j:
        out.append(run[back[j]:j])
        j = back[j]
    return out[::-1]


def log_ratio(word: str, counts: dict[str, float], total: float, seeds: dict[str, int], strength: float) -> float:
    """log P(word | block) / P(word | allow)."""
    mass = sum(seeds.values())
    p = (counts.get(word, 0) + 0.5) / (total + UNSEEN)  # words never seen share a little mass
    alpha = strength * mass
    return math.log((seeds.get(word, 0) + alpha * p) / (mass + alpha)) - math.log(p)


def score_runs(runs: DataFrame, counts: DataFrame, total: int, seeds: dict[str, int], strength: float) -> DataFrame:
    """(run, words, score) for a table of distinct letter runs."""
    runs = runs.withColumns({"size": F.length("run"), "key": F.when(F.length("run") <= BLOCK, F.col("run")).otherwise(
        F.concat(F.lit("#"), F.sha2("run", 256)))})
    blocks = runs.select("key", "size", "run", F.explode(F.expr(f"sequence(0, (size - 1) div {BLOCK})")).alias("b")).select(
        "key", "size", F.expr(f"substring(run, b * {BLOCK} + 1, {BLOCK + WORD - 1})").alias("piece"))
    parts = blocks.select("key", "size", F.explode(F.expr(
        f"flatten(transform(sequence(1, least({BLOCK}, length(piece))), i -> transform(sequence(1, least({WORD}, length(piece) - i + 1)), "
        "k -> substring(piece, i, k))))")).alias("word")).distinct()
    long = counts.where(F.length("word") > WORD).select(
        F.substring("word", 1, WORD).alias("first"), F.col("word").alias("whole"), "n", F.length("word").alias("m"))
    found = parts.join(counts.where(F.length("word") <= WORD), "word").select("key", "word", "n").union(
        parts.where(F.length("word") == WORD).join(long, (F.col("word") == F.col("first")) & (F.col("m") <= F.col("size")))
        .select("key", F.col("whole").alias("word"), "n"))  # begins alike: whether the run has it is seen below
    known = found.groupBy("key").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("ns"))  # of one run
    table = runs.join(known, "key", "left").select("run", "known", "ns")
    schema = pa.schema([("run", pa.string()), ("words", pa.list_(pa.string())), ("score", pa.float64())])
    whole = total + sum(seeds.values())

    def run(rows):
        for text, words, ns in rows:
            corpus = {w: n for w, n in zip(words or (), ns or ()) if len(w) <= WORD or w in text}
            model = Counter(corpus)
            for w, n in seeds.items():
                if w in text:
                    model[w] += n
            cut = viterbi(text, model, whole)
            yield text, cut, sum(log_ratio(w, corpus, total, seeds, strength) for w in cut)

    return map_rows(table, run, schema)


def judge(pages: DataFrame, id_col: str, url_col: str, html_col: str, rules: list[tuple[str, str]],
          seeds: dict[str, int] | None = None, strength: float = 4.0, prior: float = 0.02) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every page."""
    seeds = BLOCK_SEEDS if seeds is None else seeds
    after = F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), host_of(after).alias("host"), path_of(after).alias("path"))
    rule, decided = rule_of(rules)
    counts = store(word_counts(pages, html_col), "url-words")  # asked three times
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    texts = base.where(decided.isNull()).select(F.concat_ws(" ", "host", "path").alias("text")).distinct()
    runs = texts.select("text", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("run")).where("run <> ''")
    scored = score_runs(runs.select("run").distinct(), counts, total, seeds, strength).select("run", "score")
    salted = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = runs.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(
        salted, ["run", "salt"]).groupBy("text").agg(F.sum("score").alias("sum"))
    odds = math.log(prior / (1 - prior))
    out = base.withColumn("text", F.concat_ws(" ", "host", "path")).join(sums, "text", "left").withColumns(
        {"rule": rule, "score": F.round(F.coalesce("sum", F.lit(0.0)) + odds, 6)})
    return out.select("id", "host", "path", "rule", F.coalesce(decided, F.when(F.col("score") > 0, "block").otherwise(
        "allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
