"""Association-rule filtering of URLs; DataFrame functions only.

A URL becomes a set of tokens: its host's words, path segments with digits blotted out, query keys, fragment and scheme.
Spark's FP-growth mines the token combinations of labelled URLs with
the label as one more item; rules whose consequence is a label and whose support and confidence are high enough are kept. For matching, a rule is filed under the rarest token of its
antecedent: a token set looks its tokens up in this inverted index and keeps the rules whose antecedent it contains.
URLs with the same tokens are looked up once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.store import stored

ALLOW, BLOCK = "allow", "block"
CHANCE = 4.0  #: deviations of a confidence that count as chance
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct ``rule, verdict`` of the longest given rule (verdict, host, path) that fits, else null.

    A rule fits its host and all subdomains where the path starts with the rule's path. The list is a short one, given
    by hand; of rules of one length the first by text wins.
    """
    tests = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        tests = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(tests)
    return tests


def url_tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL; null has none."""
    host, rest = host_of(url), F.coalesce(_after(url), F.lit(""))
    words = F.transform(F.split(host, r"[.-]"), lambda w: F.concat(F.lit("w:"), w))
    segments = F.transform(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "#")))
    asked = F.regexp_extract(rest, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(asked, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("q:"), F.regexp_extract(p, "^[^=]*", 0)))
    fragment = F.regexp_extract(rest, "#(.+)", 1)
    scheme = F.array(F.concat(F.lit("s:"), F.translate(F.regexp_extract(url, "^([^:/?#]*)://", 1), UPPER, LOWER)))
    tokens = F.concat(words, segments, keys, F.when(fragment != "", F.array(F.concat(F.lit("f:"), F.regexp_replace(fragment, "[0-9]+", "#")))).otherwise(F.array()), scheme)
    return F.coalesce(F.array_sort(F.array_distinct(F.when(host != "", tokens))), F.array().cast("array<string>"))


_LABEL = "label="  #: begins the item of a row's label; URL tokens begin otherwise


def _classes(sets: DataFrame, least: int, most: float) -> DataFrame:
    """``rep, members, freq``: tokens that occur in the same rows, under the first of them, with the number of rows.

    Which rows a token is in is told by how many distinct token sets hold it and two 64-bit sums over them.
    """
    marks = [F.xxhash64(F.lit(seed), "tokens").alias(f"h{seed}") for seed in (1, 2)]
    each = sets.select("tokens", "n", *marks).select("h1", "h2", "n", F.explode("tokens").alias("token"))
    tokens = each.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("n").alias("freq")).filter((F.col("freq") >= least) & (F.col("freq") <= most))
    return tokens.groupBy("k", "x1", "x2", "freq").agg(F.min("token").alias("rep"), F.sort_array(F.collect_list("token")).alias("members")).select("rep", "members", "freq")


def _frequent(sets: DataFrame, classes: DataFrame, labels: list, least: int, many: int) -> DataFrame:
    """``c, total, n``: the combinations of tokens, in how many rows, and of each label in how many, where these are frequent."""
    from pyspark.ml.fpm import FPGrowth

    known = sets.select("id", F.explode("tokens").alias("rep")).join(classes.select("rep"), "rep").groupBy("id").agg(F.collect_list("rep").alias("reps"))
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    rows = sets.join(known, "id").select(F.concat("reps", F.array(F.concat(F.lit(_LABEL), number))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("row"))
    # Half a row less than the least keeps rounding from asking for one more.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / many).fit(stored(rows.select("items"), "url-items"))
    is_label = lambda x: F.startswith(x, F.lit(_LABEL))
    found = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("c"), F.get(F.filter("items", is_label), F.lit(0)).alias("of"), "freq")
    counts = [F.coalesce(F.max(F.when(F.col("of") == f"{_LABEL}{i}", F.col("freq"))), F.lit(0)) for i in range(len(labels))]
    grouped = found.filter(F.size("c") > 0).groupBy("c").agg(F.max(F.when(F.col("of").isNull(), F.col("freq"))).alias("total"), F.array(*counts).alias("n"))
    return stored(grouped, "url-frequent")


def mine(labelled: DataFrame, url: str = "url", label: str = "label", min_support: float = 0.0, min_rows: int = 5, min_confidence: float = 0.6,
         everywhere: float = 1.0, min_lift: float | None = None) -> DataFrame:
    """Rules ``antecedent, label, confidence, support, rare, lift`` from URLs and their labels; ``rare`` is the antecedent's rarest token.

    ``lift`` is the confidence over the label's part of all labelled rows. With ``min_lift`` a rule of less than
    ``min_confidence`` is kept too if it has that lift and is not chance: of a rare label no combination may be sure, though
    some hold it far more often. Chance is what Wilson's lower bound of the confidence, four deviations down, leaves at the
    label's part or under it; thousands of combinations are tried, so some reach a lift of 2 in 5 rows by luck.

    A rule's antecedent and label occur together in ``min_rows`` of the labelled rows, a number that does not grow with
    the table, and in a ``min_support`` part of them if that is given. Rows with a null label teach nothing, rows that
    repeat count each. Tokens of all rows and of nearly all are mined like others; only a caller that gives
    an ``everywhere`` under 1 leaves out those of a greater part of the rows. A rule is dropped when a shorter one, part of it, has the
    same label and at least its confidence. Without labelled rows there are no rules.

    Spark's FP-growth finds the combinations of tokens and label in ``min_rows`` rows. Tokens that are in the same rows go
    in as one, so repeated long URLs do not make every subset of theirs a combination; a rule is then written out for each of them.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label).isNotNull()).select(url_tokens(F.col(url)).alias("tokens"), F.col(label).alias("label"))
    sets = stored(rows.groupBy("tokens", "label").agg(F.count("*").alias("n")).withColumn("id", F.md5(F.concat_ws("\n", "label", "tokens"))), "url-sets")
    each = {r[0]: r[1] for r in sets.groupBy("label").agg(F.sum("n")).orderBy("label").collect()}
    many = sum(each.values())
    if not many:
        return spark.createDataFrame([], "antecedent array<string>, label string, confidence double, support double, rare string, lift double")
    labels, least = list(each), max(1, min_rows, math.ceil(min_support * many))
    whole = sets.groupBy("tokens").agg(F.sum("n").alias("n"))
    classes = stored(_classes(whole, least, everywhere * many), "url-classes")
    frequent = _frequent(sets, classes, labels, least, many)

    def lifted(sure: Column, base: Column) -> Column:
        if min_lift is None:
            return F.lit(False)
        n, zz = F.col("total"), CHANCE * CHANCE
        lower = (sure + zz / (2 * n) - CHANCE * F.sqrt(sure * (1 - sure) / n + zz / (4 * n * n))) / (1 + zz / n)
        return (sure >= min_lift * base) & (lower > base)

    shown = F.array(*[F.struct(F.lit(name).alias("label"), F.lit(count / many).alias("base"), F.lit(i).alias("i")) for i, (name, count) in enumerate(each.items())])
    told = frequent.select("c", "total", "n", F.explode(shown).alias("of")).withColumn("own", F.col("n")[F.col("of.i")]).withColumn("sure", F.col("own") / F.col("total"))
    told = told.withColumn("held", (F.col("own") >= least) & ((F.col("sure") >= min_confidence) | lifted(F.col("sure"), F.col("of.base"))))
    told = stored(told.select("c", "total", "own", "sure", "held", "of.*"), "url-told")
    # From one size to the next, the most confident rule among the parts; a rule must be surer than that.
    longest = told.agg(F.max(F.size("c"))).first()[0] or 0
    kept: list[DataFrame] = []
    before = None
    for size in range(1, longest + 1):
        now = told.filter(F.size("c") == size)
        if before is None:
            now = now.withColumn("best", F.lit(-1.0))
        else:
            parts = now.select("c", "i", F.explode(F.transform("c", lambda t: F.array_except("c", F.array(t)))).alias("part"))
            best = parts.join(before, ["part", "i"]).groupBy("c", "i").agg(F.max("best").alias("best"))
            now = now.join(best, ["c", "i"])
        now = stored(now, "url-level")
        kept.append(now.filter(F.col("held") & (F.col("sure") > F.col("best"))))
        before = now.select(F.col("c").alias("part"), "i", F.when(F.col("held"), F.greatest("best", "sure")).otherwise(F.col("best")).alias("best"))
    if not kept:
        return spark.createDataFrame([], "antecedent array<string>, label string, confidence double, support double, rare string, lift double")
    rules = reduce(DataFrame.unionByName, kept).withColumn("id", F.md5(F.concat_ws("\n", "label", "c")))
    alike = rules.select("id", F.explode("c").alias("rep")).join(classes, "rep").groupBy("id").agg(F.collect_list("members").alias("members"), F.collect_list(F.struct("freq", "members")).alias("freqs"))
    one = lambda made, group: F.flatten(F.transform(made, lambda c: F.transform(group, lambda token: F.concat(c, F.array(token)))))
    each_one = F.aggregate("members", F.array(F.array().cast("array<string>")), one)
    written_out = rules.join(alike, "id").withColumn("antecedent", F.explode(each_one)).withColumn("antecedent", F.array_sort("antecedent"))
    freq_of = lambda token: F.filter("freqs", lambda f: F.array_contains(f["members"], token))[0]["freq"]
    rare = F.array_min(F.transform("antecedent", lambda token: F.struct(freq_of(token).alias("freq"), token.alias("token"))))["token"]
    return stored(
        written_out.select("antecedent", "label", F.col("sure").alias("confidence"), (F.col("own") / many).alias("support"), rare.alias("rare"), (F.col("sure") / F.col("base")).alias("lift")),
        "url-rules",
    )


def match(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, by: str = "confidence") -> DataFrame:
    """The rows, inside ``row``, beside ``verdict, confidence, antecedent`` of the rule that decides.

    Of the rules that match, the one with the most of ``by`` decides, confidence or lift, then the most confident, the one with more
    support, the shorter, and the first by text. Where none matches, also for null URLs, the verdict is ``default`` and the others are null.
    """
    whole = urls.select(F.struct(*[urls[f"`{c}`"] for c in urls.columns]).alias("row"), url_tokens(F.col(url)).alias("tokens"))
    whole = whole.withColumn("key", F.md5(F.concat_ws("\n", "tokens")))
    sets = whole.select("key", "tokens").groupBy("key").agg(F.any_value("tokens").alias("tokens"))
    looked_up = sets.select("key", "tokens", F.explode("tokens").alias("rare")).join(rules, "rare")
    hits = looked_up.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct((-F.col(by)).alias("by"), (-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("n"), F.col("antecedent").alias("antecedent"), F.col("label").alias("label"))
    best = hits.groupBy("key").agg(F.min(order).alias("best"))
    return whole.join(best, "key", "left").select(
        "row", F.coalesce("best.label", F.lit(default)).alias("verdict"), (-F.col("best.c")).alias("confidence"), F.col("best.antecedent").alias("antecedent")
    )


def judge_urls(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", default: str = ALLOW,
               by: str = "confidence") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, confidence, antecedent``.

    The longest given rule that fits decides; else the mined rules do. Rows that repeat and rows without an id are judged
    each, other columns are ignored, and an empty table gives an empty result.
    """
    judged = match(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), mined, default=default, by=by)
    judged = judged.withColumn("host", host_of(F.col("row.url"))).withColumn("path", path_of(F.col("row.url")))
    judged = judged.withColumn("given", fitting_rule(F.col("host"), F.col("path"), rules))
    return judged.select(
        "row.page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "verdict").alias("verdict"), "confidence", "antecedent"
    )
