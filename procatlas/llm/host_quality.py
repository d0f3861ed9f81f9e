"""Quality rules of whole hosts.

Each text is counted once, into a slim table. Rule failures are summed for each host, a third of all rows on one host
included, since every task combines its own rows first. A host's failure rate for a rule is shrunk towards the mean of all
hosts by a beta prior whose mean and strength come from how much the hosts differ beyond chance, so a few bad documents do
not condemn a small host. Verdicts of failing hosts come back to their documents by a join over salts.

Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procatlas.llm.store import stored

BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: A document fails a rule where its counts say so; rules on a share of nothing do not fail.
RULES: Mapping[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at ascending ``starts``."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda at, then: F.coalesce(F.least(then - at, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def counted(docs: DataFrame, text: str = "text", keep: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: the columns of ``keep`` and ``COUNTS`` as longs; a null text is empty.

    Words are runs of characters that are not ASCII white space. ``n_repeat_words`` are the words of three-word windows that
    occur twice or more in the text, windows compared by their words. Lines are what ``\\n`` parts and count where they hold
    a word.
    """
    keep = dict(keep or {})
    names = list(keep)
    whole = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # Each array is a column of its own before a lambda looks into it: an expression in its place would be computed for every element.
    words = whole.select(
        *names,
        F.filter(F.split("__text", BLANK), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("__lines"),
        F.length(F.translate("__text", BLANKS, "")).alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).alias("n_symbols"),
    )
    at = lambda i, by: F.get("__words", i + by)
    starts = F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0)))
    hashed = words.select(
        *names, "__words", F.size("__words").alias("n_words"), "word_chars", "n_symbols", F.size("__lines").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.transform(starts, lambda w, i: F.xxhash64(w, at(i, 1), at(i, 2))).alias("__hashes"),
    )
    # Texts whose window hashes all differ repeat nothing; in others equal windows become neighbours, told apart by their words.
    window = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c"), i.alias("i")))
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    ordered = hashed.withColumn("__ordered", F.when(repeats, F.sort_array(window))).drop("__words", "__hashes")
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    near = lambda x, i: F.coalesce(same(x, F.get("__ordered", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("__ordered", i + 1)), F.lit(False))
    found = ordered.withColumn("__starts", F.sort_array(F.transform(F.filter("__ordered", near), lambda x: x["i"])))
    counts = {c: F.col(c) for c in COUNTS[:-1]} | {"n_repeat_words": F.when(F.col("__starts").isNull(), F.lit(0)).otherwise(_covered(F.col("__starts")))}
    return found.select(*names, *[counts[c].cast("long").alias(c) for c in COUNTS])


def beta_priors(hosts: DataFrame, rules: Mapping[str, str], least: float = 1.0, most: float = 1e6) -> dict[str, tuple[float, float]]:
    """Parameters of the beta prior of each rule, from a table of hosts with ``n`` and the failures ``k_<rule>``.

    The mean is that of all documents. The strength follows from the variance of the hosts' rates beyond what chance
    gives to hosts of their sizes (the moment estimator for unequal sizes); hosts that differ by chance alone get the
    greatest strength ``most``, hosts that are all of one kind and a single host the ``least``, which is one document.
    Only a few sums leave the cluster.
    """
    sums = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn")]
    for rule in rules:
        k = F.col(f"k_{rule}")
        sums += [F.sum(k).alias(f"k_{rule}"), F.sum(k.cast("double") ** 2 / F.col("n")).alias(f"kk_{rule}")]
    total = hosts.agg(*sums).first()
    out = {}
    for rule in rules:
        if not total["n"]:
            out[rule] = (0.5, 0.5)
            continue
        mean = total[f"k_{rule}"] / total["n"]
        spread, chance = mean * (1 - mean), total["hosts"] - 1
        room = total["n"] - total["hosts"] + 1 - total["nn"] / total["n"]
        if spread == 0 or room <= 0:
            strength = least
        else:
            alike = ((total[f"kk_{rule}"] - mean * mean * total["n"]) / spread - chance) / room
            strength = min(most, 1 / alike - 1) if alike > 1 / (1 + most) else most
            strength = max(strength, least)
        out[rule] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(counts: DataFrame, rules: Mapping[str, str] = RULES, limit: float = 0.5, deviations: float = 2.0) -> DataFrame:
    """One row per host: ``host, n``, for each rule the failures ``k_<rule>`` and the shrunk ``rate_<rule>``, and ``failed``.

    ``failed`` holds the rules whose rate is above ``limit`` by so many standard deviations of its posterior.
    """
    failures = [F.count_if(F.expr(test)).alias(f"k_{rule}") for rule, test in rules.items()]
    hosts = stored(counts.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *failures), "host-failures")
    priors = beta_priors(hosts, rules)
    # Parameters of each host's posterior, then its mean and deviation.
    posterior = [F.struct((F.col(f"k_{rule}") + a).alias("a"), (F.col("n") - F.col(f"k_{rule}") + b).alias("b")).alias(f"p_{rule}") for rule, (a, b) in priors.items()]
    rates = [F.expr(f"p_{rule}.a / (p_{rule}.a + p_{rule}.b)").alias(f"rate_{rule}") for rule in rules]
    kept = [c for c in hosts.columns]
    found = hosts.select(*kept, *posterior).select(*kept, *rates, *[F.expr(f"p_{rule}.a + p_{rule}.b").alias(f"w_{rule}") for rule in rules])
    above = [F.when(F.expr(f"rate_{rule} - {deviations} * sqrt(rate_{rule} * (1 - rate_{rule}) / (w_{rule} + 1)) > {limit}"), F.lit(rule)) for rule in rules]
    return found.select(*kept, *[f"rate_{rule}" for rule in rules], F.array_compact(F.array(*above)).alias("failed"))


def judge_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", rules: Mapping[str, str] = RULES, base: tuple[str, ...] = BASE,
    limit: float = 0.5, deviations: float = 2.0, salts: int = 32,
) -> DataFrame:
    """One row per input row: ``doc_id``, its counts, ``base_failed``, ``host``, ``host_failed`` and ``kept``.

    A document stays unless it fails a ``base`` rule itself or its host fails a rule. Rules outside ``base`` act through
    the host alone. Documents without a host, null texts (which are empty), repeated rows and rows without an id are judged
    like all others, the first by the base rules only. An empty table gives an empty result; other columns are ignored.
    """
    counts = stored(counted(docs, text, {"doc_id": F.col(doc_id), "host": F.col(host)}), "host-counts")
    verdicts = host_verdicts(counts, rules, limit, deviations).filter(F.size("failed") > 0)
    spread = verdicts.select(F.col("host").alias("__host"), F.col("failed").alias("host_failed"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    salted = counts.withColumn("__at", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(salts)).cast("int"))
    joined = salted.join(spread, (F.col("host") == F.col("__host")) & (F.col("__at") == F.col("__salt")), "left")
    tests = [F.expr(rules[rule]) for rule in base]
    own = tests[0]
    for test in tests[1:]:
        own = own | test
    return joined.select("doc_id", *COUNTS, own.alias("base_failed"), "host", F.coalesce("host_failed", F.array().cast("array<string>")).alias("host_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("host_failed") == 0)
    )
