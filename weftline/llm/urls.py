"""URL filters: rules for hosts and paths, and gradient-boosted trees for the rest.

The URLs that rules decide are the labelled ones; trees trained on their lexical features judge the others. Everything is
DataFrame work: features are column expressions, the trees are Spark's own, and only the fit takes a bounded sample
(`sample` labelled URLs of least hash). Suffix statistics, the smoothed share of blocked URLs by last host label and by
first path segment, count all labelled URLs; they are kept in 1024 hash slots each, so what is sent back is bounded.

Edge cases: a null URL, or one without "://", has an empty host and path and no rule; if all labelled URLs agree, or there
are none, what they say (or allow) goes for all. Of rules that fit, the longest decides; of equally long ones the
first in alphabetical order. Repeated rows are judged each. Extra columns pass through; existing result columns are replaced.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

SLOTS = 1024
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_share", "entropy", "parameters", "marks", "suffix_share", "folder_share")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of a URL; empty if it has no scheme."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(text, pattern, 2)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The rule that decides, like ``net/``; null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def slot(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(SLOTS)).cast("int")


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the features of the URL, but for the suffix statistics, whose slots it gets."""
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1))
    count = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    return pages.withColumns(
        {
            "length": F.char_length(text).cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_share": count(string.digits) / size,
            "entropy": entropy,
            "parameters": F.when(F.instr(text, "?") > 0, count("&=") + 1).otherwise(0).cast("double"),
            "marks": count("-_~%+#@!").cast("double"),
            "suffix_slot": slot(F.substring_index("host", ".", -1)),
            "folder_slot": slot(F.get(F.split("path", "/"), F.lit(1))),
        }
    )


def statistics(labelled: DataFrame) -> tuple[int, int, dict[str, Column]]:
    """Labelled and blocked URLs, and the smoothed share of blocked ones as expressions over the slots; one pass, 2 * SLOTS rows."""
    names = ("suffix_slot", "folder_slot")
    rows = labelled.groupingSets([[n] for n in names], *names).agg(F.grouping("suffix_slot").alias("folder"), F.count("*").alias("n"), F.sum("label").alias("blocked")).collect()
    total, blocked = (sum(r[k] for r in rows if not r["folder"]) for k in ("n", "blocked"))
    prior, found = blocked / total if total else 0.5, {}
    for name, feature, side in zip(names, ("suffix_share", "folder_share"), (0, 1), strict=True):
        known = {r[name]: (r["blocked"] + 10 * prior) / (r["n"] + 10) for r in rows if r["folder"] == side and r[name] is not None}
        found[feature] = F.lit(prior)
        if known:
            table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
            found[feature] = F.coalesce(F.try_element_at(table, F.coalesce(F.col(name), F.lit(-1))), F.lit(prior))
    return total, int(blocked), found


def judge(pages: DataFrame, rules: dict[str, str], url: str = "url", sample: int = 20_000, trees: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
    """pages with host, path, rule and verdict. rules: rule to allow or block."""
    host, path = parts(F.col(url))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]  # as Spark compares names
    known = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    known = known.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    says = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map(F.lit(""), F.lit("allow"))
    by_rule = F.try_element_at(says, F.coalesce("rule", F.lit("")))
    featured = lexical(known.select(F.struct("*").alias("row"), F.col(url).alias("url"), "host", "path", by_rule.alias("said")))
    labelled = featured.where("said is not null").withColumn("label", F.when(F.col("said") == "block", 1.0).otherwise(0.0))
    total, blocked, known_shares = statistics(labelled)
    result = lambda df, verdict: df.select("row.*", verdict.alias("verdict"))
    if blocked in (0, total):
        return result(featured, F.coalesce("said", F.lit("block" if blocked else "allow")))
    order = F.xxhash64(F.coalesce("url", F.lit("")))
    fitted = labelled.withColumns(known_shares).select(*FEATURES, "label", order.alias("o")).orderBy("o", *FEATURES).limit(sample)
    fitted = cut(fitted.drop("o"), "urls")  # the learner reads its rows many times
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, predictionCol="blocked")
    model = learner.fit(assemble.transform(fitted).select("features", "label"))
    judged = model.transform(assemble.transform(featured.withColumns(known_shares)))
    return result(judged, F.coalesce("said", F.when(F.col("blocked") == 1.0, F.lit("block")).otherwise(F.lit("allow"))))
