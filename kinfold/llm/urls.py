"""URL filters: rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions and Spark ML only.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's path; of several the longest wins.
URLs that a rule decides are labelled. The trees learn from at most ``max_examples`` different ones (half of each verdict, or what the
other leaves; those of smallest hash; all, if fewer), weighted so that each verdict keeps its share of the different URLs, and judge every
other URL. Features: length, host and path length, depth, number of host labels, digit ratio, entropy of characters, parameter count,
hyphens, file extension, and statistics of the host's suffixes: number of labelled rows, of all, and share of blocked ones under the
last label and under the last two. URLs are dealt into ``FOLDS`` by hash, and an example's statistics count the rows of the other folds only, so that
no label is learnt from itself (leaving out just its own rows would tell the label by what is missing);
``held_out_auc`` measures what the trees know about suffixes that they never saw.

A null URL, or one without ``://``, has an empty host and path and is judged like any other. If the
examples hold one verdict only, it is given to all; without examples every URL is allowed. Empty tables give no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.text import packed_row
from kinfold.operators.skew import attach
from kinfold.sources.shared import settle

#: Host, path and verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MAX_EXAMPLES = 4000
TREES = 10
DEPTH = 3
#: Rows that the suffix statistics are smoothed with.
PRIOR = 10.0
#: Parts of the URLs that do not see each other's labels while the trees are fitted.
FOLDS = 5
#: Suffixes with fewer rows are joined in one piece.
PIECE_ROWS = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``decided`` (null where no rule fits). The rules are a parameter, written into the expression."""
    host, path = F.col("host"), F.col("path")
    fits = []
    for h, p, v in rules:
        under = (host == h) | host.endswith(f".{h}")
        one = F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
        fits.append(F.when(under & path.startswith(p), one))
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return pages.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "decided": F.col("best.verdict")}).drop("best")


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)

    def add(total, c):
        share = (size - F.length(F.replace(text, c))) / size
        return total - share * F.log2(share)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(size > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(0.0)


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_share", "entropy", "parameters", "hyphens", "secure", "extension",
    "suffix1_blocked", "suffix1_seen", "suffix2_blocked", "suffix2_seen",
)


def with_features(pages: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    size = F.length(url)
    digits = size - F.length(F.translate(url, "0123456789", ""))
    times = lambda text, c: (F.length(text) - F.length(F.translate(text, c, ""))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return pages.withColumns({
        "url_length": size.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": times(path, "/"), "labels": times(host, ".") + 1, "digit_share": F.when(size > 0, digits / size).otherwise(0.0),
        "entropy": _entropy(url), "parameters": F.when(query == "", 0.0).otherwise(times(query, "&") + 1), "hyphens": times(url, "-"),
        "secure": url.startswith("https:").cast("double"), "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "suffix2": _suffix(host, 2),
    })


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def suffix_table(parsed: DataFrame) -> DataFrame:
    """One row per last two labels of a host: statistics of all decided rows under them and under the last label, the counts they
    come from, in all and by fold of URLs, and the number of rows."""
    blocked, fold = F.col("decided") == "block", _fold()
    by_fold = [[F.count_if(c & (fold == f)).alias(f"{name}2_{f}") for f in range(FOLDS)] for name, c in (("b", blocked), ("n", F.col("decided").isNotNull()))]
    counts = parsed.groupBy(_suffix(F.col("host"), 2).alias("suffix2")).agg(*by_fold[0], *by_fold[1], F.count(F.lit(1)).alias("rows"))
    counts = settle(counts).withColumn("suffix1", _suffix(F.col("suffix2"), 1))
    sums = [F.sum(f"{name}2_{f}").alias(f"{name}1_{f}") for name in "bn" for f in range(FOLDS)]
    wider = settle(counts.groupBy("suffix1").agg(*sums, F.count(F.lit(1)).alias("__size")))
    both = attach(counts, wider.drop("__size"), ["suffix1"], "suffix2", sizes=wider.select("suffix1", "__size"), floor=PIECE_ROWS)
    stats = {}
    for k in (1, 2):
        total = {name: sum((F.col(f"{name}{k}_{f}") for f in range(1, FOLDS)), F.col(f"{name}{k}_0")) for name in "bn"}
        stats |= {f"b{k}": total["b"], f"n{k}": total["n"]}
        stats |= {f"{name}{k}_folds": F.array(*[F.col(f"{name}{k}_{f}") for f in range(FOLDS)]) for name in "bn"}
        stats[f"suffix{k}_blocked"] = (total["b"] + PRIOR / 2) / (total["n"] + PRIOR)
        stats[f"suffix{k}_seen"] = F.log1p(total["n"])
    return settle(both.select("suffix2", "rows", *[c.alias(name) for name, c in stats.items()]))


def _complete(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rows with their features as one vector. The statistics of labelled rows (with ``label``) come from the other folds."""
    # Copies of a URL are spread too, so rows are told apart by their place.
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    sizes = suffixes.select("suffix2", F.col("rows").alias("__size"))
    joined = attach(placed, suffixes.drop("rows"), ["suffix2"], "place", sizes=sizes, floor=PIECE_ROWS)
    if "label" in rows.columns:
        for k in (1, 2):
            b, n = (F.col(f"{name}{k}") - F.get(f"{name}{k}_folds", _fold()) for name in "bn")
            joined = joined.withColumns({f"suffix{k}_blocked": (b + PRIOR / 2) / (n + PRIOR), f"suffix{k}_seen": F.log1p(n)})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)


def _fitted(parsed: DataFrame, suffixes: DataFrame, max_examples: int):
    """The trees, or the only verdict that the decided rows have (None without any)."""
    host, path = host_and_path(F.col("url"))
    label = (F.col("decided") == "block").cast("double")
    different = parsed.where("decided IS NOT NULL").select("url", label.alias("label")).distinct()
    kinds = {r["label"]: r["n"] for r in different.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return next(iter(kinds), None)
    samples = []
    for kind, n in kinds.items():
        most = max(1, max_examples // 2, max_examples - (sum(kinds.values()) - n))
        sample = different.where(F.col("label") == kind).orderBy(F.xxhash64("url"), "url").limit(most)
        samples.append(sample.select("url", host.alias("host"), path.alias("path"), "label", F.lit(n / min(n, most)).alias("weight")))
    examples = settle(with_features(samples[0].unionByName(samples[1])))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1)
    return trees.fit(_complete(examples, suffixes).select("features", "label", "weight").coalesce(1))


def held_out_auc(pages: DataFrame, rules=RULES, max_examples: int = MAX_EXAMPLES, folds: int = 5) -> tuple[float, dict[str, float]]:
    """Area under the curve on decided rows whose last two host labels the trees, and the suffix statistics, never saw (one fold of them), and
    the importance of every feature."""
    host, path = host_and_path(F.col("url"))
    parsed = with_rules(pages.select("url", host.alias("host"), path.alias("path")), rules)
    out = F.pmod(F.xxhash64(_suffix(F.col("host"), 2)), F.lit(folds)) == 0
    known = parsed.withColumn("decided", F.when(~out, F.col("decided")))
    suffixes = suffix_table(known)
    model = _fitted(known, suffixes, max_examples)
    tested = _complete(with_features(parsed.where(out & F.col("decided").isNotNull())), suffixes)
    scored = model.transform(tested).withColumn("label", (F.col("decided") == "block").cast("double"))
    area = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label").evaluate(scored)
    return area, dict(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True))


def judge(pages: DataFrame, rules=RULES, max_examples: int = MAX_EXAMPLES, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Per row of ``pages``: ``row`` (the columns in ``keep``), ``host``, ``path``, ``rule``, ``verdict`` and ``blocked`` (the
    trees' probability, null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    parsed = with_rules(pages.select(packed_row(keep), "url", host.alias("host"), path.alias("path")), rules)
    suffixes = suffix_table(parsed)
    model = _fitted(parsed, suffixes, max_examples)
    if model is None or isinstance(model, float):
        only = "block" if model == 1.0 else "allow"
        return parsed.select("row", "host", "path", "rule", F.coalesce("decided", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    open_rows = _complete(with_features(parsed.where("decided IS NULL")), suffixes)
    from_trees = model.transform(open_rows).select(
        "row", "host", "path", "rule", F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict"),
        vector_to_array("probability")[1].alias("blocked"),
    )
    by_rule = parsed.where("decided IS NOT NULL").select("row", "host", "path", "rule", F.col("decided").alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    return by_rule.unionByName(from_trees)
