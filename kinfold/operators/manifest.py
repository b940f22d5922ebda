"""Manifest clean-up, validation and selection.

A manifest is one row per item, all text. ``clean`` is a lazy projection; ``violations`` finds every
offending value of every rule; ``load`` combines both and raises in strict mode."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.fixed import (
    ALLOWED_VALUES, GROUP_REQUIRED_SOURCES, IMBALANCE_MODES, OPTIONAL_DEFAULTS, REQUIRED_COLUMNS,
    SINGLETON_PREFIX, SPLIT_STRATEGIES,
)
from kinfold.functions.text import is_fractional, resolve_path, strip, whole_number
from kinfold.sources.shared import settle

EXAMPLES = 3
CONFLICTS_SHOWN = 5
#: Values listed per column in an error text; the text says how many more there are.
VALUES_SHOWN = 100


def check_choice(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {sorted(allowed)}, not {value!r}")


def check_parameters(
    modality: str = "all", source: str = "all", imbalance: str = "none", strategy: str = "kfold", val_fraction: float = 0.2
) -> None:
    check_choice("modality", modality, [*ALLOWED_VALUES["modality"], "all"])
    check_choice("source", source, [*ALLOWED_VALUES["source"], "all"])
    check_choice("imbalance", imbalance, IMBALANCE_MODES)
    check_choice("split", strategy, SPLIT_STRATEGIES)
    if not 0 < val_fraction < 1:
        raise ValueError("val_fraction must lie between 0 and 1")


def require_columns(df: DataFrame) -> None:
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the manifest lacks the columns {missing}")


def fill_optional(df: DataFrame, defaults: Mapping[str, str] = OPTIONAL_DEFAULTS) -> DataFrame:
    """Adds absent optional columns and replaces empty cells by the default. Missing text becomes ''."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in (*REQUIRED_COLUMNS, *defaults) else F.col(c)
            for c in df.columns]
    filled = df.select(*text)
    for name, default in defaults.items():
        value = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)) if name in df.columns else F.lit(default)
        filled = filled.withColumn(name, value)
    return filled


def resolve(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("image_path", resolve_path(F.col("image_path"), root))


def clean(df: DataFrame, root: str, defaults: Mapping[str, str] = OPTIONAL_DEFAULTS) -> DataFrame:
    """Defaults, absolute paths, trimmed groups, singleton groups for blank ones, whole-number days."""
    require_columns(df)
    trimmed = resolve(fill_optional(df, defaults), root).withColumn("isolate_id", strip(F.col("isolate_id")))
    singleton = F.concat(F.lit(SINGLETON_PREFIX), F.col("image_path"))
    return trimmed.withColumn(
        "isolate_id", F.when(F.col("isolate_id") == "", singleton).otherwise(F.col("isolate_id"))
    ).withColumn("day", whole_number(F.col("day")))


def _row_findings(allowed: Mapping[str, Sequence[str]], group_required: Sequence[str]) -> Column:
    """The rules that one row can break, as an array of (rule, column, value); NULL entries are rules it keeps."""
    def finding(broken: Column, rule: str, column: str) -> Column:
        fact = F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(column).alias("value"))
        return F.when(broken, fact)

    domain = [finding(~F.col(c).isin(*values), "domain", c) for c, values in allowed.items()]
    blank = finding((strip(F.col("isolate_id")) == "") & F.col("source").isin(*group_required), "blank_group", "isolate_id")
    blank = F.when(blank.isNotNull(), blank.withField("value", F.lit("")))
    fractional = finding(is_fractional(F.col("day")), "fractional_day", "day")
    return F.array(*domain, blank, fractional)


def _summarise(findings: DataFrame) -> DataFrame:
    """Counts per (rule, column, value) with the first few items in path order. Both sides reduce on the
    map side: partial counts, and at most ``EXAMPLES`` rows per key and task for the examples."""
    keys = ["rule", "column", "value"]
    counts = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = findings.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy("item"))).where(
        F.col("__rn") <= EXAMPLES
    )
    examples = first.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("examples"))
    return counts.join(examples, keys)


def row_violations(
    df: DataFrame,
    root: str,
    allowed: Mapping[str, Sequence[str]] = ALLOWED_VALUES,
    group_required: Sequence[str] = GROUP_REQUIRED_SOURCES,
) -> DataFrame:
    """Domain, blank-group and fractional-day findings: ``rule, column, value, n, examples``."""
    rows = resolve(fill_optional(df), root)
    broken = F.explode(F.filter(_row_findings(allowed, group_required), lambda f: f.isNotNull()))
    return _summarise(rows.select(F.col("image_path").alias("item"), broken.alias("f")).select("item", "f.*"))


def missing_items(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose (resolved) path is not in ``listing(path)``."""
    return df.join(listing.select(F.col("path").alias("image_path")), "image_path", "left_anti")


def label_conflicts(df: DataFrame, label: str = "species", group: str = "isolate_id") -> DataFrame:
    """Groups with more than one label, with the first and last of them in text order."""
    labels = df.select(group, label).distinct()
    found = labels.groupBy(group).agg(F.count(F.lit(1)).alias("n_labels"), F.min(label).alias("first"), F.max(label).alias("last"))
    return found.where(F.col("n_labels") > 1).select(
        group, "n_labels", F.col("first").alias("first_label"), F.col("last").alias("last_label")
    )


def violations(df: DataFrame, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Every broken rule of a raw manifest in one table: ``rule, column, value, n, examples``.

    The rows are read once for all rules of single rows, the listing joined to them; only broken rows are written and summarised.
    Label conflicts, a rule of groups, read their two columns once more."""
    rows = resolve(fill_optional(df), root)
    broken = _row_findings(ALLOWED_VALUES, GROUP_REQUIRED_SOURCES)
    if listing is not None:
        there = listing.select(F.col("path").alias("image_path")).distinct().withColumn("__there", F.lit(True))
        rows = rows.join(there, "image_path", "left")
        facts = [F.lit(v).alias(n) for n, v in (("rule", "missing_item"), ("column", "image_path"), ("value", ""))]
        broken = F.array_append(broken, F.when(F.col("__there").isNull(), F.struct(*facts)))
    each = rows.select(F.col("image_path").alias("item"), F.explode(F.filter(broken, lambda f: f.isNotNull())).alias("f"))
    found = _summarise(settle(each.select("item", "f.*")))
    conflicts = label_conflicts(clean(df, root))
    return found.unionByName(conflicts.select(
        F.lit("label_conflict").alias("rule"), F.lit("species").alias("column"), F.col("isolate_id").alias("value"),
        F.col("n_labels").alias("n"), F.array("first_label", "last_label").alias("examples"),
    ))


def _messages(found: DataFrame) -> list[str]:
    """Error text per rule. Counts, examples and a bounded number of values reach the driver."""
    per_rule = W.partitionBy("rule", "column").orderBy("value")
    shown = found.withColumn("__rn", F.row_number().over(per_rule)).where(F.col("__rn") <= VALUES_SHOWN)
    totals = found.groupBy("rule", "column").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    rows = shown.join(totals, ["rule", "column"]).orderBy("rule", "column", "value").collect()
    texts: dict[tuple[str, str], str] = {}
    for rule, column in dict.fromkeys((r["rule"], r["column"]) for r in rows):
        mine = [r for r in rows if (r["rule"], r["column"]) == (rule, column)]
        values, examples = [r["value"] for r in mine], list(mine[0]["examples"])
        more = f" and {mine[0]['values'] - len(values)} more" if mine[0]["values"] > len(values) else ""
        texts[rule, column] = {
            "domain": f"{column}: {values}{more} outside its domain {sorted(ALLOWED_VALUES.get(column, ()))}",
            "blank_group": f"blank group of {mine[0]['rows']} items such as {examples}",
            "missing_item": f"no file for {mine[0]['rows']} items such as {examples}",
            "fractional_day": f"day: fractional values {values}{more}",
            "label_conflict": f"groups with several labels: {values[:CONFLICTS_SHOWN]} of {mine[0]['values']}",
        }[rule]
    return list(texts.values())


def validate(df: DataFrame, root: str, listing: DataFrame | None = None) -> None:
    """Raises one error that names every broken rule."""
    found = settle(violations(df, root, listing))
    if not found.isEmpty():
        raise ValueError("; ".join(_messages(found)))


def load(
    df: DataFrame, root: str, listing: DataFrame | None = None, strict: bool = True, modality: str = "all", source: str = "all"
) -> DataFrame:
    """A raw manifest as a validated, clean table. Validation covers the whole manifest; ``modality`` and
    ``source`` then select rows of it."""
    require_columns(df)
    if strict:
        validate(df, root, listing)
    return clean(select_raw(df, modality, source), root)


def load_into(df: DataFrame, root: str, path: str, listing: DataFrame | None = None) -> DataFrame:
    """Validates a raw manifest while its clean form is written to ``path`` (Parquet), and reads that back: the manifest is scanned once.

    Rules of single rows, and files missing from ``listing``, are counted in the pass that writes; groups with several labels are found in the
    written table. A manifest that breaks a rule leaves nothing at ``path``; only then is it read again, for the text of the error."""
    require_columns(df)
    spark = df.sparkSession
    rules = F.array_size(F.filter(_row_findings(ALLOWED_VALUES, GROUP_REQUIRED_SOURCES), lambda f: f.isNotNull()))
    rows = resolve(fill_optional(df), root).withColumn("__broken", rules)
    lost = F.lit(0)
    if listing is not None:
        there = listing.select(F.col("path").alias("image_path")).distinct().withColumn("__there", F.lit(True))
        rows = rows.join(there, "image_path", "left")
        lost = F.count_if(F.col("__there").isNull())
    seen = Observation()
    observed = rows.observe(seen, F.coalesce(F.sum("__broken"), F.lit(0)).alias("broken"), lost.alias("lost"), F.count(F.lit(1)).alias("rows"))
    # ``clean`` fills and resolves again what is filled and resolved already, which changes nothing.
    staged = f"{path.rstrip('/')}.unchecked-{uuid.uuid4().hex}"
    columns = [c for c in rows.columns if c not in ("__broken", "__there")]
    clean(observed.select(*columns), root).write.parquet(staged)
    found = seen.get
    files = spark._jvm.org.apache.hadoop.fs.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    if found["broken"] or found["lost"] or not label_conflicts(spark.read.parquet(staged)).isEmpty():
        files.delete(as_path(staged), True)
        validate(df, root, listing)
        raise ValueError("the manifest breaks a rule")
    files.delete(as_path(path), True)
    if not files.rename(as_path(staged), as_path(path)):
        raise OSError(f"cannot move {staged} to {path}")
    return spark.read.schema(clean(df, root).schema).parquet(path)


def select_raw(df: DataFrame, modality: str = "all", source: str = "all") -> DataFrame:
    """``select`` for a manifest that is not cleaned yet: plain comparisons of stored columns, which columnar
    files evaluate while they are read. An absent or empty source counts as the default one."""
    if modality != "all":
        df = df.where(F.col("modality") == modality)
    if source != "all":
        default = OPTIONAL_DEFAULTS["source"] == source
        if "source" in df.columns:
            stored = F.col("source")
            df = df.where((stored == source) | (stored == "") | stored.isNull() if default else stored == source)
        elif not default:
            df = df.where(F.lit(False))
    return df


def select(df: DataFrame, modality: str = "all", source: str = "all") -> DataFrame:
    """Equality filters on a clean table; ``all`` switches one off."""
    for name, value in (("modality", modality), ("source", source)):
        if value != "all":
            df = df.where(F.col(name) == value)
    return df


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"nothing selected for {what}")


def unknown_labels(df: DataFrame, classes: Sequence[str], label: str = "species") -> DataFrame:
    return df.where(~F.col(label).isin(*classes)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def resolve_classes(df: DataFrame, classes: Sequence[str] = (), label: str = "species") -> list[str]:
    """The given class list in its order, else the sorted distinct labels. Labels outside the list are an error."""
    if not classes:
        return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    unknown = unknown_labels(df, classes, label)
    shown = [r[0] for r in unknown.orderBy(F.desc("n"), label).limit(VALUES_SHOWN).collect()]
    if shown:
        raise ValueError(f"labels not in the class list: {sorted(shown)}, {unknown.count()} in all")
    return list(classes)


def dataset_summary(df: DataFrame, by: Sequence[str] = (), label: str = "species", group: str = "isolate_id") -> DataFrame:
    """Items, distinct groups and classes. Groups are reduced first, so no task sees a whole group."""
    groups = df.groupBy(*by, group, label).agg(F.count(F.lit(1)).alias("__n"))
    return groups.groupBy(*by).agg(
        F.sum("__n").cast("bigint").alias("n_items"),
        F.countDistinct(group).alias("n_groups"),
        F.countDistinct(label).alias("n_classes"),
    )
