"""Cleaning labelled text: validation, conflicts, leakage, duplicates, audits.

Rejected rows are a second DataFrame with a reason. What must stop a run raises ValueError after a query that
finds the offending rows. Groups of equal texts are judged by aggregates that combine before the shuffle, so
that a text with a million copies is no burden on one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import normalize, seeded_order, text_key
from textquarry.operators.ranking import hash_rank
from textquarry.session import stored

SPLITS = ("train", "validation", "test")
MOST_TEXT, MOST_LABEL = 20000, 100


@dataclass
class Cleaned:
    clean: DataFrame
    rejected: DataFrame


def first_reason(text: Column, label: Column, split: Column) -> Column:
    """Why a row is refused, null if it isn't: the first check that fails, over normalised text and label."""
    return (
        F.when(text.isNull() | label.isNull(), "text_or_label_no_string")
        .when((text == "") | (label == ""), "empty_text_or_label")
        .when((F.length(text) > MOST_TEXT) | (F.length(label) > MOST_LABEL), "text_or_label_too_long")
        .when(split.isNotNull() & ~split.isin("", *SPLITS), "unknown_split")
    )


def validated(rows: DataFrame) -> DataFrame:
    """(text, label, split, source_line, ...) → normalised text and label, key, reason."""
    rows = rows.withColumn("text", normalize("text")).withColumn("label", normalize("label"))
    rows = rows.withColumn("reason", first_reason(F.col("text"), F.col("label"), F.col("split")))
    return rows.withColumn("split", F.when(F.col("split") != "", F.col("split"))).withColumn("key", text_key("text"))


def identity(key: str) -> Column:
    """What a key is grouped and joined by: 32 bytes instead of a whole text."""
    return F.unhex(F.sha2(F.col(key), 256))


def group_facts(rows: DataFrame, key: str = "key", line: str = "source_line", same: Column | None = None) -> DataFrame:
    """For each key (as ``identity``, or ``same`` where rows have that already): its size, first line, whether labels conflict, whether splits differ.

    Labels and splits are compared by 64 bits of hash, which hash aggregation can hold.
    """
    label, split = F.xxhash64("label"), F.when(F.col("split").isNotNull(), F.xxhash64("split"))
    return rows.groupBy((identity(key) if same is None else same).alias("_key")).agg(
        F.count("*").alias("copies"), F.min(line).alias("first_line"),
        (F.min(label) != F.max(label)).alias("conflict"), F.coalesce(F.min(split) != F.max(split), F.lit(False)).alias("leak"),
    )


def with_facts(rows: DataFrame, key: str = "key", line: str = "source_line", same: Column | None = None) -> DataFrame:
    facts = group_facts(rows, key, line, same)
    return rows.join(facts, (identity(key) if same is None else same) == F.col("_key")).drop("_key")


def deduplicated(rows: DataFrame, line: str = "source_line", same: Column | None = None) -> Cleaned:
    """Groups with conflicting labels go as a whole; then a group that spans splits stops the run; then the first row stays."""
    rows = with_facts(rows, line=line, same=same)
    leaks = rows.filter("leak AND NOT conflict").orderBy(line).select(line).limit(20).collect()
    if leaks:
        raise ValueError(f"equal texts in different splits, lines {[r[0] for r in leaks]}")
    reason = F.when(F.col("conflict"), "conflicting_labels").when(F.col(line) != F.col("first_line"), "normalized_duplicate")
    judged = rows.withColumn("reason", reason).drop("copies", "first_line", "conflict", "leak")
    return Cleaned(judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").select(line, "reason"))


def check_split_policy(rows: DataFrame) -> bool:
    """Whether splits are given; giving them for some rows only stops the run."""
    n, given = rows.agg(F.count("*"), F.count("split")).first()
    if not n:
        raise ValueError("no valid rows are left")
    if 0 < given < n:
        raise ValueError("rows with and without a split can't be mixed")
    return given > 0


def assign_splits(rows: DataFrame, seed: int | str = 42, share: float = 0.2, group: str = "label", key: str = "key", order: Column | None = None) -> DataFrame:
    """For each label the first floor(share * n) rows (one at least) in seeded order are test, the next validation, the rest train.

    order: where rows have the seeded order already.
    """
    ranked = hash_rank(rows.drop("split"), [group], seeded_order(seed, F.col(key)) if order is None else order, key)
    n = F.greatest(F.lit(1), F.floor(F.col("group_size") * share))
    split = F.when(F.col("rank") <= n, "test").when(F.col("rank") <= 2 * n, "validation").otherwise("train")
    return ranked.withColumn("split", split).drop("rank", "group_size")


def check_classes(rows: DataFrame, least: int = 0) -> None:
    """Two labels at least, each with ``least`` rows; no empty split; no label that train lacks."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train")).orderBy("label")
    small = counts.filter(F.col("n") < least).limit(1).collect()
    if counts.limit(2).count() < 2:
        raise ValueError("a classification needs two labels at least")
    if small:
        raise ValueError(f"label {small[0].label} needs {least} different texts at least")
    if "split" in rows.columns and not least:
        splits = {r.split for r in rows.select("split").distinct().limit(10).collect()}
        if splits != set(SPLITS):
            raise ValueError(f"empty splits: {sorted(set(SPLITS) - splits)}")
        if counts.filter("train = 0").limit(1).collect():
            raise ValueError("validation or test has labels that train lacks")


def prepare(rows: DataFrame, seed: int | str = 42) -> Cleaned:
    """The whole way from labelled rows to a clean, split dataset and its audit."""
    # each of the checks below reads a few narrow columns; texts, cached or shuffled with them, would grow with the table in memory
    digests = validated(rows).withColumn("_digest", identity("key")).withColumn("_place", seeded_order(seed, F.col("key")))
    checked = stored(digests.drop("key"))
    if not checked.limit(1).count():
        raise ValueError("the dataset is empty")
    found = deduplicated(checked.filter("reason IS NULL").drop("reason"), same=F.col("_digest"))
    clean = found.clean
    if not check_split_policy(clean):
        check_classes(clean.withColumn("split", F.lit("train")), 5)
        clean = assign_splits(clean, seed, key="_digest", order=F.col("_place"))
    check_classes(clean)
    return Cleaned(clean.drop("_digest", "_place"), checked.filter("reason IS NOT NULL").select("source_line", "reason").unionByName(found.rejected))


def held_out_duplicates(rows: DataFrame) -> DataFrame:
    """Groups of equal texts: key (its SHA-256), lines, labels, conflicting."""
    groups = rows.groupBy(F.sha2("key", 256).alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("source_line")).alias("lines"), F.array_sort(F.collect_set("label")).alias("labels"))
    return groups.filter("n > 1").select("key", "lines", "labels", (F.size("labels") > 1).alias("conflicting"))


def without_held_out(rows: DataFrame, held_out: DataFrame, reason: str) -> Cleaned:
    """Rows whose key no held-out row has; the others are audited."""
    keys = held_out.select(identity("key").alias("_key")).distinct()
    same = identity("key") == F.col("_key")
    return Cleaned(rows.join(keys, same, "left_anti"), rows.join(keys, same, "left_semi").withColumn("reason", F.lit(reason)))


def contained_passages(docs: DataFrame, passages: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage literally.

    The first ``words`` words inside a passage (its first and last may be cut words), or all of fewer, are joined with
    the documents' windows of as many words by an equi-join; only matches are compared in full. Passages of one or two
    words have none inside and are held against all texts; blank ones are not looked for.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    asked = passages.select("item_id", F.col("text").alias("passage"), split("text").alias("w")).filter(F.size("w") > 0)
    inside = F.least(F.size("w") - 2, F.lit(words))
    anchor = asked.filter(F.size("w") > 2).select("item_id", "passage", inside.alias("n"), F.array_join(F.slice("w", F.lit(2), inside), " ").alias("anchor"))
    sizes = sorted(r.n for r in anchor.select("n").distinct().collect())  # at most ``words`` numbers
    rows = docs.select("doc_id", "text", split("text").alias("w"))

    def windows(n):
        starts = F.sequence(F.lit(1), F.size("w") - n + 1)
        return rows.filter(F.size("w") >= n).select("doc_id", F.lit(n).alias("n"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("anchor"))

    near = reduce(DataFrame.unionAll, map(windows, sizes or [words])).join(anchor, ["n", "anchor"]).select("doc_id", "item_id", "passage").distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    tiny = asked.filter(F.size("w") <= 2).select("item_id", "passage")
    return found.unionAll(docs.select("doc_id", "text").join(F.broadcast(tiny), F.contains("text", "passage")).select("doc_id", "item_id"))


def fixed_benchmark(train: DataFrame, validation: DataFrame, test: DataFrame, per_class: int, seed: int | str) -> Cleaned:
    """A benchmark whose test rows all stay, duplicates too: validation without test's texts; train without both,
    conflicting groups and duplicates; then ``per_class`` train rows of each label in seeded order.
    All have text, label, source_file, source_line, key."""
    if per_class < 5:
        raise ValueError("the budget is 5 rows of a class at least")
    own = without_held_out(validation, test, "validation_overlaps_test")
    held = test.select("key").unionAll(own.clean.select("key"))
    first = without_held_out(train, held, "train_overlaps_held_out")
    facts = with_facts(first.clean.withColumn("split", F.lit("train")))
    reason = F.when(F.col("conflict"), "train_conflict").when(F.col("source_line") != F.col("first_line"), "train_duplicate")
    judged = facts.withColumn("reason", reason).drop("copies", "first_line", "conflict", "leak")
    pool = judged.filter("reason IS NULL").drop("reason")
    few = pool.groupBy("label").count().filter(F.col("count") < per_class).limit(1).collect()
    if few:
        raise ValueError(f"label {few[0].label} has fewer than {per_class} clean rows")
    chosen = sample_per_class(pool, per_class, seed)
    keep = ["text", "label", "split", "source_file", "source_line"]
    parts = [chosen, own.clean.withColumn("split", F.lit("validation")), test.withColumn("split", F.lit("test"))]
    clean = parts[0].select(*keep).unionByName(parts[1].select(*keep)).unionByName(parts[2].select(*keep))
    audit = ["source_file", "source_line", "reason"]
    return Cleaned(clean, own.rejected.select(*audit).unionByName(first.rejected.select(*audit)).unionByName(judged.filter("reason IS NOT NULL").select(*audit)))


def sample_per_class(rows: DataFrame, k: int, seed: int | str, group: str = "label", key: str = "key") -> DataFrame:
    """At most k rows of each label, by seeded order."""
    return hash_rank(rows, [group], seeded_order(seed, F.col(key)), key).filter(F.col("rank") <= k).drop("rank", "group_size")


def budget_slices(rows: DataFrame, budgets: dict[str, int], seed: int | str, key: str = "key") -> DataFrame:
    """Disjoint slices of one pool in seeded order, named and sized by ``budgets``; the rest goes."""
    from textquarry.operators.ranking import global_rank

    ranked, name, at = global_rank(rows, seeded_order(seed, F.col(key)), key), F.lit(None).cast("string"), 0
    for split, n in budgets.items():
        name = F.when((F.col("rank") > at) & (F.col("rank") <= at + n), split).otherwise(name)
        at += n
    return ranked.withColumn("split", name).filter("split IS NOT NULL").drop("rank", "group_size")


def stress_subset(rows: DataFrame, per_class: int = 200, seed: int | str = 2027) -> DataFrame:
    """The same rows of each label in every stress mode: mode, original_text, text."""
    from textquarry.functions.text import perturbed

    chosen = sample_per_class(rows.withColumn("key", F.col("source_line").cast("string")), per_class, seed).drop("key")
    modes = ("clean_subset", "punctuation", "char_delete_5pct", "tail_truncate_30pct")
    cases = F.array(*(F.struct(F.lit(m).alias("mode"), perturbed(F.col("text"), m, seed, F.col("source_line").cast("string")).alias("changed")) for m in modes))
    return chosen.withColumn("c", F.explode(cases)).withColumn("original_text", F.col("text")).withColumn("text", F.col("c.changed")).withColumn("mode", F.col("c.mode")).drop("c")


def verify_dataset(rows: DataFrame, labels: list[str], fingerprints: dict[str, str], keep_held_out_duplicates: bool = False) -> None:
    """Stop unless a stored dataset is what its manifest says: digests, splits, labels, no text twice."""
    from textquarry.sources.sinks import fingerprint

    rows = rows.select("text", "label", "split", "source_line")
    found = {r.split: r.fingerprint for r in fingerprint(rows, "split").collect()}
    if found != fingerprints:
        raise ValueError("the files changed since their fingerprints were taken")
    if rows.filter(~F.col("label").isin(*labels) | ~F.col("split").isin(*SPLITS)).limit(1).count():
        raise ValueError("labels or splits don't fit the version")
    facts = rows.withColumn("key", text_key("text")).groupBy("key").agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    again = facts.filter("n > 1")
    if keep_held_out_duplicates:
        again = again.filter("a <> b OR a = 'train'")
    if again.limit(1).count():
        raise ValueError("a text is there twice")
    if {r.label for r in rows.filter("split = 'train'").select("label").distinct().collect()} != set(labels):
        raise ValueError("train lacks labels")


def token_length_statistics(lengths: DataFrame, column: str, most: int) -> DataFrame:
    """samples, truncated (over ``most``), max_length."""
    return lengths.agg(F.count("*").alias("samples"), F.count_if(F.col(column) > most).alias("truncated"), F.max(column).alias("max_length"))
