"""Named-entity corpora: conversion, alignment, coverage by windows, dedup policies, predictions in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.spans import character_tokens, token_of, token_windows
from textquarry.operators.review import TYPE_NAMES

LENGTH, STRIDE, MOST_WINDOWS = 384, 96, 256


def half_open(entities: Column) -> Column:
    """array<struct<start_idx, end_idx, type>> with inclusive ends → distinct, sorted array<struct<start, end, type>>."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda e: F.struct(e["start_idx"].cast("int").alias("start"), (e["end_idx"] + 1).cast("int").alias("end"), e["type"].alias("type")))))


def ner_reason(text: Column, entities: Column, offsets: Column, windows: Column, types: tuple[str, ...] = tuple(TYPE_NAMES)) -> Column:
    """Why a record is refused: bad types or bounds, ends off the tokens, or a span that no window holds. Null if accepted."""
    bad = F.exists(entities, lambda e: ~e["type"].isin(*types) | (e["start"] < 0) | (e["start"] >= e["end"]) | (e["end"] > F.length(text)))
    loose = F.exists(entities, lambda e: token_of(offsets, e["start"], e["end"]).isNull())
    open_ = F.exists(entities, lambda e: ~F.exists(windows, lambda w: (w["start"] <= e["start"]) & (e["end"] <= w["end"])))
    return F.when(text.isNull() | entities.isNull() | bad, "invalid").when(loose, "unaligned").when(open_, "uncovered")


def first_copies(rows: DataFrame, order: list[str], invalid_count: bool, key: str = "key") -> DataFrame:
    """Add reason "duplicate" to rows (key, reason, order...) whose text was seen before, by ``order``.

    Where invalid rows count, an invalid first copy blocks all later ones; else only an accepted row does.
    """
    place = F.struct(*order)
    seen = rows if invalid_count else rows.filter("reason IS NULL")
    first = seen.groupBy(F.col(key).alias("_k")).agg(F.min(place).alias("_first"))
    joined = rows.join(first, F.col(key) == F.col("_k"), "left")
    again = F.col("_first").isNotNull() & (place != F.col("_first"))
    if invalid_count:
        reason = F.when(again, "duplicate").otherwise(F.col("reason"))
    else:
        reason = F.coalesce(F.col("reason"), F.when(again, "duplicate"))
    return joined.withColumn("reason", reason).drop("_k", "_first")


def convert(rows: DataFrame, order: list[str], offsets: Callable[[Column], Column] | None = None, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """(text, entities with inclusive ends, order...) → entities half-open, windows, reason. Texts seen before are duplicates,
    whether or not the first copy was valid."""
    from textquarry.functions.text import text_key

    rows = rows.withColumn("entities", half_open(F.col("entities"))).withColumn("_o", (offsets or character_tokens)(F.col("text")))
    rows = rows.withColumn("windows", token_windows(F.col("_o"), length, stride)).withColumn("key", text_key("text"))
    rows = rows.withColumn("reason", ner_reason(F.col("text"), F.col("entities"), F.col("_o"), F.col("windows"))).drop("_o")
    return first_copies(rows, order, True)


def too_many_windows(rows: DataFrame, most: int = MOST_WINDOWS) -> DataFrame:
    """Documents that would take more than ``most`` windows (column windows)."""
    return rows.filter(F.size("windows") > most)


def window_tasks(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each window: keys, base (where it starts), text of the window."""
    w = rows.select(*keys, "text", F.explode("windows").alias("w"))
    return w.select(*keys, F.col("w.start").alias("base"), F.substring("text", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"))


def predict_in_batches(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 32) -> DataFrame:
    """Run a model over rows. ``load`` makes the predictor once for each task; it gets ``batch`` rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or load()
            made = [model(frame.iloc[lo : lo + batch]) for lo in range(0, len(frame), batch)]
            if made:  # one Arrow batch for each that came in, not one for each call
                yield pd.concat(made, ignore_index=True)

    return rows.mapInPandas(run, schema)


def predictor_for(config: dict, makers: dict[str, Callable[[dict], Callable]]) -> Callable:
    """The predictor that a run's configuration names: makers by backend, a decision recipe put around it if there is one."""
    from textquarry.operators.thresholds import decode

    backend = config.get("backend")
    if backend not in makers:
        raise ValueError(f"unknown backend {backend!r}; there are {sorted(makers)}")
    base, recipe = makers[backend](config), config.get("recipe")
    return base if recipe is None else lambda rows: decode(base(rows), recipe["thresholds"], recipe.get("policy", "raw"))


def aligned(rows: DataFrame, predictions: DataFrame, key: str = "doc_id") -> None:
    """Stop unless predictions hold exactly the rows' keys, each once."""
    both = rows.groupBy(key).agg(F.count("*").alias("a")).join(predictions.groupBy(key).agg(F.count("*").alias("b")), key, "full_outer")
    if both.filter("a IS NULL OR b IS NULL OR a <> 1 OR b <> 1").limit(1).count():
        raise ValueError("rows and predictions don't align")
