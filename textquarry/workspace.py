"""A workspace: a folder of tables for datasets, documents, extractions and reviews.

It composes the operators as a user meets them: prepare and verify datasets, evaluate and compare runs, ingest documents,
extract evidence, review, search, export. Every table is Parquet; writes append or make a new version, none is changed.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators import alias, clean, context, evidence, index, metrics, review, selection
from textquarry.sources import readers, sinks
from textquarry.sources.documents import parse_documents, sentences

ENTITIES = "doc_id string, id string, text string, type string, start int, end int"


class Conflict(ValueError):
    """A review expected another revision."""


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


class Workspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str) -> str:
        for p in parts:
            if not p or not all(c.isascii() and (c.isalnum() or c in "_-") for c in p):
                raise ValueError(f"{p!r} is no name: letters, digits, _ and - only")
        return "/".join((self.path, *parts))

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, *parts: str, schema: str | None = None) -> DataFrame:
        path = self._at(*parts)
        if self._exists(path):
            return self.spark.read.parquet(path) if schema is None else self.spark.read.schema(schema).parquet(path)
        if schema is None:
            raise KeyError(f"{'/'.join(parts)} not found")
        return self.spark.createDataFrame([], schema)

    # datasets

    def prepare(self, source: str, name: str, seed: int = 42, provenance: str = "user-provided") -> DataFrame:
        """Clean and split a labelled file into a new dataset; return its manifest."""
        if self._exists(self._at("datasets", name)):
            raise ValueError("this version exists; use a new name")
        found = clean.prepare(readers.read_records(self.spark, source), seed)
        found.clean.select("text", "label", "split", "source_line").write.partitionBy("split").parquet(self._at("datasets", name, "rows"))
        found.rejected.write.parquet(self._at("datasets", name, "audit"))
        rows = self.table("datasets", name, "rows").select("text", "label", "split", "source_line")
        sinks.manifest(rows, self.table("datasets", name, "audit"), seed, provenance).write.parquet(self._at("datasets", name, "manifest"))
        return self.table("datasets", name, "manifest")

    def dataset(self, name: str) -> DataFrame:
        """The rows of a dataset, verified against its manifest."""
        rows, m = self.table("datasets", name, "rows").select("text", "label", "split", "source_line"), self.table("datasets", name, "manifest").first()
        clean.verify_dataset(rows, list(m.labels), dict(m.split_sha256))
        return rows

    def evaluate(self, run: str, dataset: str, predictions: DataFrame, split: str = "test", backend: str = "") -> DataFrame:
        """Score predictions (source_line, p by sorted labels) of a split; store details, errors and metrics."""
        if split not in ("validation", "test"):
            raise ValueError("validation and test can be evaluated")
        rows, m = self.dataset(dataset).filter(F.col("split") == split), self.table("datasets", dataset, "manifest").first()
        from textquarry.operators.ner import aligned

        aligned(rows, predictions, "source_line")
        labels = list(m.labels)
        details = metrics.predictions(rows.join(predictions, "source_line"), labels)
        names = self.spark.createDataFrame(list(enumerate(labels)), "id int, label string")
        summary = metrics.classification_summary(metrics.confusion(details), names)
        meta = {"run": run, "split": split, "status": "completed", "backend": backend, "dataset_sha256": m.dataset_sha256, "labels": json.dumps(labels, ensure_ascii=False), "split_sha256": m.split_sha256[split], "metrics_sha256": m.split_sha256[split]}
        summary = summary.select("*", *(F.lit(v).alias(k) for k, v in meta.items()))
        sinks.save_evaluation(details, summary, self._at("runs", run, split))
        return summary

    def compare(self, runs: list[str], split: str = "validation") -> DataFrame:
        frames = [self.table("runs", r, split, "metrics") for r in runs]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return selection.compare(out)

    # documents

    def ingest(self, raw: DataFrame) -> DataFrame:
        """Parse (content, format, title, source) and store what isn't stored; return the stored documents. Bad ones stop the run."""
        parsed = parse_documents(raw)
        bad = parsed.filter("error IS NOT NULL").select("error").limit(1).collect()
        if bad:
            raise ValueError(bad[0].error)
        parsed = parsed.drop("format", "title", "source", "error").withColumn("created", F.lit(now()))
        return sinks.add_documents(self.spark, parsed, self._at("documents"))

    def documents(self) -> DataFrame:
        d = self.table("documents")
        return review.listing(d.select("id", "metadata", F.length("text").alias("characters"), F.size("blocks").alias("blocks"), "created", "sha256"), "created", "id")

    def extract(self, name: str, entities: DataFrame | None = None, glossary: DataFrame | None = None) -> DataFrame:
        """Evidence records of all stored documents as extraction ``name``; entities come from a model or a dictionary."""
        if self._exists(self._at("extractions", name)):
            raise ValueError("this extraction exists")
        docs = self.table("documents").withColumnRenamed("id", "doc_id")
        ents = entities if entities is not None else self.spark.createDataFrame([], ENTITIES)
        found = sentences(docs, "doc_id")
        ents = context.entity_context(alias.normalized(docs, ents, glossary), found).withColumn("extraction_id", F.concat_ws(":", F.lit(name), "doc_id"))
        ents.write.parquet(self._at("extractions", name, "entities"))
        records = evidence.candidates(found, self.table("extractions", name, "entities")).withColumn("extraction_id", F.concat_ws(":", F.lit(name), "doc_id"))
        for c in ("arm", "endpoint", "normalized_value"):
            records = records.withColumn(c, F.lit(None).cast("string"))
        records.write.parquet(self._at("extractions", name, "records"))
        self._index(name, self.table("extractions", name, "records").select("extraction_id", F.col("id").alias("record_id"), "text"))
        return self.records(name)

    def _index(self, name: str, records: DataFrame) -> None:
        path = self._at("extractions", name, "search")
        index.append(records, path, max(index.segments(self.spark, path), default=-1) + 1)

    def reviews(self) -> DataFrame:
        return self.table("reviews", schema=review.REVIEWS)

    def records(self, name: str) -> DataFrame:
        """Records as the reviews leave them."""
        return review.reviewed_records(self.table("extractions", name, "records"), self.reviews())

    def entities(self, name: str) -> DataFrame:
        return review.reviewed_entities(self.table("extractions", name, "entities"), self.reviews())

    def review(self, extraction_id: str, record_id: str, expected_revision: int, status: str, reviewer: str, correction: dict | None = None) -> None:
        """Append a review, if the record is at the revision it expects."""
        correction = dict(correction or {})
        unknown = set(correction) - {*review.RECORD_FIELDS, *review.ENTITY_FIELDS}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        name, doc_id = extraction_id.split(":", 1)
        table = "entities" if record_id.startswith("e") else "records"
        known = self.table("extractions", name, table).filter((F.col("extraction_id") == extraction_id) & (F.col("id") == record_id))
        if not known.limit(1).count():
            raise KeyError("record not found")
        if "evidence" in correction:
            e = correction["evidence"]
            span = self.spark.createDataFrame([(doc_id, e["start"], e["end"], e["text"])], "doc_id string, start int, end int, text string")
            reason = review.evidence_errors(span, self.table("documents").withColumnRenamed("id", "doc_id")).first().reason
            if reason:
                raise ValueError(reason)
        if "type" in correction and correction["type"] not in {*review.TYPE_NAMES, "other"}:
            raise ValueError("unknown entity type")
        incoming = self.spark.createDataFrame([(extraction_id, record_id, expected_revision, status, json.dumps(correction, ensure_ascii=False), reviewer, now())], "extraction_id string, record_id string, expected_revision int, status string, payload string, reviewer string, created string")
        new, bad = review.append(self.reviews(), incoming)
        refused = bad.first()
        if refused:
            raise Conflict(f"revision is {refused.current}, not {expected_revision}") if refused.reason == "revision_changed" else ValueError("a review needs a status and a reviewer")
        rows = self.spark.createDataFrame(new.collect(), review.REVIEWS)  # one row
        rows.write.mode("append").parquet(self._at("reviews"))
        if "evidence" in correction:
            self._index(name, self.spark.createDataFrame([(extraction_id, record_id, correction["evidence"]["text"])], "extraction_id string, record_id string, text string"))

    def history(self, extraction_id: str, record_id: str) -> DataFrame:
        return review.history(self.reviews(), extraction_id, record_id)

    def search(self, name: str, query: str) -> DataFrame:
        """Records whose evidence, as the last review left it, holds every term: from the extraction's index."""
        self.table("extractions", name, "records")
        return index.search(self.spark, self._at("extractions", name, "search"), query)

    def export(self, name: str, mode: str = "approved") -> dict[str, DataFrame]:
        """Frames of an export: approved records with what they cite, or everything with its history."""
        if mode not in ("approved", "all"):
            raise ValueError("modes are approved and all")
        records, entities = self.records(name), self.entities(name)
        if mode == "approved":
            r, e, c = review.approved_export(records, entities)
            return {"records": r, "entities": e, "concepts": c}
        r, e, h = review.full_export(records, entities, self.reviews().filter(F.col("extraction_id").startswith(f"{name}:")))
        return {"records": r, "entities": e, "concepts": alias.concepts(entities, "extraction_id"), "history": h}
