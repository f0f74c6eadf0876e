"""The pipeline's stages, one by one, against what their operators say and brute force."""

from collections import defaultdict

import corpus_pipeline as cp
from tests.llm.test_jaccard import shingles
from textquarry.llm import decontam, lines, toxicity

SF = "/root/testdata/sf0.01"
COLUMNS = list(cp.COLUMNS)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own, long = [f"a text number {i} of its own under one doc_id" for i in range(2)], " ".join(f"word{i * 7919 % 100_003}" for i in range(60_000))
    odd = spark.createDataFrame([(None, "of the and", "en", "s", 10), (None, "of the and", "en", "s", 10), (None, None, None, None, None), (-7, "", "en", "s", 0)], docs.schema)
    docs = docs.unionAll(odd).cache()
    # toxicity
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = cp.drop_toxic(spark, docs, SF).cache()
    row = lambda r: (str(r.doc_id), str(r.text))
    judged = toxicity.score(docs, model).collect()
    assert kept.columns == COLUMNS and sorted(map(row, kept.collect())) == sorted(row(r) for r in judged if r.score < 0.5) and any(r.score >= 0.5 for r in judged)
    # lines
    after = cp.drop_lines(spark, kept, SF).cache()
    assert after.columns == COLUMNS and after.count() == kept.count()
    want = sorted((r.doc_id or -9, r.kept_text) for r in lines.dedup_lines(kept).collect())
    assert sorted((r.doc_id or -9, r.text or "") for r in after.collect()) == want and sum(len(r.text or "") for r in after.collect()) < sum(len(r.text or "") for r in kept.collect())
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)
    # near copies, over all pairs that share a shingle: one row of each group, whatever doc_ids are repeated
    after = after.unionAll(spark.createDataFrame([(-8, own[0], "en", "s", 0), (-8, own[1], "en", "s", 0), (-6, own[1], "en", "s", 0), (-9, long, "en", "s", 0)], docs.schema)).cache()
    rows = after.collect()
    sets, root, holders = [shingles(r.text) for r in rows], list(range(len(rows))), defaultdict(list)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, mine in enumerate(sets):
        near = {j for s in mine for j in holders[s]}
        for j in near:
            small, large = sorted((len(mine), len(sets[j])))
            if small >= 0.8 * large and len(mine & sets[j]) >= 0.8 * len(mine | sets[j]):
                root[top(i)] = top(j)
        for s in mine or {None}:
            holders[s].append(i)
    empty = [i for i, mine in enumerate(sets) if not mine]
    for i in empty:
        root[top(i)] = top(empty[0])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top(i)].append(r)
    one = cp.drop_near_copies(spark, after, SF).cache()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    want = [min(g, key=order) for g in groups.values()]
    assert one.columns == COLUMNS and sorted(map(row, one.collect())) == sorted(map(row, want)) and len(want) < len(rows) - 10
    texts = {r.text for r in one.collect()}
    assert {*own, long} <= texts
    # benchmark
    clean = cp.drop_leaks(spark, one, SF).cache()
    leaks = {r.doc_id for r in decontam.query(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == COLUMNS and leaks and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaks
    # packing
    pieces = cp.pack(spark, clean, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).collect() == []
