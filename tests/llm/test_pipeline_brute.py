"""The pipeline against the brute-force versions, stage by stage."""

import random

import numpy as np
from fixtures import LOWER, corpus, frame, near_groups
from test_other_operators import brute_contaminated, check_packing, default_public  # noqa: F401

import corpus_pipeline


def tables(spark, folder):
    """Awkward texts with ids, copies, near copies, and passages of benchmark
    items; labels on half of the documents."""
    rng = random.Random(8)
    seen: dict = {}
    for i, t in corpus(9):
        if i is not None:
            seen.setdefault(i, t)
    vocabulary = [f"v{k}" for k in range(80)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(k, prose(n)) for k, n in enumerate([30, 20, 13, 8])] + [(9, None), (10, "")]
    rows = list(seen.items())
    for k in range(40):
        part = rng.choice(items[:4])[1].split(" ")[:rng.choice([9, 13, 30])]
        if k % 3 == 0:
            part[rng.randrange(len(part))] = "other"
        rows.append((2000 + k, f"{prose(12)} {' '.join(part)} {prose(9)}"))
    rows += [(3000 + k, rows[-1 - 2 * k][1].upper()) for k in range(10)]
    frame(spark, rows, 4).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 0 if len(t or "") < 30 else 1, 0) for i, t in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, items


def test_stages_equal_the_brute_force_versions(spark, tmp_path, default_public):  # noqa: F811
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = dict(rows)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), docs.schema)
        got = {r.doc_id: r.text for r in now.collect()}
        if name == "quality":          # the classifier's rejections are taken as they are
            assert set(got) <= set(left) and len(got) > 0.5 * len(left)
            expected = got
        elif name == "exact_dedup":
            last: dict = {}
            for i, t in left.items():
                k = (t or "").translate(LOWER)
                last[k] = max(last.get(k, -1), i)
            expected = {i: left[i] for i in last.values()}
        elif name == "near_dedup":
            expected = {i: left[i] for i, _, _, kept in near_groups(list(left.items()), 5) if kept}
        else:
            bad = {i for i, _ in brute_contaminated(list(left.items()), items)}
            assert bad
            expected = {i: t for i, t in left.items() if i not in bad}
        assert got == expected, name
        assert name == "quality" or len(got) < len(left), name
        left = got
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(left)
    check_packing(list(left.items()), default_public, packed)
    assert all(len(r.ids) == r.length and np.array(r.ids).max() < 50_257 for r in packed)
