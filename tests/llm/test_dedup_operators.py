"""The deduplication operators against brute force on awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, clashing, compare, corpus, exact_dedup, frame, line_dedup, near_groups, sha, substring_dedup, suffix_dedup
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import basketry.llm.exact_dedup as exact
import basketry.llm.line_dedup as line
import basketry.llm.near_dedup as near
import basketry.llm.substring_dedup as sub
import basketry.llm.suffix_dedup as suffix
from basketry.llm.text import Words, text_buffer

ROWS = corpus()


def test_exact_dedup(spark):
    got = exact.exact_dedup(frame(spark, ROWS)).collect()
    compare([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], exact_dedup(ROWS))


def test_exact_dedup_tells_texts_with_one_fingerprint_apart(spark):
    """Six fingerprint bits: most fingerprints are shared by different texts."""
    got = exact.exact_dedup(frame(spark, ROWS), bits=6).collect()
    compare([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], exact_dedup(ROWS))


def test_drop_exact_copies_keeps_one_row_and_all_columns(spark):
    docs = clashing(frame(spark, ROWS))
    left = exact.drop_exact_copies(docs)
    assert left.columns == docs.columns
    want = {(i, s) for i, _, _, kept, s in exact_dedup(ROWS) if kept}
    got = [(r.doc_id, sha((r.text or "").translate({c: c + 32 for c in range(65, 91)}))) for r in left.collect()]
    compare(got, want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**16 - 1), max_size=60), max_size=5), st.sampled_from([8, 16]))
def test_quotient_filters_round_trip_and_merge_losslessly(parts, remainder_bits):
    filters = [exact.CountingQuotientFilter.of(np.array(p, np.uint64)) for p in parts]
    back = [exact.CountingQuotientFilter.from_bytes(f.to_bytes(16, remainder_bits)) for f in filters]
    if not back:
        return
    merged = exact.CountingQuotientFilter.merged(back)
    values, counts = np.unique(np.array([x for p in parts for x in p], np.uint64), return_counts=True)
    assert merged.fingerprints.tolist() == values.tolist() and merged.counts.tolist() == counts.tolist()


def test_quotient_filter_counts_beyond_a_byte():
    f = exact.CountingQuotientFilter.of(np.array([5] * 1000 + [9], np.uint64))
    assert exact.CountingQuotientFilter.from_bytes(f.to_bytes(64, 40)).counts.tolist() == [1000, 1]


def test_line_dedup(spark):
    got = line.line_dedup(frame(spark, ROWS)).collect()
    compare([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got], line_dedup(ROWS))


def test_line_dedup_of_a_line_over_many_partitions(spark):
    """One line in every document: its rows fill several range partitions."""
    rows = [(i, f"the same line in all documents\nown {i % 400} line of it") for i in range(3000)]
    got = line.line_dedup(frame(spark, rows, 7)).collect()
    compare([(r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got], line_dedup(rows))


def test_line_dedup_keeps_columns_that_clash(spark):
    docs = clashing(frame(spark, ROWS))
    out = line.line_dedup(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    assert out.count() == len(ROWS) and out.where("kept = 'x'").count() == len(ROWS)


def _sub(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sub.substring_dedup(df).collect()]


@pytest.mark.parametrize("shard", [sub.MAX_SHARD, 1])
def test_substring_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(sub, "MAX_SHARD", shard)
    compare(_sub(frame(spark, ROWS)), substring_dedup(ROWS))


def test_substring_dedup_of_an_anchor_with_many_contexts(spark, monkeypatch):
    """Few documents that repeat a phrase with changing surroundings: no
    automaton gets more than MAX_SHARD contexts, and the result is whole."""
    import random
    rng = random.Random(6)
    # the phrase with the smallest hash of many: an anchor wherever it occurs
    w = Words(*text_buffer(pa.array([" ".join(f"p{k}" for k in range(3000))])))
    at, grams = w.windows(w.hashes(), sub.GRAM)
    phrase = [f"p{at[grams.argmin()] + k}" for k in range(sub.GRAM)]
    passages = [[f"q{rng.randint(0, 10**6)}" for _ in range(8)] + phrase + [f"q{rng.randint(0, 10**6)}" for _ in range(8)] for _ in range(12)]
    rows = []
    for i in range(4):
        words = []
        for k in range(60):
            own = [f"o{rng.randint(0, 10**6)}" for _ in range(8)]
            words += rng.choice(passages) if k % 5 == 0 else own + phrase + own[::-1]
        rows.append((i * 3 % 4, " ".join(words)))
    rows += [(7, rows[0][1] + " end"), (None, " ".join(passages[0] + passages[1]))] + ROWS
    largest, solve = [], sub._owners

    def spy(words):
        largest.append(words.groupBy("key").count().agg(F.max("count")).first()[0])
        return solve(words)

    monkeypatch.setattr(sub, "MAX_SHARD", 20)
    monkeypatch.setattr(sub, "_owners", spy)
    compare(_sub(frame(spark, rows)), substring_dedup(rows))
    assert len(largest) == 1 and 1 < largest[0] <= 20


def test_drop_repeated_passages(spark):
    docs = clashing(frame(spark, ROWS))
    out = sub.drop_repeated_passages(docs)
    assert out.columns == docs.columns
    want = [x[3] for x in substring_dedup(ROWS)]
    assert sorted(sha(b" ".join((r.text or "").encode().split())) for r in out.collect()) == sorted(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=5), st.integers(1, 6))
def test_suffix_automaton_names_the_smallest_owner(texts, window):
    a = sub.SuffixAutomaton()
    owners = list(range(len(texts), 0, -1))
    for o, t in zip(owners, texts, strict=True):
        a.add(t, o)
    a.finish()
    for t in texts:
        want = [min(o for o, u in zip(owners, texts, strict=True) if any(u[j:j + window] == t[k:k + window] for j in range(len(u) - window + 1)))
                for k in range(len(t) - window + 1)]
        assert a.owners(t, window) == want


def _suffix(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.suffix_dedup(df).collect()]


@pytest.mark.parametrize("shard", [suffix.MAX_SHARD, 1])
def test_suffix_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "MAX_SHARD", shard)
    compare(_suffix(frame(spark, ROWS)), suffix_dedup(ROWS))


def test_drop_repeated_bytes(spark):
    docs = clashing(frame(spark, ROWS))
    out = suffix.drop_repeated_bytes(docs)
    assert out.columns[:-1] == docs.columns
    assert sorted(sha(bytes(r[-1])) for r in out.collect()) == sorted(x[4] for x in suffix_dedup(ROWS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=50))
def test_suffix_array(values):
    s = np.array(values)
    assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: values[i:])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.integers(1, 12))
def test_repeated_starts(texts, window):
    count: dict = {}
    for t in texts:
        for k in range(len(t) - window + 1):
            count[t[k:k + window]] = count.get(t[k:k + window], 0) + 1
    want = [[k for k in range(len(t) - window + 1) if count[t[k:k + window]] > 1] for t in texts]
    assert [x.tolist() for x in suffix.repeated_starts(texts, window)] == want


@pytest.mark.parametrize("words", [2, 5])
def test_near_groups(spark, words):
    got = near.near_groups(frame(spark, ROWS), words).collect()
    compare([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], near_groups(ROWS, words))


def test_near_groups_of_a_large_group(spark):
    """Copies of one text with some words changed, many of them unlinked."""
    import random
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(250):
        words = list(base)
        for k in rng.sample(range(60), rng.randint(0, 9)):
            words[k] = f"n{rng.randint(0, 10**6)}"
        rows.append((i * 3 % 250, " ".join(words)))
    got = near.near_groups(frame(spark, rows)).collect()
    compare([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], near_groups(rows))


def test_drop_near_copies_keeps_columns(spark):
    docs = clashing(frame(spark, ROWS))
    left = near.drop_near_copies(docs)
    assert left.columns == docs.columns
    gone = {i for i, _, _, kept in near_groups(ROWS, 5) if not kept}
    compare([(r.doc_id,) for r in left.collect()], [(i,) for i, _ in ROWS if i not in gone])


@pytest.mark.parametrize(("size", "shared"), [(40, 36), (400, 360), (4000, 3000)])
def test_sketch_estimates_jaccard(size, shared):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(20):
        x = np.unique(rng.integers(0, 2**63, 2 * size - shared).astype(np.uint64))
        rng.shuffle(x)
        a, b = np.sort(x[:size]), np.sort(x[size - shared:])
        r = near.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        errors.append(near.estimate(r[0], r[1]) - len(np.intersect1d(a, b)) / len(x))
    assert abs(np.mean(errors)) < 0.06 and np.max(np.abs(errors)) < near.MARGIN


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for run in (exact.exact_dedup, exact.drop_exact_copies, line.line_dedup, sub.substring_dedup, sub.drop_repeated_passages,
                suffix.suffix_dedup, suffix.drop_repeated_bytes, near.near_groups, near.drop_near_copies):
        assert run(empty).count() == 0, run.__name__


def test_tables_of_null_texts(spark):
    rows = [(1, None), (2, None), (2, None), (None, None)]
    docs = frame(spark, rows, 2)
    assert exact.drop_exact_copies(docs).agg(F.max("doc_id")).first()[0] == 2
    assert near.drop_near_copies(docs).count() == 4
    assert {r.n_removed for r in sub.substring_dedup(docs).collect()} == {0}
    assert {r.n_removed for r in suffix.suffix_dedup(docs).collect()} == {0}


def test_no_link_of_small_sets_is_lost():
    """Sets of four and five shingles at exactly 0.8, and of other small
    sizes: each pair that is compared is counted exactly."""
    rng = np.random.default_rng(3)
    lost = 0
    for n in (4, 8, 12, 20):
        sets = np.sort(rng.integers(0, 2**64, (800, n + n // 4), dtype=np.uint64), axis=1)
        for x in sets:
            y = np.sort(rng.permutation(x)[:n])
            s = near.sketches(np.concatenate((x, y)), np.array([0, len(x), len(x) + n]))
            lost += not near._linked(x.tobytes(), y.tobytes(), s[0].tobytes(), s[1].tobytes(), 80)
    assert lost == 0


def test_marks_let_all_wanted_rows_pass(spark, monkeypatch):
    for bits, few in ((1 << 27, True), (1 << 5, False)):
        monkeypatch.setattr(sub, "MARK_BITS", bits)
        texts = spark.range(4000).selectExpr("id as doc", "xxhash64(id) as text_hash", "'x' as text")
        wanted = texts.where("doc % 40 = 3").select("doc", "text_hash")
        got = {r.doc for r in sub._marked(texts, wanted).collect()}
        assert {i for i in range(4000) if i % 40 == 3} <= got
        assert len(got) == 100 if few else len(got) > 100
    assert sub._marked(texts, wanted.limit(0)).count() == 0


def test_substring_dedup_with_a_third_of_the_ids_null(spark, monkeypatch):
    """Anchors of rows without an id do not all meet in one row."""
    rng = random.Random(6)
    def prose(n):
        return " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = prose(30)
    rows = [(None if k % 3 == 0 else k % 50, f"{prose(20)} {shared if k % 4 == 0 else prose(9)} {prose(15)}") for k in range(240)]
    sizes = []
    contexts = sub._contexts
    def spy(texts):
        sizes.append(texts.selectExpr("max(size(small) + size(large)) as n").first().n)
        return contexts(texts)
    monkeypatch.setattr(sub, "_contexts", spy)
    compare(_sub(frame(spark, rows)), substring_dedup(rows))
    assert sizes[0] < 60
