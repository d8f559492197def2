"""Filter interaction audit, token files and cross-tokenizer alignment."""

import hashlib
import io
import random
import struct
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from fixtures import SCHEMA, WORD, clashing, compare, corpus, frame, ordered
from hypothesis import given, settings
from hypothesis import strategies as st

import basketry.llm.alignment as alignment
import basketry.llm.filter_audit as audit
import basketry.llm.token_files as files
from basketry.llm.queries import PIECE_VOCABULARY, VOCABULARY, WORD_END_ID, WORD_VOCABULARY
from basketry.llm.text import text_buffer

ROWS = corpus(5)
LONG = "".join(f"word{k % 5000} " for k in range(600_000))       # over 5 MB: longer than any block or unit's part


# filter audit

def audit_tables(seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "", None]), t) for i, t in ROWS]
    rows += [(2000 + k, "hot", rng.choice(["same text", "AN UPPER TEXT", "x $ y " * 120, " ".join(f"w{j}" for j in range(230))])) for k in range(80)]
    rows += [(3000, "a", "one " * 300), (3001, "b", "one " * 300), (None, "b", "one " * 300), (None, None, "alone with no id")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i, _, _ in rows if i is not None and rng.random() < 0.7]
    return rows, labels + [labels[0], (labels[1][0], 1, 1), (None, 1, 1), (99999, 1, 1), (2001, None, None)]


def brute_audit(rows, labels):
    first: dict = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", 1 << 63), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing: dict = {}
    for i, source, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {k for k, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)),
                                  ("C", 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)), ("D", any(c in "#$%&*|" for c in t)),
                                  ("E", first.get(t, 1 << 63) < ordered(i))) if bad}
        failing.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, docs in failing.items():
        steps = {}
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fail = sum(f in d[0] for d in docs)
                steps[order, step] = (f, len(left), len(gone), fail - len(gone), sum(d[0] == {f} for d in docs),
                                      sum(d[1] for d in gone), sum(d[2] for d in gone))
        shapley = {f: sum(s[2] for s in steps.values() if s[0] == f) for f in "ABCDE"}
        out += [(part, order, step, *s[1:], shapley[s[0]]) for (order, step), s in steps.items()]
    return out


@pytest.mark.parametrize("range_rows", [audit.RANGE_ROWS, 7])
def test_filter_audit(spark, range_rows):
    """Whole ranges, and a part over many ranges."""
    rows, labels = audit_tables()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.filter_audit(docs, marks, range_rows)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    compare(got.collect(), brute_audit(rows, labels))


def test_filter_audit_of_long_texts(spark):
    rows = [(1, "s", LONG), (2, "s", LONG), (3, "s", LONG.upper()), (4, "s", "#")]
    got = audit.filter_audit(spark.createDataFrame(rows, "doc_id long, source string, text string"),
                             spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    compare(got.collect(), brute_audit(rows, []))


def test_filter_audit_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(empty, marks).count() == 0


def test_posting_lists_hold_every_row_once(spark):
    rows, labels = audit_tables()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lists = audit.posting_lists(audit._labelled(audit.filter_failures(docs), marks), 9).collect()
    assert sum(r.n for r in lists) == len(rows)
    for r in lists:
        for c in audit.FILTERS:
            assert r[c] == sorted(set(r[c])) and all(0 <= x < r.n for x in r[c])
    hot = sorted((r.first_id, r.last_id) for r in lists if r.part == "hot")
    assert len(hot) > 5 and all(a[1] <= b[0] for a, b in zip(hot, hot[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 3000), max_size=400), min_size=1, max_size=5))
def test_galloping_sets(sets):
    lists = [np.array(sorted(s), np.int32) for s in sets]
    assert audit.union(lists).tolist() == sorted(set().union(*sets))
    for x, s in zip(lists, sets, strict=True):
        assert x[~audit.contained(x, lists[0])].tolist() == sorted(s - sets[0])


def test_gallop_equals_binary_search():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (3, 100_000), (50, 1000), (1, 1), (10, 64), (10, 6400), (4000, 100_000)):
        among, keys = np.unique(rng.integers(0, 200_000, m)), np.unique(rng.integers(-5, 200_005, n))
        assert audit.gallop(keys, among).tolist() == np.searchsorted(among, keys).tolist()


# token files

@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD_VOCABULARY)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def brute_token_rows(rows, word_ids):
    """Repeated doc_ids stand in any order, so starts are compared by order elsewhere."""
    return [(i, len(ids) + 1, crc([*ids, WORD_END_ID])) for (i, _), ids in zip(rows, word_ids([t or "" for _, t in rows]), strict=True)]


@pytest.mark.parametrize("by_words", [True, False])
def test_token_files(spark, word_ids, by_words):
    rows = [*ROWS, (4000, LONG), (4001, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>"), (4002, "é é ́x İΣ ΑΣ ς　日本 x's 'LL 12")]
    manifest = files.write_token_files(clashing(frame(spark, rows, 5)), WORD_VOCABULARY, WORD_END_ID, by_words)
    got = files.read_token_files(manifest, with_ids=True).collect()
    compare([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], brute_token_rows(rows, word_ids))
    assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in got)
    in_files = sorted(got, key=lambda r: r.start)
    assert [ordered(r.doc_id) for r in in_files] == sorted(ordered(i) for i, _ in rows)
    at = 0
    for r in in_files:
        assert r.start == at
        at += r.n_tokens


def test_token_files_of_an_empty_table(spark):
    manifest = files.write_token_files(spark.createDataFrame([], SCHEMA), WORD_VOCABULARY, WORD_END_ID, True)
    assert manifest.count() == 0 and files.read_token_files(manifest).count() == 0
    assert files.read_documents(manifest, spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0


def test_read_documents(spark, word_ids):
    rows = [(i, t) for i, t in ROWS if i is not None]
    manifest = files.write_token_files(frame(spark, ROWS, 4), WORD_VOCABULARY, WORD_END_ID, True)
    wanted = [0, 3, 17, 1000, 987654]
    got = files.read_documents(manifest, spark.createDataFrame([(i,) for i in [*wanted, 3, None]], "doc_id long")).collect()
    expected = [(i, tuple([*ids, WORD_END_ID])) for (i, _), ids in zip(rows, word_ids([t or "" for _, t in rows]), strict=True) if i in wanted]
    compare([(r.doc_id, tuple(r.ids)) for r in got], expected)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAé́ \n\t\x0b  \x1c.'sΣİ1<|>日", max_size=25), max_size=8))
def test_word_ids_equal_the_library(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    encode = files.encoder(WORD_VOCABULARY, True)
    ids, counts = encode.encode(raw, offsets)
    ends = np.cumsum(counts)
    assert [ids[e - c:e].tolist() for e, c in zip(ends, counts, strict=True)] == encode._batch(texts)


def written(docs, width=2):
    out = io.BytesIO()
    w = files.FileWriter(out, width, 7)
    for i, ids in docs:
        w.add(i, np.array(ids, np.uint32))
    w.close()
    return out.getvalue()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2**63, 2**63 - 1)), st.integers(0, 300)), max_size=20), st.sampled_from([2, 4]))
def test_files_round_trip(docs, width):
    rng = random.Random(1)
    docs = [(i, [rng.randrange(1 << 8 * width) for _ in range(n)]) for i, n in docs]
    before, files.FRAME_IDS = files.FRAME_IDS, 100
    try:
        raw = written(docs, width)
    finally:
        files.FRAME_IDS = before
    r = files.FileReader(io.BytesIO(raw))
    assert r.doc_ids == [i for i, _ in docs] and r.width == width and r.end_id == 7
    assert [r.ids(k).tolist() for k in range(len(docs))] == [x for _, x in docs]
    assert [r.ids(k).tolist() for k in reversed(range(len(docs)))] == [x for _, x in reversed(docs)]


def test_any_decoder_reads_the_frames_and_readers_only_what_they_need():
    docs = [(k, list(range(k, k + 40_000))) for k in range(20)]
    raw = written(docs)
    # the frames one after the other, as a plain decoder sees them; it skips the seek table
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain.startswith(np.concatenate([x for _, x in docs]).astype("<u2").tobytes())
    r = files.FileReader(io.BytesIO(raw))
    assert r.frames_read == 0 and r.ids(11).tolist() == docs[11][1]
    assert r.frames_read == 1
    assert struct.unpack("<I", raw[-4:])[0] == files.SEEKABLE_MAGIC


def test_damage_is_found():
    docs = [(k, list(range(500))) for k in range(300)]
    raw = bytearray(written(docs))
    r = files.FileReader(io.BytesIO(raw))
    raw[int(r._starts[1]) + 40] ^= 1
    r = files.FileReader(io.BytesIO(raw))
    assert r.ids(0).tolist() == docs[0][1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r.ids(200)
    table = bytearray(written(docs))
    table[-10] ^= 1                # a checksum in the seek table
    with pytest.raises(ValueError):
        files.FileReader(io.BytesIO(table))
    with pytest.raises(ValueError):
        files.FileReader(io.BytesIO(bytes(raw) + b"more"))


# alignment

@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)


def brute_alignment(rows, libraries):
    a, b = libraries
    chars = alignment.byte_of_char()
    spelled = {i: bytes(chars.get(c, 0) for c in t) if all(c in chars for c in t) else t.encode() for t, i in a.get_vocab().items()}
    docs, held = [], {}
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [spelled[x] for x in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append((i, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        cut = sorted(set(ends_a) & set(ends_b))
        groups, x, y = [], 0, 0
        for c in cut:
            x2, y2 = ends_a.index(c, x) + 1, ends_b.index(c, y) + 1
            groups.append((ids_a[x:x2], ids_b[y:y2]))
            x, y = x2, y2
        links, k = [], 0
        for j, (id_a, end) in enumerate(zip(ids_a, ends_a, strict=True)):
            start = ends_a[j - 1] if j else 0
            while k and ends_b[k - 1] > start:
                k -= 1
            while ends_b[k] <= start:
                k += 1
            m = k
            while m < len(ids_b) and (ends_b[m - 1] if m else 0) < end:
                links.append((id_a, ids_b[m]))
                m += 1
            k = m - 1
        for p in set(links):
            held[p] = held.get(p, 0) + 1
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        docs.append((i, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text.encode()).hexdigest()))
    best: dict = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(i, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), d)
            for i, na, nb, ng, links, d in docs], held, best


AWKWARD = ["▁", "a▁b", "x ▁ y", "\x00", "a\x00b", "  ", " a", "a ", "\n \n", "<|endoftext|> hi", "<s> </s> <unk> <0x41>", "ｆ ﬁ", "á", "﻿b",
           "日本語 テスト", "😀 😀", "x" * 3000, " " * 300, "tab\there", " nb", "a\r\nb", "(())", "don't won't I'll"]


@pytest.mark.parametrize("fan_in", [alignment.FAN_IN, 2])
def test_alignment(spark, libraries, monkeypatch, fan_in):
    """One level of merges, and several of small units."""
    rows = [*ROWS, *((5000 + k, t) for k, t in enumerate(AWKWARD))]
    docs = clashing(frame(spark, rows, 9))
    got = alignment.align_documents(docs, VOCABULARY, PIECE_VOCABULARY, fan_in)
    expected, _, _ = brute_alignment(rows, libraries)
    compare(got.collect(), expected)


def test_pair_counts(spark, libraries):
    rows = ROWS[:40]
    got = alignment.pair_counts(frame(spark, rows, 3), VOCABULARY, PIECE_VOCABULARY, 2).collect()
    _, held, best = brute_alignment(rows, libraries)
    compare(got, [(a, b, n, n == best[a]) for (a, b), n in held.items()])


def test_alignment_of_long_and_repeated_texts(spark, libraries):
    rows = [(1, LONG[:1_500_000]), (2, "short"), *[(10 + k, "the same text") for k in range(300)]]
    got = alignment.align_documents(frame(spark, rows, 4), VOCABULARY, PIECE_VOCABULARY).collect()
    compare(got, brute_alignment(rows, libraries)[0])


def test_alignment_of_empty_tables(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), VOCABULARY, PIECE_VOCABULARY).count() == 0
    got = alignment.align_documents(frame(spark, [(1, None), (None, "")]), VOCABULARY, PIECE_VOCABULARY).collect()
    compare(got, [(1, *[0] * 6, ""), (None, *[0] * 6, "")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab the.,'日é\n\t  <|>x0▁", min_size=1, max_size=40), min_size=1, max_size=6))
def test_piece_ids_equal_the_library(texts):
    import sentencepiece
    texts = [t for t in texts if "▁" not in t] or ["a"]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)
    raw, offsets = text_buffer(pa.array([" " + t for t in texts], pa.string()))
    ids, counts = alignment.piece_tokenizer(PIECE_VOCABULARY).encode(raw, offsets)
    ends = np.cumsum(counts)
    assert [ids[e - c:e].tolist() for e, c in zip(ends, counts, strict=True)] == model.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 400), st.integers(1, 9), max_size=120), max_size=6), st.integers(1, 9))
def test_heap_merge_of_runs(runs, b_size):
    before, alignment.CHUNK = alignment.CHUNK, 5
    try:
        opened = [alignment.Run(alignment.write_run(np.array(sorted(r), np.int64), np.array([r[k] for k in sorted(r)], np.int64)), b_size) for r in runs]
        got, returned = [], [[] for _ in runs]
        for pairs, counts, places in alignment.merged(opened):
            assert not got or got[-1][0] // b_size < pairs[0] // b_size      # whole A ids, in order
            got += zip(pairs.tolist(), counts.tolist(), strict=True)
            for k, p in enumerate(places):
                returned[k] += pairs[p].tolist()
        total: dict = {}
        for r in runs:
            for k, n in r.items():
                total[k] = total.get(k, 0) + n
        assert got == sorted(total.items()) and returned == [sorted(r) for r in runs]
    finally:
        alignment.CHUNK = before
