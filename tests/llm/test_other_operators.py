"""Decontamination, packing, sharding, URL filter and quality classifier."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, clashing, compare, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

import basketry.llm.decontaminate as deco
import basketry.llm.packing as packing
import basketry.llm.quality as quality
import basketry.llm.sharding as sharding
import basketry.llm.url_filter as urls
from basketry.llm.bpe import tokenizer
from basketry.llm.queries import RULE_SCHEMA, URL_RULES, VOCABULARY
from basketry.llm.text import text_buffer

ROWS = corpus(2)


# decontamination

def words_of(text):
    def unit(c):
        if any(a <= ord(c) <= b for a, b in deco.UNSPACED):
            return f" {c} "
        if any(a <= ord(c) <= b for a, b in deco.PARTING):
            return " "
        return c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " "
    return "".join(map(unit, text or "")).split(" ")


def brute_contaminated(rows, items):
    out = set()
    for d, text in rows:
        w = [x for x in words_of(text) if x]
        for i, item in items:
            b = [x for x in words_of(item) if x]
            if item is None or not b:
                continue
            if len(b) < 5:
                if w == b:
                    out.add((d, i))
                continue
            size, most = (13, 2) if len(b) >= 13 else (len(b), 1 if len(b) >= 8 else 0)
            if any(sum(x != y for x, y in zip(w[p:p + size], b[q:q + size], strict=True)) <= most
                   for p in range(len(w) - size + 1) for q in range(len(b) - size + 1)):
                out.add((d, i))
    return out


def deco_tables(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(60)] + ["Été", "the"]
    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate([40, 25, 13, 14, 12, 6, 5, 4, 1, 30])]
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    items += [(30, chinese), (31, " ".join(prose(8))), (32, " ".join(prose(9))), (33, "สวัสดีครับทุกคน"), (34, "two words"), (35, "日本")]
    items += [(20, None), (21, ""), (22, items[0][1]), (0, items[0][1])]
    rows = []
    for k in range(120):
        part = rng.choice(items[:10])[1].split(" ")
        start = rng.randint(0, max(0, len(part) - 13))
        part = part[start:start + rng.choice([5, 12, 13, 14, 40])]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            part[rng.randrange(len(part))] = "other"
        joint = rng.choice([" ", "\n", "*** ", ", "])
        rows.append((k, " ".join(prose(rng.randint(0, 20))) + " " + joint.join(part).upper() + " " + " ".join(prose(rng.randint(0, 20)))))
    twelve = items[4][1].split(" ")
    rows += [(300, chinese), (301, f"前{chinese}後"), (302, chinese[:20] + "變" + chinese[21:40] + "，" + chinese[40:]), (303, items[7][1]), (304, f"x {items[7][1]}"),
             (305, " ".join([*prose(3), *twelve[:5], "changed", *twelve[6:], "end"])), (306, " ".join(["a", *twelve[1:11], "b"])),
             (307, items[11][1].replace(" ", "\u2003", 3).upper()), (308, items[12][1].replace(" ", "\u3001")), (309, "“Two—words”"), (310, "สวัสดีครับทุกคน"), (311, "日本"),
             (312, "日本語")]
    return rows + [(200, None), (201, ""), (202, "word"), (203, " ".join(prose(4000))), rows[0], (None, items[0][1])], items


@pytest.mark.parametrize("most", [deco.MAX_BROADCAST_WORDS, 0])
def test_contaminated(spark, most):
    """With broadcast items, and with the join for large benchmark tables."""
    rows, items = deco_tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = deco.contaminated(frame(spark, rows), bench, most).collect()
    compare([(r.doc_id, r.item_id) for r in got], brute_contaminated(rows, items))
    assert all(r.windows >= 1 and r.first_word >= 0 and r.matching_words >= 1 for r in got)


def test_both_ways_find_the_same(spark):
    rows, items = deco_tables(9)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    compare([tuple(r) for r in deco.contaminated(docs, bench, 0).collect()], [tuple(r) for r in deco.contaminated(docs, bench).collect()])


def test_short_and_unspaced_items_are_found(spark):
    rows, items = deco_tables()
    found = {(r.doc_id, r.item_id) for r in deco.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(300, 30), (301, 30), (302, 30), (303, 7), (305, 4), (307, 31), (308, 32), (309, 34), (310, 33), (311, 35)} <= found
    assert not {(304, 7), (306, 4), (312, 35)} & found


@pytest.mark.parametrize("n", range(8, 13))
def test_half_masks_are_lossless(n):
    """One differing place leaves a placement of the mask."""
    p = deco.whole(n)
    assert all(any(k not in range(s, s + p.span) for s in range(p.reach + 1)) for k in range(n))


def test_drop_contaminated(spark):
    rows, items = deco_tables()
    docs = clashing(frame(spark, rows))
    left = deco.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == docs.columns
    bad = {d for d, _ in brute_contaminated(rows, items)}
    compare([(r.doc_id, r.text) for r in left.collect()], [(d, t) for d, t in rows if d not in bad])


def test_masks_are_lossless():
    """Any two differing places of a window leave a placement of a mask."""
    for pair in itertools.combinations(range(deco.WINDOW), deco.SUBSTITUTIONS):
        assert any(not {o + s for o in p.offsets} & set(pair) for p in deco.LONG for s in range(p.reach + 1)), pair


def test_empty_benchmark_and_documents(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert deco.contaminated(frame(spark, ROWS), empty).count() == 0
    assert deco.drop_contaminated(frame(spark, ROWS), empty).count() == len(ROWS)
    items = spark.createDataFrame(deco_tables()[1], "item_id long, text string")
    assert deco.contaminated(spark.createDataFrame([], SCHEMA), items).count() == 0


# packing

EDGE = ["", "'s", "x's", "x'source 've 'vex", "  a", "a  b", "a \n b", "a\n\nb  ", "   ", "\n", " '", "''s", "!'s", "a'b' 's\n's x'T I'll we'LLl'll",
        "日本語 テスト１２３ ½²", "\u00a0x\u2003 y\u200bz\x1c\x85", "é\u0301 ñ a1b2 _x_ <|endoftext|>", "😀😀 ok", "it's'd", "\t\tx\ty", "a 'r 're'"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def block_ids(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    ids, counts = tokenizer(VOCABULARY).encode(raw, offsets)
    ends = np.cumsum(counts)
    return [ids[e - c:e].tolist() for e, c in zip(ends, counts, strict=True)]


def test_ids_equal_the_public_tokenizer(public):
    texts = EDGE + [a + b for a in EDGE for b in EDGE] + [t or "" for _, t in ROWS]
    assert block_ids(texts) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="'stremvld aA1 \n\t.!é日\u00a0", max_size=30), max_size=8))
def test_ids_of_random_texts(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    assert block_ids(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


SPECIAL = "<|endoftext|>"
ADDED = ["hi <|endoftext|> there", SPECIAL, SPECIAL * 3, f"  {SPECIAL}  ", f"a\n\n{SPECIAL}\n\nb", f"é{SPECIAL}'s {SPECIAL}", "<|endoftext|", "|endoftext|>",
         f"<|{SPECIAL}|>", f"<|endof{SPECIAL}text|>", "<|ENDOFTEXT|>", "x <|endof", "text|> y", ""]


@pytest.fixture(scope="module")
def default_public():
    """The public tokenizer as it comes: added tokens keep their ids."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def added_ids(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    ids, counts = tokenizer(VOCABULARY).encode_added(raw, offsets)
    ends = np.cumsum(counts)
    return [ids[e - c:e].tolist() for e, c in zip(ends, counts, strict=True)]


def test_ids_of_added_tokens_equal_the_public_tokenizer(default_public):
    assert added_ids(["hi <|endoftext|> there"]) == [[5303, 220, 50256, 612]]
    texts = ADDED + EDGE + [a + b for a in ADDED for b in ADDED + EDGE] + [t or "" for _, t in ROWS]
    assert added_ids(texts) == [e.ids for e in default_public.encode_batch(texts, add_special_tokens=False)]
    assert added_ids(["", SPECIAL, ""]) == [[], [50256], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([SPECIAL, "<|", "|>", " ", "\n", "'s", "a", "é", "1"]), max_size=12).map("".join), max_size=6))
def test_ids_of_random_texts_with_added_tokens(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    assert added_ids(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pack_documents_with_added_tokens(spark, default_public):
    rows = [(k, t) for k, t in enumerate(ADDED)] + [(100, f"word {SPECIAL} " * 1500), (101, None)]
    got = packing.pack_documents(frame(spark, rows), VOCABULARY).collect()
    check_packing(rows, default_public, got)
    assert sum(r.ids.count(50256) for r in got) == sum((t or "").count(SPECIAL) for _, t in rows)


def check_packing(rows, public, got):
    ids = {}
    for d, t in rows:
        ids.setdefault((d, t or ""), public.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.text_hash, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(len(ids[d, t or ""]) for d, t in rows)
    streams = sorted((repr(k[0]), k[2]) for k in by_doc)
    assert streams == sorted((repr(d), len(x)) for (d, _), x in ids.items())
    wanted = {(d, x.start, zlib.crc32(np.array(i[x.start:x.start + x.length], "<u4").tobytes()))
              for (d, _), i in ids.items() for x in got if x.doc_id == d and x.doc_tokens == len(i)}
    assert all((r.doc_id, r.start, r.ids_crc32) in wanted for r in got)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_pack_documents(spark, public):
    got = packing.pack_documents(frame(spark, ROWS), VOCABULARY).collect()
    used = check_packing(ROWS, public, got)
    assert used <= 1.1 * sum(r.length for r in got) / 2048 + 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_padded_sequences(spark):
    packed = packing.pack_documents(frame(spark, ROWS), VOCABULARY)
    assert {len(r.ids) for r in packing.padded_sequences(packed).collect()} == {2048}


def test_pack_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=12, max_size=12))
def test_cutting_stock_meets_the_demand(demand):
    demand = np.array(demand)
    plan = packing.cutting_stock(demand)
    sizes = np.arange(1, 13)
    assert (sum((n * p for n, p in plan), np.zeros(12, int)) == demand).all()
    assert all((p * sizes).sum() <= 12 and n > 0 for n, p in plan)
    ranks = packing.Assignment(plan, 12)
    seen = set()
    load: dict = {}
    for c in range(1, 13):
        sequence, place = ranks.of(np.full(demand[c - 1], c), np.arange(demand[c - 1]))
        for s, p in zip(sequence.tolist(), place.tolist(), strict=True):
            assert (s, p) not in seen
            seen.add((s, p))
            load[s] = load.get(s, 0) + c
    assert len(load) == sum(n for n, _ in plan) == ranks.sequences and all(x <= 12 for x in load.values())


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 3000, 64)
    plan = packing.cutting_stock(demand)
    assert sum(n for n, _ in plan) <= (demand * np.arange(1, 65)).sum() / 64 * 1.05 + 64


def test_best_pattern_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        prices = rng.random(7)
        best = max(sum(prices[c - 1] for c in combo) for k in range(8) for combo in itertools.combinations_with_replacement(range(1, 8), k)
                   if sum(combo) <= 7)
        value, pattern = packing.best_pattern(prices, 7)
        assert abs(value - best) < 1e-9 and abs((pattern * prices).sum() - best) < 1e-9


# sharding

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**31))
def test_feistel_is_a_permutation(n, seed):
    p = sharding.FeistelPermutation(n, seed)
    place = p.place_of(np.arange(n))
    assert sorted(place.tolist()) == list(range(n))
    assert (p.row_of(place) == np.arange(n)).all()


def test_shard_rows(spark):
    got = sharding.shard_rows(frame(spark, ROWS)).collect()
    again = sharding.shard_rows(frame(spark, ROWS, 7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    compare([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS])
    sizes = []
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
        sizes.append(len(slots))
    assert max(sizes) - min(sizes) <= 1
    p = sharding.FeistelPermutation(len(ROWS))
    for r in got:
        assert p.place_of([r.row_number])[0] == r.slot * 8 + r.shard and p.row_of([r.slot * 8 + r.shard])[0] == r.row_number
    by_row = sorted(got, key=lambda r: r.row_number)
    assert [r.doc_id is not None for r in by_row] == sorted(r.doc_id is not None for r in by_row)


def test_in_shards_and_empty(spark):
    docs = clashing(frame(spark, ROWS))
    out = sharding.in_shards(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    places = [(r[-2], r[-1]) for r in out.collect()]
    assert sorted(places) == sorted({(r.shard, r.slot) for r in sharding.shard_rows(docs).collect()}) and len(places) == len(ROWS)
    assert sharding.shard_rows(spark.createDataFrame([], SCHEMA)).count() == 0


# URL filter

def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), v, h + p) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[3], best[2] if best else default)


URLS = [None, "", "no scheme", "http://", "https://a.net", "https://a.net/", "HTTP://WWW.Example.NET/en/x", "http://example.net/en", "http://example.net/en/",
        "http://example.com/de/?q", "http://sub.example.com/de", "http://x.org/fr/a/b#c", "http://org/fr/", "http://norg/fr/", "http://org", "://net/x",
        "http://net?x=/y", "ftp://u:p@a.net:80/x", "http://a.net/x://b.org/fr/", "http://ÄÖ.net/é", "http://example.net./en/", "http://.net/", "http://net//",
        "http://a..net/\nb", "http://" + "a." * 300 + "net/" + "x/" * 500, "https://blog.example.org/tag/spam/1", "https://blog.example.org/tagged"]
MORE_RULES = URL_RULES + [("example.org", "/tag", "block"), ("blog.example.org", "", "allow"), ("blog.example.org", "/tag/", "block"),
                          ("blog.example.org", "/tag/s", "allow"), ("org", "", "block"), ("a.net", "/x", "allow"), ("a.net", "/x", "block")]


@pytest.mark.parametrize("rules", [URL_RULES, MORE_RULES, []])
@pytest.mark.parametrize("most", [1000, 0])
def test_url_verdicts(spark, rules, most):
    rows = list(enumerate(URLS)) + [(1, URLS[6]), (None, URLS[7])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block")], RULE_SCHEMA)
    got = urls.url_verdicts(pages, listed, max_broadcast=most).collect()
    compare([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], [(i, *brute_verdict(u, rules)) for i, u in rows])


def test_allowed_pages(spark):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"))
    left = urls.allowed_pages(pages, spark.createDataFrame(MORE_RULES, RULE_SCHEMA))
    assert left.columns == pages.columns
    compare([(r.page_id,) for r in left.collect()], [(i,) for i, u in enumerate(URLS) if brute_verdict(u, MORE_RULES)[3] == "allow"])
    assert urls.allowed_pages(pages.limit(0), spark.createDataFrame(MORE_RULES, RULE_SCHEMA)).count() == 0


# quality

def quality_tables(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < 0.7
        words = [rng.choice(["tree", "river", "under", "stone", "walk", "and", "the"]) for _ in range(rng.randint(3, 80))]
        rows.append((k, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)))
        labels.append((k, int(good), 0))
    extra = [(700, None), (701, ""), (702, "x" * 100_000), rows[0], (None, "a text")]
    labels += [(3, labels[3][1], 0), (900, 1, 0), (5, None, 0), (None, 1, 0)]
    return (spark.createDataFrame(rows + extra, SCHEMA).repartition(3),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows + extra, labels)


def test_quality_scores(spark):
    docs, labels, rows, marked = quality_tables(spark)
    got = quality.quality_scores(docs, labels).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(d) for d, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {d: q for d, q, _ in marked if q is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_do_not_matter(spark):
    from pyspark.sql import functions as F
    docs, labels, _, _ = quality_tables(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, round(r.score, 6)) for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_without_labels_and_documents(spark):
    docs, labels, rows, _ = quality_tables(spark)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.drop_low_quality(docs, labels.limit(0)).count() == len(rows)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_drop_low_quality(spark):
    docs, labels, _, marked = quality_tables(spark)
    docs = clashing(docs)
    left = quality.drop_low_quality(docs, labels)
    assert left.columns == docs.columns
    bad = {d for d, q, _ in marked if q == 0}
    stay = {r.doc_id for r in left.collect()}
    assert len(stay & bad) <= 2 and len(stay) >= 0.97 * (605 - len(bad))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=30))
def test_isotonic_is_the_best_monotone_fit(pairs):
    weight = np.array([w for w, _ in pairs], float)
    total = np.array([min(t, w) for w, t in pairs], float)
    fit = quality.isotonic(weight, total)
    assert (np.diff(fit) >= -1e-12).all()
    # max-min formula of isotonic regression
    n = len(pairs)
    want = [max(min(total[i:j + 1].sum() / weight[i:j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    assert np.allclose(fit, want)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, len(quality.STATISTICS)))
    m = quality.QualityModel(np.zeros(x.shape[1]), np.ones(x.shape[1]), fourier=20_000)
    f = m.features(x)[:, :-1]
    kernel = np.exp(-quality.BANDWIDTH * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(f @ f.T - kernel).max() < 0.06


def test_rounding_that_exceeds_a_demand():
    """Two patterns of one count, of which a single repetition is too many."""
    patterns = np.array([[2, 1, 0, 0], [0, 0, 0, 1], [0, 2, 0, 0]])
    demand = np.array([9, 8, 0, 5])
    plan = packing._whole(np.array([5, 5, 2]), patterns, demand)
    assert (sum((n * p for n, p in plan), np.zeros(4, int)) == demand).all()
    assert (4, [2, 1, 0, 0]) in [(n, p.tolist()) for n, p in plan]           # reduced by one, not dropped


def test_a_large_trie_is_small(spark):
    """500,000 rules in one process, and as they are sent."""
    import pickle
    import tracemalloc
    rules = [(f"h{k % 90_000}.example{k % 7}.org", f"/a{k % 11}/b{k}", ("allow", "block")[k % 2]) for k in range(500_000)]
    sent = pickle.dumps(urls.UrlTrie(rules))
    tracemalloc.start()
    trie = pickle.loads(sent)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 100e6 and len(sent) < 100e6
    for k in (0, 77, 499_999):
        host, path, verdict = rules[k]
        assert trie.longest("www." + host, path + "/x") == (host + path, verdict)
        assert trie.longest(host + ".net", path) is None
