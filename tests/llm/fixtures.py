"""Small tables with every awkward row, and brute-force versions."""

import hashlib
import random
import re

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Ümlaut", "ñandú", "kiwi", "日本"] + [f"w{k}" for k in range(150)]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", ". ", "\t"]) for _ in range(n))

    passage, line = prose(60), "A line that is found in many documents"
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[k] for k in (0, 0, 0, 3, 4)] + [texts[5].upper(), texts[6] + " "]
    texts += [prose(20) + passage + prose(25) for _ in range(5)]
    texts += [f"{prose(8)}\n{line}\n{prose(5)}\n  {line.upper()}\t" for _ in range(6)]
    near = texts[7].split(" ")
    for k in range(6):
        copy = list(near)
        copy[k * 3 % len(copy)] = f"changed{k}"
        texts.append(" ".join(copy))
    repeated = prose(50)
    texts += [repeated + "middle" + repeated, "x" * 900, "x" * 450, "ab" * 300, prose(3000), prose(3000) + passage]
    texts += ["", "", " ", "\n\n", "\n", "word", "word", "Word", "two words", "two  words", "\x1c\x1d", "a b", "é" * 12, "é" * 9]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(1000, None), (1001, None), (None, None), (None, texts[0]), (None, prose(30)),
             rows[0], rows[0], rows[1], (rows[2][0], prose(40))]
    return rows


SCHEMA = "doc_id long, text string"


def frame(spark, rows, partitions: int = 3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    for name in ("kept", "KEY", "_key", "_th", "_raw", "n_lines", "n_dropped", "_keep", "_body", "_doc", "_cut", "_n", "shard", "slot",
                 "kept_bytes", "text_hash", "doc", "start", "_nth", "_url"):
        df = df.withColumn(name, F.lit("x"))
    return df


def ordered(id_):
    """A null doc_id counts as the largest."""
    return 1 << 63 if id_ is None else id_


def line_dedup(rows):
    def key(x):
        return x.strip(SPACES).translate(LOWER)

    first: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= 10:
                first[k] = min(first.get(k, 1 << 64), ordered(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if first.get(key(x), ordered(i)) == ordered(i)]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def exact_dedup(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out |= {(i, keep, len(ids), i == keep, sha(t)) for i in ids}
    return list(out)


def substring_dedup(rows, window=13):
    first: dict = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, 1 << 64), ordered(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < ordered(i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def suffix_dedup(rows, window=200):
    count: dict = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for k in range(len(b) - window + 1):
            x = b[k:k + window]
            count[x] = count.get(x, 0) + 1
    out = []
    for i, b in texts:
        mark = [False] * (len(b) + 1)
        for k in range(len(b) - window + 1):
            if count[b[k:k + window]] > 1:
                mark[k:k + window] = [True] * window
        spans = sum(mark[k] and (k == 0 or not mark[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(mark), spans, sha(bytes(c for k, c in enumerate(b) if not mark[k]))))
    return out


def near_groups(rows, words=2, threshold=80):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        grams = [tuple(w[k:k + words]) for k in range(len(w) - words + 1)] or ([tuple(w)] if w else [])
        sets.append((i, frozenset(grams)))
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    usable = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, s) in enumerate(usable):
        for j, t in usable[:x]:
            inter = len(s & t)
            if 100 * inter >= threshold * (len(s) + len(t) - inter):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), i if i is None or not s else find(i), i is None or not s or find(i) == i) for i, s in sets]


def compare(got, expected):
    def order(rows):
        return sorted(map(tuple, rows), key=repr)
    got, expected = order(got), order(expected)
    wrong = [(g, e) for g, e in zip(got, expected, strict=False) if g != e]
    assert got == expected, (len(got), len(expected), wrong[:3])
