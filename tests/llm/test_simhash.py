"""Fingerprints and groups against plain loops over all pairs."""

import random
from collections import Counter

import xxhash

from strandloom.llm import blocks, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] * bool(w)
            w = ""
        else:
            w += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))]


def corpus():
    random.seed(5)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "ÀB", "Q"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two")]
    for base in range(6):
        words = random.choices(vocab, k=400)
        for _ in range(25):
            w = list(words)
            for _ in range(random.choice([0, 0, 1, 1, 2, 5])):
                w[random.randrange(len(w))] = random.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(random.choices(vocab, k=random.randint(1, 30)))) for i in range(60)]
    return rows + [rows[20], (len(rows) + 100, "long " * 30_000)]


def as_docs(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "x") for d, t in rows], "doc_id long, text string, fp string, component_id string")


def test_groups_equal_all_pairs(spark, monkeypatch):
    rows = corpus()
    want = Counter(plain_groups(rows))
    for block in (1024, 4):  # the second cuts every posting list into pairs of blocks
        monkeypatch.setattr(blocks.cut_hot, "__defaults__", (block,))
        got = Counter((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.grouped(as_docs(spark, rows)).collect())
        assert got == want


def test_one_of_each_and_empty(spark):
    rows = corpus()
    docs = as_docs(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_groups(rows)})
    assert simhash.grouped(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_loses_no_group(spark):
    random.seed(8)
    texts = [" ".join(random.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[2]), (None, texts[2]), (None, texts[4]), (None, texts[4]), (9, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "mine", "x", 1) for d, t in rows], "doc_id long, text string, _id string, key string, row int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[4]), (9, None)], key=str)
    assert all((r._id, r.key, r.row) == ("mine", "x", 1) for r in kept.collect())
