"""Spelling variants against comparison of all words, and the index and its bounds by themselves."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import variants as v

LETTER = "A-Za-zÀ-ÿ"


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(f"[{LETTER}]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = plain_words(rows)
    near = defaultdict(list)
    for a in n:
        for b in n:
            if a != b and apart(a, b):
                near[a].append(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def made(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choices("abcéÿ", k=r.randint(4, 8))) for _ in range(60)]
    for w in base[:40]:
        k = r.randrange(len(w))
        base += [w[:k] + r.choice("abcéÿ") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + r.choice("abcéÿ") + w[k:]]
    weight = [1 / (k % 23 + 1) for k in range(len(base))]
    return [(i if i % 11 else None, r.choice([" ", "-", "Ā", "1"]).join(r.choices([*base, *(w.upper() for w in base)], [*weight, *weight], k=r.randint(0, 60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, word string, n int")


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_all_pairs(spark):
    rows = made(1, 250) + [(1, None), (2, ""), (3, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa " * 9), (3, "x" * 30_000 + " " + "x" * 30_001), (4, ("x" * 30_000 + " ") * 3 + ("x" * 30_001 + " ") * 4)]
    rows += rows[-3:]
    want = plain(rows)
    assert rows_of(v.grouped(frame(spark, rows).repartition(5))) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(root not in (w, f) for w, f, root, *_ in want)


def test_hot_buckets_in_blocks(spark):
    rows = made(2, 120)
    assert rows_of(v.grouped(frame(spark, rows), block=3)) == plain(rows)


def test_edges(spark):
    assert v.grouped(frame(spark, []).limit(0)).count() == 0
    assert v.grouped(frame(spark, [(1, None), (2, "ab cd 12345 中文中文中文 ab cd"), (None, "")])).count() == 0
    rows = [(None, "straße straße straße"), (1, "STRAßE strasse ÀÉÿõü àéÿõü àÉÿõü"), (1, "Straße ×÷×÷× ×÷×÷× ×÷×÷×")]
    assert rows_of(v.grouped(frame(spark, rows))) == plain(rows)


word = st.text("abé", min_size=5, max_size=9)


@settings(max_examples=200, deadline=None)
@given(word, st.integers(0, 8), st.sampled_from("abé"), st.sampled_from("rid"))
def test_overlap_bound_holds(a, k, c, kind):
    k = min(k, len(a) - 1)
    b = {"r": a[:k] + c + a[k + 1 :], "i": a[:k] + c + a[k:], "d": a[:k] + a[k + 1 :]}[kind]
    short, long = sorted((a.encode("latin-1"), b.encode("latin-1")), key=len)
    cut = lambda w: [(p[i : i + 3], i) for p in [v.PAD + w + v.PAD] for i in range(len(w) + 2)]
    there = set(cut(short))
    limits = (0, 1) if len(long) > len(short) else (0,)
    assert sum(any((g, i - d) in there for d in limits) for g, i in cut(long)) >= len(long) - 1
    assert v.one_apart(short, long) == apart(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), unique=True).map(sorted), max_size=7), st.integers(1, 5))
def test_merge_by_definition(lists, least):
    n = Counter(k for x in lists for k in x)
    assert v.merged([list(x) for x in lists], least) == sorted(k for k, c in n.items() if c >= least)
