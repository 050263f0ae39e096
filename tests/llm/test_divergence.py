"""Source divergence against plain dictionaries and whole numbers; tries by themselves; edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import divergence as dv


def plain(rows, least=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["a", "b", "A", "é", "ß", "ñ", "中", "𝒳"], k=r.randint(1, 4)))
    vocab = [word() for _ in range(150)]
    rows = [(" ".join(r.choices(vocab, k=r.randint(0, 40))).replace(" ", r.choice([" ", "1", "\x00", "_\n"])), r.choice(["en", "de", None, ""]), r.choice(["x", "y", "z", "é", None, "Z"])) for _ in range(n)]
    return rows + [(None, "en", "x"), (None, "empty", None), ("once only", "few", "q"), ("a", "few", "r"), (" ".join(vocab) * 30, "en", "x")] + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, n_terms int, prefix string")


def test_against_plain_counts(spark):
    rows = made(1, 300)
    assert rows_of(dv.audit(frame(spark, rows).repartition(5))) == plain(rows)


def test_tries_handed_on_early_prefixes_cut_deeper_small_chunks(spark):
    rows = made(2, 150)
    got = dv.audit(frame(spark, rows).repartition(4), least_docs=2, top=5, max_leaves=20, max_meet=8, depth=1, chunk=7)
    assert rows_of(got) == plain(rows, 2, 5)


def test_cut_deeper_loses_nothing_and_bounds_what_meets(spark):
    rows = [(t or "", lang or "", s or "") for t, lang, s in made(3, 100)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    before = dv.counted(docs, 1, 50)
    after = dv.cut_deeper(before, 1, 12)
    leaves = lambda df: Counter((r.lang, t, d, tuple(sorted(c))) for r in df.collect() for t, d, c in dv.unpacked(r))
    assert leaves(before) == leaves(after)
    met = defaultdict(list)
    for r in after.collect():
        met[r.lang, r.prefix].append(r)
        assert all(t.startswith(bytes(r.prefix)) for t, _, _ in dv.unpacked(r))
    assert all(sum(r.n for r in m) <= 12 or max(r.longest for r in m) <= len(p) for (_, p), m in met.items())
    assert max(len(p) for _, p in met) > 1


def test_edges(spark):
    empty = frame(spark, []).limit(0)
    assert dv.audit(empty).count() == 0
    rows = [(None, None, None), ("", None, "x"), (None, "fr", "y")]
    assert rows_of(dv.audit(frame(spark, rows))) == {("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=6), st.integers(0, 3), st.integers(1, 9))))
def test_trie_counts_and_order(items):
    trie, want = dv.Trie(), defaultdict(Counter)
    for term, source, n in items:
        leaf = trie.leaf(term)
        leaf[source] = leaf.get(source, 0) + n
        want[term][source] += n
    got = list(trie.walk())
    assert [t for t, _ in got] == sorted(want) and trie.size == len(want)
    assert all({s: n for s, n in leaf.items() if s >= 0} == want[t] for t, leaf in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**14), st.integers(1, 9 * 10**14))
def test_shares_are_exact(count, total):
    count = min(count, total)
    assert dv.share(np.array([count], np.int64), total)[0] == 1 + 10**9 * count // total
