"""Which sources of a language write unlike each other, by exact smoothed term shares counted in mergeable byte tries.

A task counts the terms of its documents in a trie a language: it branches by bytes of UTF-8, what few terms share is not
split, and a leaf holds how many documents have the term and a counter for each source. Tries are cut at a prefix and their parts meet by range of
prefixes, where they are merged leaf by leaf; a prefix with too many leaves is cut deeper first, so no part grows with
the corpus. Traversing a merged trie gives terms in UTF-8 order, which is the order of ties: the kept ones stream by in
chunks, each adds to the sums of all pairs of sources, and each source keeps its best 200 so far.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.registry_base import register
from strandloom.session import table, written

#: A term is kept in a language if so many of its documents have it; a source reports so many terms.
LEAST_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
#: Leaves a task's tries may have before it hands them on; bytes at which tries are first cut; leaves that may meet
#: under one prefix before it is cut deeper; kept terms in a chunk.
MAX_LEAVES, DEPTH, MAX_MEET, CHUNK = 250_000, 4, 500_000, 2_048
#: Groups of language and source that are broadcast; more are joined by shuffle.
MAX_GROUPS = 100_000
#: Terms in UTF-8: ASCII letters and all bytes beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+").findall

PART = "lang string, prefix binary, n long, longest long, sources array<string>, terms binary, docs binary, sizes binary, source binary, counts binary"
KEPT = "lang string, n_terms long, totals array<struct<source: string, n: long>>, sources array<string>, terms binary, sizes binary, source binary, counts binary"


class Node:
    """An inner node: the leaf of the term that ends here, if any, and what is below by the next byte."""

    __slots__ = ("below", "end")

    def __init__(self) -> None:
        self.below: dict[int, Node | dict] = {}
        self.end: dict[int, int] | None = None


class Trie:
    """A byte trie whose last stretch is a container: a plain dict from the rest of a term to its leaf, which becomes a
    node with a container for each byte once it has over BURST terms. A leaf has the counters of sources by number, and
    the number of documents under -1."""

    BURST = 1024

    def __init__(self) -> None:
        self.root: Node | dict = {}
        self.size = 0

    def leaf(self, term: bytes) -> dict[int, int]:
        """The counters of a term, new if it has none."""
        node, above, at = self.root, None, 0
        while type(node) is Node:
            if at == len(term):
                if node.end is None:
                    node.end = {-1: 0}
                    self.size += 1
                return node.end
            above, node = node, node.below.get(term[at])
            if node is None:
                node = above.below[term[at]] = {}
            at += 1
        rest = term[at:]
        leaf = node.get(rest)
        if leaf is None:
            leaf = node[rest] = {-1: 0}
            self.size += 1
            if len(node) > self.BURST:
                burst = Node()
                for k, x in node.items():
                    if k:
                        burst.below.setdefault(k[0], {})[k[1:]] = x
                    else:
                        burst.end = x
                if above is None:
                    self.root = burst
                else:
                    above.below[term[at - 1]] = burst
        return leaf

    def walk(self) -> Iterator[tuple[bytes, dict[int, int]]]:
        """Terms with their counters in byte order; code points have the same order."""
        stack: list = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            if type(node) is Node:
                if node.end is not None:
                    yield above, node.end
                stack += [(above + bytes((k,)), node.below[k]) for k in sorted(node.below, reverse=True)]
            else:
                for rest in sorted(node):
                    yield above + rest, node[rest]


def packed(leaves: list[tuple[bytes, dict[int, int]]], names: list[str]) -> dict:
    """Leaves as flat arrays, with the sources that they name; a term has no zero byte, so one can part them."""
    place: dict[int, int] = {}
    source, counts = [], []
    for _, leaf in leaves:
        for s, n in leaf.items():
            if s >= 0:
                source.append(place.setdefault(s, len(place)))
                counts.append(n)
    return {
        "sources": [names[s] for s in place], "terms": b"\0".join([t for t, _ in leaves]), "docs": array("q", [leaf[-1] for _, leaf in leaves]).tobytes(), "sizes": array("i", [len(leaf) - 1 for _, leaf in leaves]).tobytes(),
        "source": array("i", source).tobytes(), "counts": array("q", counts).tobytes(),
    }


def unpacked(row, own: list | None = None) -> Iterator[tuple[bytes, int, list[tuple]]]:
    """(term, documents, [(source, count)]) of each leaf of a part, in byte order; sources as ``own`` has them."""
    names, at = list(row.sources) if own is None else own, 0
    pairs = list(zip([names[s] for s in memoryview(row.source).cast("i")], memoryview(row.counts).cast("q")))
    for term, docs, size in zip(row.terms.split(b"\0"), memoryview(row.docs).cast("q"), memoryview(row.sizes).cast("i")):
        yield term, docs, pairs[at : at + size]
        at += size


class Numbers(dict):
    """Numbers of the sources as they come, and their names in that order."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def __missing__(self, name: str) -> int:
        self[name] = len(self.names)
        self.names.append(name)
        return self[name]


def cut(lang: str, leaves: Iterator[tuple[bytes, dict[int, int]]], names: list[str], depth: int) -> Iterator[dict]:
    """The parts of a trie, one for each beginning of ``depth`` bytes."""
    for prefix, some in groupby(leaves, lambda x: x[0][:depth]):
        part = list(some)
        yield {"lang": lang, "prefix": prefix, "n": len(part), "longest": max([len(t) for t, _ in part]), **packed(part, names)}


def frames(rows: Iterator[dict], schema: str, size: int = 4_096) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in re.sub(r"<.*?>+", "", schema).split(", ")]
    some: list[dict] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pd.DataFrame(some, columns=columns)
            some = []
    if some:
        yield pd.DataFrame(some, columns=columns)


def counted(docs: DataFrame, depth: int = DEPTH, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """Parts of the tries that tasks count their documents in. Each row of ``docs`` is a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[str, Trie] = defaultdict(Trie)
        known: dict[str, dict[bytes, dict[int, int]]] = defaultdict(dict)  # leaves by term, to walk to each once
        numbers = Numbers()

        def handed_on() -> Iterator[dict]:
            for lang, trie in tries.items():
                yield from cut(lang, trie.walk(), numbers.names, depth)
            tries.clear()
            known.clear()

        for batch in batches:
            for (lang, source), some in batch.groupby(["lang", "source"], sort=False)["text"]:
                total, again, number = Counter(), {}, numbers[source]  # all occurrences; those after a document's first

                def settle() -> None:
                    leaves, find = known[lang], tries[lang].leaf
                    for term, n in total.items():
                        leaf = leaves.get(term)
                        if leaf is None:
                            leaf = leaves[term] = find(term)
                        leaf[number] = leaf.get(number, 0) + n
                        leaf[-1] += n - again.get(term, 0)
                    total.clear()
                    again.clear()

                for text in some:
                    terms = TERM(text.encode().lower())  # of bytes, lower() changes A-Z only
                    total.update(terms)
                    for term, n in Counter(terms).items():
                        if n > 1:
                            again[term] = again.get(term, 0) + n - 1
                    if len(total) > max_leaves:
                        settle()
                        yield from frames(handed_on(), PART)
                settle()
                if sum(t.size for t in tries.values()) > max_leaves:
                    yield from frames(handed_on(), PART)
        yield from frames(handed_on(), PART)

    return docs.mapInPandas(run, PART)


def cut_deeper(parts: DataFrame, depth: int, max_meet: int = MAX_MEET) -> DataFrame:
    """Parts of prefixes where over ``max_meet`` leaves meet, cut at twice the depth, again and again; a prefix that is a
    whole term needs no cut, as all its leaves become one. Prefixes stay apart: no part has leaves of another's."""
    while True:
        large = parts.groupBy("lang", "prefix").agg(F.sum("n").alias("all"), F.max("longest").alias("longest"), F.max(F.length("prefix")).alias("own"))
        large = written(large.where((F.col("all") > max_meet) & (F.col("longest") > F.col("own")) & (F.col("own") == depth)).select("lang", "prefix"), "large-prefixes")
        if large.isEmpty():
            return parts
        deeper = 2 * depth

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    numbers = Numbers()
                    leaves = ((t, {-1: d, **dict(c)}) for t, d, c in unpacked(row, [numbers[s] for s in row.sources]))
                    yield from frames(cut(row.lang, leaves, numbers.names, deeper), PART)

        again = parts.join(large, ["lang", "prefix"], "left_semi").mapInPandas(run, PART)
        parts = written(parts.join(large, ["lang", "prefix"], "left_anti").unionByName(again), "trie-parts")
        depth = deeper


def merged(parts: DataFrame, least_docs: int = LEAST_DOCS, chunk: int = CHUNK) -> DataFrame:
    """Kept terms in chunks, from parts that meet by range of prefixes. A task holds the trie of one prefix at a time,
    into which it reads one part after the other, and a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunks() -> Iterator[dict]:
            at, trie, numbers, kept = None, Trie(), Numbers(), []

            def traverse() -> None:
                kept.extend((at[1] + t, leaf) for t, leaf in trie.walk() if leaf[-1] >= least_docs)

            def handed_on() -> dict:
                totals = Counter()
                for _, leaf in kept:
                    totals.update(leaf)
                totals.pop(-1)
                row = packed(kept, numbers.names)
                return {"lang": at[0], "n_terms": len(kept), "totals": [{"source": numbers.names[s], "n": n} for s, n in totals.items()]} | row

            for batch in batches:
                for row in batch.itertuples():
                    if at is not None and at != (row.lang, row.prefix):
                        traverse()
                        trie = Trie()
                        if len(kept) >= chunk or kept and at[0] != row.lang:
                            yield handed_on()
                            numbers, kept = Numbers(), []
                    at = (row.lang, row.prefix)
                    own, depth = [numbers[s] for s in row.sources], len(row.prefix)
                    for term, docs, counts in unpacked(row, own):
                        leaf = trie.leaf(term[depth:])
                        leaf[-1] += docs
                        for source, n in counts:
                            leaf[source] = leaf.get(source, 0) + n
            if at is not None:
                traverse()
                if kept:
                    yield handed_on()

        yield from frames(chunks(), KEPT, 16)

    return parts.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInPandas(run, KEPT)


def share(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * counts / total) in whole numbers, three digits at a time, so totals up to 9e15 are exact."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def streamed(chunks: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value) from chunks with what is known of their language: V, and N of each source. A
    task sums the pairs of what it reads and keeps the best ``top`` terms of each source, smaller terms before."""
    schema = "lang string, source string, part string, item string, value long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        named: dict[str, list[str]] = {}
        best: dict[tuple[str, str], list] = defaultdict(list)
        for batch in batches:
            for row in batch.itertuples():
                names = named.setdefault(row.lang, list(row.every))
                place = {s: i for i, s in enumerate(names)}
                own = np.array([place[s] for s in row.sources], np.int64)
                count = np.zeros((row.n_terms, len(names)), np.int64)
                at = np.repeat(np.arange(row.n_terms), np.frombuffer(row.sizes, np.int32))
                count[at, own[np.frombuffer(row.source, np.int32)]] = np.frombuffer(row.counts, np.int64)
                each = np.asarray(row.each, np.int64)
                p, q = share(count + 1, each + row.v), share(count.sum(1) + 1, int(each.sum()) + row.v)[:, None]
                total = sums.setdefault(row.lang, np.zeros((len(names), len(names)), np.int64))
                for g in range(len(names)):
                    total[g] += ((p[:, [g]] - p) ** 2 // p).sum(0)
                terms = row.terms.split(b"\0")
                value = np.where((count > 0) & (p > q), (p - q) ** 2 // q, -1)
                for g in range(len(names)):
                    found = np.flatnonzero(value[:, g] >= 0)
                    if len(found):
                        found = found[np.argsort(-value[found, g], kind="stable")[:top]]
                        heap = best[row.lang, names[g]]
                        heap += [(-int(value[i, g]), terms[i]) for i in found]
                        if len(heap) > 8 * top:
                            heap[:] = heapq.nsmallest(top, heap)
        for lang, names in named.items():
            rows = [(lang, a, "pair", b, int(sums[lang][i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
            rows += [(lang, a, "term", t.decode(), -v) for a in names for v, t in heapq.nsmallest(top, best[lang, a])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return chunks.mapInPandas(run, schema)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, max_leaves: int = MAX_LEAVES, max_meet: int = MAX_MEET, depth: int = DEPTH, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, part ``pair``,
    and the terms that it uses more than its language, part ``term``.

    Null texts, languages and sources are read as ''. Every row counts as a document, repeats too, whatever its id, and
    other columns are not read. A group without terms has its pairs; a language without kept terms has pairs of value 0
    and no terms; ties rank by item in UTF-8 order. An empty table gives an empty result.
    """
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = cut_deeper(written(counted(read, depth, max_leaves), "trie-parts"), depth, max_meet)
    kept = written(merged(parts, least_docs, chunk), "kept-terms")
    totals = kept.select("lang", F.explode("totals").alias("t")).groupBy("lang", "t.source").agg(F.sum("t.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    groups = written(read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "groups")
    facts = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g")).join(sizes, "lang").select("lang", F.col("g.source").alias("every"), F.col("g.n").alias("each"), "v")
    if groups.count() <= MAX_GROUPS:
        facts = F.broadcast(facts)
    found = written(streamed(kept.drop("totals").join(facts, "lang"), top), "found")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS s FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, k.t, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.s + v.v) AS p FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
l AS (SELECT lang, sum(s) AS s FROM s GROUP BY lang),
q AS (SELECT p.lang, p.t, 1 + ({SCALE}::HUGEINT * (sum(p.n) + 1)) // (any_value(l.s) + any_value(v.v)) AS q FROM p JOIN l USING (lang) JOIN v USING (lang) GROUP BY p.lang, p.t),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, t) WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.t, (p.p - q.q) * (p.p - q.q) // q.q FROM p JOIN q USING (lang, t) WHERE p.n > 0 AND p.p > q.q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= {TOP}"""


@register("op12_source_divergence", SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
