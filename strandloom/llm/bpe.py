"""BPE encoding and decoding with a pair occurrence index.

The text is cut into pretokens; the distinct pretokens of a batch lie side by side in one array of symbols, and an
index maps each adjacent pair to all its positions. Active ranks are taken in ascending order: a rank's pair is merged
at every position where it still stands, and only the lists of the pairs to its left and right change. A pair made by
a merge always ranks after it, so working through the whole batch rank by rank gives each pretoken its own merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import boxed
from strandloom.llm.registry_base import register
from strandloom.session import table

#: How a byte-level vocabulary spells bytes (printable ones as themselves, the rest from U+0100 on).
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: the pretoken pattern of this byte-level family; white space spelled out as Unicode's White_Space.
WS = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

#: Pretokens a task keeps between batches; beyond that it forgets the older half, so memory stays bounded.
CACHE_MAX = 150_000
#: Characters that are encoded together, if several texts have so few.
BLOCK_CHARS = 2_000_000
#: Above all ids: makes one integer of a pair.
KEY = 1 << 24


def byte_spelling() -> dict[int, str]:
    odd = [b for b in range(256) if b not in set(PRINTABLE)]
    return {**{b: chr(b) for b in PRINTABLE}, **{b: chr(0x100 + i) for i, b in enumerate(odd)}}


class PairIndexBPE:
    """A byte-level vocabulary file (JSON with model.vocab, model.merges and added_tokens) ready for whole batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        spelling = byte_spelling()
        of_char = {c: b for b, c in spelling.items()}
        self.byte_ids = np.array([vocab[spelling[b]] for b in range(256)], np.int32)
        pairs: dict[tuple[int, int], int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            pairs.setdefault((vocab[left], vocab[right]), rank)
            self.by_rank.append((vocab[left], vocab[right], vocab[left + right]))
        keyed = sorted((a * KEY + b, r) for (a, b), r in pairs.items())
        self.pair_keys, self.pair_ranks = np.array([k for k, _ in keyed]), np.array([r for _, r in keyed])
        added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        size = max([*vocab.values(), *(i for _, i in added)]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in [*vocab.items(), *added]:
            self.bytes_of[i] = bytes(of_char[c] for c in word) if all(c in of_char for c in word) else word.encode()
        self.added = dict(added)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.pretokens = regex.compile(PATTERN).findall
        self.spelled = list(map(str, range(size)))
        self.known: dict[str, tuple[int, ...]] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where the pair never merges."""
        key = left.astype(np.int64) * KEY + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def learn(self, fresh: list[str]) -> None:
        """Encode distinct pretokens together and remember them."""
        raw = [w.encode("utf-8", "replace") for w in fresh]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths + 1)
        flat = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        symbols = self.byte_ids[flat]
        symbols[ends - 1] = -1  # no pair reaches over the end of a pretoken
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Add positions to the lists of their pairs."""
            real = ranks >= 0
            positions, ranks = positions[real], ranks[real]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts) if len(cuts) else [positions]):
                if r in where:
                    where[r].append(part)
                else:
                    where[r] = [part]
                    heapq.heappush(active, r)

        note(np.arange(n - 1), self.ranks_of(symbols[:-1], symbols[1:]))
        while active:
            rank = heapq.heappop(active)
            lists = where.pop(rank)
            left, right, new = self.by_rank[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[symbols[at] == left]
            to = after[at]
            still = symbols[to] == right
            at, to = at[still], to[still]
            if left == right and len(at) > 1:  # of a run the first two merge, then the next two
                keep, last = [], -1
                for i, j in zip(at.tolist(), to.tolist()):
                    keep.append(i != last)
                    last = j if keep[-1] else -1
                at, to = at[keep], to[keep]
            if not len(at):
                continue
            symbols[at], symbols[to] = new, -2
            beyond = after[to]
            after[at] = beyond
            before[beyond] = at
            note(at, self.ranks_of(symbols[at], symbols[beyond]))
            prior = before[at]
            prior = prior[prior >= 0]
            note(prior, self.ranks_of(symbols[prior], symbols[after[prior]]))
        kept = symbols[symbols >= -1]
        stops = np.flatnonzero(kept == -1).tolist()
        ids, start = kept.tolist(), 0
        for word, stop in zip(fresh, stops):
            self.known[word] = tuple(ids[start:stop])
            start = stop + 1

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = []
        for text in texts:
            parts = self.cut_added.split(text) if self.cut_added else [text]
            cut.append([p if k % 2 else self.pretokens(p) for k, p in enumerate(parts)])
        if len(self.known) > CACHE_MAX:
            self.known = dict(islice(self.known.items(), CACHE_MAX // 2, None))
        fresh = {w for parts in cut for p in parts if isinstance(p, list) for w in p} - self.known.keys()
        if fresh:
            self.learn(list(fresh))
        out, known = [], self.known
        for parts in cut:
            ids: list[int] = []
            for p in parts:
                if isinstance(p, list):
                    for w in p:
                        ids.extend(known[w])
                else:
                    ids.append(self.added[p])
            out.append(ids)
        return out

    def listed(self, ids) -> str:
        """The decimal ids, joined by commas."""
        return ",".join(map(self.spelled.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of the ids' bytes, U+FFFD where they are not UTF-8; special tokens stay."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBPE] = {}


def tokenizer(path: str) -> PairIndexBPE:
    """One instance a worker process: the vocabulary is read once, learnt pretokens stay for a task."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")



def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Encode whole texts and decode them again: the ``keep`` columns (doc_id if not given), n_tokens, ids
    (array<int>, unless ``with_ids`` is false), ids_sha256 and decoded_sha256.

    A null text is empty: no ids, digests of the empty string. Rows are independent, so repeated rows and ties need
    no rule; very long texts stay whole. Nothing is shuffled. ``path`` names the vocabulary file on the executors
    (by default the installed package's own). Texts are sent to tasks in Arrow batches.
    """
    keep = keep or ["doc_id"]
    k, kind = boxed(docs, *keep)
    schema = ", ".join([kind, "n_tokens long", *(["ids array<int>"] if with_ids else []), "ids_sha256 string", "decoded_sha256 string"])
    rows = docs.select(k, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        bpe = tokenizer(path or default_vocabulary())
        for batch in batches:
            block = (batch["text"].str.len().cumsum() // BLOCK_CHARS).to_numpy()
            for _, part in batch.groupby(block, sort=False):
                all_ids = bpe.encode_batch(part["text"].tolist())
                out = pd.DataFrame({"k": part["k"].values})
                out["n_tokens"] = [len(x) for x in all_ids]
                if with_ids:
                    out["ids"] = all_ids
                out["ids_sha256"] = [hashlib.sha256(bpe.listed(x).encode()).hexdigest() for x in all_ids]
                out["decoded_sha256"] = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in all_ids]
                yield out
        bpe.known.clear()  # an idle worker keeps the vocabulary only

    out = rows.mapInPandas(run, schema)
    return out.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(keep)], *out.columns[1:])


@register("op10_bpe_round_trip")
def op10_bpe_round_trip(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
