"""Personal data: base patterns, and a semi-Markov conditional random field for what patterns miss.

The field scores whole candidate segments (how many digits, in which groups, with which separators, does the check
digit hold, ...) and a dynamic program over segments of at most MAX_TOKENS tokens chooses boundaries and kinds jointly.
Spans found by the base patterns are observed: they stay, and the program fills the gaps between them. It separates,
for one, a telephone number from the card number that follows it, which a greedy pattern reads as one.
The weights are fitted by maximum likelihood to examples that a seeded generator spells out (formats of the four kinds
and look-alikes such as dates, versions and order numbers): no corpus text is needed and reruns agree.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import boxed
from strandloom.llm.registry_base import register
from strandloom.session import table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_DIGITS = 28, 19

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Where the field looks: runs of digits with separators, and spelled-out at signs with their surroundings.
NUMBERS = re.compile(r"[+(]{0,2}[0-9][0-9 ().\[\]-]{6,}")
AT = re.compile(r"[\[({] ?at ?[\])}]", re.IGNORECASE)
AROUND = 80
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.DOTALL)
DIGITS = re.compile("[^0-9]")
OBFUSCATED = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?P<at>@| ?[\[({] ?at ?[\])}] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE)
#: What an address has after the at sign.
TAIL = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9-]+)+", re.IGNORECASE)
QUAD = re.compile(r"[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four patterns: leftmost, not overlapping within a kind, failing ones dropped.

    The e-mail pattern is driven by the at signs, as trying it at every letter takes quadratic time on long runs.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = DIGITS.sub("", m[0]) if m.end() - m.start() >= 14 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def features(text: str, start: int, end: int) -> list[str]:
    """What a whole segment looks like, whatever its kind."""
    s = text[start:end]
    groups = re.findall("[0-9]+", s)
    d = "".join(groups)
    seps = re.sub("[A-Za-z0-9+]", "", s)
    prev, after = text[start - 1 : start], text[end : end + 1]
    shape = "-".join(str(min(len(g), 5)) for g in groups[:6])
    out = [f"d{min(len(d), 20)}", f"shape{shape}", "sep" + "".join(sorted(set(seps))), f"plus{s[0] == '+'}", f"parens{s.count('(')}{s.count(')')}"]
    if 14 <= len(d) <= MAX_DIGITS:
        out.append(f"luhn{luhn(d)}{len(groups) == 1 or set(map(len, groups[:-1])) == {4}}")
    if re.search(r"[^0-9A-Za-z+(\[]{2}|[ -]{2}", s.replace(") ", ")")):
        out.append("double")
    if QUAD.fullmatch(s):
        out.append(f"quad{all(int(g) <= 255 for g in groups)}")
    if m := OBFUSCATED.fullmatch(s):
        out.append(f"mail{len(m['at']) > 1}")
    elif re.search("[A-Za-z]", s):
        out.append("letters")
    if prev and (prev.isalnum() or prev in "+.-=_/@\"'"):
        out.append("tied before")
    if after and (after.isalnum() or after in "-=_/@%" or (after == "." and text[end + 1 : end + 2].isalnum())):
        out.append("tied after")
    return out


def segments(text: str, lo: int, hi: int, taken=()) -> tuple[list[int], list[tuple[int, int]]]:
    """Token ends from lo to hi, and the candidate segments as token ranges: those that start and end like an entity.

    ``taken`` (start, end) lists the spans no segment may touch, by start; they are met in one walk over the tokens.
    """
    cuts = [lo + m.start() for m in TOKEN.finditer(text[lo:hi])] + [hi]
    blocked, k, reach = [], 0, 0
    for a, b in zip(cuts, cuts[1:]):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        blocked.append(reach > a)
    found = []
    for i in range(len(cuts) - 1):
        first = text[cuts[i]]
        if not (first.isalnum() or first in "+("):
            continue
        n_digits, marked = 0, False
        for j in range(i + 1, min(i + MAX_TOKENS, len(cuts) - 1) + 1):
            if blocked[j - 1]:
                break
            last = text[cuts[j - 1] : cuts[j]]
            n_digits += len(last) if last[0] in "0123456789" else 0
            if n_digits > MAX_DIGITS:
                break
            marked = marked or last.lower() == "at" or last == "@"
            if last[-1].isalnum() and last.isascii() and (n_digits >= 7 or n_digits >= 4 and text[cuts[i] : cuts[j]].count(".") == 3 or marked and j - i >= 5):
                found.append((i, j))
    return cuts, found


def lattice(cuts: list[int], found: list[tuple[int, int]], scores: np.ndarray, touch: float) -> list[tuple[int, int, int]]:
    """The best segmentation: (start, kind, end). Two states a position: after an entity, or after a plain token."""
    by_end: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(found):
        by_end.setdefault(j, []).append(k)
    n = len(cuts) - 1
    best = [[0.0, -math.inf]] + [[-math.inf, -math.inf] for _ in range(n)]
    back: list[list] = [[None, None] for _ in range(n + 1)]
    for j in range(1, n + 1):
        p = 0 if best[j - 1][0] >= best[j - 1][1] else 1
        best[j][0], back[j][0] = best[j - 1][p], (j - 1, p, None)
        for k in by_end.get(j, ()):
            i = found[k][0]
            kind = int(scores[k].argmax())
            for p in (0, 1):
                v = best[i][p] + scores[k][kind] + touch * p
                if v > best[j][1]:
                    best[j][1], back[j][1] = v, (i, p, kind)
    out, j = [], n
    p = 0 if best[n][0] >= best[n][1] else 1
    while j > 0:
        i, q, kind = back[j][p]
        if kind is not None:
            out.append((cuts[i], kind, cuts[j]))
        j, p = i, q
    return out[::-1]


def examples(n: int = 360, seed: int = 11):
    """Texts with their gold (start, kind, end): formats of the kinds, look-alikes, and runs of several in a row."""
    rng = random.Random(seed)
    dig = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        k = rng.choice([14, 15, 16, 16, 16, 19])
        body = rng.choice("3456") + dig(k - 2)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, k, 4)) if sep else full

    def phone():
        a, b, c = dig(3), dig(3), dig(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{dig(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{dig(2)} ({a}) {b} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"+1 {a}.{b}.{c}"])

    def ip():
        q = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([".", ".", "[.]"]).join(q)

    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))

    def email():
        at, dot = rng.choice([("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" (at) ", " dot ")])
        return word() + rng.choice(["", "." + dig(2), "." + word()]) + at + word() + dot + rng.choice(["com", "org", "example" + dot + "com"])

    def other():
        bad = rng.choice("3456") + dig(14)
        bad = next(bad + c for c in "7391" if not luhn(bad + c))
        return rng.choice([f"20{dig(2)}-0{rng.randint(1, 9)}-{dig(2)}", f"{dig(2)}.0{rng.randint(1, 9)}.20{dig(2)}", f"{dig(1)}.{dig(2)}.{dig(3)}", dig(7), dig(8), dig(9), dig(10), dig(12), bad, f"{dig(4)}-{dig(4)}", f"{dig(3)}-{dig(4)}", f"{dig(3)}.{300 + rng.randrange(600)}.{dig(2)}.{dig(2)}", f"{dig(2)} {dig(2)} {dig(2)} {dig(2)}", f"{dig(4)} {dig(4)}", f"{word()} (at) {word()}", f"{word()} (at) {word()} {word()}.", f"20{dig(2)}-20{dig(2)} {dig(3)}", f"{dig(5)}-{dig(4)}", f"ab{dig(10)}", f"{dig(11)}x", f"{dig(24)}", f"{dig(4)} {dig(6)} {dig(2)}", f"x{card()}", f"-{phone()[1:]}-{dig(5)}"])

    make = {0: email, 1: ip, 2: card, 3: phone}
    for _ in range(n):
        text, gold = word() + " ", []
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            kind = rng.choice([0, 1, 2, 3, 3, 4, 4, 4])
            piece = make.get(kind, other)()
            if kind < 4:
                gold.append((len(text), kind, len(text) + len(piece)))
            text += piece + rng.choice([" ", " ", ", ", " and ", "; "])
        yield text + word(), gold


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)


def likelihood(n: int, found: list[tuple[int, int]], s: np.ndarray, touch: float, gold: list[tuple[int, int]]) -> tuple[float, np.ndarray, float]:
    """Of one text of n tokens: the negative log-likelihood of the gold (segment, kind) pairs, in order, and its
    gradient by the segments' scores and by ``touch``; forward and backward sums over all segmentations."""
    total = np.logaddexp.reduce(s, axis=1).tolist() if len(found) else []
    into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(found):
        into[j].append((i, total[k]))
        out_of[i].append((j, total[k]))
    plain, ent = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
    for j in range(1, n + 1):
        plain[j] = _add(plain[j - 1], ent[j - 1])
        for i, z in into[j]:
            ent[j] = _add(ent[j], z + _add(plain[i], ent[i] + touch))
    b_plain, b_ent = [-math.inf] * n + [0.0], [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        b_plain[i] = b_ent[i] = b_plain[i + 1]
        for j, z in out_of[i]:
            b_plain[i], b_ent[i] = _add(b_plain[i], z + b_ent[j]), _add(b_ent[i], z + touch + b_ent[j])
    whole = _add(plain[n], ent[n])
    grad, g_touch, loss = np.zeros_like(s), 0.0, whole
    for k, (i, j) in enumerate(found):
        grad[k] = math.exp(total[k] + _add(plain[i], ent[i] + touch) + b_ent[j] - whole) * np.exp(s[k] - total[k])
        g_touch += math.exp(total[k] + ent[i] + touch + b_ent[j] - whole) if ent[i] > -math.inf else 0.0
    ends = {found[k][1] for k, _ in gold}
    for k, y in gold:
        grad[k, y] -= 1
        touches = found[k][0] in ends
        g_touch -= touches
        loss -= s[k, y] + touch * touches
    return float(loss), grad, g_touch


@lru_cache(maxsize=1)
def field(steps: int = 60, rate: float = 0.3, l2: float = 2e-4) -> tuple[dict[str, list[float]], float]:
    """(weights by feature, one per kind; weight of two entities touching), by maximum likelihood and Adam."""
    data, names = [], {}
    for text, gold in examples():
        cuts, found = segments(text, 0, len(text))
        index = {(cuts[i], cuts[j]): k for k, (i, j) in enumerate(found)}
        rows = [[names.setdefault(f, len(names)) for f in ["bias", *features(text, cuts[i], cuts[j])]] for i, j in found]
        data.append((len(cuts) - 1, found, rows, [(index[a, b], y) for a, y, b in gold if (a, b) in index]))
    flat = [f for _, _, rows, _ in data for r in rows for f in r]
    seg_of = np.repeat(np.arange(sum(len(rows) for _, _, rows, _ in data)), [len(r) for _, _, rows, _ in data for r in rows])
    flat = np.array(flat)
    n_seg, w = int(seg_of[-1]) + 1, np.zeros((len(names) + 1, len(KINDS)))
    w[names["bias"]] = -3
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        scores = np.stack([np.bincount(seg_of, w[flat, y], n_seg) for y in range(len(KINDS))], axis=1)
        back, g_touch, lo = np.zeros_like(scores), 0.0, 0
        for n, found, rows, gold in data:
            _, back[lo : lo + len(rows)], g = likelihood(n, found, scores[lo : lo + len(rows)], w[-1, 0], gold)
            g_touch += g
            lo += len(rows)
        grad = np.stack([np.bincount(flat, back[seg_of, y], len(w)) for y in range(len(KINDS))], axis=1) / len(data)
        grad[-1, 0] = g_touch / len(data)
        grad += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {f: w[i].tolist() for f, i in names.items()}, float(w[-1, 0])


def looked_at(text: str) -> list[tuple[int, int]]:
    """The regions the field segments, each as a whole: those that overlap are one, and none ends within a candidate.

    Runs of digits are whole as found. The surroundings of at signs take in their addresses and end at a blank.
    """
    regions = [(m.start(), m.end(), False) for m in NUMBERS.finditer(text)]
    if any(x in text for x in ("at", "AT", "At", "aT")):
        for m in AT.finditer(text):
            lo = m.start() - (text[m.start() - 1 : m.start()] == " ")
            while lo > 0 and text[lo - 1] in LOCAL:
                lo -= 1
            tail = TAIL.match(text, m.end())
            regions.append((max(0, min(lo, m.start() - AROUND)), min(len(text), max(tail.end() if tail else 0, m.end() + AROUND)), True))
    regions = joined(regions)
    if any(at for _, _, at in regions):
        ends = [0, *(hi for _, hi, _ in regions)]
        starts = [*(lo for lo, _, _ in regions), len(text)]
        for k, (lo, hi, at) in enumerate(regions):
            while at and lo > ends[k] and not text[lo - 1].isspace():
                lo -= 1
            while at and hi < starts[k + 1] and not text[hi].isspace():
                hi += 1
            # one that reaches the next without a blank joins it
            regions[k] = (max(0, lo - (at and k > 0 and lo == ends[k])), hi + (at and k + 1 < len(regions) and hi == starts[k + 1]), at)
        regions = joined(regions)
    return [(lo, hi) for lo, hi, _ in regions]


def joined(regions: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    """Overlapping regions as one."""
    out: list[tuple[int, int, bool]] = []
    for lo, hi, at in sorted(regions):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]), at or out[-1][2])
        else:
            out.append((lo, hi, at))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], weights: dict[str, list[float]], touch: float) -> list[tuple[int, int, int]]:
    """What the field finds outside the base spans: (start, kind, end)."""
    regions = looked_at(text)
    out: list[tuple[int, int, int]] = []
    if not regions:
        return out
    taken = [(a, b) for a, _, b in base]  # by start
    # the furthest end among the spans up to each: a region's spans begin after the last one that ends before it
    reach = list(accumulate((b for _, b in taken), max))
    for lo, hi in regions:
        if hi - lo < 7:
            continue
        near = taken[bisect_right(reach, lo) : bisect_left(taken, (hi, 0))]
        # a candidate has four digits or an at sign outside the base spans
        at, rest = lo, []
        for a, b in near:
            rest.append(text[at:a] if a > at else "")
            at = max(at, b)
        outside = "".join(rest) + text[at:hi]
        if len(DIGITS.sub("", outside)) < 4 and "@" not in outside and "at" not in outside.lower():
            continue
        cuts, found = segments(text, lo, hi, near)
        if not found:
            continue
        zero = [0.0] * len(KINDS)
        scores = np.array([np.sum([weights.get(f, zero) for f in ["bias", *features(text, cuts[i], cuts[j])]], axis=0) for i, j in found])
        if scores.max() > 0:
            out += lattice(cuts, found, scores, touch)
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every whole text.

    The counts and the digest are of the base spans; ``spans`` has these and the field's. Null texts are empty: no
    spans, digest of the empty string. Rows are independent and nothing is shuffled, so repeated rows, ties and empty
    tables need no rule; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def run(batches):
        weights, touch = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base = base_spans(text or "")
                more = added_spans(text or "", base, weights, touch)
                n = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more), len(more)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "k", batch["k"].to_numpy())
            yield out

    k, kind = boxed(docs, "doc_id")
    out = docs.select(k, "text").mapInPandas(run, f"{kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.select(F.col("k.k0").alias("doc_id"), *out.columns[1:])


@register("op1_pii_semi_crf")
def op1_pii_semi_crf(spark, sf_dir):
    return found(table(spark, sf_dir, "documents"))
