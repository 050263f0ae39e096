"""Base spans against plain regular expressions; the field on held-out examples; edge cases."""

import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import pii


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.1259+-() _é%Z0", max_size=60))
def test_base_equals_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_on_joined_pieces():
    random.seed(2)
    pieces = ["a.b+c@d-e.f.g", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (499) 555-6503", "+4", ".", "@", "x", " ", "0001.2.3.255", "5500-0000-0000-0004", "\n", "é"]
    for _ in range(3000):
        text = "".join(random.choices(pieces, k=random.randint(1, 8)))
        assert pii.base_spans(text) == plain(text)


def test_field_on_unseen_examples():
    weights, touch = pii.field()
    right = total = 0
    for text, gold in pii.examples(400, seed=77):
        got = pii.added_spans(text, [], weights, touch)
        right += got == gold
        total += 1
    assert right / total > 0.9


def test_field_separates_what_patterns_join_and_leaves_prose_alone():
    weights, touch = pii.field()
    text = "call +1 (269) 555-3296 4524132264652876 or x"
    assert pii.base_spans(text) == []
    assert [(k, text[a:b]) for a, k, b in pii.added_spans(text, [], weights, touch)] == [(3, "+1 (269) 555-3296"), (2, "4524132264652876")]
    for clean in ("Licensed under CC BY-NC 4.0.", "on 2024-01-15 at 10:30", "version 1.2.3, page 12 of 300", "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"", ""):
        assert pii.added_spans(clean, pii.base_spans(clean), weights, touch) == []


def every_segmentation(n, found, at=0, last=None):
    """All lists of (segment, kind) that do not overlap, from token ``at`` on."""
    yield []
    for k, (i, j) in enumerate(found):
        if i >= at:
            for kind in range(len(pii.KINDS)):
                for rest in every_segmentation(n, found, j):
                    yield [(k, kind), *rest]


def worth(chosen, found, scores, touch):
    ends = {found[k][1] for k, _ in chosen}
    return sum(scores[k, y] for k, y in chosen) + touch * sum(found[k][0] in ends for k, _ in chosen)


def test_lattice_and_likelihood_against_all_segmentations():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 7))
        found = sorted({(int(i), int(rng.integers(i + 1, n + 1))) for i in rng.integers(0, n, 4)})
        scores, touch = rng.normal(0, 1.5, (len(found), len(pii.KINDS))), float(rng.normal())
        ways = list(every_segmentation(n, found))
        values = np.array([worth(w, found, scores, touch) for w in ways])
        best = ways[int(values.argmax())]
        assert pii.lattice(list(range(n + 1)), found, scores, touch) == [(found[k][0], y, found[k][1]) for k, y in best]
        gold = ways[int(rng.integers(len(ways)))]
        loss, grad, g_touch = pii.likelihood(n, found, scores, touch, gold)
        assert abs(loss - (np.logaddexp.reduce(values) - worth(gold, found, scores, touch))) < 1e-9
        for k in range(len(found)):
            for y in range(len(pii.KINDS)):
                step = np.zeros_like(scores)
                step[k, y] = 1e-5
                slope = (pii.likelihood(n, found, scores + step, touch, gold)[0] - pii.likelihood(n, found, scores - step, touch, gold)[0]) / 2e-5
                assert abs(slope - grad[k, y]) < 1e-6
        slope = (pii.likelihood(n, found, scores, touch + 1e-5, gold)[0] - pii.likelihood(n, found, scores, touch - 1e-5, gold)[0]) / 2e-5
        assert abs(slope - g_touch) < 1e-6


def test_field_on_texts_written_by_hand():
    """Forms that the generator of examples does not spell: sentences around, other separators, several a line."""
    weights, touch = pii.field()
    cases = [
        ("Write to maria.lopez [at] uni-graz [dot] at before Monday.", [(0, "maria.lopez [at] uni-graz [dot] at")]),
        ("Contact: jdoe (at) mail (dot) example (dot) net; office closed in July", [(0, "jdoe (at) mail (dot) example (dot) net")]),
        ("Our front desk, (020) 555-0142, is open from 9 to 17.", [(3, "(020) 555-0142")]),
        ("fax 415-555-0199 or mobile 415-555-0134", [(3, "415-555-0199"), (3, "415-555-0134")]),
        ("the server at 192[.]168[.]10[.]7 refused", [(1, "192[.]168[.]10[.]7")]),
        ("In 1987 there were 120 pupils, in 2004 only 85.", []),
        ("ISBN 0-306-40615-2, pages 112-119, 24 Nov 2011", []),
        ("We meet at noon (at least I hope so) on 12/05/2021.", []),
        ("Order 20210512-0042 shipped, weight 12.5 kg, total 1,299.00", []),
        ("He finished in 2:04:11.5, 14 seconds ahead.", []),
    ]
    right = 0
    for text, want in cases:
        base = pii.base_spans(text)
        right += sorted((k, text[a:b]) for a, k, b in base + pii.added_spans(text, base, weights, touch)) == sorted(want)
    assert right >= 9, right


def test_time_is_linear_in_the_base_spans():
    weights, touch = pii.field()

    def seconds(n):
        text = "\n".join(f"10.{i % 256}.1.{i % 200} - GET /x{i} 200 {i * 37 % 10000}" for i in range(n)) + "\n" + " ".join(f"10.0.{i % 256}.1 {i * 9991}" for i in range(n))
        begin = time.perf_counter()
        base = pii.base_spans(text)
        pii.added_spans(text, base, weights, touch)
        assert len(base) == 2 * n
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(12_000) < 8 * 2.5 * seconds(1_500)


def test_operator_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "é a@b.c 1.2.3.4", 9), (3, "é a@b.c 1.2.3.4", 9), (None, "9" * 200_000 + "a" * 200_000 + "@", 9), (5, "+1" + "(" * 100_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    out = {r.doc_id: r for r in pii.found(docs).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert pii.found(docs).count() == 6 and pii.found(docs.limit(0)).count() == 0
    assert all(out[i].base_sha256 == none and out[i].spans == "" for i in (1, 2, None, 5))
    assert out[3].spans == "email:2:7,ip:8:15" and (out[3].n_email, out[3].n_ip, out[3].n_card, out[3].n_phone) == (1, 1, 0, 0)
    assert out[3].base_sha256 == hashlib.sha256(b"email:2:7,ip:8:15").hexdigest()
