"""Neighbouring regions are segmented as one: what lies over an end is found whole."""

import time

from strandloom.llm import pii


def test_several_addresses_and_a_number_in_a_row():
    weights, touch = pii.field()
    for pad in range(0, 60, 7):
        mails = [f"{name}{'x' * (pad % 9)} (at) {name}mail.com" for name in ("alice", "bob", "carla", "dieter", "emil", "frida")]
        pieces = ["z" * pad, *mails[:3], "4524132264652876", *mails[3:], "+1 (269) 555-3296"]
        text = ", ".join(pieces)
        found = [text[a:b] for a, _, b in pii.added_spans(text, [], weights, touch)]
        assert found == pieces[1:]


def test_number_over_the_end_of_a_region():
    weights, touch = pii.field()
    for gap in range(50, 90):
        text = "bob (at) example.com " + "word " * (gap // 5) + "w" * (gap % 5 + 1) + " 4524 1322 6465 2876 end"
        found = [text[a:b] for a, _, b in pii.added_spans(text, [], weights, touch)]
        assert found == ["bob (at) example.com", "4524 1322 6465 2876"], gap


def test_regions_are_apart_and_linear():
    assert pii.looked_at("") == pii.looked_at("plain text at home") == []
    text = "x" * 300 + "b(at)c.de" + "y" * 300 + " rest"
    assert pii.looked_at(text) == [(0, 609)]
    began = time.time()
    for text in ("a(at)" * 40_000, "a" * 200_000 + "(at)" + "b." * 100_000, ("a" * 300 + "(at)b.c ") * 1000):
        got = pii.looked_at(text)
        assert all(0 <= a < b <= len(text) for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert time.time() - began < 20


def test_at_in_any_letters():
    for at in ("(at)", "(AT)", "(At)", "(aT)"):
        text = f"write to bob {at} site (dot) org today"
        assert any(f"bob {at} site (dot) org" in text[a:b] for a, b in pii.looked_at(text)), at
