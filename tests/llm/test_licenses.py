"""Hand-made texts around license templates."""

from strandloom.llm import licenses


def test_windows(spark):
    mit = licenses.TEMPLATES["mit"]
    noise = "lorem ipsum dolor sit amet " * 50
    words = mit.split()
    rows = [
        (1, noise + mit.upper() + noise),
        (2, "x\nReleased under the *MIT* License!\ny"),
        (3, " ".join(words[: len(words) * 7 // 10])),
        (4, " ".join(w if i != 40 else "changed" for i, w in enumerate(words))),
        (5, None), (6, ""), (7, "Released under the"), (8, "nothing " * 30_000 + "Licensed under CC BY-NC 4.0."),
        (8, "nothing " * 30_000 + "Licensed under CC BY-NC 4.0."), (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id or 0, r.license, r.n_matched >= licenses.CONTAINMENT * r.n_template, r.n_matched == r.n_template) for r in licenses.scan(docs).collect()))
    assert got == [(0, "mit-notice", True, True), (1, "mit", True, True), (2, "mit-notice", True, True), (4, "mit", True, False), (8, "cc-by-nc-4.0-notice", True, True)]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, {"short": "too few words"}).count() == 0


def test_every_template_is_found_at_every_offset(spark):
    rows = [(k * 100 + o, "pad " * o + t) for k, t in enumerate(licenses.TEMPLATES.values()) for o in range(0, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = list(licenses.TEMPLATES)
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect() if r.n_matched == r.n_template}
    assert got >= {(d, names[d // 100]) for d, _ in rows}
