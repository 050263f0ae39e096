"""Each stage of the pipeline on its own input, against plain versions."""

import hashlib
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

from strandloom.llm import bpe, mixing, toxicity  # noqa: E402
from strandloom.session import table, written  # noqa: E402
from tests.llm.plain import dedup_lines  # noqa: E402
from tests.llm.test_simhash import plain_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    cols, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "bpe"]

    clean = written(stages["toxicity"](spark, docs, SF), "t")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    assert clean.columns == cols and {r.doc_id: r for r in clean.collect()} == {d: r for d, r in before.items() if model.score(r.text)[0] < toxicity.CUTOFF}

    lines = written(stages["line_dedup"](spark, clean, SF), "l")
    want = dedup_lines([(r.doc_id, r.text) for r in clean.collect()])
    assert lines.columns == cols and {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {d: (t, len(t)) for d, (t, _, _) in want.items()}

    single = written(stages["simhash_near_dedup"](spark, lines, SF), "s")
    assert single.columns == cols
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in plain_groups([(r.doc_id, r.text) for r in lines.collect()])})

    mixed = written(stages["mix_sources"](spark, single, SF), "m")
    times = {r.doc_id: r.times for r in mixing.mix_sizes(single).collect()}
    assert mixed.columns == cols and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in times.items() if n})

    lib = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    text = {r.doc_id: r.text for r in single.collect()}
    for r in stages["bpe"](spark, mixed, SF).collect():
        assert list(r.ids) == lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_same_rows_again(spark):
    a, b = (Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and sum(a.values()) > 0


def odd_rows(spark):
    long = "word by word it goes on " * 20_000
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (None, "a text without any id that is here", "en", "a", 34), (2, long, "de", None, len(long)), (2, "two texts share this very id", "de", "b", 28), (3, "the same row is there twice", "en", "b", 27), (3, "the same row is there twice", "en", "b", 27), (None, None, None, None, None)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, `a.b` int, _id int, score double, n_lines_ int, n_dropped_ string"
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 0.5, 4, "n") for r in rows], extra)


def test_odd_rows_in_every_stage(spark):
    docs, stages = odd_rows(spark), dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every, alone = seen(docs), sorted(set(seen(docs)), key=str)
    for name in ("toxicity", "line_dedup", "simhash_near_dedup", "mix_sources"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where("key = 'k' AND row = 1 AND `a.b` = 2 AND _id = 3 AND score = 0.5").count() == out.count()
        if name in ("toxicity", "line_dedup"):  # clean, and no line recurs across documents
            assert seen(out) == every, name
        elif name == "simhash_near_dedup":  # null and blank are one group, whose first has an id
            assert seen(out) == [r for r in alone if r not in ((None, ""), (None, None))]
        else:
            assert set(seen(out)) <= set(every) and max(Counter(seen(out)).values()) <= 6
    out = stages["bpe"](spark, docs, SF).collect()
    assert len(out) == len(every) and [len(r.ids) for r in out if r.doc_id == 1] == [0]
