"""The driver's contract: queries, oracles, and that the training-data operators can be absent."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "orf_pairs" in entry.oracle_sql()


def test_works_without_the_llm_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0, said.stderr
    n, extra = said.stdout.split(" ", 1)
    assert int(n) >= 40 and extra.strip() == "[]"


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "frame", "start", "stop", "len"]


def test_a_broken_operator_shows(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (copy / "strandloom" / "llm").mkdir()
    (copy / "strandloom" / "llm" / "__init__.py").write_text("")
    (copy / "strandloom" / "llm" / "registry.py").write_text("from strandloom.llm import a_module_that_is_gone\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode != 0


def test_scratch_tables_go(spark):
    import glob

    from strandloom.session import discard, shared_folder, written

    kept, gone = (written(spark.range(10), n) for n in ("kept", "gone"))
    folder = shared_folder(spark).removeprefix("file:")
    discard(gone, spark.range(3))
    assert glob.glob(f"{folder}/kept-*") and not glob.glob(f"{folder}/gone-*") and kept.count() == 10


def test_a_stage_is_swept(spark):
    import glob

    from strandloom.session import Pile, mark, shared_folder, sweep, written

    before = written(spark.range(4), "before")
    since = mark()
    out, _, pile = written(spark.range(5), "result"), written(spark.range(6), "aside"), Pile(spark, "rounds")
    assert [pile.add(spark.range(n)).count() for n in (2, 3)] == [2, 3] and pile.read(spark.range(1).schema).count() == 5
    sweep(spark, since, out)
    folder = shared_folder(spark).removeprefix("file:")
    assert before.count() == 4 and out.count() == 5 and not glob.glob(f"{folder}/aside-*") and not glob.glob(f"{folder}/rounds-*")
