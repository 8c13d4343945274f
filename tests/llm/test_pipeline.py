"""The pipeline stage by stage, on odd and empty tables, and the rest of the library without this subpackage."""

import collections
import re
import os
import shutil
import subprocess
import sys
import zlib
from pathlib import Path

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tidegate.llm import registry

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark, sf, docs, tmp_path_factory):
    """What each stage gets and gives, written and read again."""
    folder, out, at = tmp_path_factory.mktemp("steps"), [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, sf).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, at, after))
        at = after
    return out


def test_stages_keep_the_columns_of_documents(steps, docs):
    assert [name for name, *_ in steps] == ["toxicity", "near_copies", "surrogates", "mixing", "packing"]
    for _, _, after in steps[:-1]:
        assert after.columns == docs.columns


def test_filters_keep_rows_as_they_are(spark, sf, steps):
    for name, before, after in steps[:2]:
        have = collections.Counter(map(tuple, after.collect()))
        assert have <= collections.Counter(map(tuple, before.collect())) and have
    kept = {r["doc_id"] for r in steps[0][2].collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean, toxic = ([i for i, y in labels.items() if y == kind] for kind in (0, 1))
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in toxic) <= 0.5 * len(toxic)


def test_near_copies_equal_all_pairs(steps):
    from test_near import kept_of

    _, before, after = steps[1]
    assert sorted(r["doc_id"] for r in after.collect()) == kept_of([(r["doc_id"], r["text"]) for r in before.collect()])


def test_surrogates_change_only_entities(steps):
    _, before, after = steps[2]
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    assert set(old) == set(new)
    assert all(new[i]["n_chars"] == len(new[i]["text"]) for i in new if new[i]["text"] != old[i]["text"])
    assert not [i for i in new if re.search(r"@mail\d+\.example\.com", new[i]["text"] or "")]


def test_the_mix_takes_copies(steps):
    _, before, after = steps[3]
    taken = collections.Counter(map(tuple, after.collect()))
    held = set(map(tuple, before.collect()))
    assert set(taken) <= held and max(taken.values()) <= 3
    words = collections.Counter()
    for r, n in taken.items():
        words[r[3]] += n * len(r[1].split())
    size = sum(len(r[1].split()) for r in held)
    assert sum(words.values()) == pytest.approx(size, rel=0.05)


def test_packing_holds_every_id(steps):
    _, before, after = steps[4]
    library = Tokenizer.from_file(registry.vocabulary())
    pieces = collections.Counter()
    for r in after.collect():
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for r in before.collect():
        want[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
    assert pieces == want


def test_run_gives_the_last_stage(spark, sf, steps):
    assert corpus_pipeline.run(spark, sf).count() == steps[-1][2].count()


def test_odd_and_empty_tables_pass_every_stage(spark, odd, sf):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), spark.createDataFrame([], DOCS), odd):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, at, sf)
            rows = after.collect()
            if name == "packing":
                assert bool(rows) == bool(at.count())
            else:
                assert after.columns == docs.columns
                at = spark.createDataFrame(rows, docs.schema)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_this_subpackage(tmp_path, pipeline):
    for name in ("tidegate", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 150, done.stderr


def test_nothing_else_imports_this_subpackage():
    for path in (ROOT / "tidegate").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidegate.llm" not in path.read_text(), path
