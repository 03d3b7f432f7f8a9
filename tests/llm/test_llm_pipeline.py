import hashlib
import os
import shutil
import subprocess
import sys

import corpus_pipeline
import duckdb
import llm_cases as cases
import pytest
from llm import line_quality, packing, repeats, simhash, toxicity
from llm.common import fold_of, table
from test_llm_rules_and_models import plain_scan
from test_llm_repeats import plain as plain_repeats
from test_llm_simhash import plain_components, plain_fingerprint
from test_llm_tokens import check_packing


def test_stages_by_hand(spark, sf_dir):
    """Every stage's decision on the given documents, worked out plainly from its own input."""
    docs, kept = table(spark, sf_dir, "documents"), {}
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(function(spark, docs, sf_dir).collect(), function(spark, docs, sf_dir).schema)
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = kept["toxicity"]
    whole = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(whole, table(spark, sf_dir, "labels"), learn=fold_of("doc_id", 4) != 2)
    mild = {r[0] for r in before if toxicity.score_of(plain_scan(toxicity.folded(r[1] or ""), lexicon), lexicon) < toxicity.THRESHOLD}
    assert 0 < len(mild) < len(before)
    assert sorted(map(tuple, after.collect())) == sorted(r for r in before if r[0] in mild)

    before, after = kept["quality rules"]
    judged = {r.doc_id: r for r in line_quality.judged(kept["toxicity"][1]).collect()}
    found = {r.doc_id: r for r in after.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in before])
    assert set(found) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({line_quality.SQL}) WHERE kept").fetchall()}
    texts = {r[0]: r[1] for r in before}
    assert all(found[i].text == texts[i] for i in found if not judged[i].lost_chars)
    assert all(len(found[i].text) < len(texts[i]) and found[i].n_chars == len(found[i].text) for i in found if judged[i].lost_chars)

    before, after = kept["SimHash near-dedup"]
    group = plain_components([plain_fingerprint(r[1]) for r in before])
    least = {}
    for g, r in zip(group, before):
        least[g] = min(least.get(g, r), r)
    assert sorted(map(tuple, after.collect())) == sorted(least.values())

    before, after = kept["substring dedup"]
    want = {r[0]: r for r in plain_repeats(before)}
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert sorted((r.doc_id, *plain_digest(r.text)) for r in rows) == sorted((i, w[1] - w[2], w[3]) for i, w in want.items())

    before, after = kept["packing"]
    check_packing(after.collect(), before)


def plain_digest(text):
    words = text.encode().split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def test_run_is_the_last_stage(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "substring dedup", "packing"]


@pytest.mark.parametrize("make", [cases.awkward, cases.empty])
def test_awkward_tables_pass_every_stage(spark, sf_dir, make, tmp_path):
    docs = cases.with_clashes(make(spark))
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(i)))
        after = spark.read.parquet(path)
        if name != "packing":
            assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema] and after.columns == docs.columns
        docs = after


def test_everything_else_imports_without_this_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(root):
        if name not in ("llm", "corpus_pipeline.py", ".git", "tests"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'kpi_set' in q and set(e.oracle_sql()) <= set(q)"
    # The entry adds its own folder to the path, so it has to be a copy, not a link.
    os.remove(tmp_path / "__spark_entry__.py")
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
