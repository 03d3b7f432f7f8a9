"""Very long texts through every operator on texts: whole results, in bounded time."""

import time

import llm_cases as cases
import pytest
from llm import contamination, katz, language, line_quality, packing, pieces, repeats, simhash, token_counts, toxicity
from llm.queries import BYTE_BPE, PIECES

LONG = ["x" * 1_000_000, "word " * 200_000, "A sentence of its own. " * 40_000, "line\n" * 200_000, "".join(f"{i} " for i in range(150_000)),
        " " * 1_000_000, "中文字" * 100_000]
LEXICON = toxicity.Lexicon({" word ": 3.0}, (), (-2.0, 0.5, 1.0))


def predicted(docs):
    rows = [(i, "some plain words of one tongue " * 5, "en", "s", 0) for i in range(12)]
    return language.predict(docs, language.fit(docs.sparkSession.createDataFrame(rows, cases.SCHEMA)))


@pytest.mark.parametrize("operator", [
    repeats.removal_digest, repeats.remove_repeats, lambda d: pieces.encoding_digest(d, PIECES), lambda d: token_counts.count_tokens(d, BYTE_BPE),
    line_quality.judged, line_quality.clean, predicted, lambda d: toxicity.score(d, LEXICON), katz.score_texts, simhash.near_duplicates,
    lambda d: contamination.contamination(d, d.sparkSession.createDataFrame([(1, "word " * 12), (2, "a sentence of its own")], "item_id int, text string")),
], ids=["repeats", "remove", "pieces", "tokens", "quality", "clean", "language", "toxicity", "katz", "simhash", "contamination"])
def test_long_texts(spark, operator):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(LONG)], cases.SCHEMA).repartition(4)
    begun = time.monotonic()
    rows = operator(docs).collect()
    assert time.monotonic() - begun < 120
    kept = {"clean"} if operator is line_quality.clean else set()
    assert kept or sorted({r["doc_id"] for r in rows}) == list(range(len(LONG)))


def test_long_texts_are_packed(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LONG)], "doc_id bigint, text string")
    rows = packing.pack(docs, BYTE_BPE).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(LONG)))
    for i in range(len(LONG)):
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
