import random
import time
import zlib

import llm_cases as cases
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import bpe, packing, pieces, token_counts
from llm.queries import BYTE_BPE, PIECES
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(BYTE_BPE)
COUNTER = token_counts.PrefixCounter(bpe.load(BYTE_BPE), kept=500)
PARTS = ["'", "s", "re", " ", "  ", "\n", "\t", "a", "the", "é", "1", "!", "<|endoftext|>", "<|", "|>", "　", "日本", "🙂", "'ll", "can", "not",
         "ing", "՘", "ᲈ", "\x85", "=" * 40, "aaaa", " the"]
texts = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


# ---- operator 3 ---------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(texts)
def test_count_at_every_prefix(text):
    table = token_counts.PrefixTable(COUNTER, text)
    want = [len(library_ids(text[:i])) for i in range(len(text) + 1)]
    assert [table.count(i) for i in range(len(text) + 1)] == want
    for budget in (0, 1, 2, 5, 100):
        longest = max(i for i, n in enumerate(want) if n <= budget)
        assert table.characters_within(budget) == longest
        assert COUNTER.count_and_cut(text, budget) == (want[-1], longest)
        assert table.fits(budget) == (want[-1] <= budget)


@pytest.mark.parametrize("unit", ["a", " ", "\n", "中", "ab1", "'", "=", "\x1c", "é", "\u2003 "])
def test_long_texts_are_cut_in_time(unit):
    """200 000 characters without a boundary: a few seconds at most, as the library counts at prefixes here and there."""
    text = f"start {unit * (200_000 // len(unit))} end"
    COUNTER.count("x" * 500)  # the automaton is made once for a worker
    begun = time.process_time()
    n, fits = COUNTER.count_and_cut(text, 512)
    table = token_counts.PrefixTable(COUNTER, text)
    within = {budget: table.characters_within(budget) for budget in (0, 1, 2, 511, 512, n // 2, n - 1)}
    assert time.process_time() - begun < 15
    assert (n, fits) == (len(library_ids(text)), within[512])
    for budget, i in within.items():
        assert len(library_ids(text[:i])) <= budget
        for j in (i + 1, i + 2, i + 17):
            assert len(library_ids(text[:j])) > budget
    for i in random.Random(1).sample(range(len(text)), 4):
        assert table.count(i) == len(library_ids(text[:i]))


def test_learning_in_any_order_gives_the_same_counts():
    words = [cases.prose(i, 40) for i in range(5)]
    one, two = (token_counts.PrefixCounter(bpe.load(BYTE_BPE)) for _ in range(2))
    split = [p for w in words for p in one.pretokens(w)]
    one.learn(split)
    for p in random.Random(1).sample(split, len(split)):
        assert two.counts(p) == one.counts(p)


def test_awkward_rows_are_counted(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    found = token_counts.count_tokens(docs, BYTE_BPE, budget=100)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(library_ids(r[1] or "")), n > 100) for r in cases.awkward_rows()), key=repr)
    assert cases.table_of(found.drop("budget_chars")) == want
    assert token_counts.count_tokens(cases.empty(spark), BYTE_BPE).count() == 0


def test_settled_characters_split_alike():
    pre = bpe.load(BYTE_BPE).library.pre_tokenizer
    shown = bpe.load(BYTE_BPE).characters
    for c in random.Random(0).sample(sorted(bpe.settled_characters()), 3000):
        if not 0xD800 <= ord(c) < 0xE000:
            text = f"a{c} {c}{c}1"
            assert [p for p, _ in pre.pre_tokenize_str(text)] == ["".join(shown[b] for b in p.encode()) for p in bpe.pattern().findall(text)]


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


# ---- operator 8 ---------------------------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(texts)
def test_fast_ids_are_the_librarys(text):
    assert packing.encode(bpe.load(BYTE_BPE), text, None).tolist() == library_ids(text)


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "\t " * 1_000_000])
def test_long_white_space_is_encoded(run):
    for text in (run, f"a {run}b"):
        assert packing.encode(bpe.load(BYTE_BPE), text, None).tolist() == library_ids(text)


def test_long_white_space_is_packed(spark):
    rows = [(1, "some words", "en", "s", 0), (2, f"a {' ' * 2_000_000}b", "en", "s", 0), (3, "more words", "en", "s", 0)]
    check_packing(packing.pack(spark.createDataFrame(rows, cases.SCHEMA).repartition(1), BYTE_BPE).collect(), rows)


def check_packing(rows, documents, capacity=packing.CAPACITY):
    """Every id in one piece, checksums right, sequences gapless, full or a power of two."""
    ids = [np.array([*library_ids(t or ""), packing.END_ID], "<u4") for _, t, *_ in documents]
    pieces_left = sorted((r.doc_id is None, r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    by_key = {}
    for p in pieces_left:
        by_key.setdefault(p[:3], []).append(p[3:])
    for (doc_id, *_), own in zip(documents, ids):
        cut = by_key[doc_id is None, doc_id, len(own)]
        at = 0
        while at < len(own):
            found = next(p for p in cut if p[0] == at and p[2] == zlib.crc32(own[at:at + p[1]].tobytes()))
            cut.remove(found)
            at += found[1]
    assert not any(by_key.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at.bit_count() == 1


@pytest.mark.parametrize("parts,open_windows", [(1, 1), (3, 2), (7, 16)])
def test_awkward_rows_are_packed(spark, parts, open_windows):
    docs = cases.with_clashes(cases.awkward(spark, parts))
    check_packing(packing.pack(docs, BYTE_BPE, open_windows=open_windows).collect(), cases.awkward_rows())


def test_leftovers_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rows = [(i, cases.prose(i, 10 + i * 3), "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(20)
    found = packing.pack(docs, BYTE_BPE, open_windows=3).collect()
    check_packing(found, rows)
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= total // packing.CAPACITY + 11


def test_nothing_to_pack(spark):
    assert packing.pack(cases.empty(spark), BYTE_BPE).count() == 0


def test_rests_go_where_they_fit_best():
    packer = packing.Packer(0, capacity=10, open_windows=2)
    for name, n in (("a", 6), ("b", 7), ("c", 3), ("d", 9)):
        packer.add(name, 0, np.arange(n, dtype="<u4"), n)
    # c fills b's window; d opens one; the next fits neither, so the fullest (d's) is topped up.
    packer.add("e", 0, np.arange(5, dtype="<u4"), 5)
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in packer.rows] == [
        ("b", 0, 7, 0, 0), ("c", 0, 3, 0, 7), ("d", 0, 9, 1, 0), ("e", 0, 1, 1, 9), ("a", 0, 6, 2, 0), ("e", 1, 4, 2, 6)]


# ---- operator 2 ---------------------------------------------------------------------------------------------------
SAMPLES = ["a", " ", "  ", "▁", "é", "日本", "🙂", "\n", "\t", "<s>", "<0x41>", "the ", "ing", "​", "\x00", "</s>", "<unk>", "　", "     "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(SAMPLES), max_size=12).map("".join))
def test_pieces_equal_the_other_librarys(text):
    ours, theirs = encoder(), original()
    ids = ours.encode([text])[0]
    assert ids.tolist() == theirs.encode(text) and ours.decode([ids])[0] == theirs.decode(theirs.encode(text))
    assert ours.agrees(text)


_made = {}


def encoder():
    return _made.setdefault("ours", pieces.Pieces(PIECES, kept=50, verify=True)) if "ours" not in _made else _made["ours"]


def original():
    return _made.setdefault("theirs", sentencepiece.SentencePieceProcessor(model_file=PIECES))


def test_awkward_rows_in_pieces(spark):
    docs = cases.with_clashes(cases.awkward(spark))
    digest = sorted(pieces.encoding_digest(docs, PIECES).collect(), key=repr)
    theirs = {r[:2]: original().encode(r[1] or "") for r in cases.awkward_rows()}
    want = sorted((i is None, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, _), ids in
                  ((r[:2], theirs[r[:2]]) for r in cases.awkward_rows()))
    assert sorted((r.doc_id is None, r.doc_id, r.n_pieces, r.ids_crc32) for r in digest) == want
    assert all(r.verified for r in digest)
    encoded = pieces.encode_table(docs, PIECES)
    decoded = cases.table_of(pieces.decode_table(encoded, PIECES))
    assert decoded == sorted(((i, original().decode(ids)) for (i, _), ids in ((r[:2], theirs[r[:2]]) for r in cases.awkward_rows())), key=repr)
    assert pieces.encoding_digest(cases.empty(spark), PIECES).count() == 0


def test_a_difference_is_seen():
    wrong = pieces.Pieces(PIECES, verify=True)
    right = wrong._ids
    wrong._ids = lambda segments: [b if "x" not in s else [*b, 0] for s, b in zip(segments, right(segments))]
    wrong.encode(["plain words", "an x here"])
    assert wrong.agrees("plain words") and not wrong.agrees("an x here")


def message(fields):
    """A protobuf message of (number, bytes or int or float)."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram_file(path, dummy_prefix=1, trim=1):
    scored = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)),
              ("▁", -3.0, 1), ("▁a", -2.0, 1), ("a", -3.5, 1), ("b", -3.625, 1), ("ab", -4.0, 1), ("▁ab", -5.0, 1), ("bb", -6.5, 1), ("aba", -7.0, 1)]
    fields = [(1, message([(1, p.encode()), (2, s), (3, k)])) for p, s, k in scored]
    fields.append((2, message([(3, 1), (35, 1), (40, 0), (41, 1), (42, 2)])))
    fields.append((3, message([(1, b"identity"), (3, dummy_prefix), (4, trim), (5, 1)])))
    path.write_bytes(message(fields))
    return str(path)


@pytest.mark.parametrize("dummy_prefix,trim", [(1, 1), (1, 0), (0, 0)])
def test_unigram_models(tmp_path, dummy_prefix, trim):
    path = unigram_file(tmp_path / "m.model", dummy_prefix, trim)
    ours, theirs = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", "ab", " ", "  ", "é", "bb"]) for _ in range(draw.randrange(12)))
        assert ours.encode([text])[0].tolist() == theirs.encode(text), text


def test_refused_models(tmp_path):
    (tmp_path / "u.model").write_bytes(message([(1, message([(1, b"<unk>"), (3, 2)])), (1, message([(1, b"x"), (3, 4)]))]))
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "u.model"))
