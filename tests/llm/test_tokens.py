import hashlib
import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chatlake.llm import packing, tokencount, wordtable

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in (
    "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_encoding_and_decoding_as_the_library_does(documents, messy_rows, frequent):
    library = Tokenizer.from_file(WORD_BPE)
    expected = []
    for doc_id, text, *_ in messy_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(decoded), decoded))
    found = wordtable.encode_decode(documents(messy_rows), WORD_BPE, frequent=frequent)
    found = found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_a_frequent_word_that_shares_its_hash_is_joined_by_word(documents, monkeypatch):
    # Every word gets one of a few hashes, so nearly all of them clash.
    plain = wordtable._hashes_of
    rows = [(1, "alpha beta gamma alpha beta alpha", None, None), (2, "delta epsilon alpha", None, None)]
    whole = wordtable.encode_decode(documents(rows), WORD_BPE).collect()
    table = wordtable.word_table(wordtable.texts(documents(rows)), WORD_BPE)
    monkeypatch.setattr(wordtable, "_hashes_of", lambda words: plain(words) & np.uint64(0))
    frequent, others = wordtable.most_frequent(table, 3)
    assert not len(frequent.hashes) and others.count() == 5 and len(whole) == 2


def test_numbers_survive_packing():
    for numbers in ([], [0, 65279, 65280, 65535, 65536, 1 << 20, 3, 0xFEFFFF, 0xFF0000, 1 << 30], list(range(70_000))):
        assert wordtable.unpacked(wordtable.packed(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("vocabulary, size", [(1 << 16, 2), ((1 << 16) + 1, 4)])
def test_ids_of_a_rare_word_travel_in_as_few_bytes_as_the_vocabulary_needs(vocabulary, size):
    unit = wordtable._unit(vocabulary)
    ids = [[vocabulary - 1, 0, 7], [], [1], [5] * 300]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([9, 9, 9, 9], pa.int64()), pa.array([70_000, 0, 1, 2], pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["row", "place", "ids"])
    entries = next(wordtable._entries(unit)(iter([batch]))).column("entry")
    assert [len(e) for e in entries.to_pylist()] == [4 + size * len(x) for x in ids]
    # Those of one text have places from 0 on, in any order; here they are a slice of a longer column.
    data, starts, sizes = wordtable._own_ids(entries.slice(1), unit)
    assert [data[a: a + n].tolist() for a, n in zip(starts, sizes)] == ids[1:]


def test_repeated_rows_and_rare_words_keep_their_places(documents):
    library, text = Tokenizer.from_file(WORD_BPE), "zq1 zq2\u00a0x zq1\x1czq3 zq2 zq1\vzq4"
    rows = [(1, text, None, None), (1, text, None, None), (2, text, None, None), (3, None, None, None)]
    found = wordtable.encode_decode(documents(rows), WORD_BPE, frequent=0).collect()
    expected = {i: digest(" ".join(map(str, library.encode(t or "", add_special_tokens=False).ids))) for i, t, *_ in rows}
    assert sorted((r.doc_id, r.ids_sha256) for r in found) == sorted((i, expected[i]) for i, *_ in rows)


@pytest.mark.parametrize("chunk, overlap", [(65_536, 256), (300, 40), (64, 4)])
def test_token_counts_as_the_library_gives_them(documents, messy_rows, chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    # Spaces in runs and single letters leave no stable boundary in small overlaps.
    rows = messy_rows + [(90, "a" * 900, None, None), (91, " " * 700, None, None), (92, "q9Z" * 300 + "▁ x", None, None)]
    expected = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows]
    found = tokencount.count_tokens(documents(rows), PIECES, limit=100, chunk=chunk, overlap=overlap).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in found))) == sorted(map(repr, expected))
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)


def test_no_token_crosses_a_stable_boundary():
    model, pieces = tokencount._model(PIECES)
    longest, rng = max(map(len, pieces)), random.Random(3)
    for _ in range(60):
        text = "".join(rng.choices(["the ", "ing", "x9", "é", "  ", "Zq", "字", "\n"], k=40))
        plain = text.replace(" ", "▁")
        at = [i for i in range(1, len(text)) if tokencount.stable_boundary(plain, i, pieces, longest)]
        assert set(at) <= set(tokencount._ends(model, text))


def test_pieces_and_places(documents, messy_rows):
    library = Tokenizer.from_file(BYTE_BPE)
    expected = []
    for doc_id, text, *_ in messy_rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for piece, length in enumerate(packing.cut_lengths(len(ids), 1024)):
            expected.append((doc_id, piece, start, length, zlib.crc32(ids[start: start + length].tobytes())))
            start += length
    found = packing.pack_documents(documents(messy_rows), BYTE_BPE).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in found))) == sorted(map(repr, expected))
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024
    assert len(filled) == packing.fewest_possible(np.bincount([r.length for r in found], minlength=1025), 1024)


def fewest(lengths, capacity):
    """Smallest number of bins by trying everything."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1:]])
        place(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_plans_use_every_piece_and_hardly_more_sequences_than_needed():
    rng = random.Random(2)
    extra = 0
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(lengths, minlength=31)
        plan = packing.plan_packing(counts, 30)
        used = np.zeros(31, int)
        for times, filling in plan:
            assert sum(filling) <= 30
            np.add.at(used, filling, times)
        assert (used == counts).all()
        needed = fewest(lengths, 30)
        assert packing.fewest_possible(counts, 30) <= needed
        extra += sum(t for t, _ in plan) - needed
    assert extra <= 2


def test_bin_completion_turns_back_until_the_plan_is_the_best():
    rng = random.Random(5)
    cases = [[8, 8, 10, 10, 11, 11, 13, 13], [7, 8, 11, 11, 11, 12, 13, 15], [7, 7, 11, 11, 11, 12, 12, 13]]
    cases += [[rng.randint(5, 16) for _ in range(rng.randint(1, 11))] for _ in range(100)]
    for lengths in cases:
        counts = np.bincount(lengths, minlength=31)
        plan = packing.plan_packing(counts, 30, nodes=None)
        used = np.zeros(31, int)
        for times, filling in plan:
            assert sum(filling) <= 30
            np.add.at(used, filling, times)
        assert (used == counts).all()
        assert sum(t for t, _ in plan) == fewest(lengths, 30)
        # A bounded search gives no more sequences than a plan made without turning back.
        assert sum(t for t, _ in packing.plan_packing(counts, 30, nodes=3)) <= sum(
            t for t, _ in packing.plan_packing(counts, 30, nodes=0))


def test_fillings_are_just_the_undominated_ones():
    rng = random.Random(6)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 12) for _ in range(rng.randint(0, 7))), reverse=True)
        room = rng.randint(0, 20)
        sets = {tuple(c) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if sum(c) <= room}

        def dominated(chosen):
            left_out = Counter(lengths) - Counter(chosen)
            parts = {c for n in range(len(chosen) + 1) for c in itertools.combinations(chosen, n)}
            return any(sum(p) <= y <= sum(p) + room - sum(chosen) and p != (y,) for y in left_out for p in parts)

        found = [tuple(f) for f in packing.undominated_fillings(np.bincount(lengths, minlength=21), room) if f is not None]
        assert sorted(found) == sorted(c for c in sets if not dominated(c))
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


def test_many_empties_and_equal_lengths_are_planned():
    for lengths in (np.full(3000, 1), np.full(5000, 300), np.full(7, 1024), np.concatenate([np.full(90_000, 1), np.arange(1, 1025)])):
        counts = np.bincount(lengths, minlength=1025)
        plan = packing.plan_packing(counts)
        used = np.zeros(1025, int)
        for times, filling in plan:
            assert sum(filling) <= 1024
            np.add.at(used, filling, times)
        assert (used == counts).all()
        each = 1024 // int(lengths[0]) if len(set(lengths.tolist())) == 1 else 0
        assert sum(t for t, _ in plan) == (-(-len(lengths) // each) if each else packing.fewest_possible(counts, 1024))


def test_a_filling_wastes_as_little_as_any():
    rng = random.Random(9)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 40)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        for order in (0, 1, 3):
            filling = packing.best_filling(np.bincount(lengths, minlength=41), room, order)
            assert sum(filling) == max(s for s in sums if s <= room)
            assert all(filling.count(n) <= lengths.count(n) for n in filling)


def test_empties_spaces_and_letters_without_end(documents):
    texts = [" " * 1_000_000, "a" * 1_000_000, "\n" * 200_000 + "x", "é字" * 1000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(10 + i, None if i % 2 else "", "en", "s") for i in range(3000)]
    library = Tokenizer.from_file(BYTE_BPE)
    expected = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    found = packing.pack_documents(documents(rows), BYTE_BPE).toPandas()
    assert found[found.doc_id < 10].groupby("doc_id").length.sum().to_dict() == expected
    assert (found[found.doc_id >= 10].length == 1).all() and len(found[found.doc_id >= 10]) == 3000
    assert found.sequence_id.nunique() == packing.fewest_possible(np.bincount(found.length, minlength=1025), 1024)


def test_merging_by_rank_is_proven_from_the_file(tmp_path, documents, messy_rows):
    assert packing.merges_by_rank(BYTE_BPE)
    spec = json.loads(open(BYTE_BPE, encoding="utf-8").read())
    # Two entries swap their ids, so merges no longer come in the order of ids.
    vocab = spec["model"]["vocab"]
    one, two = (p for p, i in vocab.items() if i in (300, 301))
    vocab[one], vocab[two] = vocab[two], vocab[one]
    path = str(tmp_path / "swapped.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(spec, file)
    assert not packing.merges_by_rank(path)
    library = Tokenizer.from_file(path)
    expected = {(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in messy_rows}
    found = packing.token_pieces(documents(messy_rows), path, capacity=1 << 20).collect()
    assert {(r.doc_id, r.length) for r in found} == expected


def test_empty_tables(documents):
    none = documents([])
    assert wordtable.encode_decode(none, WORD_BPE).count() == 0
    assert tokencount.count_tokens(none, PIECES).count() == 0
    assert packing.pack_documents(none, BYTE_BPE).count() == 0
