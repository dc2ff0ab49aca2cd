import re

import numpy as np
import pyarrow as pa

from chatlake.llm.wordhash import Words, shingle_hashes, slices, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern(messy_rows):
    column = pa.array([r[1] for r in messy_rows])
    words = Words(column)
    for i, (_, text, *_) in enumerate(messy_rows):
        spans = zip(words.starts[words.first[i]:words.first[i + 1]], words.ends[words.first[i]:words.first[i + 1]])
        assert [words.data[a:b].tobytes().decode() for a, b in spans] == WORD.findall(text or "")


def test_equal_words_and_only_they_have_equal_hashes(messy_rows):
    words = Words(pa.array([r[1] for r in messy_rows]))
    names = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    by_hash = dict(zip(words.hashes().tolist(), names))
    assert len(by_hash) == len(set(names)) and all(by_hash[h] == n for h, n in zip(words.hashes().tolist(), names))


def test_lower_case_is_ascii_only():
    hashes = Words(pa.array(["ABC abc ÄB äB"])).hashes(lower=True)
    assert hashes[0] == hashes[1] and hashes[2] != hashes[3]


def test_windows_do_not_depend_on_their_place():
    words = np.random.default_rng(1).integers(0, 2**64, 40, dtype=np.uint64)
    twice = np.concatenate([words, words])
    for found in (shingle_hashes(twice, 5), window_hashes(twice, 20)):
        assert (found[: 20] == found[40: 60]).all() and len(np.unique(found[:40])) == 40
    assert not len(window_hashes(words, 41)) and not len(shingle_hashes(words[:0], 1))


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c" * 10, "d"]})
    parts = list(slices(batch, "text", 20))
    assert [r for p in parts for r in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1


def test_a_word_longer_than_a_slice(monkeypatch):
    import chatlake.llm.wordhash as w

    column = pa.array(["ab " * 30 + "c" * 100 + " de"])
    whole = Words(column).hashes()
    monkeypatch.setattr(w, "SLICE_BYTES", 16)
    assert (Words(column).hashes() == whole).all()
