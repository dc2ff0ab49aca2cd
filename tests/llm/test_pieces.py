import hashlib

import public_tokenizers
import pytest
import sentencepiece

from chatlake.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (90, " ", None, None), (91, "a ", None, None), (92, " a  b ", None, None), (93, "▁x ▁ y ▁", None, None),
    (94, " " * 5000 + "z", None, None), (95, "x" * 20000, None, None), (96, "<s> a</s>\n\n\tb\x00c", None, None),
    (97, "a‍🧑‍🚀   q▁", None, None),
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block, row", [(32 << 20, 4096), (400, 3)])
def test_as_the_library_encodes_and_decodes(documents, messy_rows, monkeypatch, block, row):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", block)
    monkeypatch.setattr(pieces, "ROW_WORDS", row)
    monkeypatch.setattr(pieces, "ROW_DOCS", row)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = messy_rows + ODD
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        expected.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(decoded), ids, decoded))
    found = pieces.encode_decode(documents(rows), PATH, with_texts=True).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    short = pieces.encode_decode(documents(rows), PATH).collect()
    assert sorted(map(repr, map(tuple, short))) == sorted(repr(e[:4]) for e in expected)


def test_every_distinct_word_is_segmented_once(spark, documents):
    # A third of all words is one word, and copies share everything.
    rows = [(i, f"the same the w{i % 7} the", "en", "s") for i in range(3000)]
    read = documents(rows).select("doc_id", "text").repartition(5)
    held = read.mapInArrow(pieces._number(PATH, 8), pieces._BLOCKS)
    rows_of = held.where("radix is not null").collect()
    # Once per block, and blocks are as many as partitions here.
    assert sum(len(pieces.widened(r.numbers)) for r in rows_of) == 5 * 9
    assert pieces.encode_decode(documents(rows), PATH).select("ids_sha256").distinct().count() == 7


def test_whole_texts_are_words_where_pieces_cross_markers():
    model = pieces.Model(PATH)
    model.alone = False
    assert model.words("a b  c") == ["a▁b▁▁c"] and model.words("") == []


def test_empty_table(documents):
    assert pieces.encode_decode(documents([]), PATH).collect() == []
