import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chatlake.llm import alignment

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_letters():
    """The table of byte-level vocabularies, as their libraries define it."""
    kept = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    letters, extra = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            letters[chr(256 + extra)] = b
            extra += 1
    return letters


def by_hand(rows):
    """Every step on whole texts, token by token."""
    first, second, letters = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND), byte_letters()
    first.encode_special_tokens = True

    def bytes_a(i):
        return bytes(letters[c] for c in first.id_to_token(i))

    def bytes_b(i):
        return bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        data = b" " + (text or "").encode()
        if b"".join(map(bytes_a, a)) != data or b"".join(map(bytes_b, b)) != data:
            a, b = [], []
        groups, links, done_a, done_b, i, j = [], [], 0, 0, 0, 0
        own_a, own_b = [], []
        while i < len(a) or j < len(b):
            if done_a <= done_b and i < len(a):
                own_a.append(a[i])
                done_a += len(bytes_a(a[i]))
                i += 1
            else:
                own_b.append(b[j])
                done_b += len(bytes_b(b[j]))
                j += 1
            if done_a == done_b and own_a and own_b:
                links.append((own_a[-1], own_b[-1]))
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(doc_id, n_a, n_b, n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for doc_id, n_a, n_b, n, links, digest in found]


ODD = [(90, " ", None, None), (91, "a ", None, None), (92, "▁x y", None, None), (93, " " * 3000 + "z", None, None),
       (94, "<s> a</s> <|endoftext|>\x00", None, None), (95, "dup the dup", None, None), (95, "dup the dup", None, None)]


# Many small runs, merged over several levels; and one run per task.
@pytest.mark.parametrize("run_links, radixes, fan_in", [(alignment.RUN_LINKS, 64, 256), (200, 5, 3)])
def test_as_counted_by_hand(documents, messy_rows, run_links, radixes, fan_in):
    rows = messy_rows + ODD + [(200 + i, "the same words the same", "en", "s") for i in range(60)]
    found = alignment.align(documents(rows).repartition(6), FIRST, SECOND, run_links=run_links, radixes=radixes, fan_in=fan_in)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, by_hand(rows)))


def test_numbers_survive_squeezing():
    for kind, values in (("<u4", [0, 1, 2**32 - 1]), ("<u8", [0, 2**63 - 1, 5]), ("u1", [0, 1, 255]), ("<u4", [])):
        assert alignment.widened(alignment.squeezed(np.array(values, kind), kind), kind).tolist() == values


def test_merge_gives_totals_in_order():
    runs = [(np.array(p), np.array(t)) for p, t in (([1, 5, 9], [1, 2, 3]), ([5], [10]), ([], []), ([1, 9, 12], [4, 5, 6]))]
    assert list(alignment._merged(runs)) == [(1, 5, [0, 3]), (5, 12, [0, 1]), (9, 8, [0, 3]), (12, 6, [3])]


def test_empty_table(documents):
    assert alignment.align(documents([]), FIRST, SECOND).collect() == []
