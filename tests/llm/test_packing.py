import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import packing
from tapeloom.llm.queries import tokenizer_path

ODD = [
    "á ́b x\x1cy\x85z <|endoftext|>foo bar<|startoftext|> İΣ'S it's　w q", "", "   ", "\x0b\x0c x", None,
    "Don't Ünïcode, ªº. µ! <|STARTOFTEXT|> a.. b., ß? ÀÉ; 1,2. x1, İ, Å ﬁ  'S 'LL tail\n\n..", "?!", "A, B. C; D: E! F?",
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def brute_ids(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_wise_ids_equal_whole_text_ids(tok):
    rng = random.Random(2)
    alphabet = "ab cdé.,'!?;:\n\t 12<|>ÀΣßñ  -"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    ids, bounds = packing.token_ids(pa.array(texts), tokenizer_path())
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == brute_ids(tok, t)[:-1], repr(t)


def test_pieces_and_places(spark, make_docs, odd_rows, tok):
    rows = [*odd_rows, *[(100 + i, t) for i, t in enumerate(ODD)]]
    got = packing.pack(make_docs(rows), tokenizer_path(), capacity=512).collect()
    want = []
    for doc, text in rows:
        ids = np.array(brute_ids(tok, text), "<u4")
        want += [(doc, n, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for n, at in enumerate(range(0, len(ids), 512))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 1


def test_hot_length_is_ranked_by_salts(spark, monkeypatch, make_docs):
    monkeypatch.setattr(packing, "ROWS_A_SALT", 7)
    got = packing.pack(make_docs([(i, "same words here") for i in range(100)]), tokenizer_path(), capacity=16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 100
    assert len({r.sequence_id for r in got}) == 25


def best_bins(lengths, capacity):
    """The fewest bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_patterns_use_every_piece_and_few_bins():
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(9)]
        counts = {n: lengths.count(n) for n in lengths}
        used, bins = defaultdict(int), 0
        for times, pattern in packing.bin_patterns(counts, 20):
            assert sum(n * k for n, k in pattern.items()) <= 20
            bins += times
            for n, k in pattern.items():
                used[n] += times * k
        assert dict(used) == counts
        assert bins <= best_bins(lengths, 20) + 1


def test_empty_table(make_docs):
    assert packing.pack(make_docs([]), tokenizer_path()).count() == 0
