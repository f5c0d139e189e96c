import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import ordered, queries, tokens
from tapeloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def check(tok, rows, got, capacity):
    """Every id in one piece, its checksum, and gapless windows; returns the padding."""
    want = sorted([*tok.encode(text or "", add_special_tokens=False).ids, 2] for _, text in rows)
    docs, seen = defaultdict(list), []
    by_doc = {}
    for doc, text in rows:
        by_doc.setdefault(doc, []).append(np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        docs[r.id].append(r)
    assert sorted(docs, key=repr) == sorted(by_doc, key=repr)
    for doc, pieces in docs.items():
        # rows that share an id: each text's pieces are among them as often as the text is
        expected = 0
        for ids in by_doc[doc]:
            expected += len(ids)
        assert sum(p.length for p in pieces) == expected
        for p in pieces:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in by_doc[doc])
        if len(by_doc[doc]) == 1:
            end = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == end
                end += p.length
            seen.append(end)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    lost = 0
    for places in windows.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        lost += padding(end, capacity)
    assert sum(r.length for r in got) == sum(map(len, want))
    return lost


def test_odd_rows(make_docs, odd_rows, tok):
    rows = [*odd_rows, (20, "word " * 3000), (21, "x" * 3000 + "1" * 2000), (22, 'One. Two! "Three?" J. Four… five'), (23, ".")]
    for capacity in (128, 4096):
        got = ordered.pack(make_docs(rows), tokenizer_path(), capacity=capacity).collect()
        check(tok, rows, got, capacity)


def test_little_padding_and_order(make_docs, tok):
    rng = random.Random(3)
    rows = [(i, " ".join(" ".join(rng.choice(["tea", "of", "stone"]) for _ in range(rng.randint(3, 25))) + "." for _ in range(rng.randint(1, 60)))) for i in range(200)]
    got = ordered.pack(make_docs(rows), tokenizer_path(), capacity=512).collect()
    lost = check(tok, rows, got, 512)
    assert lost < 0.03 * sum(r.length for r in got)
    order = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [(r.id, r.start) for r in order] == sorted((r.id, r.start) for r in got)


def test_segments_are_cut_between_documents(make_docs, tok):
    rows = [(i, "some words of a text. and more") for i in range(300)]
    got = ordered.pack(make_docs(rows), tokenizer_path(), capacity=128, segment=500).collect()
    check(tok, rows, got, 128)
    assert len({r.sequence_id >> 32 for r in got}) == -(-sum(r.length for r in got) // 500)


def test_a_third_of_one_row(make_docs, tok):
    rows = [(5, "the same words. again")] * 100 + [(i, f"text {i}") for i in range(200)]
    got = ordered.pack(make_docs(rows), tokenizer_path(), capacity=128).collect()
    check(tok, rows, got, 128)


def plain_best(place, penalty, capacity):
    cost = [0] + [None] * (len(place) - 1)
    for j in range(1, len(place)):
        cost[j] = penalty[j] + min(cost[i] + padding(place[j] - place[i], capacity) for i in range(j) if place[j] - place[i] <= capacity)
    return cost[-1]


def test_cuts_are_the_best():
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.choice([16, 20, 64])
        place = np.cumsum([0, *[rng.randint(1, 16) for _ in range(rng.randint(0, 40))]])
        penalty = np.array([0, *[rng.choice([0, 3, 9]) for _ in place[1:]]])
        cuts, cost = ordered.best_cuts(place, penalty, capacity)
        assert cost == plain_best(place.tolist(), penalty.tolist(), capacity)
        ends = [0, *place[cuts].tolist()]
        assert ends[-1] == place[-1]
        assert cost == sum(padding(b - a, capacity) for a, b in zip(ends, ends[1:])) + int(penalty[cuts].sum())


def test_checksums_of_parts():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(4 * rng.randint(0, 50)), rng.randbytes(4 * rng.randint(0, 5000))
        assert ordered.crc_between(zlib.crc32(a), zlib.crc32(a + b), len(b) // 4) == zlib.crc32(b)


def test_query_and_empty_table(spark, make_docs, tok):
    assert ordered.pack(make_docs([]), tokenizer_path()).count() == 0
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_ordered_packing(spark, folder).withColumnRenamed("doc_id", "id").collect()
    lost = check(tok, rows, got, 4096)
    assert lost < 0.05 * sum(r.length for r in got)


def test_known_words_are_searched_once(tok, monkeypatch):
    known, searched, index_in = tokens.Words(tokenizer_path()), [], tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda *a, **k: (searched.append(a), index_in(*a, **k))[1])
    for words in (["tea", "Öl", "x1", "stone", "naïve", "9"], ["stone", "É!", "of", "tea", "zzqx"], ["of"]):
        rows = known.rows(pa.array(words), np.ones(len(words), np.int64))
        assert known.words.take(pa.array(rows)).to_pylist() == words
        for word, row in zip(words, rows):
            assert known.pool[known.begin[row] :][: known.size[row]].tolist() == tok.encode(word, add_special_tokens=False).ids
    assert len(searched) == 3  # the search builds a table of all known words each time
