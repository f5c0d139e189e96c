import random
import zlib
from collections import Counter

import pytest

from tapeloom.llm import repeats


def brute(texts, length):
    """Removed places of each text, by counting every window."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(gone)
    return out


def made_texts(rng, n, alphabet="abcd"):
    draw = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    parts = [draw(rng.randint(30, 260)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = draw(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(parts)
            a = rng.randint(0, len(p) // 3)
            t += p[a : len(p) - rng.randint(0, len(p) // 3)] + draw(rng.choice([0, 1, 40]))
        texts.append(t)
    return texts + ["", "ab" * 200, "x" * 500, "x" * 61]


@pytest.mark.parametrize("largest", [5_000, 1])
def test_equals_brute_force(make_docs, largest):
    rng = random.Random(12)
    texts = made_texts(rng, 50) + made_texts(rng, 20, "éa")
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (4, "c" * 300), (900, None), (901, texts[7])]
    got = repeats.without_repeats(make_docs(rows), length=60, largest_group=largest).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = [(d, len(t), len(g), bytes(b for i, b in enumerate(t) if i not in g)) for (d, _), t, g in zip(rows, raw, brute(raw, 60))]
    have = [(r.id, r.n_bytes, sum(x.end - x.begin for x in r.runs), bytes(r.kept)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert any(0 < n[2] < n[1] for n in want)


def test_production_length(make_docs, odd_rows):
    got = {(r.id, r.n_bytes): r for r in repeats.without_repeats(make_docs(odd_rows)).collect()}
    plain = len(odd_rows[3][1].encode())
    assert plain >= 200 and bytes(got[(5, plain)].kept) == b"" and len(got[(5, plain)].runs) == 1
    assert got[(1, 0)].runs == [] and got[(4, len(odd_rows[4][1].encode()))].runs == []
    assert repeats.without_repeats(make_docs([])).count() == 0


def test_interval_tree_of_a_suffix_array():
    text = b"mississippi"
    suffixes = sorted(text[i:] for i in range(len(text)))
    common = [repeats._common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    nodes = {suffixes[first][:depth]: last - first + 1 for depth, first, last in repeats.prefix_intervals(common)}
    assert nodes == {b"issi": 2, b"i": 4, b"p": 2, b"si": 2, b"ssi": 2, b"s": 4}


def test_maximal_repeats_equal_pairwise_extension():
    rng = random.Random(4)
    for _ in range(200):
        seen = {(bytes(rng.choices(b"ab", k=rng.randint(0, 9))), b"#" + bytes(rng.choices(b"ab", k=rng.randint(0, 9)))) for _ in range(rng.randint(2, 9))}
        lefts, rights = map(list, zip(*seen))
        want = {}
        for i in range(len(lefts)):
            covers = [(repeats._common(lefts[i], lefts[j]), repeats._common(rights[i], rights[j])) for j in range(len(lefts)) if j != i]
            want[i] = {(-a + k, -a + k + 6) for a, b in covers for k in range(a + b - 5)}
        have = {i: set() for i in want}
        for i, a, b in repeats.maximal_repeats(lefts, rights, 6):
            have[i] |= {(-a + k, -a + k + 6) for k in range(a + b - 5)}
        assert have == want


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    core = bytes(rng.choices(b"abcdef", k=300))
    texts = [b"x" * 33 + core + b"y" * 70, core, b"zq" * 55 + core[:250]]
    doc, place, anchor, kind, lead, tail = repeats.anchors(texts, 100)
    offset = [33, 0, 110]
    at = [{(p - offset[d], a) for d2, p, a in zip(doc, place, anchor) if d2 == d} for d in range(3)]
    inner = {x for x in at[1] if 100 <= x[0] < 150}
    assert inner <= at[0] and inner <= at[2]
    covered = sum(int(a + b) - 100 + 1 for a, b in zip(lead, tail))
    assert covered == sum(len(t) - 99 for t in texts)  # each window belongs to one anchor


def test_rows_without_id_are_told_apart(make_docs):
    rng = random.Random(7)
    seen = {}
    while True:  # two beginnings of one CRC-32, which texts that go on alike keep
        one = "".join(rng.choice("abcdefgh") for _ in range(12))
        other = seen.setdefault(zlib.crc32(one.encode()), one)
        if other[-1] != one[-1]:
            break
    tail = "".join(rng.choice("klmnop ") for _ in range(300))
    rows = [(None, one + tail), (None, other + tail), (1, "zz " + one + tail)]
    assert zlib.crc32(rows[0][1].encode()) == zlib.crc32(rows[1][1].encode())
    got = [(r.id, bytes(r.kept).decode()) for r in repeats.without_repeats(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, ""), (None, other), (1, "zz ")], key=repr)
