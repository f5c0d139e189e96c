import random

import xxhash

from tapeloom.llm import components, simhash
from tapeloom.llm.components import connected_components


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, linked):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(keys))]


def test_fingerprint_is_the_majority_of_shingle_hashes(odd_rows):
    for _, text in odd_rows:
        if text is None or len(text) < 10_000:
            assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint("A\x0bb\x0cC  d") == brute_print("a b c d")
    assert simhash.fingerprint("x y z") == brute_print("x y z")  # only six bytes are white space


def test_components_equal_brute_force(spark, make_docs, odd_rows):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(300)]
    rows = list(odd_rows)
    for i in range(60):
        words = list(base)
        words[rng.randrange(300)] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    docs = make_docs(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t) for _, t in rows if t is None or len(t) < 10_000]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    roots = brute_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    want = sorted(((d, p, least.get(r)) for (d, _), p, r in zip(rows, prints, roots)), key=repr)
    assert sorted(((g.id, g.fp % 2**64, g.component) for g in got if g.id != 4), key=repr) == want
    assert len({g.component for g in got}) < len({p for p in prints})


def test_links_find_every_close_pair(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            prints.add(y)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {tuple(r) for r in simhash.links(df).collect()}
    want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == want and want


def test_no_exploded_side_is_broadcast(spark, capsys):
    prints = spark.range(2).toDF("fp")
    simhash.links(prints).explain()
    edges = spark.range(2).selectExpr("id + 1 AS a", "id AS b")
    for large in (True, False):
        components._star(edges, large).explain()
    plans = capsys.readouterr().out
    assert "Broadcast" not in plans and plans.count("SortMergeJoin") == 3


def test_one_document_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted([1, 4, 5, 6, 7, 8], key=repr)  # 1 stands for all without words


def test_empty_table(make_docs):
    docs = make_docs([])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


def test_connected_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300), (5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
