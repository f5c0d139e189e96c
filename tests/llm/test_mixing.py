import random

import duckdb
import pytest

from tapeloom.llm import mixing, queries


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    """Water filling step by step; ``sizes`` in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        full = {i for i in free if share[i] > limit * sizes[i]}
        if not full:
            for i in free:
                target[i] = share[i]
            break
        for i in full:
            target[i] = float(limit * sizes[i])
            left -= target[i]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [[10, 1, 1, 100], [5], [0, 0, 7], [1, 1, 1, 1, 1000, 2], [3, 30, 300, 3000, 30000]])
def test_targets_equal_water_filling(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_by_a_loop(spark, make_docs, odd_rows):
    rng = random.Random(1)
    rows = [(d, t, "en", rng.choice(["b", "é", "A", None])) for d, t in odd_rows]
    rows += [(100 + i, "w " * rng.randint(0, 60), "en", rng.choice(["b", "b", "b", "é", "A", "Z", None])) for i in range(200)]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(order, brute_targets([sizes[s] for s in order])))
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 2


def test_sizes_count_ascii_blanks_only(make_docs):
    got = mixing.mix(make_docs([(1, "a\x0bb\x0cc d e"), (2, None), (3, " \n")])).collect()
    assert {r.id: r.size for r in got} == {1: 4, 2: 0, 3: 0}


def test_mixed_documents_are_whole_rows(make_docs, odd_rows):
    docs = make_docs([(d, t, "en", "s" if i % 3 else "t") for i, (d, t) in enumerate(odd_rows)])
    got = mixing.mixed_documents(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    times = {}
    for r in mixing.mix(docs).collect():
        times[(r.id, r.size)] = times.get((r.id, r.size), 0) + (r.whole if r.size else 0)
    have = {}
    for r in got.collect():
        k = (r.doc_id, len((r.text or "").split()))
        have[k] = have.get(k, 0) + 1
    assert have == {k: n for k, n in times.items() if n}


def test_hot_source_in_buckets(make_docs, monkeypatch):
    rows = [(i, "w " * (i % 5 + 1), "en", "hot" if i % 3 else "b") for i in range(300)]
    plain = sorted(map(repr, mixing.mix(make_docs(rows)).collect()))
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 5)
    assert sorted(map(repr, mixing.mix(make_docs(rows)).collect())) == plain


def test_empty_table(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mixed_documents(make_docs([])).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    for name in ("op1_line_dedup", "op6_source_mixing", "op7_license_scan"):
        df = queries.QUERIES[name](spark, folder)
        cols = sorted(df.columns)
        rel = con.sql(queries.ORACLES[name])
        at = [rel.columns.index(c) for c in cols]
        want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
        assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want, name
