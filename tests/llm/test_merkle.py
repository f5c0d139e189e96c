import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_tree(nodes):
    """(top, the siblings of each leaf from the lowest level up as (before, after))."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            steps[leaf].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], steps


def brute(rows):
    """Rows of (doc_id, text, lang, source) as the registered query returns them."""
    groups = {}
    for doc, text, lang, source in rows:
        chars = None if text is None else len(text)
        own = [h(*map(field, (doc, source, lang, chars, t))) for t in (text, text and text.replace("\n", ""))]
        altered = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        groups.setdefault(source, []).append((doc is not None, doc or 0, own[0], doc, own[altered]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: (sorted(groups[s]), *brute_tree([x[2] for x in sorted(groups[s])])) for s in order}
    if not order:
        return []
    root, above = brute_tree([below[s][1] for s in order])
    out = []
    for s, high in zip(order, above):
        leaves, subroot, steps = below[s]
        for (_, _, leaf, doc, given), low in zip(leaves, steps):
            up = given
            for before, after in low + high:
                up = h(before, up, after)
            out.append((doc, leaf, subroot, root, h(*(x for step in low + high for x in step)), up, up == root))
    return out


def rows_of(docs):
    got = merkle.manifest(docs)
    fold = merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    got = got.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("p"), fold.alias("f"))
    return [(*r, r.f == r.root) for r in got.collect()]


def check(make_docs, rows):
    assert sorted(rows_of(make_docs(rows)), key=repr) == sorted(brute(rows), key=repr)


def test_odd_rows_and_sources(make_docs, odd_rows):
    rng = random.Random(4)
    check(make_docs, [(d, t, rng.choice(["en", None]), rng.choice([None, "", "é", "Z", "a"])) for d, t in odd_rows])


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 1, 1, 3], [27, 28, 1], [730, 10, 4]])
def test_runs_of_every_length(make_docs, sizes):
    rows = [(i * 7 % 10007, f"line {i}\nend" if i % 3 else "plain", "en", f"s{s:02}") for s, n in enumerate(sizes) for i in range(n)]
    check(make_docs, rows)


def test_many_sources_and_small_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rng = random.Random(2)
    rows = [(i, f"a {i}\nb", "en", f"s{min(rng.randint(0, 90), 60)}") for i in range(400)]
    check(make_docs, rows)


def test_only_changed_texts_fail(make_docs):
    rows = [(i, "two\nlines" if i % 2 else "one line", "en", "s") for i in range(60)]
    for doc, *_, ok in rows_of(make_docs(rows)):
        assert ok == (doc % 2 == 0 or zlib.crc32(str(doc).encode()) % 2 == 1)


def test_empty_table(make_docs):
    assert rows_of(make_docs([])) == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    rel = con.sql(queries.ORACLES["op12_merkle_manifest"])
    got = queries.op12_merkle_manifest(spark, folder)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
