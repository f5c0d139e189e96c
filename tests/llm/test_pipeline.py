import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_lines import brute as brute_lines
from test_mixing import brute_targets
from test_packing import brute_ids
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

from tapeloom.llm import langid, lines, mixing, packing, queries, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd_rows):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "ing", "ea", "st", "on", "re"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, "\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6)))) for i in range(100, 220)]
    rows += [(300, rows[5][1]), (301, rows[6][1] + " extra"), (302, "first line\n" + rows[7][1]), *odd_rows, (400, "Привет мир, это другой язык")]
    # repeated rows and rows of one id are of one source
    full = [(d, t, "en", f"s{(d or 0) % 3}", None if t is None else len(t)) for d, t in rows]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_keep_the_columns_and_hand_over_all_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.where("piece = 0").count() == counts[-1]
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(repr, last.select("doc_id", "piece", "length", "ids_crc32").collect())
    )


def brute_mix(rows):
    """(row, times) of whole documents, source by source."""
    size = lambda r: len((r.text or "").encode().split())
    sources = sorted({r.source for r in rows})
    sizes = [sum(size(r) for r in rows if r.source == s) for s in sources]
    for source, total, target in zip(sources, sizes, brute_targets(sizes)):
        keyed = []
        for r in rows:
            if r.source == source and size(r):
                raw = r.text.encode()
                dense = [b for b in raw if b not in (9, 10, 11, 12, 13, 32)]
                letters = [b for b in raw if b >= 128 or chr(b).isalpha()]
                unit = (int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                keyed.append((-math.log(unit) / (0.05 + 0.95 * (len(letters) / len(dense))), r.doc_id, r))
        epochs = math.floor(target / total)
        left = target - epochs * total
        for _, _, r in sorted(keyed, key=lambda k: k[:2]):
            fraction = max(0.0, min(1.0, left / size(r)))
            left -= size(r)
            yield r, math.floor(epochs + fraction + 0.5)


def test_pipeline_equals_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = [r for r in rows if any(c.isalpha() for c in r.text or "") and r.doc_id != 400]  # the one in another script
    kept = brute_lines([(r.doc_id, r.text) for r in rows])
    rows = [type(r)(**(r.asDict() | {"text": kept[(r.doc_id, r.text)][0]})) for r in rows]
    prints = [brute_print(r.text) for r in rows]
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    roots = brute_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    best = {}
    for i, root in enumerate(roots):
        place = (rows[i].doc_id is None, rows[i].doc_id or 0, signed[i])
        if root not in best or place < best[root][0]:
            best[root] = (place, i)
    rows = [rows[i] for _, i in best.values()]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r, times in brute_mix(rows):
        ids = np.array(brute_ids(tok, r.text), "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            x = ids[at : at + 4096]
            want[(r.doc_id, n, at, len(x), zlib.crc32(x.tobytes()))] += times
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == +want
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096 and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
    assert all(m is not None for m in (langid, lines, mixing, packing, simhash))
