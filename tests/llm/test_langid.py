import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import langid

SYLLABLES = {"aa": ["ba", "be", "ta", "the", "ing", "st"], "bb": ["ko", "ka", "zu", "ß", "ung", "sch"], "cc": ["oui", "é", "tre", "ê", "que"]}


def text_in(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def fold(text):
    out = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    kept = ""
    for c in out:
        if c != " " or (kept and kept[-1] != " "):
            kept += c
    return "   " + kept


def brute_model(texts):
    """Interpolated Kneser-Ney of one language by dictionaries: a function of (context, character)."""
    top = Counter(f[i - 3 : i + 1] for f in map(fold, texts) for i in range(3, len(f)))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    stats = {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        stats[n] = (once / (once + 2 * twice) if once else 0.5, total, kinds)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 65536
        d, total, kinds = stats[n]
        h = gram[:-1]
        if not total[h]:
            return p(gram[1:])
        return max(counts[n][gram] - d, 0) / total[h] + d * kinds[h] / total[h] * p(gram[1:])

    return p


def test_probabilities_equal_the_recursion():
    rng = random.Random(1)
    texts = {lang: [text_in(rng, lang, rng.randint(1, 30)) for _ in range(12)] for lang in ("aa", "bb", "cc")}
    counts = {}
    for lang, own in texts.items():
        codes, _, first = langid._folded(own)
        counts[lang] = np.unique(langid._grams(codes)[first], return_counts=True)
    model = langid.fit(counts)
    models = {lang: brute_model(own) for lang, own in texts.items()}
    tests = ["Thebing kota.", "sch, 42 ÉTRE!\nê", "xyz Ж日本", "", "  a", "ba"]
    entropy, n, letters = langid.entropies(model, tests)
    for i, t in enumerate(tests):
        f = fold(t)
        assert n[i] == len(f) - 3 and letters[i] == sum(c != " " for c in f)
        for k, lang in enumerate(model.languages):
            want = -sum(math.log(models[lang](f[j - 3 : j + 1])) for j in range(3, len(f))) / max(1, n[i])
            assert entropy[i, k] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_chances_of_all_characters_sum_to_one():
    p = brute_model(["ba bebe sting the ta", "the the bing"])
    assert sum(p("the"[:3] + chr(c)) for c in range(65536)) == pytest.approx(1)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(7)
    return [(i, text_in(rng, lang, rng.randint(2, 60)), lang) for i, lang in enumerate(rng.choices(["aa", "bb", "cc"], k=400))]


def test_held_out_accuracy_and_odd_texts(make_docs, labelled, odd_rows):
    odd = [(d and d + 1000, t, None) for d, t in odd_rows] + [(5000, "Привет мир, это другой язык", None), (5001, "12 34", "aa"), (5002, "ba " * 200_000, "aa")]
    got = langid.languages(make_docs(labelled + odd)).collect()
    assert len(got) == len(labelled) + len(odd)
    by = {r.id: r for r in got}
    for doc, _, lang in labelled:
        assert by[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
    held = [(by[d].lang_pred, lang) for d, _, lang in labelled if by[d].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.97
    assert not any(by[d].rejected for d, _, _ in labelled)
    assert by[5000].rejected and by[5000].lang_pred in SYLLABLES
    for doc in (1001, 1002, 1003, 5001):
        assert (by[doc].lang_pred, by[doc].score, by[doc].rejected) == ("und", 0.0, True)
    assert by[5002].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(make_docs, labelled):
    other = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in labelled]
    a = sorted(map(repr, langid.languages(make_docs(labelled)).collect()))
    assert a == sorted(map(repr, langid.languages(make_docs(other)).collect()))


def test_rejected_rows_go(make_docs, labelled):
    docs = make_docs([*labelled, (5000, "Привет мир, это другой язык", None), (5001, None, "aa")])
    got = langid.keep_identified(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    assert sorted(r.doc_id for r in got.collect()) == [d for d, _, _ in labelled]


def test_nothing_to_learn_from(make_docs):
    assert langid.languages(make_docs([])).count() == 0
    assert [r.lang_pred for r in langid.languages(make_docs([(1, "abc", None)])).collect()] == ["und"]


def test_small_languages_are_calibrated(make_docs, monkeypatch):
    rng = random.Random(9)
    rows = [(i, text_in(rng, "aa" if i < 400 else "bb", 40), "aa" if i < 400 else "bb") for i in range(460)]
    rows += [(900 + i, text_in(rng, "cc", 40), "cc") for i in range(12)]
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 25_000)  # only the first language has more
    model = langid.learn(make_docs(rows))
    assert model.languages == ["aa", "bb", "cc"] and model.mean.min() > 0.3 and (model.spread < 1).any(axis=1).all()
    assert langid.classify(model, ["xqxq wvwv " * 20])["rejected"].all()
    assert not langid.classify(model, [t for _, t, _ in rows])["rejected"].any()


@pytest.mark.parametrize("first", [0, 1000, 2000, 3000, 4000, 5000])
def test_language_of_one_or_two_rows_is_learned(make_docs, first):
    rng = random.Random(first)
    rows = [(first + i, text_in(rng, "aa", 30), "en") for i in range(200)]
    small = [i for i in range(first + 300, first + 400) if zlib.crc32(str(i).encode()) % 5][:2]
    rows += [(i, text_in(rng, "bb", 30), "de") for i in small]
    assert langid.learn(make_docs(rows)).languages == ["de", "en"]
    assert langid.learn(make_docs(rows[:-1])).languages == ["de", "en"]
    long = [(first + i, text_in(rng, "aa", 30), "en") for i in range(20)] + [(small[0], text_in(rng, "cc", 400_000), "fr"), (small[1], "?!", "xx")]
    assert langid.learn(make_docs(long)).languages == ["en", "fr"]


def test_many_labels(make_docs, monkeypatch):
    rng = random.Random(6)
    rows = [(i, text_in(rng, "aa", 20), "en") for i in range(60)] + [(100 + i, text_in(rng, "bb", 5), f"l{i % 700}") for i in range(1400)]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 400)
    monkeypatch.setattr(langid, "CELLS", 1 << 12)
    model = langid.learn(make_docs(rows))
    assert len(model.languages) == 400 and "en" in model.languages
    entries = sum(len(x.value) for x in (*model.chances, *model.weights))
    assert entries < 0.2 * sum(len(x.keys) for x in (*model.chances, *model.weights)) * 400
    got = langid.languages(make_docs([*rows[:3], (9000, text_in(rng, "aa", 20))])).collect()
    assert {r.lang_pred for r in got} == {"en"}
