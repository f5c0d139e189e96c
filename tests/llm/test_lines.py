import random

from tapeloom.llm import lines


def brute(rows, run=2, long_words=20):
    """Kept text of each distinct (id, text), by comparing every run with all earlier ones."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for doc, text in docs:
        parts = text.split("\n")
        full = [i for i, x in enumerate(parts) if x.strip(" ")]
        runs = [full[i : i + run] for i in range(len(full) - run + 1)]
        runs += [[i] for i in full if parts[i].strip(" ").count(" ") >= long_words - 1]
        gone = set()
        for r in sorted(runs):
            content = (len(r), *[parts[i].strip(" ") for i in r])
            if content in seen:
                gone.update(r)
            seen.add(content)
        out[(doc, text)] = ("\n".join(x for i, x in enumerate(parts) if i not in gone), len(gone))
    return out


def check(docs, rows, **how):
    got = lines.dedup_lines(docs, **how).collect()
    want = brute(rows, **how)
    expected = sorted(((d, *((None, 0) if t is None else want[(d, t)])) for d, t in rows), key=repr)
    assert sorted(((r.id, r.kept, r.lines_removed) for r in got), key=repr) == expected
    return got


def test_equals_brute_force(make_docs):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", " line 1 "] + [" ".join(f"w{i}{j}" for j in range(25)) for i in range(4)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    check(make_docs(rows), rows)
    check(make_docs(rows), rows, run=3)
    check(make_docs(rows), rows, run=4, long_words=30)


def test_odd_rows(make_docs, odd_rows):
    one_text_an_id = [r for r in odd_rows if r != (6, "another text of one id")]
    got = {r.id: r for r in check(make_docs(one_text_an_id), one_text_an_id)}
    assert got[8].kept == "line a b c\nline d e f\nother" and got[8].blocks_removed == 1
    assert got[1].kept is None and got[1].lines_in == 0 and got[2].lines_in == 1


def test_repeated_rows_get_one_result(make_docs):
    rows = [(2, "a\nb\nc"), (1, "a\nb"), (2, "a\nb\nc")]
    assert sorted(r.kept for r in lines.dedup_lines(make_docs(rows)).collect()) == ["a\nb", "c", "c"]


def test_run_that_overlaps_its_first_occurrence(make_docs):
    assert lines.dedup_lines(make_docs([(1, "x\nx\nx")])).first().kept == "x"


def test_columns_stay(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = lines.without_repeated_lines(docs)
    assert got.schema.simpleString() == docs.schema.simpleString() and got.count() == len(odd_rows)
    assert lines.without_repeated_lines(make_docs([])).count() == 0


def test_no_python_on_the_path(make_docs):
    plan = lines.dedup_lines(make_docs([(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
