import random
import re
from collections import Counter

import pytest

from tapeloom.llm import licenses


def words_of(x):
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in x).split()


def windows(text, threshold):
    """Every window of every notice, without anchors; then the best of each place and those that none beats."""
    words = words_of(text)
    pairs = list(zip(words, words[1:]))
    best = {}
    for rank, (name, template) in enumerate(licenses.NOTICES):
        own, width = {tuple(b.split()) for b in licenses.bigrams(template)}, len(words_of(template)) - 1
        if len(own & set(pairs)) * 2 < threshold * len(own):
            continue
        for p, pair in enumerate(pairs):
            if pair in own:
                held = pairs[p : p + width]
                dice = 2 * len(own & set(held)) / (len(own) + len(held))
                if dice >= threshold:
                    best[p] = min(best.get(p, (0, 0, 0, 0, "")), (-dice, rank, p, p + len(held), name))
    found = list(best.values())
    kept = [x for x in found if not any(y[2] <= x[3] and y[3] >= x[2] and y < x for y in found)]
    return [("window", p, name, -low) for low, _, p, _, name in kept]


def brute(rows, threshold=licenses.THRESHOLD):
    out = []
    for doc, text in rows:
        if text is None:
            continue
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))]
        blocks = re.split(r"\n[^A-Za-z0-9]*\n", text)
        units += [("block", i, b) for i, b in enumerate(blocks) if "\n" in b]
        out += [(doc, *w) for w in windows(text, threshold)]
        for kind, i, x in units:
            words = words_of(x)
            pairs = Counter(zip(words, words[1:]))
            scored = []
            for rank, (name, template) in enumerate(licenses.TEMPLATES):
                own = {tuple(b.split()) for b in licenses.bigrams(template)}
                dice = 2 * len(own & set(pairs)) / (len(own) + sum(pairs.values())) if pairs else 0
                if dice >= threshold:
                    scored.append((-dice, rank, name))
            if scored:
                dice, _, name = min(scored)
                out.append((doc, kind, i, name, -dice))
    return sorted(out, key=repr)


def test_equals_brute_force(make_docs, odd_rows):
    mit = licenses.TEMPLATES[5][1]
    words = mit.split()
    rows = [
        *odd_rows,
        (20, "Title\nReleased under the MIT License\nbody"),
        (21, "intro\n\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n\nend"),
        (22, mit.replace("Software", "Program", 2)),
        (23, " ".join(words[: len(words) // 2])),
        (24, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.\nlicensed  UNDER cc-by-nc 4.0"),
        (25, " ".join(["license"] * 50_000)),
        (25, "Released under the MIT License."), (25, "Released under the MIT License."),
    ]
    got = licenses.license_notices(make_docs(rows)).collect()
    have = sorted(((r.id, r.kind, r.unit, r.license, r.dice) for r in got), key=repr)
    assert [r[:4] for r in have] == [r[:4] for r in brute(rows)]
    assert [r[4] for r in have] == pytest.approx([r[4] for r in brute(rows)])
    assert {(20, "MIT"), (21, "MIT"), (22, "MIT"), (24, "CC-BY-NC-4.0")} <= {(r[0], r[3]) for r in have}
    assert 23 not in {r[0] for r in have}


def test_empty_table_and_native_plan(make_docs):
    got = licenses.license_notices(make_docs([]))
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


EMBEDDED = [
    ("Licensed under the MIT License.", "MIT"), ("MIT License", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"), ("License: MIT", "MIT"),
    ("Distributed under the MIT license.", "MIT"), ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("We say that this tool, which is released under the ISC License, has no warranty.", "ISC"),
    ("All pages here are licensed under CC BY-NC-SA 4.0, but for the logo.", "CC-BY-NC-SA-4.0"),
    ("x = 1 # Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance\n# with the License.", "Apache-2.0"),
    ("This library is distributed under the GNU Lesser General Public License, version 3 or any later one, at your choice.", "LGPL-3.0"),
    ("/*\n * Foo\n *\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n"
     " * copyright notice and this permission notice appear in all copies.\n */", "ISC"),
]
CLEAN = [
    "The MIT press will license the book to you under a new contract.", "A public license for software is a text.", "He is licensed under state law to practise medicine.",
    "We compared the MIT License with the GNU General Public License in our lecture.", "Version 3, 29 June 2007", "under the License",
]


def test_embedded_notices_are_found_and_mentions_left_alone(make_docs):
    rows = [(i, t) for i, (t, _) in enumerate(EMBEDDED)] + [(100 + i, t) for i, t in enumerate(CLEAN)]
    found = {}
    for r in licenses.license_notices(make_docs(rows)).collect():
        found.setdefault(r.id, set()).add(r.license)
    for i, (text, name) in enumerate(EMBEDDED):
        # the first line of a GPL's title names the family by itself
        assert name in found.get(i, ()) and found[i] <= {name, "GPL"}, (text, found.get(i))
    assert not [i for i in found if i >= 100]


def test_windows_equal_brute_force_on_mixed_texts(make_docs):
    rng = random.Random(5)
    notices = [t for _, t in licenses.NOTICES]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(notices).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["the", "license", "under", "mit"])
            cut = rng.randint(0, 2)
            parts.append(" ".join(w[cut:]) if rng.random() < 0.5 else " ".join(w[: len(w) - cut]))
            if rng.random() < 0.5:
                parts.append(rng.choice(["and so on", "\n\n", "\n# ---\n", "this is licensed", ""]))
        rows.append((i // 2, " ".join(parts)))
    got = licenses.license_notices(make_docs(rows)).collect()
    have = sorted(((r.id, r.kind, r.unit, r.license, round(r.dice, 9)) for r in got), key=repr)
    assert have == sorted(((*r[:4], round(r[4], 9)) for r in brute(rows)), key=repr)
    assert sum(r[1] == "window" for r in have) > 40


def test_a_text_of_many_notices_is_linear(make_docs):
    text = "Licensed under the MIT License. Released under CC BY 4.0.\n" * 5000
    got = licenses.license_notices(make_docs([(1, text)])).where("kind = 'window'").groupBy("license").count().collect()
    assert {(r.license, r["count"]) for r in got} == {("MIT", 5000), ("CC-BY-4.0", 5000)}
