import random

from ruleframe.llm import licenses as lc


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        nxt = [0]
        for j, y in enumerate(b, 1):
            nxt.append(row[j - 1] + 1 if x == y else max(row[j], nxt[-1]))
        row = nxt
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        b = [rng.randrange(30) for _ in range(rng.randrange(40))]
        a = [x for x in b if rng.random() > 0.2] + [rng.randrange(30) for _ in range(rng.randrange(10))]
        pairs = lc.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b)
        # All words unique: patience alignment finds the longest one.
        u = rng.sample(range(50), 20)
        v = rng.sample(range(50), 20)
        assert len(lc.align(u, v)) == longest_common(u, v)


def test_gaps_without_anchors_are_aligned_whole():
    rng = random.Random(5)
    for n in (60, 80, 300):
        u = [rng.randrange(9) for _ in range(n)]
        assert len(lc.align(u, u)) == n
        v = [rng.randrange(9) for _ in range(n)]
        pairs = lc._common(u, v)
        assert len(pairs) == longest_common(u, v) and all(u[i] == v[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def covered(words, template, needed):
    """Whether some run of the text has enough of the template, by full tables."""
    need, width = -(-len(template) * 4 // 5), int(len(template) * lc.SPREAD) + 2
    for start in range(len(words)):
        for end in range(start + need, min(len(words), start + width) + 1):
            n = longest_common(words[start:end], template)
            if n >= need and n >= lc.DENSITY * (end - start):
                run = b" ".join(words[start:end])
                if all(b" ".join(template[a:b]) in run for a, b in needed):
                    return True
    return False


def test_scan_equals_brute_force():
    rng = random.Random(12)
    names = [n for n in lc.TEMPLATES if len(lc.words_of(lc.TEMPLATES[n][0])) <= 14]
    chosen = {n: lc.TEMPLATES[n][:1] for n in names}
    scanner = lc.Scanner(chosen)
    vocabulary = sorted({w.decode() for n in names for w in lc.words_of(chosen[n][0])}) + [f"f{i}" for i in range(400)]
    hits = 0
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(14))]
        if rng.random() < 0.7:
            notice = [w.decode() for w in lc.words_of(chosen[rng.choice(names)][0])]
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
            words[len(words) // 2 : len(words) // 2] = notice
        text = " ".join(words)
        want = {n for (n, _, t), needed in zip(scanner.templates, scanner.telling, strict=True) if covered(lc.words_of(text), t, needed)}
        got = {m[2] for m in scanner.scan(text)}
        # Of matches that overlap one is reported, so each license that is covered is found or lies over one that is.
        assert got <= want and bool(got) == bool(want), text
        hits += bool(got)
    assert hits > 40


def test_increasing_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(40) for _ in range(rng.randrange(15))]
        got = [x[i] for i in lc.increasing(x)]
        assert all(a < b for a, b in zip(got, got[1:], strict=False))
        best = [1] * len(x)
        for i in range(len(x)):
            best[i] = max([best[j] + 1 for j in range(i) if x[j] < x[i]], default=1)
        assert len(got) == max(best, default=0)


def test_planted_notices(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "license", "under", "work", "a", "is", "foo", "bar", "this", "version", "to"])
    rows, want = [], {}
    names = [(n, t) for n, ts in lc.TEMPLATES.items() for t in ts]
    for i in range(160):
        filler = lambda: " ".join(word() for _ in range(rng.randrange(0, 60)))
        if i % 2:
            (n, t), (m, u) = rng.choice(names), rng.choice(names)
            rows.append((i, f"{filler()}\n{t.upper()}\n{filler()}. {u} {u}\n{filler()}"))
            want[i] = {n, m}
        else:
            rows.append((i, filler()))
            want[i] = set()
    got = {r.doc_id: r for r in lc.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] <= set(got[i].licenses.split(",")) or not want[i] for i in want)
    assert all(got[i].n_licenses == 0 for i in want if not want[i])


def test_edited_notice_and_repeats():
    s = lc.Scanner()
    text = "x " * 50 + "This program is a free software; you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of this License, or at your option any later version"
    assert [m[2] for m in s.scan(text)] == ["GPL-3.0"]
    assert [m[:3] for m in s.scan("Released under the MIT License. Released under the MIT License.")] == [(0, 5, "MIT"), (5, 10, "MIT")]
    assert s.scan("released the terms under a pact that MIT drew, no license") == []


def test_odd_rows(odd_docs, no_docs):
    got = lc.scan(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.n_licenses for r in got} == {0}
    assert lc.scan(no_docs).count() == 0


def test_words_that_tell_licenses_apart():
    s = lc.Scanner()
    names = lambda text: [m[2] for m in s.scan(text)]
    gnu = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    assert names("This program " + gnu.format("General Public License", 2)) == ["GPL-2.0"]
    assert names("This program " + gnu.format("General Public License", 3)) == ["GPL-3.0"]
    assert names("This library " + gnu.format("Lesser General Public License", 2.1)) == ["LGPL-2.1"]
    assert names("This program " + gnu.format("Affero General Public License", 3)) == ["AGPL-3.0"]
    assert names("Released under the Apache License.") == []
    assert names("Licensed under the Educational Community License, Version 2.0") == []
    assert names("This work is licensed under the GNU General Public License, version 4.") == []
    assert names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"] and names("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names(lc.TEMPLATES["BSD-2-Clause"][0]) == ["BSD-2-Clause"] and names(lc.TEMPLATES["BSD-3-Clause"][0]) == ["BSD-3-Clause"]
    assert names(lc.TEMPLATES["BSD"][0] + " as told elsewhere") == ["BSD"]


def test_each_template_is_its_own_license():
    s = lc.Scanner()
    assert all([m[2] for m in s.scan(t)] == [name] for name, texts in lc.TEMPLATES.items() for t in texts)
