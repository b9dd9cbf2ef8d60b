"""Operators 2, 4, 5, 6, 7, 8, 9 and the pipeline against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import ann, bagminhash, licenses, pii, pq, toxicity, warc
from trellis.llm.components import connected


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


# operator 2


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def test_pii_is_valid_linked_and_whole(spark):
    rows = [
        (1, "x 4041894974608795 y +1 (988) 555-2485, a.b1@mail.example.com 10.1.2.3 2024-01-31 123-45-6789", "c"),
        (2, "card 4041-8949-7460-8795 tel 988-555-2485 on 31.01.2024 or 31/01/2024; A.B1@mail.example.com", "c"),
        (3, None, "c"), (4, "", "c"), (5, "v1.2.3.4.5 300.1.1.1 4041894974608796 2024-02-30 000-12-3456", "c"), (1, "same 10.1.2.3", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_found string")
    out = pii.pseudonymise(docs, "k", count_col="n").collect()
    a, b = out[0].text, out[1].text
    card, phone = re.search(r"\d{16}", a)[0], re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4})", a)[1]
    assert luhn(card) and card != "4041894974608795" and card[0] == "4"
    assert re.sub(r"\D", "", re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", b)[0]) == card
    assert re.sub(r"\D", "", re.search(r"tel (\S+)", b)[1]) == re.sub(r"\D", "", phone)
    day = re.search(r"\d{4}-\d{2}-\d{2}", a)[0]
    assert "/".join(reversed(day.split("-"))) in b and ".".join(reversed(day.split("-"))) in b
    mail = re.search(r"(\S+)@mail.example.com", a)[1]
    assert mail != "a.b1" and re.fullmatch(r"[a-z]\.[a-z]\d", mail) and mail + "@mail" in b
    assert re.search(r"\d+\.\d+\.\d+\.\d+", a)[0] == out[5].text[5:] != "10.1.2.3"
    assert [r.n for r in out] == [6, 5, 0, 0, 0, 1] and out[2].text is None and out[4].text == rows[4][1]
    assert all(r.pii_found == "c" for r in out)


def test_pii_cards_among_other_numbers(spark):
    card = "4111111111111111"
    spaced, dashed = "4111 1111 1111 1111", "4111-1111-1111-1111"
    forms = [
        spaced + " 12/26", card + " 123", dashed + "-123", dashed + "-1234", "12 " + spaced, "12-" + dashed, "12 35 " + spaced + " 12 26 123",
        spaced + " 31/12/2024", card + " 10.1.2.3",
    ]
    docs = spark.createDataFrame([(i, f"pay {t} now {card}.") for i, t in enumerate(forms)], "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()]
    made = re.search(r"now (\d+)", out[0])[1]
    assert luhn(made) and made != card
    for text, form in zip(out, forms, strict=True):
        assert made in re.sub("[ -]", "", text.split("now")[0]), form
        assert spaced not in text and dashed not in text and card not in text, form
    assert "31/12/2024" not in out[7] and "10.1.2.3" not in out[8]


def test_pii_telephones_after_plus_one(spark):
    same = ["+12125551234", "+1 2125551234", "+1 (212) 555-1234", "+1-212-5551234", "+1.212.555.1234"]
    low = ["+1 (123) 555-1234", "+11235551234", "+1 (212) 155-1234", "+1 000 000 0000"]
    rows = [(i, f"call {t}, now") for i, t in enumerate([*same, *low, "(123) 555-1234", "+1 21255512345"])]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert all(re.sub("[0-9]", "9", t) == re.sub("[0-9]", "9", r[1]) for t, r in zip(out, rows, strict=True))
    made = [re.sub("[^0-9]", "", t) for t in out]
    assert len(set(made[:5])) == 1 and made[0] != "12125551234" and made[0][1] >= "2" <= made[0][4]
    assert made[5] == made[6] != "11235551234" and len({*made[5:9]}) == 3 and all(m[0] == "1" and (m[1] < "2" or m[4] < "2") for m in made[5:9])
    assert all(t != r[1] for t, r in zip(out[:9], rows, strict=False)) and [out[9], out[10]] == [rows[9][1], rows[10][1]]


def test_feistel_is_a_permutation(spark):
    grid = spark.range(35 * 12).select((F.col("id") % 35).alias("l"), F.floor(F.col("id") / 35).alias("r"))
    out = grid.select(pii.feistel("k", F.lit("t"), F.col("l"), F.col("r"), F.lit(35), F.lit(12)).alias("x")).distinct()
    assert out.count() == 420 and out.where("x.l < 0 or x.l >= 35 or x.r < 0 or x.r >= 12").count() == 0
    plan = pii.pseudonymise(spark.range(1).select(F.lit("a").alias("text")), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# operator 4


def test_chain_learns_and_keeps_clean(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        toxic, junk = i % 7 == 0, i % 5 == 0
        text = words(rng, 60) + " " + " ".join(rng.choice(["Vilebad,", "nastyword", "horrid."]) for _ in range(2 * toxic))
        rows.append((i, text + " x$$$ y%%%" * junk, 0))
        marks.append((i, int(not junk), int(toxic)))
    rows += [(1000, None, 0), (1001, "", 0), (0, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic int").repartition(3)
    labels = spark.createDataFrame(marks + [(2000, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels.where("doc_id < 400"), {k: f() for k, f in toxicity.CHAIN.items()})
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    truth = {i: bool(t) for i, _, t in marks}
    assert np.mean([got[i].rejected == truth[i] for i in range(400, 600)]) > 0.98
    assert not got[1000].rejected and not got[1001].rejected and 0 <= got[5].p_junk <= 1
    kept = {r.doc_id for r in toxicity.keep_clean(docs, chain).collect()}
    assert kept == {i for i, r in got.items() if not r.rejected}
    none = toxicity.train(docs.limit(0), labels, {k: f() for k, f in toxicity.CHAIN.items()})
    assert not any(r.rejected for r in toxicity.score(docs, none).collect())


def test_chain_equals_a_dense_one(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        rows.append((i, words(rng, 20) + (" vile bad" if toxic and rng.random() < 0.9 else "") + (" zz** qq" if junk else "") + rng.choice(["", " bad", " zz**"])))
        marks.append((i, None if i % 11 == 0 else int(not junk), None if i % 13 == 0 else int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([*marks, (5000, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, {k: f() for k, f in toxicity.CHAIN.items()})
    hashed = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)).alias("f")).collect()}
    known = [(i, q, t) for i, q, t in marks if not (q is None and t is None)]
    text, texts = dict(rows), []
    label = lambda q, t: [None if q is None else q == 0, None if t == 0 else None, None if t is None else t == 1]
    y = []
    for _, q, t in known:
        prose = False if t == 0 or q == 0 else None if q is None or t is None else True
        y.append([v if v is None else float(v) for v in (label(q, t)[0], prose, label(q, t)[2])])
    y = np.array(y, np.float64)
    texts = [toxicity.text_features(text[i]) for i, _, _ in known]
    folds = np.array([hashed[i] for i, _, _ in known])

    def choose(train):
        kept = set()
        for k in range(3):
            on = train & ~np.isnan(y[:, k])
            n, pos, found = on.sum(), (y[on, k] == 1).sum(), []
            for f in {f for t in texts for f in t}:
                has = np.array([f in t for t in texts])
                total, hits = (has & on).sum(), (has & on & (y[:, k] == 1)).sum()
                both = (total + 1) / (n + 2)
                z = abs((hits + 0.5) / (pos + 1) - (total - hits + 0.5) / (n - pos + 1)) / np.sqrt(both * (1 - both) * (1 / (pos + 1) + 1 / (n - pos + 1)))
                if total >= 4 and z >= 4:
                    found.append((-z, f))
            kept |= {f for _, f in sorted(found)[:600]}
        return sorted(kept)

    dense = lambda names: np.array([[float(t.get(f, 0)) for f in names] for t in texts]).reshape(len(texts), len(names))
    empty = lambda n: toxicity._Sparse(n, 0, *[np.zeros(0, np.int64)] * 2, np.zeros(0))
    sets = {f: choose(folds != f) for f in (-1, *range(5))}
    earlier, weights = np.zeros((len(texts), 0)), []
    for k in range(3):
        ok, held = ~np.isnan(y[:, k]), np.zeros(len(texts))
        whole = np.hstack([dense(sets[-1]), earlier])
        weights.append(toxicity.fit_linear(empty(ok.sum()), whole[ok], y[ok, k]))
        for f in range(5):
            both, on = np.hstack([dense(sets[f]), earlier]), ok & (folds != f)
            w = toxicity.fit_linear(empty(on.sum()), both[on], y[on, k])
            held[folds == f] = 1 / (1 + np.exp(-(both[folds == f] @ w[:-1] + w[-1])))
        earlier = np.column_stack([earlier, held])
    assert sorted(chain.columns) == sets[-1] and len(sets[-1]) >= 2
    for a, b in zip(chain.weights, weights, strict=True):
        assert np.allclose(a, b, atol=1e-6)


# operators 5 and 8


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16))
    x[500:560] = x[7] + 0.08 * rng.standard_normal((60, 16))
    x[600:605] = x[9]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [1.0] * 15]
    rows += [(1000 + i, v, 2) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4), x


@pytest.mark.parametrize("block", [90, 32768])
def test_collision_counting_recall(vectors, monkeypatch, block):
    monkeypatch.setattr(ann, "ROW_BLOCK", block)
    df, x = vectors
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = ann.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    assert sorted(by) == list(range(0, 700, 50))
    for q, found in by.items():
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(700), -s))[:5]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 5 and all(abs(score - s[v]) < 1e-12 for v, score in found)
    assert hits >= 0.9 * 5 * len(by)
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") == 0, 5).collect()
    assert len(few) == 2 and ann.search(df.limit(0), F.lit(True), 5).collect() == []


def test_collision_counting_verifies_few():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64))
    arrays, unit = ann.Arrays(x, np.arange(6000), 5), x / np.linalg.norm(x, axis=1)[:, None]
    queries, hits = np.arange(0, 6000, 100), 0
    for a in range(0, 60, 16):
        some = queries[a : a + 16]
        for q, (rows, _) in zip(some, arrays.nearest(x[some], some), strict=True):
            s = unit @ unit[q]
            s[q] = -2
            hits += len(set(rows.tolist()) & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 300 and arrays.verified <= 0.15 * 60 * 6000  # unclustered vectors are the hardest


def test_collision_counting_with_repeats_and_ties(spark):
    rows = [(50, [1.0, 2.0], 1), (50, [1.0, 2.0], 2), (50, [3.0, -1.0], 3), (7, [2.0, 4.0], 4), (3, [1.0, 2.0], 5), (9, [1.0], 6), (100, [2.0], 7)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 50 == 0, 5)
    nulls = ann.search(spark.createDataFrame([(0, [1.0]), (None, [2.0]), (4, [2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5)
    assert sorted((r.rank, r.vec_id) for r in nulls.collect()) == [(1, 4), (2, None)]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert out[100] == [(1, 9)] and sorted(out[50]) == sorted([(1, 3), (2, 7), (3, 50), (4, 50)] * 2 + [(1, 3), (2, 7), (3, 50), (4, 50)])


@pytest.mark.parametrize("block", [100, 16384])
def test_product_quantisation_equals_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    monkeypatch.setattr(pq, "QUERY_BLOCK", 2 * block)
    monkeypatch.setattr(pq, "QUERY_BATCH", 64)
    monkeypatch.setattr("trellis.llm.components.HOT_ROWS", 20)
    df, x = vectors
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(700)
    for _ in range(20):
        label = np.minimum(label, np.where(near, label[None, :], 9999).min(1))
    got = {r.vec_id: r for r in pq.links(df, 0.9).collect()}
    assert len(got) == 706
    assert [got[i].n_links for i in range(700)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(700)] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(1000, 1006))
    assert pq.links(df.limit(0)).collect() == []


def test_product_quantisation_with_copies_and_lengths(spark, monkeypatch):
    monkeypatch.setattr("trellis.llm.components.HOT_ROWS", 20)
    rows = [(i, [1.0, 2.0, 0.0], "a") for i in range(60)] + [(7, [1.0, 2.0, 0.01], "b"), (None, [1.0, 2.0], "c"), (90, [2.0, 4.0], "c"), (91, [0.0, 1.0, 0.0], "d"), (92, [-1.0], "e")]
    got = pq.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(
        [(False, i, 60, 0, i == 0) for i in range(60)] + [(False, 7, 60, 0, False), (True, None, 1, 90, False), (False, 90, 1, 90, True), (False, 91, 0, 91, True), (False, 92, 0, 92, True)]
    )


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 420)]
    root = list(range(420))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(pairs + [(None, 1)], "a long, b long").where("a is not null")).collect()}
    assert all(got.get(v, v) == find(v) for v in range(420))


# operator 6


def test_licences():
    known = licenses.Sentences()
    mit = "\n".join(licenses.SENTENCES[i][0] + "." for i in ("mit.grant", "mit.notice", "mit.warranty"))
    wrapped = "# " + mit.replace(" copy,", " copy,\n# ")
    name = lambda t: [m[0] for m in licenses.match_rules(known.find(t))]
    assert name(mit) == ["MIT"] and name("MIT License\n\n" + wrapped) == ["MIT"]
    assert name("Text. Licensed under the Apache License, Version 2.0.\nMore; released under the mit license.") == ["Apache-2.0", "MIT"]
    assert name("foo\nLicensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and name("") == []
    assert name("it is not licensed under the MIT licensees") == [] and name("Permission granted") == []


def test_real_notices():
    name = lambda t: [m[0] for m in licenses.match_rules(licenses.known_sentences().find(t))]
    assert name("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == ["CC-BY-SA-4.0"]
    lgpl = " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n"
    assert name(lgpl) == ["LGPL-2.1-or-later"] and name(lgpl.replace("Lesser ", "").replace("2.1", "3")) == ["GPL-3.0-or-later"]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    assert name(apache) == ["Apache-2.0"]
    for text, found in {
        "Apache-2.0 OR MIT": ["Apache-2.0", "MIT"], "GPL-3.0-or-later": ["GPL-3.0-or-later"], "GPL-2.0+": ["GPL-2.0-or-later"], "gpl-2.0": ["GPL-2.0-only"],
        "(GPL-2.0-only WITH Classpath-exception-2.0) AND ISC */": ["GPL-2.0-only WITH Classpath-exception-2.0", "ISC"], "LicenseRef-own": ["LicenseRef-own"],
        "MIT. And so on": ["MIT"], "nothing known": [], "MIT AND": ["MIT"], "": [],
    }.items():
        assert sorted(name(f"// SPDX-License-Identifier: {text}\nint x;")) == sorted(found), text
    assert name("Boost Software License - Version 1.0 - August 17th, 2003") == ["BSL-1.0"] and name("Made available under the terms of the Eclipse Public License v 2.0.") == ["EPL-2.0"]


def naive_find(text, wordings, longest):
    words, out, free = list(re.finditer(r"\w+", text)), [], 0
    for i, w in enumerate(words):
        if w.start() < free or not licenses._begins(text, w.start()):
            continue
        for n in range(min(longest, len(words) - i), 0, -1):
            identifier = wordings.get(tuple(x.group().lower() for x in words[i : i + n]))
            if identifier and licenses._END.match(text, words[i + n - 1].end()):
                out.append((identifier, w.start(), words[i + n - 1].end()))
                free = out[-1][2]
                break
    return out


def naive_rules(found, gap=licenses.GAP):
    left, out = list(range(len(found))), []
    for licence, wanted in licenses.RULES:
        k = 0
        while k < len(left):
            used, at = [], k
            for identifier in wanted:
                hit = next((j for j in range(at, min(len(left), at + (gap + 1 if used else 1))) if found[left[j]][0] == identifier), None)
                if hit is None:
                    break
                used.append(hit)
                at = hit + 1
            if len(used) == len(wanted):
                out.append((licence, found[left[used[0]]][1], found[left[used[-1]]][2]))
                left = [i for j, i in enumerate(left) if j not in used]
            else:
                k += 1
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def test_licences_equal_a_naive_matcher():
    known, rng = licenses.known_sentences(), random.Random(12)
    tokens = lambda t: tuple(re.findall(r"\w+", t.lower()))
    wordings = {tokens(w): i for i, ws in licenses.SENTENCES.items() for w in ws}
    names = {tokens(w): i for i, ws in licenses.SENTENCES.items() if i.startswith("name.") for w in ws}
    for lead in [(), *{tokens(a + b) for a in licenses._LEADS for b in licenses._ARTICLES}]:
        wordings |= {(*lead, *n): i for n, i in names.items()} | ({("the", *n): i for n, i in names.items()} if not lead else {})
    longest, pool = max(map(len, wordings)), [w for ws in licenses.SENTENCES.values() for w in ws]
    for _ in range(150):
        text = ""
        for _ in range(rng.randint(0, 12)):
            some = rng.choice(pool)
            some = " ".join(some.split()[: rng.randint(1, 60)]) if rng.random() < 0.3 else some
            text += rng.choice(["", "Released under ", "This file is licensed under the ", "x ", "the "]) + rng.choice([some, some.upper(), some.replace(" ", "\n# ", 2)]) + rng.choice([". ", ".\n", " ", ", ", "\n\n", " x "])
        found = known.find(text)
        assert found == naive_find(text, wordings, longest), text
        assert licenses.match_rules(found) == naive_rules(found)
    identifiers = sorted({i for _, w in licenses.RULES[:40] for i in w})
    for _ in range(400):
        found = [(rng.choice(identifiers[:14]), 2 * k, 2 * k + 1) for k in range(rng.randint(0, 25))]
        assert licenses.match_rules(found) == naive_rules(found)


def test_licences_in_very_long_texts():
    import time

    began = time.monotonic()
    for text, n in (("MIT License.\n" * 30_000, 30_000), (" " * 1_000_000 + "MIT License", 1), ("Permission is hereby " * 50_000, 0), ("SPDX-License-Identifier: " * 30_000, 0), ("SPDX-License-Identifier: MIT OR " + "(" * 100_000, 1)):
        assert len(licenses.match_rules(licenses.known_sentences().find(text))) == n
    assert time.monotonic() - began < 60


def test_licence_sentences_far_from_the_line_start():
    known = licenses.Sentences()
    for before in (" " * 20, "x\n" + " " * 16, "x\n * " + " " * 12, "//" + "=" * 20 + "\n//" + " " * 30, "x." + " " * 40, "\n" + "*" * 5000):
        assert [f[0] for f in known.find(before + "MIT License\n")] == ["name.MIT"], before
    for before in ("x" + " " * 40, "x_" + "*" * 40, "x. y" + " " * 12):
        assert known.find(before + "MIT License\n") == [], before
    # same answers as the pattern over the whole text before the word
    start, rng = re.compile(r"(?:[.!?;:,(|\"]\s*|\n[^\w\n]*|\A\W*)\Z"), random.Random(6)
    for _ in range(3000):
        before = "".join(rng.choice("a_. \n*\t,-(") for _ in range(rng.randint(0, 9)))
        assert licenses._begins(before + "MIT", len(before)) == bool(start.search(before)), before


def test_licence_scan(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "Released under the MIT License.", "b"), (2, "Released under the MIT License.", "b")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, tuple(r.licences)) for r in licenses.scan(docs).collect())
    assert got == [(1, ()), (2, ("MIT",)), (2, ("MIT",))]
    assert licenses.scan(docs.limit(0)).collect() == []


# operator 7


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a = (np.sort(h[:300]), rng.integers(1, 6, 300))
    b = (np.sort(h[100:]), rng.integers(1, 6, 300))
    both, i, j = np.intersect1d(a[0], b[0], return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    truth = low / (a[1].sum() + b[1].sum() - low)
    assert abs(bagminhash.similarity(a, b) - truth) < 1e-12
    found = np.mean(bagminhash.signature(a, 2048) == bagminhash.signature(b, 2048))
    assert abs(found - truth) < 4 * np.sqrt(truth * (1 - truth) / 2048)


def test_unlike_texts_share_no_shingles():
    bits = [bin(i).count("1") % 2 for i in range(2048)]  # Thue-Morse and its complement
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    assert bagminhash.similarity(*map(bagminhash.shingles, texts)) == 0.0
    assert bagminhash.similarity(*map(bagminhash.shingles, (" ".join(t) for t in texts))) > 0.9  # the same five-letter runs
    rng = random.Random(1)
    seen, text = {}, [rng.choice(["aa", "ab", "ba", "b", "aab", "a\u00e9"]) for _ in range(4000)]
    hashes, counts = bagminhash.shingles(" ".join(text))
    for i in range(len(text) - 4):
        seen[tuple(text[i : i + 5])] = seen.get(tuple(text[i : i + 5]), 0) + 1
    assert sorted(counts.tolist()) == sorted(seen.values()) and len(hashes) == len(seen)


def test_links_between_blocks_are_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 150).astype(np.uint64))
    bags = []
    for _ in range(60):
        keep = base[rng.random(len(base)) < rng.choice([1, 0.95, 0.9, 0.6])]
        bags.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(1, 25)).astype(np.uint64)])))
    may = rng.random((25, 35)) < 0.9
    got = set(zip(*(x.tolist() for x in bagminhash.links_between(bags[:25], bags[25:], may, 0.8)), strict=True))
    share = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert got == {(i, k) for i in range(25) for k in range(35) if may[i, k] and share(bags[i], bags[25 + k]) >= 0.8} and len(got) > 20


def brute_classes(rows):
    """(row number to class root) by all pairs; rows are (id, text)."""
    bags = [bagminhash.shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda v: v if label[v] == v else find(label[v])
    for i in range(len(rows)):
        for k in range(i):
            if len(bags[i][0]) and bagminhash.similarity(bags[i], bags[k]) >= 0.8:
                a, b = find(i), find(k)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [8, 512])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", block)
    monkeypatch.setattr("trellis.llm.components.HOT_ROWS", block)
    rng = random.Random(7)
    rows, base = [], words(rng, 120).split()
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(120)] = words(rng, 1)
        rows.append((i, " ".join(copy) if i < 80 else words(rng, rng.randint(1, 80))))
    rows += [(200, rows[100][1]), (201, rows[100][1].upper()), (202, None), (203, ""), (204, "  "), (205, "one two"), (206, "one  two"), (200, rows[100][1])]
    rows += [(5, rows[120][1]), (None, rows[121][1]), (None, rows[130][1] + " x"), (None, "null alone"), (204, "\t")] + [(300 + i, "many same") for i in range(30)]
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, same_node string, kept_id int").repartition(3)
    roots, ids = brute_classes(rows), {}
    for (d, t), r in zip(rows, roots, strict=True):
        ids.setdefault(r, []).append(d)
    least = lambda r: min((d for d in ids[r] if d is not None), default=None)
    expected = sorted(((d, least(r), len(ids[r])) for (d, _), r in zip(rows, roots, strict=True)), key=str)
    got = bagminhash.classes(docs)
    assert sorted(((r.doc_id, r.class_id, r.n_class) for r in got.collect()), key=str) == expected
    out = bagminhash.keep_one(docs)
    kept = sorted(r.kept_id for r in out.collect())
    assert out.columns == docs.columns and [roots[i] for i in kept] == sorted(set(roots), key=[roots[i] for i in kept].index) and len(kept) == len(set(roots))
    assert all(rows[i][0] == least(roots[i]) for i in kept)
    assert bagminhash.classes(docs.limit(0)).collect() == [] and bagminhash.keep_one(docs.limit(0)).collect() == []


# operator 9


def test_warc_round_trip(spark):
    rng = random.Random(3)
    big = words(rng, 9000) + " é日👧 "
    html = [None, "", "short", "short", big, big, "x" * 1000, "x" * 1000, "a\r\n\r\nb\n\n", "é" * 20000, big]
    pages = spark.createDataFrame([(i, f"http://x/{i} y", h, "z") for i, h in enumerate(html)] + [(None, None, big, "z")], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(warc.round_trip(pages, with_payload=True).collect(), key=lambda r: (r.page_id is None, r.page_id))
    for r in got:
        text = big if r.page_id is None else html[r.page_id] or ""
        data = text.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        last = max(i for i, h in enumerate(html) if (h or "") == text)
        revisit = r.page_id is not None and len(data) >= 1000 and r.page_id != last
        assert (r.record_type, r.refers_to) == (("revisit", last) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == data
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_of_other_writers(spark, tmp_path):
    import base64
    import gzip

    def record(k, body, version=b"WARC/1.0", **more):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:{k}>", "WARC-Page": k, "Content-Length": len(block), **more}
        return version + b"\r\n" + "".join(f"{a}: {b}\r\n" for a, b in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    raw = [record(k, b"body %d" % k * 50, **{"WARC-Payload-Digest": b32(b"body %d" % k * 50)}) for k in range(3000)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw[:2900]))  # a member for each record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(raw[2900:2990])))
    (tmp_path / "c.warc").write_bytes(b"".join(raw[2990:]))
    got = warc.read(spark, str(tmp_path), with_payload=True).collect()
    assert sorted((r.page, bytes(r.payload)) for r in got) == [(k, b"body %d" % k * 50) for k in range(3000)]
    with pytest.raises(ValueError):
        warc.inflate(gzip.compress(b"x" * 100)[:-3])
    many = [b"r%d" % k for k in range(50)]
    assert warc.inflate(warc._EMPTY_MEMBER.join(map(warc.member, many))) == gzip.decompress(b"".join(map(warc.member, many))) == b"".join(many)


def test_warc_framing():
    for data in (b"", b"a", b"x" * 4096, b"y" * 9999):
        assert warc.dechunked(warc.chunked(data)) == data
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


# the pipeline


def test_pipeline_stages_equal_plain_lists(spark, tmp_path, monkeypatch):
    """Each stage on its own input, with nulls, repeats, empty and clashing columns, against a list version."""
    import zlib

    import corpus_pipeline
    import public_tokenizers
    import test_pii
    from tokenizers import Tokenizer

    from trellis.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9001, None, "en", None, None), (9002, "", "en", "s", 0), (9003, "  ", None, "s", 2), (None, "no id at all, mail a.b@x.org", "en", "s", 5), (9004, "twice the same " * 9, "en", "s", 9), (9005, "twice the same " * 9, "en", "s", 9), (9004, "twice the same " * 9, "en", "s", 9)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    docs = docs.withColumns({"rejected": F.lit("r"), "same_node": F.lit(1), "kept_id": F.lit(2)}).repartition(3)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    listed = lambda df: sorted(map(tuple, df.collect()), key=str)

    rows = listed(docs)
    clean = steps["toxicity"](spark, docs, str(tmp_path))
    rate = toxicity.train(docs, labels, {k: f() for k, f in toxicity.CHAIN.items()}).scorer()
    assert clean.columns == docs.columns and listed(clean) == sorted((r for r in rows if not r[1] or rate(r[1])[-1] < 0.5), key=str)

    clean.write.parquet(f"{tmp_path}/clean")
    clean = spark.read.parquet(f"{tmp_path}/clean")
    rows = listed(clean)
    once = steps["near_duplicates"](spark, clean, str(tmp_path))
    roots, least = brute_classes([r[:2] for r in rows]), {}
    for r, root in zip(rows, roots, strict=True):
        least.setdefault(root, []).append((r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()[:16], r))
    expected = sorted((min(v, key=lambda x: x[:3])[3] for v in least.values()), key=str)
    assert once.columns == docs.columns and listed(once) == expected

    once.write.parquet(f"{tmp_path}/once")
    once = spark.read.parquet(f"{tmp_path}/once")
    rows = listed(once)
    hidden = steps["pii"](spark, once, str(tmp_path))
    monkeypatch.setattr(test_pii, "KEY", queries.PII_KEY)
    made = [(r[0], test_pii.plain(r[1])[0] if r[1] is not None else None, *r[2:]) for r in rows]
    made = sorted(((*r[:4], r[4] if r[1] is None else len(r[1]), *r[5:]) for r in made), key=str)
    assert hidden.columns == docs.columns and listed(hidden) == made

    hidden.write.parquet(f"{tmp_path}/hidden")
    pieces = steps["packing"](spark, spark.read.parquet(f"{tmp_path}/hidden"), str(tmp_path)).collect()
    coder, want, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], []
    for r in made:
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 2]
        parts = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == r[0] and p.doc_tokens == len(ids))
        got.append(parts)
        want.append([(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n, _ in parts])
        assert sum(n for _, n, _ in parts) == len(ids) * sum(x[0] == r[0] and x[1] == r[1] for x in made)
    assert got == want
    line = sorted((p.sequence_id * 4096 + p.offset, p.length) for p in pieces)
    assert [a for a, _ in line] == np.cumsum([0, *(n for _, n in line[:-1])]).tolist()

    assert sorted((p.doc_id is None, p.doc_id or 0, p.start, p.length) for p in corpus_pipeline.run(spark, str(tmp_path)).collect())[0][3] > 0
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
