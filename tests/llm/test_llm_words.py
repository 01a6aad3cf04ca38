"""Operators 2, 5 and 8 against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from conftest_llm import LOWER, lower_words, rows_of
from pyspark.sql import functions as F

from sweepledger.llm.components import components
from sweepledger.llm.license_templates import Automaton, Scanner, scan_licenses
from sweepledger.llm.positional_index import find_passages, keep_clean, passage_digest
from sweepledger.llm.shared import row_places, without_places
from sweepledger.llm.simhash import keep_one, links_within, near_duplicates


def brute_passages(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = lower_words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = lower_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if held := windows.get(tuple(w[k : k + n])):
                    found |= held
                    hit.update(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def pairs(frame, key="doc_id"):
    return [tuple(r) for r in frame.select(key, "text").collect()]


def random_corpus(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choice(["a ", "b ", "the ", "É-", "x,"]) for _ in range(rng.randint(0, 300)))) for i in range(50)]
    items = [(i, docs[i % 40][1][5 : 5 + rng.randint(0, 60)]) for i in range(30)] + [(None, "b b a"), (3, None), (1, "a " * 30)]
    docs += [(None, None), (7, ""), (8, "a " * 3000), (8, "a " * 3000)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [1 << 19, 40])
def test_passages_equal_brute_force(spark, block_words):
    docs, items = random_corpus(spark)
    found = passage_digest(find_passages(docs, items, block_words=block_words))
    assert rows_of(found) == brute_passages(pairs(docs), pairs(items, "item_id"))


def test_passages_of_the_tables(spark, documents, testdata):
    items = spark.read.parquet(f"{testdata}/benchmark.parquet")
    found = rows_of(passage_digest(find_passages(documents, items)))
    assert found == brute_passages(pairs(documents), pairs(items, "item_id")) and any(r[-1] for r in found)


def test_passages_of_odd_texts(spark, odd_docs):
    items = spark.createDataFrame([(1, "A b"), (2, None), (2, "word word word")], "item_id long, text string")
    assert rows_of(passage_digest(find_passages(odd_docs, items))) == brute_passages(pairs(odd_docs), pairs(items, "item_id"))
    none = items.limit(0)
    assert {r[-1] for r in rows_of(passage_digest(find_passages(odd_docs, none)))} == {False}
    assert find_passages(odd_docs.limit(0), items).count() == 0
    kept = keep_clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    clean = [d for d, *_, hit in brute_passages(pairs(odd_docs), pairs(items, "item_id")) if not hit]
    assert sorted(map(str, clean)) == sorted(str(r["doc_id"]) for r in kept.collect())


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x c b y a x"), (2, "c b y y a"), (3, "a b x"), (4, "a a c"), (5, "b a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    near = {r["doc_id"] for r in find_passages(docs, items, slop=1).collect() if r["spans"]}
    assert near == {1}
    assert {r["doc_id"] for r in find_passages(docs, items, slop=2).collect() if r["spans"]} == {1, 2}
    twice = spark.createDataFrame([(1, "a a b")], "item_id long, text string")
    assert not [r for r in find_passages(docs, twice, slop=5).collect() if r["spans"]]


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", first.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def test_near_duplicates_of_the_tables(documents):
    assert rows_of(near_duplicates(documents)) == brute_groups(pairs(documents))


def test_near_duplicates_of_odd_texts(odd_docs):
    groups = brute_groups(pairs(odd_docs))
    assert rows_of(near_duplicates(odd_docs)) == groups
    assert near_duplicates(odd_docs.limit(0)).count() == 0
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    with_id = {g for _, _, g in groups if g is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(with_id)
    assert kept.count() == len(with_id) + len({f for _, f, g in groups if g is None})


def test_rows_keep_their_places_when_splits_change(spark, recut):
    read, collect = recut
    texts = [f"w{i // 2} x{i // 2} y{i // 2} z{i // 2}" for i in range(12)]
    docs = read([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(collect(keep_one(docs))) == [(i, t) for i, t in enumerate(texts) if i % 2 == 0]
    items = spark.createDataFrame([(1, "w0 x0 y0 z0"), (2, "w4 x4 y4 z4")], "item_id long, text string")
    assert sorted(collect(keep_clean(docs, items))) == [(i, t) for i, t in enumerate(texts) if i // 2 not in (0, 4)]


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_dropping_by_place(odd_docs, monkeypatch, limit):
    """Broadcast or shuffled, the same rows go, and none but those."""
    monkeypatch.setattr("sweepledger.llm.shared.BROADCAST_BYTES", limit)
    placed = row_places(odd_docs, "at")
    gone = placed.where("length(text) > 5")
    kept = without_places(placed, gone.union(gone), "at")
    assert kept.columns == odd_docs.columns
    assert rows_of(kept) == rows_of(odd_docs.where("text IS NULL OR length(text) <= 5"))
    assert rows_of(without_places(placed, gone.limit(0), "at")) == rows_of(odd_docs)


def test_row_places(spark, odd_docs):
    """Places differ from row to row, also where rows of a file stand several times."""
    twice = odd_docs.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    for frame in (odd_docs, odd_docs.union(odd_docs), twice, spark.range(50), odd_docs.join(odd_docs.select("doc_id"), "doc_id")):
        placed = row_places(frame, "at")
        assert placed.count() == frame.count() == placed.select("at").distinct().count()
    assert row_places(odd_docs, "at").schema["at"].dataType.simpleString() == "struct<file:bigint,row:bigint>"


@pytest.mark.parametrize("distance, segments", [(3, 2), (3, 4), (1, 2), (2, 2), (5, 4)])
def test_links_are_all_pairs_within(spark, distance, segments):
    rng = random.Random(1)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(5):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x - (1 << 64) if x >> 63 else x)
    frame = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    near = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert {tuple(r) for r in links_within(frame, distance, segments).collect()} == near


def test_probes_are_not_broadcast(spark):
    plan = links_within(spark.range(100).selectExpr("id AS fingerprint"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(700)] + [(10**6, 10**6 + i) for i in range(1, 500)] + [(5, 5), (None, 3), (1, 2)]
    random.Random(2).shuffle(links)
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(701)} | {10**6 + i: 10**6 for i in range(500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl,gpl-3"),
    "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by,cc-by-nc-4.0"),
    "cc by cc by-nc-sa 3.0 x CC BY 4.0": ("cc-by", "cc-by,cc-by-4.0,cc-by-nc-sa-3.0"),
    "Licensed under the Apache\nLicense, Version 2.0.": ("apache", "apache,apache-2.0"),
    "released under the MIT License": ("mit", "mit,mit-notice"),
    "a mit license": ("mit", "mit"),
    "GNU General Public License": ("gpl", "gpl"),
    "gnu general public licenses": ("", ""),
    "GNU Lesser General Public License version 3 7 days later": ("", "lgpl-3"),
    "GNU Lesser General Public License version 2.1 or later": ("", "lgpl-2.1"),
    "GNU Library General Public License version 2, 1999": ("", "lgpl-2"),
}


def test_license_notices(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    found = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in scan_licenses(docs).collect()}
    assert found == dict(enumerate(NOTICES.values()))


GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
    'shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
    "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
    "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
FORMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
ENDORSE = (
    "3. Neither the name of Some Name nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n"
)
BY = (
    "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def test_whole_license_texts_without_a_base_phrase():
    from sweepledger.llm.license_templates import PHRASES, TEMPLATES

    texts = {
        f"x Copyright (c) 2020 A. Name and others\n{GRANT} y": "mit-text",
        f"// {GRANT}": "mit-text",
        f"Copyright 2021, B\nAll rights reserved.\n{FORMS}{BY}": "bsd-2-clause-text",
        f"{FORMS}{ENDORSE}{BY}": "bsd-3-clause-text",
        f"Copyright (c) 1999 C {ISC}": "isc-text",
        "under the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of": "lgpl-2.1",
        "GNU Affero General Public License, version 3": "agpl-3",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy": "mpl-2.0",
        GRANT.replace("sublicense", "lend"): None,
    }
    scanner = Scanner(PHRASES, TEMPLATES)
    for text, label in texts.items():
        found = scanner.scan(text)
        assert not found["base"] and [n["label"] for n in found["notices"]] == ([label] if label else [])
    assert [n["label"] for n in scanner.scan("Apache License 2.0")["notices"]] == ["apache-2.0"]


def test_every_template_of_a_text_accepts_its_own_words():
    from sweepledger.llm.license_texts import TEXTS

    for label, template in TEXTS:
        words = re.sub(r"<<(?:begin|end)Optional>>|<<var;match=\.\+.*?>>", "", template).replace("<<var;match=https?>>", "https")
        (notice,) = Scanner({}, [(label, template)]).scan(f"x {words} y")["notices"]
        assert (notice["label"], notice["begin"], notice["end"]) == (label, 1, len(words.split()) + 1)


def test_license_phrases_equal_brute_force(spark, documents, odd_docs):
    from sweepledger.llm.license_templates import PHRASES

    for docs in (documents, odd_docs):
        want = []
        for d, t in pairs(docs):
            w = lower_words(t)
            places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            starts = [i for i, _ in places]
            want.append((d, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
        got = scan_licenses(docs)
        assert rows_of(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=str)
        assert got.where("NOT score BETWEEN 0 AND 1").count() == 0
        assert got.where("array_size(array_except(split(base_labels, ','), split(labels, ','))) > 0").count() == 0


def test_automaton_regions():
    template = "<<beginOptional>>a <<beginOptional>>b <<endOptional>><<endOptional>>c <<var;match=[0-9]+;least=0;most=2;name=n>> d"
    automaton = Automaton("l-{n}", template)
    accepted = lambda t: (automaton.accept(t.encode().split(), 0) or (0,))[0]
    assert [accepted(t) for t in ("c d", "a c d", "a b c d", "b c d", "c 1 d", "c 1 2 d", "c 1 2 3 d", "c", "c x d")] == [2, 3, 4, 0, 3, 4, 0, 0, 0]
    assert Scanner({"m n": "x"}, [("t", template)]).scan("A, b; c d m N")["notices"][0]["end"] == 4
    with pytest.raises(ValueError):
        Automaton("l", "<<beginOptional>>a")
