"""Operators 11 to 13: locally consistent phrases, stripes of collocations, Merkle proofs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS, rows_of
from pyspark.sql import functions as F

from sweepledger.llm import collocations as C
from sweepledger.llm import consistent_phrases as P
from sweepledger.llm import merkle_manifest as M
from sweepledger.llm.places import with_places

WORD = 2**64


# Operator 11


def slow_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % WORD
    return x ^ (x >> 31)


def slow_parse(symbols, level):
    """One level, symbol by symbol: the phrases' names, and the place each begins at."""
    runs = []
    for i, s in enumerate(symbols):
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1, i])
    label = [s for s, _, _ in runs]
    for _ in range(3 if level == 1 else 4):
        after = [label[0] & 1]
        for a, b in zip(label, label[1:]):
            place = ((a ^ b) & -(a ^ b)).bit_length() - 1 if a != b else 8
            after.append(2 * place + (b >> place & 1))
        label = after
    names = [int(P.BYTE_NAMES[s]) if level == 1 else s for s, _, _ in runs]
    names = [slow_mix((x + n * int(P.ADD)) % WORD) if n > 1 else x for x, (_, n, _) in zip(names, runs)]
    cuts = [i for i in range(len(runs)) if i == 0 or 0 < i < len(runs) - 1 and label[i - 1] < label[i] > label[i + 1]]
    found = []
    for b, e in zip(cuts, [*cuts[1:], len(runs)]):
        total = sum(x * pow(int(P.BASE), j, WORD) for j, x in enumerate(names[b:e]))
        found.append(slow_mix((total + (e - b) * int(P.ADD) + level) % WORD))
    return found, [runs[c][2] for c in cuts]


def slow_levels(text):
    symbols, places, level = list(text), list(range(len(text))), 0
    while len(symbols) > 1 or level == 0 and symbols:
        level += 1
        symbols, at = slow_parse(symbols, level)
        places = [places[i] for i in at]
        yield level, symbols, places


def slow_names(text):
    names = {n >> 32 for level, found, _ in slow_levels(text) for n in found if level >= P.LEVEL or len(found) == 1}
    return sorted(names)[: P.NAMES]


def texts_of(seed, n):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ab cde.é") for _ in range(rng.randrange(rng.choice([3, 40, 2000])))) for _ in range(n)]
    return [t or "" for t in ODD_TEXTS] + made


def test_phrases_equal_slow_parse():
    texts = [t.encode() for t in texts_of(1, 60)]
    found = defaultdict(list)
    for level, doc, begin, name, _ in P.phrases(texts):
        for d, b, n in zip(doc.tolist(), begin.tolist(), name.tolist()):
            found[d, level].append((n, b))
    for d, text in enumerate(texts):
        want = {level: list(zip(names, places)) for level, names, places in slow_levels(text)}
        assert {level: f for (e, level), f in found.items() if e == d} == want
    values, ends = P.smallest_names(texts)
    assert [values[b:e].tolist() for b, e in zip([0, *ends[:-1]], ends)] == list(map(slow_names, texts))


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(3)
    middle = "".join(rng.choice("the quick brown fox") for _ in range(3000))
    texts = [(a + middle + b).encode() for a, b in [("", ""), ("x", "yy"), ("some other words before ", " and after"), (middle[::-1], middle[::2])]]
    shared = []
    for text, lead in zip(texts, [0, 1, 24, 3000]):
        levels = {}
        for level, doc, begin, name, _ in P.phrases([text]):
            if level <= 4:
                inside = (begin >= lead + 600) & (begin < lead + 2400)
                levels[level] = list(zip((begin[inside] - lead).tolist(), name[inside].tolist()))
        shared.append(levels)
    assert all(x == shared[0] for x in shared[1:]) and len(shared[0][4]) > 10


def slow_likeness(a, b):
    x, y = (sorted({n >> 32 for level, found, _ in slow_levels(t) for n in found if level >= P.LEVEL or len(found) == 1}) for t in (a, b))
    most = len(x) + len(y) if len(x) < P.NAMES and len(y) < P.NAMES else P.NAMES
    union = sorted({*x[: P.NAMES], *y[: P.NAMES]})[:most]
    both = len({*x[: P.NAMES]} & {*y[: P.NAMES]} & set(union))
    return 2 * both / (len(union) + both) if union else 1.0


def test_compared_with_next(spark):
    texts = texts_of(2, 40)
    rows = [(i * 7 % 1000 - 30, t, 1, 2) for i, t in enumerate(texts)] + [(500, "again " * 30, 3, 4)] * 3 + [(None, "no id", 5, 6), (None, None, 5, 6), (501, None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, down int").repartition(5)
    hashes = {r[0]: r[1] for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()}
    order = sorted(rows, key=lambda r: (~r[0] if r[0] is not None else P.LAST, hashes[r[1]]))
    want = []
    for row, following in zip(order, order[1:] + order[:1]):
        own, other = row[1] or "", following[1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        prints = ["".join(f"{n:08x}" for n in slow_names(t.encode())) for t in (own, edited)]
        near = [round(slow_likeness(own.encode(), t.encode()), 9) for t in (edited, other)]
        want.append((row[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), *prints, *near))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in P.compare_with_next(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [tuple(r)[:2] + tuple(r)[5:] for r in P.compare_with_next(docs.where("doc_id = 501")).collect()] == [(501, 0, 1.0, 1.0)]
    assert P.compare_with_next(docs.limit(0)).collect() == []


def test_half_edited_texts_are_half_alike(spark, documents):
    rows = [r for r in P.compare_with_next(documents).collect() if r["n_chars"] >= 1000]
    edited, following = (np.array([r[c] for r in rows]) for c in ("near_edited", "near_next"))
    assert 0.4 < np.median(edited) < 0.6 and np.median(following) < 0.05
    assert (edited >= following).mean() > 0.95


def test_fingerprints_and_spans(spark, odd_docs):
    prints = P.fingerprints(odd_docs).select("doc_id", "text", "fingerprint").collect()
    assert len(prints) == odd_docs.count()
    assert all(r["fingerprint"] == "".join(f"{n:08x}" for n in slow_names((r["text"] or "").encode())) for r in prints)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(5, 20))], "doc_id long, text string")
    spans = defaultdict(list)
    for r in P.document_phrases(docs).collect():
        spans[r["doc_id"]].append((r["begin"], r["end"]))
    for doc_id, text in docs.collect():
        pieces = sorted(spans[doc_id])
        assert [b for b, _ in pieces] + [len(text.encode())] == [0, *(e for _, e in pieces)] if text else not pieces


def test_buckets():
    rng = np.random.default_rng(4)
    keys = rng.integers(-5, 5, (500, 2))
    bounds = np.unique(np.r_[keys[:20], [keys[np.lexsort(keys.T[::-1])[0]]]], axis=0)
    want = [max(i for i, b in enumerate(bounds.tolist()) if b <= k) for k in keys.tolist()]
    assert P.bucket_of(keys[:, 0], keys[:, 1], (bounds[:, 0], bounds[:, 1])).tolist() == want


# Operator 12


def slow_collocations(rows, top=2000, longest=5, least=100, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= share * counts[p[i : i + m]]}
        found = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("least, top, share, block_words", [(100, 2000, 100, 1 << 20), (4, 9, 100, 64), (20, 2000, 60, 700)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top, share, block_words):
    rng = random.Random(least)
    words = "a b c the of x-y Éa ñ b' 漢 \x00z".split()
    gaps = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ""]
    line = lambda: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), line() if i % 50 else None, i, i) for i in range(600)]
    rows += [("en", t, 0, 0) for t in ODD_TEXTS] + [("fr", "one two three four five six, " * 30, 0, 0)] * 4
    docs = spark.createDataFrame(rows, "lang string, text string, n int, prefix int").repartition(4)
    monkeypatch.setattr(C, "HOT_SHARE", least)  # many prefixes in parts, or few
    got = rows_of(C.collocations(docs, top=top, least=least, share=share, block_words=block_words))
    assert got == slow_collocations([r[:2] for r in rows], top=top, least=least, share=share) and got
    assert C.collocations(docs.limit(0)).collect() == []


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """With a bitmap that lets everything through, as a far too small one would."""
    docs = spark.createDataFrame([("en", "to be or not to be that is the question " * 3)] * 9, "lang string, text string")
    want = rows_of(C.collocations(docs, least=20))
    monkeypatch.setattr(C, "frequent_bitmap", lambda phrases: np.full(1 << (C.BITS - 6), 2**64 - 1, np.uint64))
    assert rows_of(C.collocations(docs, least=20)) == want and want


def test_stripes_of_a_block_are_few_rows_whatever_is_frequent():
    words = [b"w%d" % i for i in range(5000)]
    ids = np.r_[np.arange(5000), -1, np.arange(5000), 0].astype(np.int32)
    every = np.full(1 << (C.BITS - 6), 2**64 - 1, np.uint64)
    for width in (2, 3):
        bundles = C.block_stripes("en", words, ids, width, every, {"w7"})
        assert 0 < bundles.num_rows <= 1024
        first, bundle, prefix, known, nexts, counts = C.merged(bundles)
        got = Counter(dict(zip(zip(known.take(prefix).to_pylist(), nexts.to_pylist()), counts.tolist())))
        plain = [f"w{i}" if i >= 0 else "." for i in ids.tolist()]
        phrases = [plain[i : i + width] for i in range(len(plain) - width + 1)]
        assert got == Counter((" ".join(p[:-1]), p[-1]) for p in phrases if "." not in p)


def test_scores_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 1, "a", 3 * 10**12), ("en", 1, "b", 2 * 10**12 + 1), ("en", 2, "a b", 10**12 + 7)]
    counted = spark.createDataFrame(counts, "lang string, width int, phrase string, f long")
    words = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a: (counted, words))
    (row,) = C.collocations(counted).collect()
    assert row["score"] == 1000 * (10**12 + 7) * 9 * 10**15 // (3 * 10**12 * (2 * 10**12 + 1))


# Operator 13


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(level):
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for p, i in zip(proofs, at):
            p.append((i % 2 == 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        at = [i // 2 for i in at]
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], proofs


def slow_manifest(rows):
    leaf = lambda row: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [slow_tree(list(map(leaf, g))) for g in groups]
    root, over = slow_tree([t[0] for t in trees])
    out = []
    for group, (subroot, proofs), top in zip(groups, trees, over):
        for row, proof in zip(group, proofs):
            doc_id, n_chars = row[0], row[3]
            changed = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            own = leaf((*row[:3], n_chars + 1, row[4]) if changed else row)
            for before, digest in proof + top:
                own = sha((digest or "") + own if before else own + (digest or ""))
            out.append((doc_id, leaf(row), subroot, root, sha("".join(d for _, d in proof + top if d)), own, own == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, level int, root int"


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en", None]), (7, ["en"]), (300, [None, "en", "fr", "é", "zz"]), (2600, ["en", "en", "de"])])
def test_manifest_equals_brute_force(spark, n, langs):
    rng = random.Random(n)
    rows = [
        (i if i % 9 else None, f"s{i % 3}" if i % 4 else None, rng.choice(langs), i if i % 5 else None, rng.choice([None, "", "é" * (i % 50)]), 1, 2, 3)
        for i in range(1, n + 1)
    ] + [(5, "a", langs[0], 1, "twice", 1, 2, 3)] * (3 if n > 1 else 0)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = M.manifest_digest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert rows_of(got) == slow_manifest([r[:5] for r in rows])


def test_manifest_of_nothing(spark):
    assert M.manifest_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_proofs_without_broadcast(spark, monkeypatch):
    """Nodes are shuffled where they are not small, with the same proofs; columns with the results' names are replaced, others kept."""
    rows = [(i, f"g{i % 3}", hashlib.sha256(str(i).encode()).digest(), i, i) for i in range(500)]
    leaves = spark.createDataFrame(rows, "i long, g string, d binary, place int, `own.tree` int")
    want = rows_of(M.merkle_proofs(leaves, "g", ["i"], "d"))
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    proofs = M.merkle_proofs(leaves, "g", ["i"], "d")
    assert rows_of(proofs) == want
    assert proofs.columns == ["i", "g", "d", "own.tree", "place", "subroot", "root", "proof"]
    checked = proofs.select(M.folded(F.col("d"), F.col("proof")).alias("up"), "root", F.size("proof").alias("n"))
    assert checked.where("up != root OR n != 10").count() == 0  # 8 levels over 167 leaves, 2 over 3 groups


def test_places(spark):
    rows = [(random.Random(i).choice(["a", None, "b"]), i * 37 % 500) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got, sizes = with_places(frame, ["g"], [F.col("v").asc()], "at")
    want = {(g, v, sum(1 for h, w in rows if h == g and w < v)) for g, v in rows}
    assert set(map(tuple, got.collect())) == want and dict(sizes.collect()) == Counter(g for g, _ in rows)
