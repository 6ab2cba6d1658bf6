"""Operators 1, 2 and 7 against brute force."""

import hashlib
import random

import pytest

from gleaner.llm import neardup, substrings, suffixes


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, repeats inside a text, odd spaces, nulls and empty ones."""
    r = random.Random(2)
    passage = words(r, 70)
    texts = [" ".join(words(r, r.randint(3, 150))) for _ in range(30)]
    texts += [" ".join(words(r, 20) + passage[: r.randint(45, 70)] + words(r, 20)) for _ in range(12)]
    texts += [texts[0], texts[3], texts[3], texts[31], None, "", " \n\t ", "one", "a b c d e", "a b c d e", "A B c D e"]
    base = words(r, 90)
    for _ in range(12):
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = "edit"
        texts.append(" ".join(copy))
    texts.append(" ".join(["tick"] * 300))
    texts.append("x" * 500 + " é " + "x" * 500)
    texts.append(" ".join(words(r, 60)) + "\x0b" + "  ".join(passage))
    r.shuffle(texts)
    return texts


def expected_windows(texts, ids, n):
    w = {k: (t or "").encode().split() for k, t in enumerate(texts)}
    first = {}
    for k, x in w.items():
        for j in range(len(x) - n + 1):
            key = tuple(x[j : j + n])
            first[key] = min(first.get(key, ids[k]), ids[k])
    out = []
    for k, x in w.items():
        gone = [False] * len(x)
        for j in range(len(x) - n + 1):
            if first[tuple(x[j : j + n])] < ids[k]:
                gone[j : j + n] = [True] * n
        kept = b" ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out.append((ids[k], len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n", [50, 7])
def test_repeated_words(docs, corpus, n):
    ids = [3 * k for k in range(len(corpus))]
    got = substrings.remove_repeats(docs(corpus, ids), length=n)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == expected_windows(corpus, ids, n)


def test_repeated_words_of_one_id_and_null_ids(docs, corpus):
    a = " ".join(map(str, range(60)))
    got = sorted(substrings.remove_repeats(docs([a, a, a, "short", a], [5, 5, 9, 9, None])).select("doc_id", "n_removed").collect(), key=str)
    assert [tuple(r) for r in got] == [(5, 0), (5, 0), (9, 0), (9, 60), (None, 0)]


def test_difference_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("f", [substrings.remove_repeats, suffixes.remove_repeated_bytes, neardup.near_duplicates])
def test_empty_table(docs, f):
    assert f(docs([])).collect() == []


def expected_bytes(texts, ids, n):
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    seen, out = set(), []
    for k in order:
        t = (texts[k] or "").encode()
        gone = bytearray(len(t))
        for j in range(len(t) - n + 1):
            s = t[j : j + n]
            if s in seen:
                gone[j : j + n] = b"\1" * n
            seen.add(s)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((ids[k], len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("n", "options"), [(100, {}), (100, {"group": 1}), (20, {"bucket": 10, "group": 1}), (61, {"group": 2}), (100, {"group": 3, "bucket": 50})])
def test_repeated_bytes(docs, corpus, n, options):
    ids = [100 - k for k in range(len(corpus))]
    got = suffixes.remove_repeated_bytes(docs(corpus, ids), length=n, **options)
    assert sorted(map(tuple, got.collect())) == expected_bytes(corpus, ids, n)


def test_suffix_classes():
    r = random.Random(5)
    for _ in range(200):
        n, letters = r.choice([3, 5, 8]), r.choice([b"ab", b"abc", bytes(range(256))])
        strings = [bytes(r.choices(letters, k=r.randint(n, n + 12))) for _ in range(r.randint(1, 12))]
        got, want = {}, {}
        for a, b, k in zip(*(x.tolist() for x in suffixes.suffix_classes(strings, n)), strict=True):
            got.setdefault(k, set()).add((a, b))
        for i, s in enumerate(strings):
            for j in range(len(s) - n + 1):
                want.setdefault(s[j : j + n], set()).add((i, j))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_suffix_classes_from_a_minimizer():
    """Windows around a common middle are classed by their bytes and by how far from it they start."""
    r = random.Random(6)
    for _ in range(200):
        n, middle = r.choice([6, 9]), r.choice(["xyz", "aaa"])
        strings, begin = [], []
        for _ in range(r.randint(1, 12)):
            b = r.randint(0, n - 3)
            rest = n - 3 + r.randint(0, b) - b
            strings.append("".join([*r.choices("ab", k=b), middle, *r.choices("ab", k=max(0, rest))]).encode())
            begin.append(b)
        got, want = {}, {}
        for a, b, k in zip(*(x.tolist() for x in suffixes.suffix_classes(strings, n, begin)), strict=True):
            got.setdefault(k, set()).add((a, b))
        for i, s in enumerate(strings):
            for j in range(min(begin[i] + 1, max(0, len(s) - n + 1))):
                want.setdefault((begin[i] - j, s[j : j + n]), set()).add((i, j))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_contexts_are_split_without_loss():
    r = random.Random(7)
    for _ in range(300):
        n, span = 20, r.randint(3, 19)
        begin = r.randint(0, n - span)
        string = bytes(r.choices(b"ab", k=n + r.randint(0, begin)))
        parts = suffixes.split_context(string, begin, span, n)
        starts = []
        for offset, part, at, wide in parts:
            assert part == string[offset : offset + len(part)] and span < wide <= n
            for j in range(len(part) - n + 1):
                starts.append(offset + j)
                assert j <= at and at + wide <= j + n
        assert sorted(starts) == list(range(len(string) - n + 1))


def test_large_text_is_cut_in_pieces(monkeypatch):
    r = random.Random(1)
    text = bytes(r.choices(b"ab ", k=5000))
    whole = suffixes.Cutter(100).runs(text)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    _, start, count, left = suffixes.Cutter(100).runs(text)
    assert (left >= 0).all() and (count <= left + 1).all()
    assert count.sum() == whole[2].sum() == len(text) - 99
    at = [x for s, c in zip(start, count, strict=True) for x in range(s, s + c)]
    assert at == list(range(len(text) - 99))


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_groups(texts, ids, links=None):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(shingles(t)), find(i), find(i) == i) for i, t in zip(ids, texts, strict=True))


def test_near_duplicates(docs, corpus):
    ids = [2 * k for k in range(len(corpus))]
    got = neardup.near_duplicates(docs(corpus, ids))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == expected_groups(corpus, ids)


@pytest.mark.parametrize("block", [4, 256])
def test_chains_in_one_bucket(docs, monkeypatch, block):
    """Near copies that are linked in a chain, and many that share a passage but are not linked."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(8)
    base = words(r, 100, 10**6)
    texts = []
    for k in range(30):
        base = list(base)
        for j in range(2):
            base[(7 * k + 50 * j) % 100] = f"new{k}x{j}"
        texts.append(" ".join(base))
    passage = words(r, 60, 10**6)
    texts += [" ".join(passage + words(r, r.randint(8, 40), 10**6)) for _ in range(40)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    got = neardup.near_duplicates(docs(texts, ids))
    assert sorted(map(tuple, got.collect())) == expected_groups(texts, ids)


def test_near_duplicates_of_null_and_repeated_ids(docs):
    a = " ".join(map(str, range(40)))
    got = neardup.near_duplicates(docs([a, a, "other words stand here now", a], [7, 7, 7, None])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(7, 7, True)] * 3 + [(None, None, True)]


def test_sketch_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    whole = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for n in (3, 40, 1000):
        a, b = np.unique(whole[: 3 * n]), np.unique(whole[n : 4 * n])
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sk = neardup.sketches([a, b, a[:0]], 2000)
        assert abs((sk[0] == sk[1]).mean() - want) < (0.06 if n > 3 else 0.5)
        assert (sk[2] == 0).all()


def test_keep_first(docs, corpus):
    d = docs(corpus)
    kept = neardup.keep_first(d)
    assert kept.columns == d.columns
    want = [i for i, _, _, k in expected_groups(corpus, list(range(len(corpus)))) if k]
    assert sorted(r.doc_id for r in kept.collect()) == want
