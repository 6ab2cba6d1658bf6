"""Operators 11, 12 and 13."""

import bisect
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import alignment, blocks, negatives, scoring
from gleaner.llm.queries import tokenizer

A, B = tokenizer(), tokenizer("piece_bpe_32k.model")


# --- blocks


def test_places():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-(1 << 62), 1 << 62, 5000))
    r.shuffle(keys)
    p = blocks.Places(keys)
    assert (p.of(keys) == np.arange(len(keys))).all()
    assert (p.of(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert (blocks.Places(keys[:0]).of(keys) == -1).all()


def test_sums():
    s, want, r = blocks.Sums(), Counter(), random.Random(2)
    for _ in range(40):
        keys = [r.randrange(-9, 9000) for _ in range(5000)]
        want.update(keys)
        s.add(np.array(keys), np.ones(len(keys), np.int64))
    s.settle()
    assert dict(zip(s.keys.tolist(), s.n.tolist(), strict=True)) == want and (np.diff(s.keys) > 0).all()


# --- 11

TEXTS = [
    "The  quick brown\tfox\n jumps  over", "", None, " ", "a", "x" * 3000, "naïve café — résumé’s “quoted”", "日本語 テキスト です。 mixed", "привет мир ещё", "<|endoftext|> <s> </s> <unk> <0x41> <pad>",
    "tab\t tab  nbsp　 wide  em", "holds ▁ itself", "▁", "🙂 emoji 👩‍👩‍👧 zwj", "line\r\nends\r\n\r\n  indented\n\n\n", "it's we'll I'd 's 123456 12 3.14", "The  quick brown\tfox\n jumps  over", "\x00nul \x1f unit᠎ sep \u0085 next", "é combining İ dotted", "   ", "a " * 500, "ab " * 3 + "\n \n  x",
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    rows, links, of_doc = [], Counter(), []
    for text in texts:
        ia, ib = [], []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
            pieces = [b.id_to_piece(i) for i in ib]
            bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ia, ib = [], []
        mine = []
        if ia:
            ends = [np.cumsum(list(map(len, x))).tolist() for x in (ba, bb)]
            owner = [[k for k, x in enumerate(side) for _ in x] for side in (ba, bb)]
            mine = [(ia[x], ib[y]) for x, y in sorted(set(zip(*owner, strict=True)))]
            cuts = sorted(set(ends[0]) & set(ends[1]))
            groups, x, y = [], 0, 0
            for c in cuts:
                x2, y2 = bisect.bisect_right(ends[0], c), bisect.bisect_right(ends[1], c)
                groups.append(",".join(map(str, ia[x:x2])) + "|" + ",".join(map(str, ib[y:y2])))
                x, y = x2, y2
            rows.append((len(ia), len(ib), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        else:
            rows.append((0, 0, 0, 0, ""))
        links.update(mine)
        of_doc.append(mine)
    most = {}
    for (_, y), n in links.items():
        most[y] = max(n, most.get(y, 0))
    return [(*r[:4], sum(links[p] == most[p[1]] for p in m), sum(links[p] for p in m), r[4]) for r, m in zip(rows, of_doc, strict=True)]


@pytest.mark.parametrize("most", [1, 1 << 19])
def test_link_report(docs, most):
    got = alignment.link_report(docs(TEXTS), A, B, most=most).collect()
    assert len(got) == len(TEXTS)
    want = brute_alignment(TEXTS)
    for r in got:
        assert tuple(r)[1:] == want[r.doc_id], TEXTS[r.doc_id]


def test_link_report_of_random_texts(docs):
    r = random.Random(3)
    signs = "ab e\n\t  .,'é日ж▁<s>09 🙂"
    texts = ["".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(300)]
    got = {x.doc_id: tuple(x)[1:] for x in alignment.link_report(docs(texts), A, B, most=50).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_link_report_of_odd_rows(docs):
    assert alignment.link_report(docs([]), A, B).collect() == []
    got = alignment.link_report(docs(["one two", "one two", None], ids=[None, None, 3]), A, B).collect()
    assert sorted((x.doc_id or 0, x.n_a) for x in got) == [(0, 2), (0, 2), (3, 0)]


def test_groups_give_the_texts_back(docs):
    texts = [t for t in TEXTS if t and "▁" not in t]
    t = alignment.Tokens(A, B)
    for r in alignment.align(docs(texts), A, B).collect():
        x = y = 0
        whole = [b"".join(table[i] for i in ids) for table, ids in ((t.a_bytes, r.a_ids), (t.b_bytes, r.b_ids))]
        assert whole[0] == whole[1] == (" " + texts[r.doc_id]).encode()
        for n, m in zip(r.a_counts, r.b_counts, strict=True):
            assert b"".join(t.a_bytes[i] for i in r.a_ids[x : x + n]) == b"".join(t.b_bytes[i] for i in r.b_ids[y : y + m])
            x, y = x + n, y + m
        assert (x, y) == (len(r.a_ids), len(r.b_ids))


def test_shared_cuts():
    r = random.Random(4)
    for _ in range(300):
        docs_, at = [], 0
        a, b, la, lb = [], [], [], []
        for _ in range(r.randint(1, 4)):
            n = r.randint(1, 60)
            docs_.append(n)
            for ends, last in ((a, la), (b, lb)):
                ends += sorted({*(at + 1 + r.randrange(n) for _ in range(r.randint(0, n))), at + n})
                last.append(len(ends) - 1)
            at += n
        got = alignment.shared_cuts(np.array(a), np.array(b), np.array(la), np.array(lb))
        assert np.array(a)[got].tolist() == sorted(set(a) & set(b))


# --- 12


def brute_scores(texts, learns, depth):
    """Every node's counts in a dictionary, weighted by recursion."""
    end, counts = 255, {}

    def walk(text):
        data = [end] * depth + list((text or "").encode().lower()) + [end]
        for i in range(depth, len(data)):
            before = tuple(data[i - 1 - k] for k in range(depth))
            for bit in range(8):
                yield before, (bit, data[i] >> (8 - bit)), data[i] >> (7 - bit) & 1

    for text, learn in zip(texts, learns, strict=True):
        if learn:
            for before, prefix, one in walk(text):
                for d in range(depth + 1):
                    counts.setdefault((prefix, before[:d]), [0, 0])[one] += 1
    children = {}
    for prefix, before in counts:
        if before:
            children.setdefault((prefix, before[:-1]), []).append((prefix, before))

    def own(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    both = {}
    for node in sorted(counts, key=lambda x: -len(x[1])):
        mine = own(counts[node])
        below = sum(both[c] for c in children.get(node, []))
        both[node] = mine if len(node[1]) == depth else max(mine, below) + math.log1p(math.exp(-abs(mine - below))) - math.log(2)

    def chance(prefix, before, one):
        q = None
        for d in range(depth, -1, -1):
            node = (prefix, before[:d])
            n = counts.get(node, [0, 0])
            here = (n[one] + 0.5) / (sum(n) + 1)
            w = 1 if d == depth else math.exp(own(n) - math.log(2) - both.get(node, 0)) if node in counts else 0.5
            q = here if q is None else w * here + (1 - w) * q
        return q

    return [sum(math.log10(chance(p, b, o)) for b, p, o in walk(t)) for t in texts]


def brute_base(texts, learns):
    import re

    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w] + [None] for t in texts]
    c = Counter(w for ws, x in zip(words, learns, strict=True) if x for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in words]


WORDS = "the a of Über naïve 日本 x Cat cat dog \n \t".split(" ")


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_scores(docs, most):
    r = random.Random(5)
    texts = [" ".join(r.choices(WORDS, k=r.randint(0, 30))) for _ in range(60)] + [None, "", "\xa0\x85", "zzz unseen " * 5, "A" * 400, "a" * 400]
    texts += texts[:4]
    learns = [i % 3 != 0 for i in range(len(texts))]
    got = {x.doc_id: x for x in scoring.score_texts(docs(texts), F.col("doc_id") % 3 != 0, most=most).collect()}
    base, want = brute_base(texts, learns), brute_scores(texts, learns, scoring.DEPTH)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == base[i][:3] and got[i].held_out != learns[i]
        assert got[i].base_score == pytest.approx(base[i][3]) and got[i].score == pytest.approx(want[i], rel=1e-9)


def test_scores_add_up_to_one(docs):
    """The chances of all bytes after a context are a distribution."""
    texts = ["the cat sat", "the dog ran", "abcabc"] + ["the c" + chr(k) for k in range(128)]
    got = scoring.score_texts(docs(texts), F.col("doc_id") < 3).collect()
    assert len(got) == len(texts) and all(x.score < 0 for x in got)
    keys = np.array([int.from_bytes(b"c eht" + bytes([k]), "big") for k in range(256)])
    spark = docs([]).sparkSession
    grams, _ = scoring.grams_of([t.encode() for t in texts[:3]])
    keys_n = {int(k): 0 for k in keys} | {int(k): int(n) for k, n in zip(*np.unique(grams, return_counts=True), strict=True)}
    rows = {x.key: x.log for x in scoring.gram_logs(spark.createDataFrame(list(keys_n.items()), "key long, n long")).collect()}
    assert sum(10 ** rows[int(k)] for k in keys) == pytest.approx(1)


def test_scores_of_odd_rows(docs):
    assert scoring.score_texts(docs([]), F.lit(True)).collect() == []
    got = scoring.score_texts(docs(["a b", None], ids=[None, 1]), F.lit(False)).collect()
    assert sorted((x.n_tokens, x.n_known, x.train_tokens, round(x.score, 6)) for x in got) == [(1, 0, 0, round(8 * math.log10(0.5), 6)), (3, 0, 0, round(32 * math.log10(0.5), 6))]
    got = scoring.score_texts(docs(["a b", "a b"]), F.lit(None).cast("boolean")).collect()
    assert all(not x.held_out and x.n_known == 3 for x in got)


def test_parts_are_cut_between_contexts(spark):
    r = random.Random(6)
    rows = sorted({int.from_bytes(bytes(r.choices([97, 98, 255], k=6)), "big") for _ in range(700)})
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 7]), pa.array([1] * len(rows[i : i + 7]))], names=["key", "n"]) for i in range(0, len(rows), 7)]
    got = list(scoring._parts(iter(batches), 5, most=20))
    assert len(got) > 5 and [k for t in got for k in t.column("key").to_pylist()] == rows
    heads = [{k >> 24 for k in t.column("key").to_pylist()} for t in got]
    assert sum(map(len, heads)) == len(set().union(*heads))


# --- 13


def brute_negatives(rows, anchors, k=5, low=80):
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v, strict=False)), i, lab) for i, lab, v in rows if i != a)
        for ps, p, _ in [s for s in scores if s[2] == la][:k]:
            inside = [(-s, i) for s, i, lab in scores if lab != la and low * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(a, p, n + 1, i, -ps, s) for n, (s, i) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 300, 1 << 29])
def test_negatives(spark, monkeypatch, spread):
    r = random.Random(spread)
    rows = [(i, r.randrange(3) if i % 5 else 0, [r.randint(-spread // 3, spread) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, r.randrange(3), rows[7][2]) for i in range(120)]  # copies: ties
    rows += [(600, 1, []), (601, 9, [1] * 6), (602, 0, [5] * 3)]
    r.shuffle(rows)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 50)
    monkeypatch.setattr(negatives, "STEP", 16)
    got = negatives.mine(spark.createDataFrame(rows, "id long, label long, vector array<long>"), F.col("id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, {i for i, _, _ in rows if i % 20 == 0})


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [0.5, -0.001]), (2, None, [1.0]), (None, 1, [1.0]), (3, 1, None), (4, 1, [nan, 1.0]), (5, 1, [1.0, None]), (6, 1, [-inf]), (7, 1, []), (1, 0, [0.5, -0.001])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<float>, block string, part string")
    assert sorted(map(tuple, negatives.quantised(df).collect())) == [(1, 0, [128, -1]), (1, 0, [128, -1]), (7, 1, [])]
    got = negatives.mine(negatives.quantised(df), F.lit(True)).collect()
    assert got == []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(negatives.quantised(empty), F.lit(True)).collect() == []
