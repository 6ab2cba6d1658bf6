"""Operators 3, 4, 5, 9 and 10."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, fingerprints, html, language, secrets
from gleaner.llm.common import Windows

KEY = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def brute_base(text):
    text, out = text or "", []
    for rank, (pattern, group, least) in enumerate(((secrets.ASSIGN, 2, 6), (secrets.ACCESS, 0, 20), (secrets.HEX, 0, 24))):
        for m in re.finditer(pattern, text, re.I | re.A if rank == 0 else 0):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


TEXTS = [
    f'a token = "{KEY}" b', f"é Password: hunter22 and {KEY}", "secret: token: abcdefgh", "token==abcdef api-key=zzzzzz apikey=zzzzzz", None, "",
    "AKIA" + "B" * 16 + " AKIAB AKIA" + "9" * 40, "x" * 3000 + f" api_key={KEY[:8]}", "lonely Zx81kQ0vB7sT3nM5pL9w here", "again Zx81kQ0vB7sT3nM5pL9w", "copied aB3dE5fG7hJ9kL1mN2pQ", "copied aB3dE5fG7hJ9kL1mN2pQ",
    "copied aB3dE5fG7hJ9kL1mN2pQ", "ſecret=abcdefg 12345678901234567890 ",
]
SOURCES = ["a", "b", "c", "a", "b", "c", "a", None, "a", "a", "a", "b", "c", "a"]


def test_secrets(docs):
    got = secrets.secret_report(docs(TEXTS, sources=SOURCES)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        base = brute_base(TEXTS[r.doc_id])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[8] == "owned:7:27" and spans[9] == "owned:6:26"  # one owner
    assert spans[10] == spans[11] == spans[12] == ""  # three owners: an example
    assert {r.doc_id: r.n_live for r in got}[0] == 0  # its value also stands with another owner


def test_owned_spans_by_brute_force(docs):
    """Counts by owners and repositories, and which bare strings are live, on random corpora."""
    import math
    from collections import Counter

    r = random.Random(12)
    values = ["".join(r.choices("ABCDEFghijklmnop0123456789", k=24)) + "7" for _ in range(60)] + ["word" * 6, "1" * 24, "a1" * 14]
    texts, sources = [], []
    for _ in range(150):
        sources.append(r.choice(["a", "a", "b", "c", None]))
        own = values[["a", "b", "c", None].index(sources[-1]) :: 4] if r.random() < 0.8 else values
        texts.append(" ".join(r.choice([f"w{r.randrange(50)}", r.choice(own), f"token={r.choice(own)}"]) for _ in range(r.randint(1, 5))))
    for k in range(10):  # mirrored texts
        texts.append(texts[k])
        sources.append("m")

    def bare(t):
        base = brute_base(t)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            n = Counter(m[0])
            bits = -sum(x / len(m[0]) * math.log2(x / len(m[0])) for x in n.values())
            if re.search("[0-9]", m[0]) and not m[0].isdigit() and bits >= 3 and not any(s < m.end() and m.start() < e for s, _, e in base):
                yield m.start(), m.end(), m[0]

    held = {}
    for i, t in enumerate(texts):
        owner = f"={sources[i]}" if sources[i] else t
        found = [v for *_, v in bare(t)]
        for s, k, e in brute_base(t):
            found.append(re.search(secrets.ASSIGN, t[s:e], re.I | re.A)[2] if k == 0 else t[s:e])
        for v in found:
            held.setdefault(v, set()).add((owner, i, t))
    live = set()
    for v, rows in held.items():
        owners = {}
        for o, _, t in rows:
            owners.setdefault(o, set()).add(t)
        everywhere = {t for *_, t in rows}
        repos = {min(str(i) for _, i, t in rows if t == text) for text in everywhere}
        if len(owners) < 3 and len(repos) < 10 and (len(owners) == 1 or any(x == everywhere for x in owners.values())):
            live.add(v)
    got = {x.doc_id: x.spans for x in secrets.secret_report(docs(texts, sources=sources)).collect()}
    assert 0 < len(live) < len(held)
    for i, t in enumerate(texts):
        want = [(s, 3, e) for s, e, v in bare(t) if v in live] + brute_base(t)
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want)), t


def test_secrets_of_repeated_rows_and_empty_table(docs):
    got = secrets.secret_report(docs([TEXTS[0], TEXTS[0], "none"], [4, 4, 4])).collect()
    assert sorted(r.spans for r in got) == ["", "assign:2:43,hex:11:43", "assign:2:43,hex:11:43"]
    assert secrets.secret_report(docs([])).collect() == []


def test_redaction(docs):
    d = docs(TEXTS[:3] + ["clean", None], [1, 1, 2, 3, 4], ["a"] * 5)
    got = secrets.redact(d)
    assert got.columns == d.columns
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text is not None)
    assert rows == [(1, "a [secret]\" b", 13), (1, "é [secret] and [secret]", 23), (2, "secret: token: abcdefgh", 23), (3, "clean", 5)]
    assert sum(r.text is None for r in got.collect()) == 1


def test_fingerprints(docs):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(r.randint(1, 400))) for _ in range(40)] + [None, "", "é" * 9, "same text here", "same text here"]
    ids = [7 * k for k in range(len(texts))]
    got = {x.doc_id: x for x in fingerprints.imatch(docs(texts, ids)).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        t, n = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        new = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        a, b = map(fingerprints.from_text, (x.fingerprint, got[ids[(k + 1) % len(ids)]].fingerprint))
        assert x.near_next == fingerprints.likeness(a, b)
    assert got[ids[43]].fingerprint == got[ids[44]].fingerprint and got[ids[43]].near_next == 1
    long = [x for k, x in enumerate(got.values()) if x.n_chars > 400]
    assert np.mean([x.near_edited for x in long]) > 0.3 > 0.1 > np.mean([x.near_next for x in long])


def brute_fingerprints(texts, low=0.2, high=0.95):
    """I-Match by plain numbers: frequencies of terms, the band, and for each subset the sum of its terms' mixed hashes."""
    import math

    import xxhash

    full = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def terms(t):
        return sorted({x for w in t.encode().split() if (x := w.strip(bytes(c for c in range(33, 127) if not chr(c).isalnum())).lower())})

    df = {}
    for t in texts:
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
    n = max(2, len(texts))
    band = {x for x, k in df.items() if low <= math.log(n / k) / math.log(n) <= high}

    def fingerprint(t):
        mine = [x for x in terms(t) if x in band] or terms(t)
        hashed = [mix(xxhash.xxh3_64_intdigest(x) * 0xD6E8FEB86659FD93 & full) for x in mine]
        out = ""
        for d, density in enumerate((16, 64, 256, 1024, 4096)):
            salt = mix((d + 1) * 0x9E3779B97F4A7C15 + 7 & full)
            for k in range(16):
                inside = [x | 1 for x in hashed if mix(x ^ salt) % density == k]
                total = mix(sum(inside) & full)
                out += f"{(total & 0xFFFF) or 1:04x}" if total else "0000"
        return out

    return fingerprint


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_fingerprints_by_brute_force(docs, most):
    r = random.Random(9)
    texts = [" ".join(r.choice(["the", "The,", "and", f"t{r.randrange(60)}", f'"T{r.randrange(900)}.', "--", "é"]) for _ in range(r.randint(0, 90))) for _ in range(60)] + [None, "", "the and", "unique words only"]
    sign = brute_fingerprints([t or "" for t in texts])
    got = fingerprints.imatch(docs(texts), most=most).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(texts)))
    for x in got:
        t, n = texts[x.doc_id] or "", texts[(x.doc_id + 1) % len(texts)] or ""
        new = fingerprints.edited(t, n)
        assert x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (x.fingerprint, x.edited_fingerprint) == (sign(t), sign(new)), t
        assert (x.near_edited, x.near_next) == tuple(fingerprints.likeness(fingerprints.from_text(sign(t)), fingerprints.from_text(sign(y))) for y in (new, n))


def test_fingerprints_of_names(spark, docs):
    """Ids that are no numbers."""
    rows = spark.createDataFrame([(f"n{k}", f"text {k % 3} a b c") for k in range(9)], "name string, text string")
    got = {x.doc_id: x for x in fingerprints.imatch(rows, id_col="name").collect()}
    assert sorted(got) == [f"n{k}" for k in range(9)] and got["n0"].fingerprint == got["n3"].fingerprint


def test_fingerprint_of_one_and_none_and_ties(docs):
    (x,) = fingerprints.imatch(docs(["just one document"], [None])).collect()
    assert x.near_next == 1
    assert fingerprints.imatch(docs([])).collect() == []
    assert len(fingerprints.imatch(docs(["b c", "a b", "a b"], [1, 1, 1])).collect()) == 3


def brute_tiles(p, t, least):
    fp, ft, out = [True] * len(p), [True] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and fp[i + n] and ft[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return sum(out)
        for i, j in found:
            if all(fp[i : i + best]) and all(ft[j : j + best]):
                fp[i : i + best] = ft[j : j + best] = [False] * best
                out.append(best)


def test_tiling():
    r, w = random.Random(3), Windows(0x9E3779B97F4A7C15)
    for k in range(900):
        few = r.choice([2, 3, 4, 6])
        p, t = [r.randint(1, few) for _ in range(r.randint(3, 36 if k % 3 else 20))], [r.randint(1, few) for _ in range(r.randint(3, 36))]
        if r.random() < 0.6:
            k = r.randrange(len(p))
            t = t[:10] + p[k:] + t[10:20] + p[:k] + t[20:]
        got = decontaminate.tiles(*(np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (p, t)), 3, w)
        assert all(p[i : i + n] == t[j : j + n] for i, j, n in got)
        assert sum(n for *_, n in got) == brute_tiles(p, t, 3)


def test_leaks(spark, docs, monkeypatch):
    r = random.Random(4)
    item = [f"q{r.randrange(10**6)}" for _ in range(30)]
    noise = lambda n: [f"z{r.randrange(10**6)}" for _ in range(n)]
    texts = [
        " ".join(noise(30) + item + noise(30)), " ".join(noise(5) + item[15:] + noise(9) + item[:15]), " ".join(w.upper() + ",\n" for w in item), " ".join(noise(80) + item[:10]),
        " ".join(noise(200)), None, "", " ".join(item[::-1]), " ".join(sum(([x, "zz"] for x in item), [])),
    ]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "y"), (3, "two words", "z"), (4, "", "")], "item_id long, text string, doc_id string")
    for most in (1 << 27, 1 << 15):
        monkeypatch.setattr(decontaminate, "MOST_BITS", most)
        got = decontaminate.find_leaks(docs(texts), bench).collect()
        assert sorted((x.doc_id, x.item_id, x.coverage) for x in got) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0)]
        kept = decontaminate.drop_leaks(docs(texts), bench)
        assert sorted(x.doc_id for x in kept.collect()) == [3, 4, 5, 6, 7, 8]
    odd = docs([texts[0], texts[0], "clean", texts[0], None], [None, 5, None, 5, None])
    assert sorted(map(str, (x.doc_id for x in decontaminate.find_leaks(odd, bench).collect()))) == ["5", "5", "None"]
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and sorted(map(str, (x.text for x in kept.collect()))) == ["None", "clean"]
    assert len(decontaminate.find_leaks(docs([texts[0]] * 2, [5, 5]), bench.unionByName(bench)).collect()) == 2
    assert decontaminate.find_leaks(docs([]), bench).collect() == []
    assert decontaminate.find_leaks(docs(texts), bench.where("false")).collect() == []


def brute_leaks(texts, items, share, least):
    out = []
    for i, t in texts.items():
        t = re.findall(r"\w+", (t or "").lower())
        for j, p in items.items():
            p = re.findall(r"\w+", (p or "").lower())
            if len(p) >= least and len(set(t)) and len({tuple(p[k : k + least]) for k in range(len(p))} & {tuple(t[k : k + least]) for k in range(len(t) - least + 1)}):
                total = brute_tiles(p, t, least)
                if total >= share * len(p):
                    out.append((i, j, len(p), total))
    return sorted(out)


def test_leaks_by_brute_force(spark, docs):
    r = random.Random(14)
    items = {k: " ".join(f"v{r.randrange(40)}" for _ in range(r.randint(3, 14))) for k in range(12)}
    texts = {}
    for k in range(60):
        words = [f"v{r.randrange(40)}" for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(list(items.values())).split()
            a = r.randrange(len(w))
            at = r.randint(0, len(words))
            words[at:at] = w[a : a + r.randint(3, 9)]
        texts[k] = " ".join(words)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontaminate.find_leaks(docs(list(texts.values()), list(texts)), bench).collect()
    want = brute_leaks(texts, items, 0.5, 4)
    assert sorted((x.doc_id, x.item_id, x.item_words, x.tiled_words) for x in got) == want and len(want) > 10


PAGE = """<!doctype html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body>
<header class="site"><h1>Site name</h1><p>A tagline of the site that is long enough to look like text.</p></header>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies here. Please accept all of them right now.</p></div>
<article><h1>Title &amp; more</h1><p><b>Bold start.<br><p>First   paragraph, with a <a href=x>link</a>&nbsp;in it.
<form><label>Your mail</label><input></form><p>Short.</p><aside><p>Read these other things that you may like as well.</p></aside>
<!-- <p>hidden</p> --><p title="a > b">Last paragraph of the text &lt;here&gt;.</p></article>
<section class="comments"><p>I liked this a lot, thanks for writing it. Really.</p></section>
<footer><p>Copyright of a company with a long name and address.</p></footer>"""
MAIN = "Title & more Bold start. First paragraph, with a link in it. Short. Last paragraph of the text <here>."


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2), (3, "v", "", 3), (None, "w", "<p>Only a plain sentence of words stands here.", 4), (5, "x", "<", 5)], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].text == MAIN and got[1].n_chars == len(MAIN)
    assert (got[2].text, got[2].url, got[3].text) == ("", None, "")
    assert got[None].text == "Only a plain sentence of words stands here."
    assert html.extract(pages.limit(0)).collect() == []


def test_cut_is_minimal():
    """The labels cost no more than any other labelling."""
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 9)
        left = [r.choice([0, r.randint(-90, 90), r.randint(-500, 500)]) for _ in range(n)]
        edges = [(i, j, r.choice([0, 5, 40, 90])) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda m: sum(max(0, -x) if m >> i & 1 else max(0, x) for i, x in enumerate(left)) + sum(c for i, j, c in edges if (m >> i & 1) != (m >> j & 1))  # noqa: E731, B023
        got = sum(int(k) << i for i, k in enumerate(html.minimum_cut(left, edges)))
        assert cost(got) == min(map(cost, range(1 << n)))


def test_smoothness_follows_the_tree():
    found, tree = html.blocks("<div><p>One two.<p>Three four.</div><div><div><p>Five <b>six</b>.</p></div><p><a href=x>Seven</a></div><p>Eight.")
    assert [b.text for b in found] == ["One two.", "Three four.", "Five six.", "Seven", "Eight."]
    # distances 2, 5, 3 and 3 in page order; Seven is a link, so 90 is 27 where it stands
    assert [c for i, j, c in html.smoothness(found, tree) if j == i + 1] == [90, 90 // 4, 27 // 2, 27 // 2]
    assert html.smoothness([html.Block("a", 0, 0, "")] * 2, tree) == [(0, 1, 90)]


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return html.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_learned_costs(spark, sf_dir, weights):
    """On pages that mark nothing, the fitted costs find the text that the marks told of."""
    assert weights != html.PRIOR and all(0.5 <= w / p <= 2 for w, p in zip(weights, html.PRIOR, strict=True))
    assert html.learn(spark.createDataFrame([], "html string")) == html.PRIOR
    got = want = both = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        blank = html.main_text(re.sub("(</?)(article|main)", r"\1div", r.html), weights).split()
        told = html.main_text(r.html, weights).split()
        from collections import Counter

        got, want, both = got + len(blank), want + len(told), both + (Counter(blank) & Counter(told)).total()
    assert both >= 0.97 * want and both >= 0.97 * got


def test_pages_of_odd_markup_with_learned_costs(weights):
    assert html.main_text(PAGE, weights) == MAIN
    for w in ('div class="overflow-hidden"', 'div class="has-sidebar"', 'div class="comments-open category-social"', 'div class="sidebar"', "form"):
        assert html.main_text(f"<body><{w}>{PAGE.split('<body>')[1]}</{w.split()[0]}>", weights) == MAIN
    page = "".join(f"<p>{PARAGRAPHS[k % 2]}</p><p><a href=x>Read the next one here</a></p>" for k in range(60))
    assert html.main_text(page, weights) == " ".join(PARAGRAPHS * 30)


def test_articles_of_the_table(spark, sf_dir):
    import html as entities

    for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inside))).split())
        assert r.text == want


def test_language(spark, sf_dir, docs):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(docs):
    r = random.Random(1)
    kinds = {"en": "the of and with that", "de": "der und nicht für ein", "fr": "le la et pour une", "es": "el los y para una", "xx": "zug bork dva"}
    texts = [" ".join(r.choices(v.split(), k=30)) for v in kinds.values() for _ in range(12)] + [None, "", "12 34 !!", "the and of"]
    langs = [k for k in kinds for _ in range(12)] + ["en", "en", "en", None]
    got = {x.doc_id: x for x in language.identify(docs(texts, langs=langs)).collect()}
    assert [got[60 + k].lang_pred for k in range(4)] == ["und", "und", "und", "en"]
    assert got[60].score == 0 and sum(got[k].lang_pred == langs[k] for k in range(60)) > 55
    assert {x.lang_pred for x in language.identify(docs(["a b"], langs=[None])).collect()} == {"und"}
    assert language.identify(docs([])).collect() == []
    kept = language.reject(docs(texts, langs=langs))
    assert sorted(x.doc_id for x in kept.collect()) == [*range(60), 63]


def test_letters_are_the_unicode_category():
    assert not any(map(language.has_letter, [None, "", "12 ²½", "Ⅷ", "〇", "٣", "_-", "\u0301"]))
    assert all(map(language.has_letter, ["1a", "é", "ß²", "Ω", "字", "ʰ"]))


def test_no_language_is_too_large_to_sample():
    for count in (1, 400, 10**6, 5 * 10**8, 10**13):
        share = language.lowest(400, count) / language.SPACE
        assert share == 1 if count <= 400 else 0.99 < share * count / 400 < 1.01


def test_reject_without_labels(docs):
    d = docs(["some words", "12", None, "ja"], [1, 2, None, None], langs=[None] * 4)
    assert sorted(map(str, (x.doc_id for x in language.reject(d).collect()))) == ["1", "None"]
    assert language.reject(docs([])).collect() == []


def test_doubtful_language_goes(spark, sf_dir, docs):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = [(r.text, r.lang) for r in d.where("length(text) > 100").orderBy("doc_id").collect()]
    r = random.Random(2)
    junk = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    junk += ["Sää on tänään erittäin kaunis ja menemme lasten kanssa rannalle uimaan ja leikkimään hiekassa koko päivän", "Погода сегодня очень хорошая и мы едем с детьми на пляж чтобы купаться и играть в песке весь день"]
    half = {v: next(t for t, lang in clean if lang == v and len(t) > 400)[:400] for v in ("en", "fr")}
    junk.append(half["en"] + " " + half["fr"])
    texts, langs = [t for t, _ in clean] + junk, [v for _, v in clean] + [None] * len(junk)
    kept = {x.doc_id for x in language.reject(docs(texts, langs=langs)).collect()}
    assert not kept & set(range(len(clean), len(texts)))
    assert len(kept) >= 0.99 * len(clean) and {langs[k] for k in kept} == {v for _, v in clean}


def test_redaction_of_null_ids(docs):
    d = docs([TEXTS[0], "clean", None, f"other {KEY} end", TEXTS[0], TEXTS[0]], [None, None, None, None, None, 5], ["a"] * 6)
    got = sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in secrets.redact(d).collect())
    assert got == [(0, "", 0), (0, 'a [secret]" b', 13), (0, 'a [secret]" b', 13), (0, "clean", 5), (0, "other [secret] end", 18), (5, 'a [secret]" b', 13)]


def test_secrets_by_owners_and_repositories(docs):
    wide, mirrored, shared = "Zx81kQ0vB7sT3nM5pL9w", "aB3dE5fG7hJ9kL1mN2pQ", "Qm4nB6vC8xZ0lK2jH4gF"
    rows = [(f"guide {k} {wide}", "a") for k in range(12)]  # copied widely inside one owner
    rows += [(f"mine {mirrored}", "a"), (f"mine {mirrored}", "b"), (f"also mine {mirrored}", "b")]  # one text of b's is mirrored
    rows += [(f"null {k} {shared}", None) for k in range(3)]  # owners that are not known to be one
    got = {r.doc_id: r for r in secrets.secret_report(docs([t for t, _ in rows], sources=[s for _, s in rows])).collect()}
    assert [got[k].spans for k in range(12)] == [""] * 12 and got[0].n_example == 1 and got[0].counts == "8:1:12"
    assert [got[k].spans for k in (12, 13, 14)] == ["owned:5:25", "owned:5:25", "owned:10:30"] and got[12].counts == "5:2:2"
    assert [got[k].spans for k in (15, 16, 17)] == [""] * 3 and got[15].counts == "7:3:3"


@pytest.mark.parametrize("wrapper", ['div class="overflow-hidden"', 'div aria-hidden="false"', 'div title="a hidden valley"', 'div class="has-sidebar"', 'div class="content-sidebar-wrap"', 'div class="comments-open category-social"', 'div class="sidebar"', "form"])
def test_html_of_wrappers(wrapper):
    body = PAGE.split("<body>")[1]
    assert html.main_text(f"<body><{wrapper}>{body}</{wrapper.split()[0]}>") == MAIN
    article = "<article" + wrapper[wrapper.find(" ") :] + ">" if 'class="sidebar"' not in wrapper and " " in wrapper else "<article>"
    assert html.main_text(PAGE.replace("<article>", article)) == MAIN


def test_html_that_is_not_shown_and_formulas():
    long = "This sentence is not shown to anyone who reads the page, long as it is."
    for mark in ("hidden", 'hidden="hidden"', 'aria-hidden="true"', 'style="display: none"'):
        assert html.main_text(PAGE.replace("<p>Short.", f"<div {mark}><div><p>{long}</p></div></div><p>Short.")) == MAIN
    got = html.main_text(PAGE.replace("First   paragraph,", "First <math><mi>x</mi><mo>+</mo><mn>1</mn></math> <svg><path d='M0'></path><text>label</text></svg> <object>data</object> paragraph,"))
    assert got == MAIN.replace("First paragraph,", "First x+1 label data paragraph,")


PARAGRAPHS = ["The first of two paragraphs that tell of something at some length, as an article would do.", "The second goes on with it, and it too has enough words to be read as the text of the page."]


@pytest.mark.parametrize("page", [
    "<svg-icon></svg-icon><select-box></select-box>{}", "<!doctype html><head><title>t</title>{}", "<select><option>x{}", "<p>{}<canvas>", "<script>var a = 1;{}", "<style>p {{ color: red }}\n{}",
    "<div class='page no-header'>{}</div>", "<div class='layout with-sidebar'>{}</div>", "<article class='post has-sidebar'>{}</article>", "<form>{}</form>",
])
def test_html_of_odd_markup(page):
    got = html.main_text(page.format("".join(f"<p>{x}</p>" for x in PARAGRAPHS)))
    assert got.removeprefix("x ") == " ".join(PARAGRAPHS)


def test_paragraphs_between_links_stay():
    page = "".join(f"<p>{PARAGRAPHS[k % 2]}</p><p><a href=x>Read the next one here</a></p>" for k in range(600))
    assert html.main_text(page) == " ".join(PARAGRAPHS * 300)


@pytest.mark.parametrize(("page", "text"), [
    ("<p>Short.</p>", "Short."), ("no tags at all", "no tags at all"), ("<nav><p>Home</p></nav><h1>Title here</h1><p>Few words.</p><footer>Copyright</footer>", "Title here Few words."),
    ("<nav><p>Home</p></nav><ul><li><a href=x>One</a></ul><footer>Copyright</footer>", ""),
])
def test_html_of_little_text(page, text):
    assert html.main_text(page) == text


def test_html_of_open_quotes_and_comments():
    body = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    for page in ("<p title='it>" + body, "<b it's>" * 3 + body, "<a \">x</a>" * 100 + body, body + "<!-- not closed <p>", body + "<!-- not closed", body + "<p title='"):
        assert " ".join(PARAGRAPHS) in html.main_text(page) and "not closed" not in html.main_text(page)
    assert [b.text for b in html.blocks("<p title='a > b'>one<p title=\"a > b\">two")[0]] == ["one", "two"]


def test_large_pages_take_linear_time():
    import time

    r = random.Random(5)
    line = lambda k: f"<p>{PARAGRAPHS[k % 2]}</p>" if r.random() < 0.5 else f"<li><a href=x>link {k}</a>"
    for page in ("".join(map(line, range(40_000))), "<div>" * 30_000 + "<p>deep words</p></div>" * 30_000, "<b>" * 30_000 + "<div>x</div>" * 30_000, "<select>" * 30_000 + "<p>words", "<a '" * 50_001 + ">", "<a '" * 50_000, "<b '><b '\">" * 30_001, "<ul>" + "<li>x" * 50_000):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 10


# --- columns whose names the stages use, and what they do with odd rows


@pytest.mark.parametrize("stage", ["redact", "reject", "keep_first", "drop_leaks"])
def test_stages_with_clashing_names(spark, stage):
    from gleaner.llm import neardup

    extra = "__id __key __found __gone __lang_pred __score gone _gone hit_id hit_key HIT_SPANS leak_id leak_key lang_pred SCORE".split()
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"{c} string" for c in extra)])
    texts = ["the cat sat on the mat and the dog lay down there too", f"token = {KEY} and more words about it", None, "", "the cat sat on the mat and the dog lay down there too", "what is the capital city of france today my friend"]
    ids = [0, 1, 2, None, 4, 5]
    rows = [(i, t, "en", "s", None if t is None else len(t), *(f"{c}{k}" for c in extra)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(1, "capital city of france today my friend")], "item_id long, text string")
    run = {"redact": secrets.redact, "reject": language.reject, "keep_first": neardup.keep_first, "drop_leaks": lambda d: decontaminate.drop_leaks(d, items)}[stage]
    got = run(df)
    assert got.columns == df.columns
    lost = {"redact": set(), "reject": {2, None}, "keep_first": {4}, "drop_leaks": {5}}[stage]
    kept = {r.doc_id: r for r in got.collect()}
    assert set(kept) == set(ids) - lost
    assert all(kept[i][c] == f"{c}{k}" for k, i in enumerate(ids) if i in kept for c in extra)
    if stage == "redact":
        assert KEY not in kept[1].text and kept[1].n_chars == len(kept[1].text)
    assert run(df.limit(0)).collect() == []


def test_stages_by_other_names(spark):
    df = spark.createDataFrame([("k1", f"token = {KEY}", "me"), ("k2", "nothing", "me")], "name string, body string, source string")
    got = {r.name: r.body for r in secrets.redact(df, id_col="name", text_col="body", repo_col="name").collect()}
    assert KEY not in got["k1"] and got["k2"] == "nothing"


def test_hot_seeds_join_few_rows(docs, spark):
    """One phrase is in every item and every document; pairs are those that brute force finds all the same."""
    r = random.Random(8)
    hot = "which of the following statements is true"
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    items = [f"{hot} " + " ".join(word() for _ in range(r.randint(6, 14))) for _ in range(40)] + [hot]
    texts = [" ".join([hot, *(word() for _ in range(20)), *(r.choice(items).split()[r.randint(0, 9) :] if r.random() < 0.3 else [])]) for _ in range(120)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs(texts), bench).collect()}
    t = decontaminate.Tokens()
    tokens = [t.of(x) for x in items]
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(tokens) if 2 * sum(n for *_, n in decontaminate.tiles(y, t.of(x), 4, t.windows)) >= len(y)}
    assert got == want and len(want) > 120
    # What the seeds that are left would join, against all of them.
    windows = [t.windows.of(y, 4) for y in tokens]
    df = {}
    for x in texts:
        for h in set(t.windows.of(t.of(x), 4).tolist()):
            df[h] = df.get(h, 0) + 1
    every = sum(df.get(h, 0) for w in windows for h in w.tolist())
    left = 0
    for w, y in zip(windows[:-1], tokens[:-1], strict=True):
        places = np.array([k for k, h in enumerate(w.tolist()) if h in df], np.int64)
        n = np.array([df[h] for h in w[places].tolist()], np.int64)
        left += int(n[np.isin(places, decontaminate.rare_places(places, n, len(y), 4, 0.5))].sum())
    assert left < 10 * len(texts) < every


def test_tiles_of_repeated_words():
    import time

    t = decontaminate.Tokens()
    began = time.perf_counter()
    got = decontaminate.tiles(t.of("x " * 200), t.of("x " * 200_000), 4, t.windows)
    assert got == [(0, 0, 200)] and time.perf_counter() - began < 20


def test_quotes_are_read_by_one_rule():
    """Against the rule itself, in the plainest way, on random tags; and in linear time."""
    import time

    def plain(page, at, last):
        place, quote = at, None
        while place < last:
            c = page[place]
            if quote is None and c == ">":
                return place
            if c in "\"'":
                quote = None if quote == c else quote or c
            place += 1
        return page.find(">", at, last)

    r = random.Random(9)
    for _ in range(3000):
        page = "".join(r.choices("<a>\"'x =", weights=[2, 2, 2, 3, 3, 2, 1, 1], k=r.randint(2, 40))) + ">"
        last = page.rfind(">") + 1
        ends = html.TagEnds(page, last)
        for at in range(last):
            assert ends.of(at) == plain(page, at, last), (page, at)
    for page in ("<a \"x>" * 50_000, "<a \"'" * 50_000 + ">", "<a \"\"<b ''" * 30_000 + "\">"):
        began = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - began < 3


# --- the linear machines of operator 10, against another solver and plain votes


def newton(x, y, c):
    """Least ||w||^2 / 2 + c * sum of squared hinges, by Newton steps on the rows that are too near."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        near = 1 - y * (x @ w) > 0
        grad = w - 2 * c * x[near].T @ (y[near] * (1 - y[near] * (x[near] @ w)))
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * x[near].T @ x[near], grad)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    return w


@pytest.mark.parametrize("noise", [0.0, 0.3])
def test_svm_against_another_solver(noise):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ r.normal(size=12) + noise * r.normal(size=200) > 0.1, 1.0, -1.0)
    got, want = language.svm(x, y), newton(x, y, 1.0)
    assert np.linalg.norm(got - want) < 0.01 * np.linalg.norm(want)
    ones = np.hstack([x, np.ones((200, 1))])
    told = np.sign(ones @ got) == np.sign(ones @ want)
    assert told[np.abs(ones @ want) > 0.02].all()


def test_votes_are_counted():
    """Inside a family the language that wins most duels, in plain Python."""
    r = random.Random(4)
    langs = ["de", "nl", "sv", "da"]
    assert len({language._FAMILY[v] for v in langs}) == 1
    stems = {v: ["".join(r.choices("abcdefgh", k=4)) for _ in range(6)] for v in langs}
    text = lambda v: " ".join(r.choices(stems[v], k=20) + r.choices(sum(stems.values(), []), k=8))
    model = language.Model(language.vectors([text(v) for v in langs for _ in range(12)]), [v for v in langs for _ in range(12)])
    x = language.vectors([text(r.choice(langs)) for _ in range(40)])
    got, _ = model.predict(x)
    for row, pred in zip(np.hstack([x, np.ones((len(x), 1), np.float32)]), got, strict=True):
        wins = dict.fromkeys(langs, 0)
        for (a, b), w in model.pairs.items():
            wins[a if row @ w > 0 else b] += 1
        assert wins[pred] == max(wins.values())


@pytest.mark.parametrize("name", ["user-comments", "reader-feedback", "visitor-discussion", "legal"])
@pytest.mark.parametrize("element", ["article", "div"])
def test_comments_and_notices_by_compound_names(name, element):
    """Of names of several words, those for people say nothing; words that only look alike say nothing either."""
    main = "<h1>Title of it</h1>" + "<p>This is a sentence of the article about many things. It has another one, too.</p>" * 4
    more = "<p>I think that this is a really great article, thanks for writing it. I agree with every word.</p>" * 3
    page = f"<body><{element}>{main}</{element}><section class='{name}'>{more}</section><div class='has-sidebar'><p>No boilerplate but a proper paragraph of the text, as long as others.</p></div></body>"
    got = html.main_text(page)
    assert "agree" not in got and got.count("another one") == 4 and "No boilerplate" in got


def test_every_labelled_document_is_learned_from(docs):
    """Two languages of 30 vocabularies each, far more documents than a chunk: what only few documents say is known, rare languages are in every chunk."""
    r = random.Random(7)
    words = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for _ in range(60)]
    texts = [" ".join(r.choices(words[k % 60], k=30)) for k in range(1200)] + ["ωμεγα αλφα βητα"] * 3
    langs = ["en" if k % 60 < 30 else "de" for k in range(1200)] + ["el"] * 3
    d = docs(texts, langs=langs)
    dealt, chunk = language.in_chunks(d, 64, F.col("doc_id") >= 0)
    rows = dealt.select("doc_id", "lang", chunk).collect()
    assert {x.doc_id for x in rows} == set(map(str, range(1203)))
    of = {}
    for x in rows:
        of.setdefault(x.chunk, []).append(x.lang)
    assert len(of) == 19 and all({"en", "de"} <= set(v) and len(v) < 128 for v in of.values()) and sum("el" in v for v in of.values()) == 19
    got = {x.doc_id: x.lang_pred for x in language.identify(d, 64).collect()}
    assert sum(got[k] == langs[k] for k in range(1200)) >= 0.97 * 1200
    model = language.train(d, 64)
    assert model.langs == ["de", "el", "en"] and all(w.any() for w in model.root)
    one = language.train(d, 64).root
    assert (one == language.train(d.repartition(7), 64).root).all()  # no order of rows or sums shows


def test_floor_is_set_on_every_held_out_document(docs):
    import zlib

    r = random.Random(9)
    kinds = {"en": "the of and with that", "fr": "le la et pour une"}
    texts, langs = [" ".join(r.choices(v.split(), k=30)) for v in kinds.values() for _ in range(200)], [v for v in kinds for _ in range(200)]
    d = docs(texts, langs=langs)
    rows, chunk = language.in_chunks(d, 20, language.held_out(F.col("doc_id")))
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sorted(int(x.doc_id) for x in rows.select("doc_id", chunk).collect()) == held and len(held) > 60
    model = language.train(d)
    counts = language.tried(model, [texts[k] for k in held], [langs[k] for k in held])
    assert counts[0] + counts[1] >= 2 * len(held)  # each text is told rightly or not, and words of random letters as many
    assert language.LIMITS[0] <= language.doubt(d, model, 20) < 1


def test_pressed_counts_lose_nothing():
    texts = ["a", "the cat sat on the mat", "é" * 70_000, "of the " * 60]
    counts = [language.unpressed(language.pressed(c)) for c in language.gram_counts(texts)]
    assert all((a == b).all() for a, b in zip(counts, language.gram_counts(texts), strict=True))
    assert np.allclose(language.scaled(counts, len(texts)), language.vectors(texts), atol=1e-7)
