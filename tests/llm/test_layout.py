"""Operators 6 and 8, the pipeline and the registry."""

import random
import zlib

import pytest

from gleaner.llm import common, packing, sharding
from gleaner.llm.queries import QUERIES, tokenizer


@pytest.fixture(scope="module")
def ids():
    return packing.Ids(tokenizer())


def test_ids_are_the_tokenizers(ids):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer())
    for s in ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext |>", "< |endoftext|>", "x" * 5000 + " y"]:
        assert ids.of(s) == b"".join(i.to_bytes(4, "little") for i in plain.encode(s, add_special_tokens=False).ids), s
    r = random.Random(1)
    letters = [chr(i) for i in range(0x250)] + [" "] * 60 + list("abc'st're123") * 6 + ["\n"] * 20 + ["　", " "]
    for k in range(8000):
        s = "".join(r.choices(letters if k % 2 else list("abc'st1,.é    \n"), k=r.randint(0, 25)))
        assert ids.of(s) == ids.encode(s), repr(s)


def check_pieces(rows, texts, model, size):
    data = {i: model.encode(t or "") + b"\0\0\0\0" for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(data[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        assert r.doc_tokens * 4 == len(data[r.doc_id])
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert 4 * at == len(data[i])
    padding = 0
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(len(d) for d in data.values()) // 4


@pytest.mark.parametrize(("parts", "fan_in", "windows"), [(1, 32, 4), (5, 2, 4), (7, 32, 64)])
def test_packing(docs, ids, parts, fan_in, windows):
    r = random.Random(3)
    texts = {k: " ".join(f"{r.randrange(999)}" for _ in range(r.choice([0, 1, 5, 40, 300]))) for k in range(120)}
    texts[3], texts[4] = None, "word " * 900
    d = docs(list(texts.values()), list(texts)).repartition(parts)
    rows = packing.pack(d, tokenizer(), size=128, open_windows=windows, fan_in=fan_in).collect()
    padding, total = check_pieces(rows, texts, ids, 128)
    assert padding < 0.12 * total


def test_packing_of_nothing_and_repeats(docs):
    assert packing.pack(docs([]), tokenizer()).collect() == []
    rows = packing.pack(docs(["a", "a", None], [1, 1, None]), tokenizer()).collect()
    assert sum(r.length for r in rows) == 5 and len({r.sequence_id for r in rows}) == 1


def test_shards(docs):
    r = random.Random(2)
    texts = ["é" * r.randint(0, 50) for _ in range(300)] + [None, "", "x" * 4000]
    ids = [r.randrange(10**12) for _ in texts]
    got = sharding.byte_shards(docs(texts, ids)).collect()
    assert sorted((x.doc_id, x.size, x.text_crc32) for x in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    ordered = sorted(got, key=lambda x: x.doc_id)
    assert [x.shard for x in ordered] == sorted(x.shard for x in got)
    total, before = sum(x.size for x in got), 0
    for x in ordered:
        assert x.shard == (2 * before + x.size) * 8 // (2 * total)
        before += x.size
    for s in {x.shard for x in got}:
        assert [x.slot for x in ordered if x.shard == s] == list(range(sum(x.shard == s for x in got)))
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}


def test_shards_of_ties_and_nothing(docs):
    got = sharding.byte_shards(docs(["a", "bb", None, "a"], [5, 5, None, 5]), shards=2).collect()
    assert len(got) == 4 and sorted((x.shard, x.slot) for x in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sharding.byte_shards(docs([])).collect() == []


def test_pipeline(spark, sf_dir, ids):
    """Each stage against plain Python on what it was given."""
    import corpus_pipeline
    from gleaner.llm import secrets
    from tests.llm.test_dedup import expected_groups
    from tests.llm.test_texts import brute_leaks

    docs = common.table(spark, sf_dir, "documents")
    items = {r.item_id: r.text for r in common.table(spark, sf_dir, "benchmark").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "benchmark decontamination", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = common.staged(stage(spark, docs, sf_dir), "test")
        if name == "packing":
            check_pieces(out.collect(), {i: r.text for i, r in before.items()}, ids, 1024)
            continue
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language ID":
            assert len(after) > 0.97 * len(before)
        if name == "near-duplicates":
            assert sorted(after) == [i for i, _, _, k in expected_groups([r.text for r in before.values()], list(before)) if k]
        if name == "benchmark decontamination":
            assert set(before) - set(after) == {i for i, *_ in brute_leaks({i: r.text for i, r in before.items()}, items, 0.5, 4)}
        if name == "secret scans":
            assert set(after) == set(before)
            for i, r in after.items():
                assert bool(secrets.base_spans(before[i].text)) <= (r.text != before[i].text)
                assert not [s for s in secrets.base_spans(r.text) if s[1] > 0]
        docs = out


def test_registry():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", ["op1_cover_substrings", "op2_fast_sketch_neardup", "op7_suffix_collections", "op8_byte_shards", "op13_slot_negatives"])
def test_sql_gives_the_same(spark, sf_dir, name):
    import duckdb

    from gleaner.llm.queries import SQL

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    answer = con.execute(SQL[name])
    names = [d[0] for d in answer.description]
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(answer.fetchall())


def test_entry_hides_no_failure():
    """Only the absence of these folders is passed over, not a module that fails inside them."""
    import subprocess
    import sys

    root = __file__.rsplit("/", 3)[0]
    run = lambda gone: subprocess.run([sys.executable, "-c", f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=root)
    assert "xxhash" in run("xxhash").stderr.splitlines()[-1]
    assert int(run("gleaner.llm").stdout) == int(run("corpus_pipeline").stdout) - len(QUERIES)
