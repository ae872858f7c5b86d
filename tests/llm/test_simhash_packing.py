"""op5 and op7 against brute force."""

import re
import zlib

import numpy as np
import pytest
import xxhash

from riskloom.llm import bpe, packing, simhash


def slow_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints_and_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000, None), (10_001, ""), (10_002, " \n "), (10_003, "Two words"), (10_004, "a b c d " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = {k: slow_print(t) for k, t in rows}
    assert {k: v[0] for k, v in got.items()} == want
    ids = sorted(want)
    prints = np.array([want[i] for i in ids], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near)) if i < j]
    assert {k: v[1] for k, v in got.items()} == slow_components(pairs, ids)
    assert len(set(slow_components(pairs, ids).values())) < len(ids)


@pytest.mark.parametrize("radius", [2, 4])
def test_links_of_close_prints_with_hot_shards(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set()
    for c in centres:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(int(c) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    edges = [(r.a, r.b) for r in simhash.link_prints(df, radius).collect()]
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    want = slow_components([(i, j) for i, j in zip(*np.nonzero(near)) if i < j], range(len(x)))
    assert slow_components(edges, range(len(x))) == want
    assert all(near[a, b] or want[a] == want[b] for a, b in edges)


def test_bands_cover_the_radius():
    rng = np.random.default_rng(2)
    for n in (10, 10**6, 10**9, 10**12):
        bands = simhash.bands_for(n, 4)
        for _ in range(200):
            flipped = set(rng.choice(64, 4, replace=False).tolist())
            assert any(not flipped & set(b) for b in bands)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert packing.pack(df).count() == 0


def test_ids_equal_the_tokenizers_library():
    enc = bpe.encoder(bpe.default_path())
    assert enc.fast is not None
    rng = np.random.default_rng(3)
    parts = [*"ab c\n\t.,'sé1²٣日\x1f\x85|<>", "<|endoftext|>", "　", " ", "\n ", "'ll", "  "]
    made = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    for text in made:
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert enc.size[enc.encode(text)].sum() == len(text.encode())


def test_packing_is_a_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000, None), (10_001, ""), (10_001, ""), (None, "no key"), (10_002, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df).collect()
    tok = bpe.encoder(bpe.default_path()).tokenizer
    want = sorted(((k, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for k, t in rows), key=repr)
    joined = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length > 0
        joined.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    single = {k: v for k, v in joined.items() if k[0] != 10_001}
    assert all(np.concatenate([i for _, i in sorted(v, key=lambda x: x[0])]).tolist() in [list(w[1]) for w in want if w[0] == k[0]] for k, v in single.items())
    assert len([p for p in pieces if p.doc_id == 10_001]) == 2
    assert sum(p.length for p in pieces) == sum(len(w[1]) for w in want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 2048 and (at & (at - 1)) == 0


def test_digest_columns(spark, sf):
    row = packing.digest(spark, sf).orderBy("doc_id", "start").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    ids = np.append(bpe.encoder(bpe.default_path()).encode(text), 1)[row.start : row.start + row.length]
    assert row.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
