"""Encoding, packing, repeated strings, lines and near duplicates against plain Python."""

import itertools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidegrid.llm import bpe, hyperminhash, line_dedup, packing, suffix_dedup

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_encoding_is_that_of_the_library_and_goes_back(docs, texts):
    encoding = bpe.load_ranks(RANKS, public_tokenizers.PATTERN)
    got = bpe.token_digests(docs, RANKS).collect()
    want = []
    for text in [t for _, t in texts] + [texts[3][1]] * 2 + ["no id here\nat all"]:
        ids = encoding.encode_ordinary(text or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_long_texts_are_cut_only_where_no_match_spans(texts):
    encoding = bpe.load_ranks(RANKS, public_tokenizers.PATTERN)
    odd = ["".join(t or "" for _, t in texts), "a" * 5000, " " * 3000 + "b", "x\n\n\n  y" * 900, "1a2b" * 1500, "  é" * 700, "'s" * 2000]
    for text in odd:
        for size in (7, 64, 501):
            assert bpe.encode_text(encoding, public_tokenizers.PATTERN, text, size) == encoding.encode_ordinary(text)


def test_columns_named_like_the_ids_are_replaced(spark):
    rows = spark.createDataFrame([(1, "one two", "old", 5), (None, None, "old", 6)], "doc_id long, text string, ids string, decoded int")
    encoded = bpe.encode(rows, RANKS)
    assert sorted(encoded.columns) == ["decoded", "doc_id", "ids"]  # the text is left out, as documented
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS).collect()}
    assert got == {1: b"one two", None: b""}


def test_no_rows_no_tokens(empty):
    assert bpe.token_digests(empty, RANKS).count() == 0


SPECIAL = ["<|endoftext|> begins", "ends in <|endoftext|>", "in<|endoftext|>side", "<|endoftext|><|endoftext|><|endoftext|>", "a <|endoftext|> b  <|endoftext|>\n\n c",
           "<|endoftext|", "|endoftext|> é<|endoftext|>é ", " <|endoftext|><|endoftext", "x " * 400 + "<|endoftext|>" + " y" * 400, "<|endoftext|>"]


def test_pieces_have_the_tokenizer_ids(spark, docs, texts):
    """The library as it is set by default, also where a text holds its special token."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    odd = [(1000 + k, t) for k, t in enumerate(SPECIAL)]
    rows = docs.where("doc_id <> 3").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).coalesce(1)
    got = {}
    for r in packing.token_pieces(rows, VOCABULARY, capacity=300, ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in [*texts, *odd]:
        if i == 3:
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(got[i], key=lambda r: r.piece)
        held = b"".join(r.ids for r in pieces)
        assert np.frombuffer(held, "<u4").tolist() == ids
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert all(r.length == 300 for r in pieces[1:]) and 1 <= pieces[0].length <= 300
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)


def test_texts_to_pack_are_encoded_in_small_slices(spark, monkeypatch):
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    seen, encode_all = [], packing.encode_all
    monkeypatch.setattr(packing, "encode_all", lambda buffer, *rest: (seen.append(len(buffer)), encode_all(buffer, *rest))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([f"text {i} " * 9000 for i in range(60)])], names=["doc_id", "text"])
    rows = [r for b in packing.token_pieces(Docs(), VOCABULARY)(iter([batch])) for r in b.to_pylist()]
    assert sum(seen) == sum(len(t) for t in batch.column("text").to_pylist()) and max(seen) <= 1 << 20
    assert {r["doc_id"] for r in rows} == set(range(60))


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(3)
    sizes = np.concatenate((rng.integers(1, 65, 3000), [64] * 40, [33] * 200)).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long").repartition(5)
    got = packing.pack(items, capacity=64, group_items=500, fan_in=2).collect()
    assert sorted(r.item for r in got) == list(range(len(sizes)))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, sizes[r.item]))
    for members in bins.values():
        at = 0
        for offset, size in sorted(members):
            assert offset == at
            at += size
        assert at <= 64
    assert len(bins) <= 1.02 * max(sum(sizes) / 64, sum(s > 32 for s in sizes))


def test_best_fit_takes_the_fullest_bin_with_room():
    bin_of, place = packing.best_fit(np.array([9, 8, 2, 1, 1]), 10)
    assert bin_of.tolist() == [0, 1, 1, 0, 2] and place.tolist() == [0, 0, 8, 9, 0]


def test_packing_all_documents(docs, empty):
    got = packing.pack_documents(docs, VOCABULARY).toPandas()
    assert len(got[got.piece == 0]) == docs.count()
    ends = got.assign(end=got.offset + got.length).groupby("sequence_id").agg(end=("end", "max"), held=("length", "sum"))
    assert (ends.end == ends.held).all() and ends.end.max() <= 2048
    assert packing.pack_documents(empty, VOCABULARY).count() == 0


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for x in raw:
        for k in range(len(x) - 199):
            seen[x[k: k + 200]] = seen.get(x[k: k + 200], 0) + 1
    for x in raw:
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k: k + 200]] > 1:
                gone[k: k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(x, gone) if not g)
        yield len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def test_repeated_strings_go(docs, empty):
    held = docs.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *x) for r, x in zip(held, brute_repeats([r.text for r in held])))
    got = suffix_dedup.repeat_report(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in got) == want
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_cut_text_has_no_broken_characters(docs):
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    assert cut.columns[:6] == ["doc_id", "text", "lang", "source", "score", "n_bytes"]
    by_id = {r.doc_id: r.text for r in cut.collect()}
    assert by_id[306] == "" and by_id[312]


def brute_lines(texts, percent):
    """Lines removed, over (doc_id, text) in order."""
    before, gone = [], {}
    for i, text in texts:
        for k, line in enumerate((text or "").split("\n")):
            held = frozenset(words(line))
            if not held:
                continue
            if any(100 * len(held & b) >= percent * len(held | b) for b in before):
                gone.setdefault(i, set()).add(k)
            before.append(held)
    return gone


def test_similar_lines_go(docs, texts, empty):
    order = sorted(texts, key=lambda x: x[0]) + [(None, "no id here\nat all")]
    gone = brute_lines(order, 80)
    want = {}
    for i, text in order:
        kept = [x for k, x in enumerate((text or "").split("\n")) if k not in gone.get(i, ())]
        want[i] = (None if text is None else "\n".join(kept), 0 if text is None else text.count("\n") + 1, len(gone.get(i, ())))
    got = line_dedup.remove_similar_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    held = got.collect()
    assert len(held) == docs.count()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in held} == want
    assert line_dedup.remove_similar_lines(empty).count() == 0


@pytest.mark.parametrize("percent", [60, 67, 80, 95])
def test_similar_sets_share_a_key_of_their_prefixes(percent):
    """Random sets with the most differences allowed, over words of all rarities; a word seen once is never common."""
    rng = np.random.default_rng(percent)
    for _ in range(3000):
        n = int(rng.integers(1, 40))
        pool = rng.permutation(200).astype(np.uint64) + np.uint64(1 << 40)
        code_of = rng.choice(rng.choice([1, 2, 20, 30, 31, 60], 3), 200)
        m = int(rng.integers(n, 100 * n // percent + 1))
        most = (100 * (n + m)) // (100 + percent)
        common = -(-percent * (n + m) // (100 + percent))
        if common > min(n, m, most):
            continue
        both = pool[:common]
        code_of[:common] = np.maximum(code_of[:common], 2)
        sides = [np.r_[0:common, common: n], np.r_[0:common, n: n + m - common]]
        keys = []
        for at in sides:
            line, hashes, codes = line_dedup._distinct(np.zeros(len(at), int), pool[at], code_of[at].astype(np.uint8))
            once, some = np.array([(codes <= 1).sum()]), np.array([((codes > 1) & (codes <= line_dedup.SOME)).sum()])
            held = np.arange(len(at)) <= line_dedup._prefix(np.array([len(at)]), once, some, percent, percent < 67)[0]
            keys.append(set(line_dedup._keys(line, hashes, codes, percent < 67)[held & (codes > 1)].tolist()))
        assert keys[0] & keys[1], (n, m, len(both))


def test_lines_that_meet_no_similar_one_are_done_early(spark):
    """Lines over the same twenty words share words, but few share two or three that are neighbours in rarity."""
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{rng.integers(0, 4000)}" for _ in range(20)) for _ in range(400)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, lines[0], "x " + lines[1]])], "doc_id long, text string")
    rows = suffix_dedup.keyed(docs)
    signed = line_dedup.staged(line_dedup._signatures(rows, line_dedup.word_rarity(rows), 80), "signed")
    active = {r.doc_id for r in line_dedup._active(signed).collect()}
    assert {0, 1, 400, 401} <= active and len(active) < 40
    assert {r.doc_id for r in line_dedup.remove_similar_lines(docs).where("n_removed > 0").collect()} == {400, 401}


def test_keys_of_one_set_alone_are_never_written(spark, monkeypatch):
    """Of all keys of all lines, only those that two sets hold are staged; exactly their lines and copies go on."""
    rng = np.random.default_rng(4)
    lines = [" ".join(f"w{rng.integers(0, 900)}" for _ in range(30)) for _ in range(300)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, lines[0], "x " + lines[1]])], "doc_id long, text string")
    rows = suffix_dedup.keyed(docs)
    signed = line_dedup._signatures(rows, line_dedup.word_rarity(rows), 80)
    held, copies = {}, {}
    for r in signed.collect():
        copies.setdefault(r.set_a, set()).add(r.doc_id)
        for name in r.names:
            held.setdefault(name, set()).add(r.set_a)
    shared = [sets for sets in held.values() if len(sets) > 1]
    want = {i for s in set().union(*shared) for i in copies[s]} | {i for some in copies.values() if len(some) > 1 for i in some}
    written, staged = [], line_dedup.staged

    def counted(df, label):
        out = staged(df, label)
        if "names" in df.columns:
            written.append(sum(len(r.names or ()) for r in out.select("names").collect()))
        return out

    monkeypatch.setattr(line_dedup, "staged", counted)
    assert {r.doc_id for r in line_dedup._active(signed).collect()} == want
    removed = line_dedup.remove_similar_lines(docs).where("n_removed > 0")
    assert {r.doc_id for r in removed.collect()} == {300, 301}
    assert max(written) <= sum(map(len, shared)) < sum(map(len, held.values())) / 4


def sets_of(texts, k):
    for text in texts:
        w = words(text)
        yield {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_the_true_components(docs, texts, k, percent):
    sets = dict(zip([i for i, _ in texts], sets_of([t for _, t in texts], k)))
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    got = hyperminhash.near_duplicates(docs, k, percent)
    assert {"lang", "source", "score"} <= set(got.columns) and got.count() == docs.count()
    held = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert held.pop(None)[1:] == (None, True)
    assert held == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_of_nothing(empty):
    assert hyperminhash.near_duplicates(empty).count() == 0


def test_a_family_of_variants_is_not_paired_up(spark):
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(i, base.replace(f"w{i} ", "other ")) for i in range(120)]
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_registers_keep_similarity():
    rng = np.random.default_rng(1)
    for size in (6, 40, 700):
        shared = rng.integers(0, 2**64, size, dtype=np.uint64)
        own = rng.integers(0, 2**64, (2, max(1, size // 10)), dtype=np.uint64)
        sets = [np.unique(np.concatenate((shared, o))) for o in own]
        owner = np.concatenate([np.full(len(s), k) for k, s in enumerate(sets)])
        table, _ = hyperminhash.registers_of(owner, np.concatenate(sets), 2)
        true = size / (size + 2 * max(1, size // 10))
        assert abs((table[0] == table[1]).mean() - true) < 0.25


def test_blocks_of_a_band_meet_like_all_pairs(spark):
    """Components larger than a block, one-node components, and bands that many share."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, 512), dtype=np.uint8)
    table = np.repeat(base, 15, axis=0)
    edits = rng.random(table.shape) < rng.choice([0.02, 0.1, 0.3], len(table))[:, None]
    table[edits] = rng.integers(0, 256, edits.sum())
    part = [(k // 15) * 15 if k % 15 < 9 else k for k in range(len(table))]
    size = [int(s) for s in rng.integers(300, 400, len(table))]
    full = np.repeat(np.packbits(rng.random(base.shape) < 0.9, axis=1), 15, axis=0)
    nodes = spark.createDataFrame([(k, size[k], bytearray(table[k].tobytes()), bytearray(full[k].tobytes())) for k in range(len(table))],
                                  "node long, n_shingles long, registers binary, full binary")
    parts = spark.createDataFrame(list(enumerate(part)), "node long, component long")
    members = hyperminhash.band_keys(nodes).join(parts, "node").select("band", "node", "n", "component")
    longs, want = table.view(np.uint64), set()
    for a, b in itertools.combinations(range(len(table)), 2):
        left, right = ((np.array([size[k]]), longs[[k]], full[[k]].view(np.uint64)) for k in (a, b))
        if part[a] != part[b] and (longs[a] == longs[b]).any() and hyperminhash._likely(left, right, 80)[0]:
            want.add((a, b))
    assert len(want) > 50
    for block in (4, 128):
        got = [tuple(r) for r in hyperminhash._across(members, nodes, 80, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("size", [3, 20, 60, 300, 2000])
def test_no_similar_pair_is_ruled_out_by_its_registers(size):
    """Differing own registers never count more than the shingles that are not shared."""
    rng = np.random.default_rng(size)
    ruled = 0
    for alone in range(0, max(2, size // 3), max(1, size // 40)):
        shared = rng.integers(0, 2**64, size, dtype=np.uint64)
        sets = [np.unique(np.concatenate((shared, rng.integers(0, 2**64, alone, dtype=np.uint64)))) for _ in range(2)]
        owner = np.repeat([0, 1], [len(s) for s in sets])
        table, full = hyperminhash.registers_of(owner, np.concatenate(sets), 2)
        bits, longs = np.packbits(full, axis=1).view(np.uint64), table.view(np.uint64)
        left, right = ((np.array([len(sets[k])]), longs[[k]], bits[[k]]) for k in (0, 1))
        likely = hyperminhash._likely(left, right, 85)[0]
        true = 100 * size / (size + 2 * alone)
        assert likely or true < 85
        ruled += not likely
    assert ruled or size < 20
