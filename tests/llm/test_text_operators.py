"""Dedup, packing and tokenizing against brute force over awkward texts."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from conftest import rows
from tokenizers import Tokenizer

from sheetledger.llm import byte_bpe, components, exact_dedup, packing, simhash
from sheetledger.llm.common import filtered, without

from .conftest import HARD

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected_groups(texts):
    out = {}
    for i, t in enumerate(texts):
        out.setdefault(strip(t), []).append(i)
    found = {}
    for body, ids in out.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            found[i] = (keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest())
    return found


def test_exact_groups(documents):
    long = "".join(f"word{i} " for i in range(20_000))
    texts = [*HARD, long, long.replace(" ", "\n"), long + "end", "wo rd", "x" * 69_999, "ab"]
    for df in (documents(texts), documents(texts, extra=True).repartition(3)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(df).collect()}
        assert got == expected_groups(texts)
    assert exact_dedup.exact_groups(documents([])).count() == 0


def test_exact_groups_tell_colliding_chunks_apart(documents):
    texts = ["abc", "abd", "a b c", "xyz", "abd", ""]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(documents(texts), key=lambda c: len(c)).collect()}
    assert got == expected_groups(texts)


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 122, 60_000).astype(np.uint8)
    gear = exact_dedup._gear()

    def chunks(data):
        h = exact_dedup.rolling(data, gear)
        ends = exact_dedup.cuts(np.flatnonzero((h & np.uint32(0x7FF00)) == 0) + 1, len(data), 512, 16384)
        return [data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    whole, moved = chunks(body), chunks(np.concatenate([body[:100], body[37:45], body[100:]]))
    assert b"".join(whole) == body.tobytes() and all(len(c) <= 16384 for c in whole)
    assert len(set(whole) & set(moved)) > len(whole) / 2  # an insertion changes the chunks around it only


def brute_prints(texts, words=3):
    out = []
    for t in texts:
        found = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        shingles = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def brute_components(prints, radius):
    ids = list(range(len(prints)))
    while True:
        new = [min(ids[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= radius) for i in range(len(prints))]
        new = [new[k] for k in new]
        if new == ids:
            return ids
        ids = new


def test_simhash_groups(documents):
    base = [f"w{i * 7919 % 503}" for i in range(400)]
    texts = [*HARD[:7], *HARD[9:]]
    for k in range(60):
        words = list(base)
        for j in range(k % 9):
            words[(k * 31 + j * 57) % 400] = f"v{k}{j}"
        texts.append(" ".join(words))
    prints = brute_prints(texts)
    for df in (documents(texts), documents(texts, extra=True).repartition(5)):
        got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(df).collect())
        assert got == [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints, 3)))]
    assert len({c for _, _, c in got}) < len(texts) - 20
    assert simhash.near_groups(documents([])).count() == 0


def test_links_of_tiles_connect_what_all_links_connect():
    rng = np.random.default_rng(5)
    for radius in (3, 9):
        seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        x = np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for s in seeds])
        y = np.concatenate([x[::3] ^ np.uint64(5), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
        own, theirs = simhash.tile_labels(x[:, None], radius), simhash.tile_labels(y[:, None], radius)
        i, j = simhash.cross_links(x[:, None], y[:, None], own, theirs, radius)
        both = np.concatenate([x, y])
        wanted = np.nonzero(np.bitwise_count(both[:, None] ^ both[None, :]) <= radius)

        def joined(left, right):
            low = np.arange(len(both))
            while True:
                new = low.copy()
                np.minimum.at(new, left, low[right])
                np.minimum.at(new, right, low[left])
                if (new == low).all():
                    return low.tolist()
                low = new

        left = np.concatenate([np.arange(len(x)), np.arange(len(y)) + len(x), i])
        right = np.concatenate([own, theirs + len(x), j + len(x)])
        assert (np.bitwise_count(x[i] ^ y[j]) <= radius).all() and len(i) < len(both)
        assert joined(left, right) == joined(*wanted)


def test_near_offsets_miss_no_pair():
    offsets = set(simhash.near_offsets(4, 3))
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.integers(0, 64, 3):
            b ^= 1 << int(bit)
        parts = [tuple((v >> s & 0xFFFF).bit_count() for s in (0, 16, 32, 48)) for v in (a, b)]
        d = tuple(p - q for p, q in zip(*parts))
        assert d in offsets or tuple(-v for v in d) in offsets


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300)]
    got = dict(rows(components.connected(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in [100, *range(200, 250)]}, 299: 299, 300: 299}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def check_pieces(got, texts, size):
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in enumerate(texts)}
    seen, windows = {i: 0 for i in ids}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["length"] > 0 and zlib.crc32(bytes(r["ids"])) == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(v) for i, v in ids.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    return windows


def test_packing(documents):
    texts = [*HARD, *("some words of text " * (3 + 41 * i % 97) for i in range(120)), "<|endoftext|> it's"]
    for df in (documents(texts), documents(texts, extra=True).repartition(7)):
        windows = check_pieces(packing.pack(df, WORDS, size=256, windows=4, group=3).collect(), texts, 256)
        assert sum(sum(n for _, n in w) < 256 for w in windows.values()) <= 8 * 3
    assert packing.pack(documents([]), WORDS).count() == 0


@pytest.mark.parametrize("texts", [["a b", "c", "d e f"], [None], ["word " * 30] * 2, ["a", "", None, "b c", "d"], ["some words " * 200, "x", None]])
def test_packing_of_few_tokens(documents, texts):
    """Partitions without a row, with one text, and with less than a window."""
    for parts in (1, 4, 9):
        check_pieces(packing.pack(documents(texts).repartition(parts), WORDS, size=64).collect(), texts, 64)


def test_packer_fits_best():
    out = []
    packer = packing.Packer(10, 2, out.append)
    for doc, n in enumerate((6, 7, 3, 4, 9)):  # 3 goes beside 7, 4 beside 6; both windows leave full
        packer.add((doc, 0, bytes(4 * n), n))
    assert [[p[0] for p in w] for w in out] == [[1, 2], [0, 3]] and [p[0] for p in packer.merge()] == [4]


def test_byte_bpe(documents):
    texts = [*HARD, "ab" * 30_000, "don't  we\n\n 'll see", "漢字한글 مرحبا", " \n x", "a \nb", "tail \t"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (documents(texts), documents(texts, extra=True)):
        got = byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
        assert len(got) == len(texts)
        for r in got:
            text = texts[r["doc_id"]] or ""
            assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        for r in byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect():
            ids = np.array(own.encode_ordinary(texts[r["doc_id"]] or ""), dtype="<u4").tobytes()
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert byte_bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN).count() == byte_bpe.round_trip(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rows_pass_with_all_columns(documents):
    df = documents(["a", None, "b", ""], extra=True)
    kept = filtered(df, "text", lambda c: np.array([v is not None for v in c.to_pylist()]))
    assert kept.columns == df.columns and rows(kept, "doc_id") == [(0,), (2,), (3,)]
    left = without(df, df.where("text = 'b'").select("doc_id"))
    assert left.columns == df.columns and rows(left, "doc_id") == [(0,), (1,), (3,)]
