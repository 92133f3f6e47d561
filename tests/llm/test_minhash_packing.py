import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glasspool.llm import minhash, packing
from glasspool.llm.components import components
from glasspool.llm.text import PieceCache, window_hashes, word_hashes, words_and_ends
from tests.llm.conftest import odd_rows, texts

WORDS = public_tokenizers.path("word_bpe_49k.json")


def shingles(text, width):
    words = text.encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(by_id, width, percent):
    sets = {i: shingles(t, width) for i, t in by_id.items()}
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * len(sets[a] | sets[b]):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_groups_against_brute_force(small, workspace, width, percent):
    found = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_groups(small, workspace, width, percent).collect()}
    assert found == brute_components(texts(small), width, percent)


def test_a_large_family_in_small_blocks(spark, workspace, monkeypatch):
    """Copies of one text with few and with many edits, far beyond one block."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 20)
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    by_id = {}
    for i in range(300):
        words = list(base[: 120 - i % 40])
        for k in random.integers(0, len(words), i % 9):
            words[k] = f"x{random.integers(0, 30)}"
        by_id[i] = " ".join(words)
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_groups(docs, workspace, 3, 85).collect()}
    assert found == brute_components(by_id, 3, 85)


def test_near_groups_of_odd_rows(odd, nothing, workspace):
    rows = minhash.near_groups(odd, workspace).collect()
    assert len(rows) == len(odd_rows())
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert found[1] == (1, True) and found[3] == (3, True) and found[None] == (None, True)
    assert found[5] == (4, False) and found[8] == (7, False)
    assert found[10] == (9, False) and found[11] == (9, False) and found[13] == (13, True)
    left = minhash.drop_near_copies(odd, workspace)
    assert left.schema == odd.schema
    assert sum(r["doc_id"] is None for r in left.collect()) == 2
    assert minhash.near_groups(nothing, workspace).count() == minhash.drop_near_copies(nothing, workspace).count() == 0


def test_signatures_estimate_similarity():
    signer, random = minhash.Signer(40), np.random.default_rng(3)
    pool = random.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:])
    part = lambda s: np.concatenate([(s * signer.factor[:, None] + signer.offset[:, None]).min(1), (s * signer.factor[:, None] + signer.offset[:, None]).max(1)])
    assert abs((part(a) == part(b)).mean() - 800 / 1200) < 0.12
    assert minhash.bands_for(0.85) == 20 and minhash.bands_for(0.8) > 20


def test_components_of_paths_and_stars(spark, workspace):
    pairs = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 180)] + [(300, 300)]
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long"), workspace).collect()))
    assert found == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 180)}}


def test_words_and_windows(monkeypatch):
    text = "é b  c\nab b c é\x0bb".encode()
    words = word_hashes(text)
    assert words.size == len(text.split()) and (words[:2] == words[-2:]).all()
    assert window_hashes(words, 3).size == words.size - 2 and window_hashes(words[:2], 3).size == 1
    assert word_hashes(b" \n").size == 0
    again, ends = words_and_ends(text)
    last = [w[-2] * 256 + w[-1] if len(w) > 1 else w[0] for w in text.split()]
    assert (again == words).all() and ends.tolist() == last
    monkeypatch.setattr("glasspool.llm.text.SEGMENT_BYTES", 3)
    assert (word_hashes(text) == words).all()


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, documents, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for doc_id, text in documents:
        ids = ids_of(tokenizer, text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            expected.append((doc_id, k, at, part.size, zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expected, key=repr)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(r["length"] for r in rows) / capacity


def test_packing_of_documents(small, workspace):
    rows = packing.pack(small, workspace, WORDS).collect()
    bins, least = check_packing(rows, texts(small).items(), 4096)
    assert bins <= 1.05 * least + 1


def test_packing_of_odd_rows_in_several_rounds(odd, nothing, workspace, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    rows = packing.pack(odd, workspace, WORDS, capacity=64).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows()], 64)
    assert packing.pack(nothing, workspace, WORDS).count() == 0


def test_sum_of_squares_against_brute_force():
    random = np.random.default_rng(1)
    lengths = random.integers(1, 31, 400)
    chosen, gaps = packing.sum_of_squares(lengths, 30), []
    squares = lambda open_gaps: sum(n * n for n in np.bincount([g for g in open_gaps if g], minlength=1))
    for length, place in zip(lengths.tolist(), chosen.tolist()):
        options = []
        for gap in {g for g in gaps if g >= length}:
            after = list(gaps)
            after[after.index(gap)] = gap - length
            options.append(squares(after))
        options.append(squares([*gaps, 30 - length]))
        if place == len(gaps):
            gaps.append(30)
        gaps[place] -= length
        assert gaps[place] >= 0 and squares(gaps) == min(options)


def test_encoder_against_the_library():
    encoder, tokenizer = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [
        "A B <|ENDOFTEXT|> a b", "x<|startoftext|>y <|endoftext|>", "É é ÀB ÇA, ß. it's we'll 'S", "12 ½ a1b2",
        "İstanbul ΣΑΣ ﬁ", "é ́ a b", "word.*** a%%% ,. | b.,;:!x", "ÀÖØÞ àöøÿß, <|startoftext|> ÉCOLE It S'ÉTÉ Été!", "\x00\x01 😀😀", *(r[1] or "" for r in odd_rows()[:6]),
    ]
    expected = [ids_of(tokenizer, text)[:-1] for text in texts]
    as_numbers = lambda found: [np.frombuffer(ids, "<u4").tolist() for ids in found]
    assert as_numbers(encoder.ids([text.encode() for text in texts])) == expected
    encoder.cache = PieceCache()
    encoder.cache.MOST_BYTES = 1000  # each text alone, and hardly anything kept
    for text, ids in zip(texts * 2, expected * 2):
        assert as_numbers(encoder.ids([text.encode()])) == [ids], text
