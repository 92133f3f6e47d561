import hashlib
import json
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from glasspool.llm import chat, pieces, tokens
from glasspool.llm.oracles import ORACLES
from glasspool.llm.queries import QUERIES
from glasspool.llm.text import PieceCache
from tests.llm.conftest import FOLDER, odd_rows, texts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", "  a   b\n\n  c \t x  ", "it's we'll I'D 's's", "a b  　 c \nd", "x<|endoftext|> y<|endoftext|>",
    "١٢٣ ½ ² ৫", "  ", "a\x1cb !\x1c!", "é ́é", "😀😀👍🏽", "a" * 3000, "\r\n\r\n x", "\x85 x", "ａ１", "\n x\n\n  y",
]


def test_counts_against_the_library(small):
    counter, library = tokens.TokenCounter(BYTES), Tokenizer.from_file(BYTES)
    for text in [*HARD, *texts(small).values()]:
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), text[:50]


def test_a_full_cache_changes_nothing(small, monkeypatch):
    monkeypatch.setattr(PieceCache, "MOST_BYTES", 20_000)
    test_counts_against_the_library(small)


def test_token_counts_of_odd_rows(odd, nothing):
    found = tokens.token_counts(odd, BYTES).collect()
    expected = Counter((i, len((t or "").encode())) for i, t, *_ in odd_rows())
    assert Counter((r["doc_id"], r["n_bytes"]) for r in found) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 512) and (r["n_bytes"] or not r["n_tokens"]) for r in found)
    assert tokens.token_counts(nothing, BYTES).count() == 0


ODD_PIECES = [
    "▁", "a▁b", "  leading", "trailing  ", "a  b   c    d", "\t\ttabs\n\n\nlines", "<s> </s> <unk> <0x41> <0xE2>", "naïve café", "日本語テキスト", "ελληνικά и русский",
    "\u0000 null", "😀👍🏽 emoji 😀", "aaaa aaaaa aaaaaaaaaaaaaaaaa", "....... ------ ====== ______", "x" * 5000, "ab" * 3000, "\ufffd \u200b \u00a0 x", "ﬁ ｆｕｌｌ ①",
    "for (int i = 0; i < n; ++i) { a[i] += b[i]; }  // done", "https://a.example/b?c=d&e=%20", "\r\n\r\n", "é e\u0301", "0123456789 1,000,000.00", "𝔘𝔫𝔦 𐍈",
]


def test_ids_are_those_of_the_library(small):
    coder, library = pieces.PieceCoder(MODEL), SentencePieceProcessor(model_file=MODEL)
    for text in [*HARD, *ODD_PIECES, *texts(small).values()]:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text[:80]
        if "▁" not in text:
            assert coder.decode(ids) == text
        assert coder.decode(ids) == library.decode(library.encode(text))


@pytest.mark.parametrize("seed", range(3))
def test_pieces_stay_apart_as_merging_says(seed):
    draw, coder = random.Random(seed), pieces.PieceCoder(MODEL)
    kept = [value[1] for value in coder.automaton.values()]
    together = 0
    for _ in range(4000):
        left, right = draw.choice(kept), draw.choice(kept)
        if draw.random() < 0.7:  # halves and ends of pieces are more likely to merge
            piece = coder.pieces[draw.choice(kept)]
            at = draw.randrange(len(piece) + 1)
            ends = [i for i in (coder.pieces.index(piece[:at]) if piece[:at] in coder.halves else -1, coder.pieces.index(piece[at:]) if piece[at:] in coder.halves else -1)]
            left, right = (left if ends[0] < 0 else ends[0]), (right if ends[1] < 0 else ends[1])
        x, y = coder.pieces[left], coder.pieces[right]
        want = coder.merged(x + y)[0] == [x, y]
        together += not want
        assert coder.stay_apart(left, right) == want, (x, y)
    assert together > 100


def test_pieces_of_odd_rows(odd, nothing):
    found = pieces.round_trip(odd, MODEL).collect()
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in found) == Counter((i, digest(t)) for i, t, *_ in odd_rows())
    back = pieces.decoded(pieces.encoded(odd, MODEL), MODEL).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t, *_ in odd_rows())
    assert pieces.encoded(nothing, MODEL).count() == pieces.round_trip(nothing, MODEL).count() == 0


def test_caches_hold_a_bounded_number_of_bytes():
    """Many different words, some of them very long, as texts without white space have."""
    cache, bound = PieceCache(), 200_000
    cache.MOST_BYTES = bound
    learn = lambda some: {piece: piece[::-1].encode() for piece in some}
    held = lambda: sum(len(k) + len(v) for d in (cache.known, cache._older) for k, v in d.items())
    for k in range(3000):
        words = [f"word{k}", f"word{k % 7}", "w" * 100 + str(k)]
        assert cache.of(words, learn) == [w[::-1].encode() for w in words]
        assert held() < bound
        table = cache.table(set(words), learn)
        assert [table[w] for w in words] == [w[::-1].encode() for w in words]
        assert held() < bound
    assert not any(len(k) > cache.LONGEST for d in (cache.known, cache._older) for k in d)
    coder = pieces.PieceCoder(MODEL)
    for k in range(300):
        coder.encode(f"{k}" + "Ab" * 5_000)
    assert not coder.cache.known


SCHEMAS = {
    "add": T.StructType([T.StructField("b", T.LongType(), False), T.StructField("a", T.LongType(), False), T.StructField("note", T.StringType())])
}
CALL = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, level string, key string"


def test_calls_are_linked_ordered_and_checked(spark, workspace):
    calls = spark.createDataFrame(
        [
            (1, 5, "c", "add", '{"note":"é\\n","b":2,"a":1}', ["a", "b"], "x", "y"),
            (1, 1, "a", "add", '{"a":1,"b":"no"}', [], "x", "y"),
            (1, 3, "b", "add", '{"a":1}', ["a", None], "x", "y"),
            (1, 7, "d", "nope", "{}", ["d"], "x", "y"),
            (1, 8, "e", "add", "{broken", ["zzz"], "x", "y"),
            (1, 9, None, "add", '{"a":1,"b":2,"extra":3}', None, "x", "y"),
            (2, 1, "f", "add", None, None, None, None),
            (2, 1, "f", "add", '{"b":5,"a":4}', None, None, None),
        ],
        CALL,
    )
    results = spark.createDataFrame(
        [("c", 6, "later"), ("c", 6, "early"), ("a", 2, None), (None, 1, "lost"), ("q", 1, "no call")],
        "call_id string, turn long, content string",
    )
    found = chat.linked_calls(calls, results, SCHEMAS, workspace).collect()
    by_id = {(r["call_id"], r["valid"]): r for r in found}
    assert len(found) == 8 and len(by_id) == 8
    assert {k: by_id[k]["level"] for k in by_id} == {
        ("a", False): 0, ("b", False): 1, ("c", True): 2, ("d", False): None, ("e", False): None,
        (None, False): None, ("f", False): 0, ("f", True): 0,
    }
    line = by_id["c", True]["line"]
    assert by_id["c", True]["results"] == 2
    assert line == json.dumps({"arguments": '{"a":1,"b":2,"note":"é\\n"}', "id": "c", "name": "add", "result": "early"}, ensure_ascii=False, separators=(",", ":"))
    assert {r["call_id"] for r in chat.orphans(calls, results).collect()} == {None, "q"}
    empty = chat.linked_calls(calls.limit(0), results, SCHEMAS, workspace)
    assert empty.count() == 0
    plan = chat.linked_calls(calls, results, SCHEMAS, workspace)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_chain_is_ordered(spark, workspace):
    calls = spark.createDataFrame([(1, k, f"{k:03}", "t", "{}", [f"{k - 1:03}"] if k else [], None, None) for k in range(12)], CALL)
    assert {r["call_id"]: r["level"] for r in chat.levels(calls, workspace).collect()} == {f"{k:03}": k for k in range(12)}


def test_turns_without_conversation_or_number_are_calls(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 2, "user", "c"), (1, None, "user", "d"), (None, None, "user", "e"),
            (None, 3, "assistant", "f"), (1, None, "assistant", "g")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {json.loads(json.loads(r["line"])["arguments"])["text"]: r for r in QUERIES["op3_chat"](spark, str(tmp_path)).collect()}
    assert {k: (r["call_id"], r["level"], r["valid"], r["results"]) for k, r in found.items()} == {
        "a": ("1-0", 0, True, 1), "c": (None, None, True, 0), "d": (None, None, True, 0), "e": (None, None, True, 0),
    }


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    if not FOLDER.exists():
        pytest.skip("test tables are not here")
    duck = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = QUERIES[name](spark, str(FOLDER))
    answer = duck.execute(ORACLES[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, answer.fetchall()))
