import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from glasspool.llm import lm, pii, toxicity
from tests.llm.conftest import FOLDER, odd_rows, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c_d@e.f", "a@b.c@d.e", "@x.y a@ b@c a@b..c é@b.c", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0300.1.1.1", "1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", "+1 (2) 3.4-5 6789 +12 +1234567890123456 ++49 30 123456-",
    "é 12 a.b@c.d, 4111111111111111x", "0000000000000000", "",
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (2 if k % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(part) <= 255 for part in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                found.append((kind, *m.span()))
    return found


def test_base_spans_against_the_patterns(small):
    for text in [*HARD, *texts(small).values()]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_of_long_runs_are_quick():
    for run in ("a" * 200_000 + "@", "1" * 200_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(run)


def disclosing_corpus():
    """`zork` stands near one address in all its documents, `common` everywhere."""
    rows = [(k, f"note {k} from zork: common boss@firm.example said x{k} y{k}") for k in range(6)]
    rows += [(100 + k, f"common words only {k}") for k in range(40)]
    rows += [(200, "only@once.example near rareword"), (201, rows[0][1])]
    return rows


def test_terms_that_disclose(spark, workspace):
    docs = spark.createDataFrame(disclosing_corpus(), "doc_id long, text string")
    by_id = {r["doc_id"]: r["spans"] for r in pii.sanitise(docs, workspace).collect()}
    text = disclosing_corpus()[0][1]
    terms = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in by_id[0].split(",") if s.startswith("term")]
    assert "zork:" in terms and "common" not in terms and "x0" not in terms
    assert by_id[201] == by_id[0] and by_id[100] == "" and "term" not in by_id[200]
    left = {r["doc_id"]: r["text"] for r in pii.redact(docs, workspace).collect()}
    assert "[EMAIL]" in left[0] and "zork" not in left[0] and "common" in left[0] and "boss" not in left[0]
    assert left[201] == left[0] and left[100] == "common words only 0"


def test_quotient_against_brute_force(spark, workspace, small):
    narrow = small.select("doc_id", "text")
    found = workspace.store(pii.find(narrow.selectExpr("doc_id", "text", "monotonically_increasing_id() AS row")))
    pairs = {tuple(r) for r in pii.disclosing(found, narrow, workspace, alpha=0.5, least_texts=2).collect()}
    words, entities, near, kinds = Counter(), Counter(), Counter(), {}
    for text in texts(small).values():
        spans = pii.base_spans(text)
        words.update(set(map(pii._term, text.encode().split())) - {b""})
        entities.update({pii._entity(k, text[s:e]) for k, s, e in spans})
        for pair in {(entity, term) for entity, term, _, _ in pii._near(text, spans)}:
            near[pair] += 1
            kinds.setdefault(pair, set()).add(text)
    total, expected = len(texts(small)), set()
    for (entity, term), n in near.items():
        quotient = math.log2(n * total / (words[term] * entities[entity])) / math.log2(total / entities[entity])
        if len(kinds[entity, term]) >= 2 and quotient >= 0.5:
            expected.add((entity, int(pii._keys([term])[0])))
    assert pairs == expected


def test_terms_far_from_their_entity_and_in_other_documents(spark, workspace):
    filler = lambda k: " ".join(f"f{j}" for j in range(60)) + f" v{k}"
    rows = [(k, f"Quillfeather, {filler(k)} boss@firm.example {filler(k)} quillfeather.") for k in range(20)]
    rows += [(50, f"they met Quillfeather {filler(50)}")]
    rows += [(100 + k, filler(k)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = {r["doc_id"]: r["spans"] for r in pii.sanitise(docs, workspace).collect()}
    left = {r["doc_id"]: r["text"] for r in pii.redact(docs, workspace).collect()}
    for i, text in rows:
        marked = [tuple(map(int, s.split(":")[1:])) for s in by_id[i].split(",") if s.startswith("term")]
        assert marked == [m.span() for m in re.finditer(r"(?i)quillfeather[.,]?", text)], i
        assert "uillfeather" not in left[i] and "f7 f8" in left[i]


def test_terms_go_from_rows_without_id(spark, workspace):
    docs = spark.createDataFrame([(None if k == 0 else i, t) for k, (i, t) in enumerate(disclosing_corpus())], "doc_id long, text string")
    left = [r["text"] for r in pii.redact(docs, workspace).collect() if r["doc_id"] is None]
    assert len(left) == 1 and "[EMAIL]" in left[0] and "zork" not in left[0] and "common" in left[0]


def test_pii_of_odd_rows(odd, nothing, workspace):
    rows = pii.sanitise(odd, workspace).collect()
    assert len(rows) == len(odd_rows())
    found = {r["doc_id"]: r for r in rows}
    assert [found[12][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 0, 1]
    assert found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[1]["spans"] == ""
    left = pii.redact(odd, workspace, length_column="n_chars")
    assert left.columns == odd.columns
    by_id = {r["doc_id"]: r for r in left.collect()}
    assert by_id[12]["text"] == "write to [EMAIL] now, [PHONE] or [IP]" and by_id[12]["n_chars"] == len(by_id[12]["text"])
    assert by_id[1]["text"] is None and left.count() == len(odd_rows())
    assert pii.sanitise(nothing, workspace).count() == pii.redact(nothing, workspace).count() == 0


def brute_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the best segment, then both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    start = -best[2]
    end = start - best[1]
    left = brute_segments(scores[:start])
    right = [(s + end, e + end, v) for s, e, v in brute_segments(scores[end:])]
    return [*left, (start, end, best[0]), *right]


def test_segments_against_brute_force():
    random = np.random.default_rng(7)
    for _ in range(300):
        scores = random.integers(-4, 5, random.integers(0, 15)).astype(float) + random.choice([0, 0.25])
        found = toxicity.maximal_segments(scores)
        assert sum(v for *_, v in found) == pytest.approx(sum(v for *_, v in brute_segments(scores.tolist())))
        assert all(v == pytest.approx(scores[s:e].sum()) and v > 0 for s, e, v in found)
        assert max([0.0, *(v for *_, v in found)]) == pytest.approx(max([0.0, *(v for *_, v in brute_segments(scores.tolist()))]))


def toxic_corpus():
    random = np.random.default_rng(9)
    vocabulary = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for k in range(900):
        words = list(random.choice(vocabulary, 60))
        if toxic := k % 6 == 0:
            words[20:24] = random.choice(["vile", "rotten", "filth", "foul"], 4)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_texts(spark, workspace):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic long")
    rows = toxicity.toxicity(frame, marks, workspace).collect()
    truth = dict(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if truth[r["doc_id"]] and r["predicted"]:
            assert any(s["start"] <= 23 and s["end"] > 20 for s in r["segments"])


def plain_segments(scores):
    """The scores of `brute_segments`, by sums of prefixes."""
    sums = [0.0]
    for score in scores:
        sums.append(sums[-1] + score)

    def within(low, high):
        spans = [(sums[j] - sums[i], i, j) for i in range(low, high) for j in range(i + 1, high + 1)]
        value, i, j = max(spans, key=lambda span: (span[0], span[1] - span[2]), default=(0.0, 0, 0))
        return [*within(low, i), value, *within(j, high)] if value > 0 else []

    return within(0, len(scores)) if any(score > 0 for score in scores) else []


def plain_logistic(x, y):
    """Intercept and slope of the penalised logistic loss, by Newton's steps on plain numbers."""
    a = b = 0.0
    n = len(x)
    for _ in range(50):
        chances = [1 / (1 + math.exp(-max(-30, min(30, a + b * v)))) for v in x]
        ga = sum(p - t for p, t in zip(chances, y)) / n + toxicity.PENALTY * 1e-3 * a
        gb = sum((p - t) * v for p, t, v in zip(chances, y, x)) / n + toxicity.PENALTY * b
        weights = [p * (1 - p) for p in chances]
        aa = sum(weights) / n + toxicity.PENALTY * 1e-3
        ab = sum(w * v for w, v in zip(weights, x)) / n
        bb = sum(w * v * v for w, v in zip(weights, x)) / n + toxicity.PENALTY
        a, b = a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab)
    return a, b


def brute_toxicity(texts, training):
    """The score of each of `texts`, from `training` rows (text, toxic, calibrates), without Spark or numpy."""
    counts = {flag: Counter(w for text, toxic, cal in training if toxic == flag and not cal for w in text.split()) for flag in (0, 1)}
    n0, n1 = (sum(counts[flag].values()) for flag in (0, 1))
    weighed = {}
    for word in {*counts[0], *counts[1]}:
        y, n = counts[1][word], counts[0][word]
        prior, whole = toxicity.PRIOR * (y + n), toxicity.PRIOR * (n1 + n0)
        odds = math.log((y + prior) / (n1 + whole - y - prior)) - math.log((n + prior) / (n0 + whole - n - prior))
        weighed[word] = odds, abs(odds) / math.sqrt(1 / (y + prior) + 1 / (n + prior))
    best = None
    for least in toxicity.SIGNIFICANT:
        odds = {word: value for word, (value, z) in weighed.items() if z >= least}
        for cost in toxicity.COSTS:
            def segments(text):
                return plain_segments([odds.get(w, 0.0) - cost for w in text.split()])

            shares = [((counts[0][w] + 0.5) / n0, value - cost) for w, value in odds.items()]
            shares.append((max(0.0, 1 - sum(share for share, _ in shares)), -cost))
            moment = lambda rate: sum(share * math.exp(min(700, rate * score)) for share, score in shares) - 1
            low, high = 1e-6, 1.0
            while moment(high) < 0 and high < 64:
                high *= 2
            for _ in range(60):
                low, high = ((low + high) / 2, high) if moment((low + high) / 2) < 0 else (low, (low + high) / 2)
            rate = high
            chosen = [(segments(text), len(text.split()), toxic) for text, toxic, calibrates in training if calibrates]
            clean = [(max(found, default=0.0), size) for found, size, toxic in chosen if not toxic]
            log_k = rate * sum(top for top, _ in clean) / len(clean) - 0.5772 - sum(math.log(size) for _, size in clean) / len(clean)

            def evidence(found, size):
                return sum(max(0.0, rate * score - log_k - math.log(size)) for score in found)

            x, y = [math.log1p(evidence(found, size)) for found, size, _ in chosen], [toxic for *_, toxic in chosen]
            a, b = plain_logistic(x, y)
            chances = [max(1e-9, min(1 - 1e-9, 1 / (1 + math.exp(-(a + b * v))))) for v in x]
            loss = -sum(math.log(p if toxic else 1 - p) for p, toxic in zip(chances, y)) / len(y)
            if best is None or loss < best[0] - 1e-12:
                scores = [a + b * math.log1p(evidence(segments(text), len(text.split()))) for text in texts]
                best = loss, [1 / (1 + math.exp(-v)) for v in scores]
    return best[1]


def test_toxicity_scores_against_brute_force(spark, workspace):
    docs, labels = toxic_corpus()
    docs, truth = docs[:300], dict(labels)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:300], "doc_id long, toxic long")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame, marks, workspace).collect()}
    third = {r[0]: r[1] for r in frame.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(3)) == 0).collect()}
    training = [(text, truth[k], third[k]) for k, text in docs if zlib.crc32(str(k).encode()) % 3 != 1]
    expected = brute_toxicity([text for _, text in docs], training)
    assert [found[k] for k, _ in docs] == pytest.approx(expected, abs=1e-6)
    assert max(expected) > 0.7 > 0.3 > min(expected)


def test_calibration_rows_do_not_grow_with_texts(spark):
    """What the driver reads has a value for each model, however many segments a text has."""
    model = toxicity.Model(toxicity.toxic_tokens(b"foul"), np.array([2.0]))
    frame = spark.createDataFrame([("foul a b c " * 50_000, True), ("foul", False), ("", False)], "text string, toxic boolean")
    rows = toxicity._measured(frame, [model, model], lambda model, size, segments: len(segments))
    assert sorted(zip(rows["size"], (list(v) for v in rows["values"]))) == [(0, [0, 0]), (1, [1, 1]), (200_000, [50_000, 50_000])]


def test_toxicity_of_odd_rows(odd, nothing, spark, workspace):
    labels = spark.createDataFrame([(4, 1), (6, 0), (9, 0), (12, 1), (13, 0), (14, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels, workspace).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len(toxicity.toxicity(odd, labels.limit(0), workspace).collect()) == len(odd_rows())
    assert toxicity.toxicity(nothing, labels, workspace).count() == 0


def test_scores_against_brute_force(small, workspace):
    rows = {r["doc_id"]: r for r in lm.score(small, workspace).collect()}
    lower = lambda text: text.encode().lower().split() + [None]
    counts, held = Counter(), lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    for i, text in texts(small).items():
        if not held(i):
            counts.update(lower(text))
    total, distinct = sum(counts.values()), len(counts)
    for i, text in texts(small).items():
        words, r = lower(text), rows[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(words), sum(counts[w] > 0 for w in words), total)


def test_a_small_head_changes_little(small, workspace, monkeypatch):
    """Head words and others are counted alike; only the rounding of sums differs."""
    whole = {r["doc_id"]: r for r in lm.score(small, workspace).collect()}
    monkeypatch.setattr(lm.Vocabulary.of.__func__, "__defaults__", (1000, lm.TOP, lm.VECTORS))
    for r in lm.score(small, workspace).collect():
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], abs=1e-6)
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]


def prepared_texts(docs, workspace):
    narrow = docs.select("doc_id", F.lit(False).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    texts = workspace.store(lm.hashed(narrow))
    counts = workspace.store(lm.word_counts(texts))
    return texts, counts


@pytest.fixture(scope="module")
def fitted(small, workspace):
    """A model with few vectors, so that words of all three kinds are frequent."""
    texts, counts = prepared_texts(small, workspace)
    vocabulary = lm.Vocabulary.of(counts, head=3000, vectors=1500)
    codes = workspace.store(lm.encoded(texts, vocabulary))
    return counts, vocabulary, codes, lm.train(codes, vocabulary)


def brute_log(parameters, vocabulary, sizes, word, count, ending, near, far):
    """log10 P(word | two classes), with every sum over all alternatives written out."""
    r = parameters["R"][near].astype(float) @ parameters["A1"] + parameters["R"][far].astype(float) @ parameters["A2"]
    scores = parameters["Q"].astype(float) @ r + parameters["b"]
    found = np.flatnonzero(vocabulary.words == np.uint64(word))
    code = int(vocabulary.codes[found[0]]) if found.size else -1
    if 0 <= code < lm.TOP:
        return scores[code] / math.log(10) - np.log10(np.exp(scores).sum()), code
    shared = int(vocabulary.first[ending] + (word >> 40) % vocabulary.parts[ending])
    low, high = vocabulary.starts[shared], vocabulary.starts[shared + 1]
    inner = parameters["U"][low:high].astype(float) @ r + parameters["c"][low:high]
    entry = code - lm.TOP if code >= 0 else high - 1
    log = (scores[lm.TOP + shared] + inner[entry - low]) / math.log(10) - np.log10(np.exp(scores).sum()) - np.log10(np.exp(inner).sum())
    if code < 0:
        n, v = sizes[shared]
        log += math.log10((count + 1) / (n + v + 1))
    return log, lm.TOP + shared


def test_model_scores_against_brute_force(small, workspace, fitted):
    """The score of whole texts as a sum over their words, each normalised over the whole vocabulary."""
    counts, vocabulary, codes, parameters = fitted
    rows = counts.collect()
    n_of = {r["word"] % 2**64: (r["n"], r["word"] % 2**16) for r in rows}
    with_vector = {int(w) for w, c in zip(vocabulary.words, vocabulary.codes) if c >= 0}
    sizes = {k: [0, 0] for k in range(lm.SUFFIXES)}
    for word, (n, ending) in n_of.items():
        if word not in with_vector:
            shared = int(vocabulary.first[ending] + (word >> 40) % vocabulary.parts[ending])
            sizes[shared][0] += n
            sizes[shared][1] += 1
    tables = lm.Tables.of(parameters, vocabulary.starts)
    found = {r["row"]: r["model_log"] for r in lm.model_scores(codes, vocabulary, tables).collect()}
    rest = {r["row"]: r for r in codes.select("row", "doc_id", "rest_log", "tail").collect()}
    all_texts, kinds = texts(small), Counter()
    for row in sorted(rest)[:20]:
        hashes = lm.tokens(all_texts[rest[row]["doc_id"]].encode()[:4000])
        if len(all_texts[rest[row]["doc_id"]].encode()) > 4000:
            continue
        near = far = lm.START
        want = 0.0
        for word, ending in zip(hashes.tolist(), lm.endings_of(hashes).tolist()):
            log, kind = brute_log(parameters, vocabulary, sizes, word, n_of[word][0], ending, near, far)
            want += log
            kinds[word in with_vector, kind < lm.TOP] += 1
            near, far = kind, near
        rare = sum(t["n"] * math.log10(n_of[t["word"] % 2**64][0] + 1) for t in rest[row]["tail"])
        assert found[row] + rest[row]["rest_log"] + rare == pytest.approx(want, rel=1e-4, abs=1e-3)
    assert len(kinds) == 3 and min(kinds.values()) > 20


def test_training_gains_on_held_out_texts(small, workspace):
    rows = lm.score(small, workspace).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_sum_to_one(fitted):
    _, vocabulary, _, parameters = fitted
    tables = lm.Tables.of(parameters, vocabulary.starts)
    every = np.arange(lm.CLASSES)
    for near, far in ((lm.START, lm.START), (3, lm.START), (700, 900)):
        here = lambda size: (np.full(size, near), np.full(size, far))
        assert (10 ** tables.class_logs(*here(lm.CLASSES), every)).sum() == pytest.approx(1, abs=1e-4)
        entries = np.arange(vocabulary.starts[-1])
        logs = tables.entry_logs(*here(entries.size), vocabulary.class_of, entries)
        np.testing.assert_allclose(np.bincount(vocabulary.class_of, 10**logs), 1, atol=1e-4)


def test_hashes_are_found():
    random = np.random.default_rng(8)
    keys = np.unique(random.integers(1, 2**63, 50_000, dtype=np.uint64))
    table = lm.Table(keys)
    np.testing.assert_array_equal(table.find(keys), np.arange(keys.size))
    others = np.setdiff1d(random.integers(1, 2**63, 50_000, dtype=np.uint64), keys)
    assert (table.find(others) == -1).all() and lm.Table(keys[:0]).find(others[:3]).tolist() == [-1] * 3


def test_classes_of_endings_are_balanced():
    random = np.random.default_rng(9)
    endings = np.concatenate([np.full(4000, 7), random.integers(0, 3000, 8000)])
    first, parts = lm._classes_of_endings(endings)
    hashes = random.integers(1, 2**63, endings.size, dtype=np.uint64)
    hashes = (hashes & ~lm.ENDING) | endings.astype(np.uint64)
    shared = lm._shared_class(first, parts, hashes)
    sizes = np.bincount(shared, minlength=lm.SUFFIXES)
    assert shared.min() >= 0 and shared.max() < lm.SUFFIXES and sizes.max() < 3 * endings.size / lm.SUFFIXES
    every = np.arange(1 << 16)
    assert ((first >= 0) & (first + parts <= lm.SUFFIXES)).all() and first.size == every.size
    assert lm._classes_of_endings(endings[:0])[1].max() == 1


def random_parameters(seed, entries=900):
    random = np.random.default_rng(seed)
    return {name: (random.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in lm.shapes(entries).items()}


STARTS = np.concatenate([[0], np.cumsum([3] * 200 + [5] * 55 + [25])])


def test_training_learns_what_follows():
    """Each class is followed by its neighbour; the model must find that beyond class shares."""
    shares, inner = np.full(lm.CLASSES, 1 / lm.CLASSES), 1 / np.repeat(np.diff(STARTS), np.diff(STARTS))
    start = random_parameters(1)
    start["b"][:], start["c"][:] = np.log(shares), np.log(inner)
    trainer, random = lm.Trainer(start, shares, inner, STARTS, 0), np.random.default_rng(2)
    for _ in range(400):
        near = random.integers(0, 40, 512)
        # after an even class its neighbour, after an odd one an entry of the last class
        target = np.where(near % 2 == 0, (near + 1) % 40, lm.CLASSES - 1)
        entry = np.where(near % 2 == 0, -1, STARTS[-2] + near % 25)
        trainer.step(near, random.integers(0, 40, 512), target, entry)
    near, far = np.arange(0, 40, 2), np.zeros(20, dtype=np.int64)
    gain = lambda p, q: lm.Tables.of(p, STARTS).class_logs(near, far, q).sum()
    assert gain(trainer.p, near + 1) > gain(start, near + 1) + 10
    odd = np.arange(1, 40, 2)
    words = lambda p: lm.Tables.of(p, STARTS).entry_logs(odd, far, np.full(20, lm.SUFFIXES - 1), STARTS[-2] + odd % 25).sum()
    assert words(trainer.p) > words(start) + 10


def test_every_position_is_trained(spark, workspace, monkeypatch):
    """Short texts too: over the rounds, each token of each training text is a target once."""
    frame = spark.createDataFrame([(k, "ab c") for k in range(40)], "doc_id long, text string")
    texts, counts = prepared_texts(frame, workspace)
    vocabulary = lm.Vocabulary.of(counts)
    assert vocabulary.tokens == 120
    codes = [np.frombuffer(r["codes"], "<u2") for r in lm.encoded(texts, vocabulary).collect()]
    seen = Counter()
    for turn in range(lm.ROUNDS):
        for k, one in enumerate(codes):
            seen.update((k, p) for p in range(len(one))[(len(one) + turn) % lm.ROUNDS :: lm.ROUNDS])
    assert sum(seen.values()) == 120 and set(seen.values()) == {1}
    parameters = lm.train(workspace.store(lm.encoded(texts, vocabulary)), vocabulary)
    assert parameters["Q"].shape == (lm.CLASSES, lm.WIDTH) and not np.array_equal(parameters["Q"], lm.initial(vocabulary)["Q"])


def test_a_step_against_full_gradients():
    shares, inner = np.full(lm.CLASSES, 1 / lm.CLASSES), 1 / np.repeat(np.diff(STARTS), np.diff(STARTS))
    start, random = random_parameters(3), np.random.default_rng(4)
    trainer = lm.Trainer(start, shares, inner, STARTS, 5)
    near, far = random.integers(0, 50, (2, 300))
    target = np.where(np.arange(300) % 3 == 0, random.integers(0, 50, 300), lm.TOP + random.integers(0, 50, 300))
    entry = np.where(target >= lm.TOP, STARTS[np.maximum(target - lm.TOP, 0)] + random.integers(0, 3, 300), -1)
    trainer.step(near, far, target, entry)
    again = np.random.default_rng(5)
    noise = np.searchsorted(np.cumsum(shares), again.random(lm.NOISE))
    r = start["R"][near] @ start["A1"] + start["R"][far] @ start["A2"]
    logit = lambda rows: r @ start["Q"][rows].T + start["b"][rows] - np.log(lm.NOISE * shares[rows])
    true, false = 1 / (1 + np.exp(np.diag(logit(target)))), -1 / (1 + np.exp(-logit(noise)))
    dr = true[:, None] * start["Q"][target] + false @ start["Q"][noise]
    grads = {name: np.zeros(shape) for name, shape in lm.shapes(900).items()}
    np.add.at(grads["Q"], target, true[:, None] * r)
    np.add.at(grads["Q"], noise, false.T @ r)
    np.add.at(grads["b"], target, true)
    np.add.at(grads["b"], noise, false.sum(axis=0))
    some = np.flatnonzero(entry >= 0)
    drawn = np.searchsorted(np.cumsum(inner), (target[some] - lm.TOP)[:, None] + again.random((some.size, lm.INNER_NOISE)))
    for n, i in enumerate(some):
        assert ((STARTS[target[i] - lm.TOP] <= drawn[n]) & (drawn[n] <= STARTS[target[i] - lm.TOP + 1])).all()
        last = STARTS[target[i] - lm.TOP + 1] - 1
        for k, sign in [(entry[i], 1), *((min(d, last), -1) for d in drawn[n])]:
            z = start["U"][k] @ r[i] + start["c"][k] - np.log(lm.INNER_NOISE * inner[k])
            pull = 1 / (1 + np.exp(z)) if sign > 0 else -1 / (1 + np.exp(-z))
            grads["U"][k] += pull * r[i]
            grads["c"][k] += pull
            dr[i] += pull * start["U"][k]
    np.add.at(grads["R"], near, dr @ start["A1"].T)
    np.add.at(grads["R"], far, dr @ start["A2"].T)
    grads["A1"], grads["A2"] = start["R"][near].T @ dr, start["R"][far].T @ dr
    for name, grad in grads.items():
        grad /= target.size
        np.testing.assert_allclose(trainer.p[name], start[name] + lm.RATE * grad / np.sqrt(1e-2 + grad * grad), atol=2e-5)


def test_scores_of_odd_rows(odd, nothing, workspace):
    rows = lm.score(odd, workspace).collect()
    assert len(rows) == len(odd_rows()) and all(r["score"] < 0 and math.isfinite(r["base_score"]) for r in rows)
    assert lm.score(nothing, workspace).count() == 0


def test_pipeline_stages(spark, small, workspace):
    """Each stage against its own input: what it rejects, keeps and rewrites."""
    stages = dict(corpus_pipeline.STAGES)
    folder, before = str(FOLDER), small
    sizes = []
    for name in list(stages)[:-1]:
        after = workspace.store(stages[name](spark, before, folder))
        assert after.columns == small.columns
        old, new = texts(before), texts(after)
        assert set(new) <= set(old) and len(new) == after.count()
        if name == "exact_dedup":
            same = {}
            for i, text in old.items():
                same[text] = max(i, same.get(text, -1))
            assert set(new) == set(same.values())
        if name == "remove_pii":
            assert set(new) == set(old) and not any(pii.base_spans(t) for t in new.values())
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if r["text"] != old[r["doc_id"]])
        else:
            assert all(new[i] == old[i] for i in new)
        sizes.append(len(new))
        before = after
    assert 0 < sizes[-1] < len(texts(small))
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == sizes[-1]


def test_inner_steps_sort_rows_once(monkeypatch):
    """Vectors and biases of a batch share one sort, and equal sums made row by row."""
    random = np.random.default_rng(3)
    sizes = random.integers(2, 9, lm.SUFFIXES)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    entries = int(starts[-1])
    parameters = {name: (random.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in lm.shapes(entries).items()}
    inner = 1 / np.repeat(sizes, sizes).astype(float)
    trainer = lm.Trainer(parameters, np.full(lm.CLASSES, 1 / lm.CLASSES), inner, starts, 0)
    sorts, sort, updates = [], lm._sorted_rows, {}
    monkeypatch.setattr(lm, "_sorted_rows", lambda rows: sorts.append(rows) or sort(rows))
    monkeypatch.setattr(trainer, "_update", lambda name, rows, grad, size: updates.update({name: (rows, grad.copy())}))
    shared = random.integers(0, lm.SUFFIXES, 50)
    r, dr = random.standard_normal((50, lm.WIDTH)).astype(np.float32), np.zeros((50, lm.WIDTH), np.float32)
    trainer._inner(r, dr, lm.TOP + shared, starts[shared])
    assert len(sorts) == 1
    rows, sums = updates["U"]
    assert list(rows) == sorted(set(sorts[0])) == list(updates["c"][0])
    assert sums.shape == (rows.size, lm.WIDTH) and updates["c"][1].shape == (rows.size,)
    # the products' sum is the same whatever row they fall to
    width = sorts[0].size // 50
    biases = dict(zip(rows, updates["c"][1]))
    alone = [k for k in rows if (sorts[0] == k).sum() == 1]
    assert alone
    for k in alone:
        at = int(np.flatnonzero(sorts[0] == k)[0])
        assert np.allclose(sums[list(rows).index(k)], biases[k] * r[at // width], atol=1e-6)
