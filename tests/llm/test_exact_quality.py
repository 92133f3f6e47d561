import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from glasspool.llm import exact, quality
from tests.llm.conftest import odd_rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(rows):
    found = defaultdict(list)
    for row in rows:
        found[row[1] or ""].append(row[0])
    return found


def test_duplicate_groups_against_brute_force(small):
    same = groups(small.select("doc_id", "text").collect())
    found = {r["doc_id"]: tuple(r)[1:] for r in exact.duplicate_groups(small).collect()}
    assert found == {
        i: (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in same.items() for i in ids
    }


def test_a_full_filter_changes_nothing(odd):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(exact.duplicate_groups(odd)) == rows(exact.duplicate_groups(odd, most_words=1))


def test_duplicate_groups_of_odd_rows(odd):
    found = exact.duplicate_groups(odd).collect()
    assert len(found) == len(odd_rows())
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert by_id[1] == [(2, 3, False)] and by_id[2] == [(2, 3, True)]
    assert by_id[4] == [(5, 2, False)] and by_id[8] == [(8, 2, True)]
    assert by_id[13] == [(13, 2, True)] * 2
    assert sorted(by_id[None], key=repr) == [(2, 3, False), (None, 1, True)]


def test_drop_copies_keeps_columns_and_empty_tables(odd, nothing):
    left = exact.drop_copies(odd)
    assert left.schema == odd.schema
    assert {r["doc_id"] for r in left.collect()} == {None, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15}
    assert exact.drop_copies(nothing).count() == exact.duplicate_groups(nothing).count() == 0


def test_the_main_path_is_native(odd):
    plan = exact.duplicate_groups(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def counted(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(lines), sum("A" <= c <= "Z" for c in text),
    )


def test_counts_against_brute_force(small):
    for text in [*texts(small).values(), *(r[1] or "" for r in odd_rows()), "a b c a b c", "x x x x", "a\n a\na\n\n"]:
        assert tuple(map(int, quality.measure(text.encode()))) == counted(text)


def test_sketch_buckets(spark):
    frame = spark.range(0, 70_000, 7).select("id", quality.bucket(F.col("id")).alias("least"))
    for row in frame.collect():
        assert row["least"] <= row["id"] < row["least"] * (1 + 1 / 32) + 1


def test_verdicts_follow_the_sketch(spark, workspace):
    plain = lambda i: "\n".join(f"w{i} a{k} b{k + i} words{k} li{k}ne" for k in range(12))
    clean = [(i, plain(i), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"word{i}{k} ***" for k in range(60)), "en", "a") for i in range(20)]
    rare = [(2000, plain(2000), "xx", "b")]
    docs = spark.createDataFrame(clean + junk + rare, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.judge(docs, workspace).filter("kept").collect()}
    assert kept == {i for i, *_ in clean} | {2000}
    left = quality.keep_good(docs, workspace)
    assert left.schema == docs.schema and {r["doc_id"] for r in left.collect()} == kept


def test_fences_against_sorted_values(spark, workspace, small):
    judged = quality.judge(small, workspace).join(small.select("doc_id", "lang", "source"), "doc_id").collect()
    down = lambda v: v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6)
    values = lambda rows, a, b: sorted(down(1000 * r[a] // r[b]) if r[b] else 0 for r in rows)
    sound = [r for r in judged if not r["base_failed"]]
    quart = lambda v, q: v[-(-len(v) * q // 100) - 1]
    for r in judged:
        chosen = sound
        for part in ([s for s in sound if s["lang"] == r["lang"]], [s for s in sound if (s["lang"], s["source"]) == (r["lang"], r["source"])]):
            chosen = part if len(part) >= quality.LEAST_GROUP else chosen
        good = not r["base_failed"]
        for a, b, slack, two in quality.RATIOS.values():
            v, x = values(chosen, a, b), 1000 * r[a] // r[b] if r[b] else 0
            q25, q50, q75 = (quart(v, q) for q in (25, 50, 75))
            good &= x <= q75 + 3 * max(q75 - q50, slack) and (not two or x >= q25 - 3 * max(q50 - q25, slack))
        assert r["kept"] == good


def test_quality_of_odd_rows_and_empty_tables(odd, nothing, workspace):
    found = quality.judge(odd, workspace).collect()
    assert len(found) == len(odd_rows())
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] == 0)
    assert quality.keep_good(odd, workspace).schema == odd.schema
    assert quality.judge(nothing, workspace).count() == quality.keep_good(nothing, workspace).count() == 0
