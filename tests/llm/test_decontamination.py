import hashlib
import random
import re

from tests.llm import cases
from tidemark.llm import decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        own = words(text)
        for k in range(max(1, len(own) - 12) if own else 0):
            windows.setdefault(tuple(own[k : k + 13]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if (w := tuple(own[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    names |= windows[w]
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def tables(spark, path, docs, items):
    spark.createDataFrame(docs, cases.DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 2)
    items = [(k % 9, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for k in range(12)] + [(20, None), (None, "an item without any id")]
    docs = []
    for k in range(60):
        own = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            text = (rng.choice(items)[1] or "").split()
            start = rng.randint(0, max(0, len(text) - 5))
            at = rng.randint(0, len(own))
            own[at:at] = text[start : start + rng.randint(5, 40)]
        docs.append((k, rng.choice([" ", ", ", "-"]).join(own).title()))
    return docs + cases.EDGE, items


def test_hits_equal_brute_force(spark, tmp_path):
    for seed in range(3):
        docs, items = planted(seed)
        found = decontamination.op10_decontamination(spark, tables(spark, tmp_path / str(seed), docs, items))
        assert cases.rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(docs, items)


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs, items = planted(7)
    docs_df, bench = spark.createDataFrame(docs, cases.DOCS), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 300)
    monkeypatch.setattr(decontamination, "FOLLOWED", 5)
    names = ["doc_id", "n_words", "n_hit", "hit_items", "contaminated", "longest_match", "longest_item", "longest_doc_word"]
    one = cases.rows(decontamination.with_hits(docs_df, bench).select(names))
    assert cases.rows(decontamination.with_hits(docs_df, bench, block_bytes=600).select(names)) == one


def brute_matches(docs, items):
    """(item, item word) -> (words, -doc, -word) of the longest match of at least a window."""
    best = {}
    for name, text in {(("" if i is None else str(i)), t) for i, t in items}:
        own = words(text)
        least = min(13, len(own))
        for at in range(len(own) - least + 1 if own else 0):
            for doc, other in docs:
                there = words(other)
                for place in range(len(there)):
                    n = 0
                    while at + n < len(own) and place + n < len(there) and own[at + n] == there[place + n]:
                        n += 1
                    if n >= least:
                        best[name, at] = max(best.get((name, at), (0, 0, 0)), (n, -doc, -place))
    return best


def test_longest_matches_equal_brute_force(spark):
    for seed in range(2):
        docs, items = planted(seed)
        docs = [(d, t) for d, t in docs[:40]]
        docs_df, bench = spark.createDataFrame(docs, cases.DOCS), spark.createDataFrame(items, "item_id long, text string")
        for size in (1 << 20, 700):
            found = {(r.item_id, r.item_word): (r.n_words, -r.doc_id, -r.doc_word) for r in decontamination.longest_matches(docs_df, bench, block_bytes=size).collect()}
            assert found == brute_matches(docs, items)


def test_a_documents_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "x " + " ".join(item.split()[5:50]) + " y " + " ".join(item.split()[:20])), (2, " ".join(item.split()[5:20])), (3, "clean")], cases.DOCS)
    found = decontamination.with_hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert cases.rows(found, "doc_id", "longest_match", "longest_item", "longest_item_word", "longest_doc_word") == [(1, 45, "1", 5, 1), (2, 15, "1", 5, 0), (3, 0, None, None, None)]


def test_removal_and_edge_cases(spark):
    docs, items = planted(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, cases.DOCS).selectExpr("*", "'own' as n_hit", "'own' as contaminated")
    left = decontamination.without_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert sorted([r.doc_id for r in left.collect()], key=repr) == sorted([d for d, *_, bad in brute(docs, items) if not bad], key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.without_contaminated(frame, none).count() == len(docs)
    assert decontamination.with_hits(cases.empty(spark), bench).collect() == []
