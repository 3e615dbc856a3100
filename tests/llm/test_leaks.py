import random

import numpy as np
import pytest

from tidewell.llm.leaks import ItemIndex, edit_distances, edits_allowed, item_blocks, leak_counts, leak_recall, leaked_items, words_of

COMMON = [f"w{k}" for k in range(60)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def brute(docs, items, passage=12):
    found = {}
    for d, text in docs:
        own = words_of(text)
        for i, item in items:
            w = words_of(item)
            size = min(passage, len(w))
            if not size or d is None or i is None:
                continue
            most = edits_allowed(size)
            for a in range(len(own) - size + 1):
                for b in range(len(w) - size + 1):
                    if len(set(own[a : a + size]) & set(w)) < len(set(w[b : b + size])) - most:
                        continue
                    n = distance(own[a : a + size], w[b : b + size])
                    if n <= most:
                        found[d, i] = min(n, found.get((d, i), n))
    return found


def corpus(seed, n_docs=120):
    rng = random.Random(seed)
    items = [(100 + k, " ".join(rng.choice(COMMON) for _ in range(rng.choice([1, 3, 7, 11, 12, 13, 30])))) for k in range(25)]
    items += [(200, items[0][1]), (201, ""), (202, None), (203, "?!"), (None, "w1 w2"), (204, "Öl über alles 5 x"), (100, items[0][1])]
    docs = []
    for k in range(n_docs):
        words = [rng.choice(COMMON + ["foreign", "zzz"] * 20) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            own = words_of(rng.choice(items[:25])[1])
            cut = rng.randint(0, max(0, len(own) - 12))
            own = own[cut : cut + rng.choice([11, 12, 13, 40])]
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["zzz"], [own[at], "zzz"]])
                own = own or ["zzz"]
            words[len(words) // 2 : len(words) // 2] = own
        docs.append((k, rng.choice([" ", "  ", ", ", "\n- ", "<b>"]).join(w.upper() if rng.random() < 0.3 else w for w in words)))
    docs += [(900, None), (901, ""), (902, "…"), (903, "ÖL ÜBER-ALLES 5—X"), (1, docs[1][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_passages_are_all_found_and_near_ones_mostly(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "'x' AS distance").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'s' AS suite")
    rows = leaked_items(d, i).collect()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
    assert len(got) == len(rows)
    expected = brute(docs, items)
    exact = {p for p, n in expected.items() if n == 0}
    assert {p for p, n in got.items() if n == 0} == exact and exact
    assert set(got) <= set(expected) and all(got[p] >= expected[p] for p in got)
    near = set(expected) - exact
    assert len(near) > 8 and len(near & set(got)) >= 0.9 * len(near)
    counts = {r["item_id"]: (r["n_exact"], r["n_documents"]) for r in leak_counts(leaked_items(d, i)).collect()}
    assert sum(c[0] for c in counts.values()) == len(exact)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus(3, 25)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, leaked_items(d, i).where("distance = 0").select("doc_id", "item_id").collect()))
    assert len(list(item_blocks(i, "item_id", "text", 40))) > 3
    monkeypatch.setattr("tidewell.llm.leaks.item_blocks", lambda a, b, c: item_blocks(a, b, c, 40))
    assert sorted(map(tuple, leaked_items(d, i).where("distance = 0").select("doc_id", "item_id").collect())) == whole


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0
    assert [tuple(r) for r in leaked_items(d, i).collect()] == [(1, 1, 0, 1, 0, 1)]
    large = 2**62 + 1
    d = spark.createDataFrame([(None, "x a b"), (large, "a b a b"), (large, "a b")], "doc_id bigint, text string").coalesce(1)
    assert {tuple(r) for r in leaked_items(d, i).collect()} == {(None, 1, 0, 1, 1, 2), (large, 1, 0, 2, 0, 3)}


def test_edit_distance_in_a_band():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (300, 12))
    b = a.copy()
    for row in b:
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, 12)
            row[at:] = np.append(row[at + 1 :], rng.integers(0, 4)) if rng.random() < 0.5 else row[at:]
            row[rng.integers(0, 12)] = rng.integers(0, 4)
    for most in (0, 1, 2, 3):
        assert edit_distances(a, b, most).tolist() == [min(most + 1, distance(x.tolist(), y.tolist())) for x, y in zip(a, b, strict=True)]


def test_long_text_and_no_windows_across_texts():
    index = ItemIndex.build([(1, [f"k{n}" for n in range(20)])])
    halves = [" ".join(f"k{n}" for n in range(6)), " ".join(f"k{n}" for n in range(6, 20))]
    assert sorted(set(index.search(halves)["text"])) == [1]
    long = "x " * 300_000 + halves[1] + " y" * 300_000
    assert index.search([long])["distance"].tolist() == [0]
    assert len(index.search([])) == 0 and len(ItemIndex.build([]).search(["a b"])) == 0


def test_exhaustive_search_and_recall(spark):
    docs, items = corpus(4, 60)
    expected = brute([d for d in docs if d[1]], items)
    named = [(i, words_of(t)) for i, t in items if i is not None and t is not None]
    found = ItemIndex.build(named).exhaustive([words_of(t) for _, t in docs])
    assert {(docs[t][0], i): n for (t, i), n in found.items()} == expected
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    rows = {r["distance"]: (r["n_matches"], r["n_found"]) for r in leak_recall(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert sum(n for n, _ in rows.values()) == len(expected) and rows[0][0] == rows[0][1] == sum(n == 0 for n in expected.values())
    assert all(found <= n for n, found in rows.values())
    none = leak_recall(d.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(map(tuple, none)) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
