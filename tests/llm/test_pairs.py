"""SimHash, decontamination and neighbours against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from siteweave.llm import common, decontaminate, neighbours, registry, simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(i for i in prints if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components(spark):
    random.seed(5)
    words = ["Alpha", "beta", "GAMMA", "delta", "é", "x\x85y", "zeta"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 40))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "one", "Two words", "a\x0bb\x0cc", "w " * 5000]
    texts += [texts[3] + " tail", texts[3], texts[3].lower()]
    docs = spark.createDataFrame([(i * 7 % 71, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string, component_id int")
    got = {r["id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(prints)
    assert got == {i: (signed(p), want[i]) for i, p in prints.items()}


def test_links_in_crowded_and_quiet_segments(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(4)]
    prints = {b for b in base}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(random.randint(1, 6)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    want = brute_components(prints)
    groups = {frozenset(j for j in want if want[j] == want[i]) for i in want}
    frame = spark.createDataFrame([(signed(p),) for p in prints.values()], "fingerprint long")
    names = {signed(p): i for i, p in prints.items()}
    for bucket in (0, 5, 1000):
        roots = {names[r["node"]]: r["root"] for r in common.connected_components(simhash.link_fingerprints(frame, bucket)).collect()}
        found = {frozenset(j for j in roots if roots[j] == roots[i]) for i in roots} | {frozenset([i]) for i in prints if i not in roots}
        assert found == groups


def test_path_and_star_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    roots = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(101)}) == 1 and len({roots[500 + i] for i in range(50)}) == 1 and len(set(roots.values())) == 2
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "same old text here"), (3, "same old text here"), (3, "same old text here"), (9, "another thing altogether now"), (None, "same old text here"), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as h")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 3), (False, 9), (False, 11), (True, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


ITEMS = [
    (1, "Which river runs through the old harbour town of Mirelle in winter? The broad grey Ostra."),
    (2, "The council of seven lamps decided that no bell should ring before the third tide had turned"),
    (3, ""), (4, None), (5, "tiny"),
]


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    random.seed(7)
    noise = lambda n: " ".join(random.choice(["the", "of", "river", "bell", "town", "lamp", "tide", "grey", "and", "ring"]) for _ in range(n))
    near = ITEMS[1][1].replace("third", "fourth")
    texts = [noise(300), noise(150) + " " + ITEMS[0][1].upper() + " " + noise(150), ITEMS[1][1], near, None, "", noise(61) + " " + ITEMS[1][1], "Which river runs? The broad grey Ostra."]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in decontaminate.with_hits(docs, bench).collect()}
    assert got == {0: set(), 1: {1}, 2: {2}, 3: {2} if shingle_share(near) >= 0.8 else set(), 4: set(), 5: set(), 6: {2}, 7: set()}
    assert {r["doc_id"] for r in decontaminate.drop_leaked(docs, bench).collect()} == {i for i, h in got.items() if not h}
    assert decontaminate.drop_leaked(docs, bench.limit(0)).count() == len(texts)


def shingle_share(text):
    whole, there = decontaminate.words_of(ITEMS[1][1].lower()), decontaminate.words_of(text.lower())
    return decontaminate.share(whole, there)


def brute_hits(text, items):
    """Item ids by the rule on every passage, without any retrieval."""
    words, out = decontaminate.words_of((text or "").lower()), []
    for item, item_text in items:
        own = decontaminate.words_of((item_text or "").lower())
        if own:
            n, parts = decontaminate.stride_of(len(own)), [own, *decontaminate.question_and_answer(item_text)]
            passages = [words[s * n : (s + 2) * n] for s in range(len(words) // n + 1)]
            if any(decontaminate.leaks([decontaminate.share(part, p) for part in parts]) for p in passages):
                out.append(item)
    return sorted(out)


def planted(seed, n_items=40, n_docs=60):
    """Items of common and rare words, and documents with damaged copies of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ".", "?"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 70))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = text(rng.randint(0, 400)).split()
        for _ in range(rng.randint(0, 3)):
            part, at = items[rng.randrange(n_items)][1].split(), rng.randint(0, len(words))
            if rng.random() < 0.5:
                part = part[rng.randint(0, len(part) // 8) :]
            else:
                part[rng.randrange(len(part))] = "zzz"
            words[at:at] = part
        docs.append((d, " ".join(words)))
    return items, docs


def test_query_equals_the_rule_on_every_passage(spark, tmp_path):
    items, docs = planted(8)
    items += [items[3], (None, "nothing known about this nameless item"), (50, items[4][1])]
    docs += [(100, None), (101, ""), (102, "x nothing known about this nameless item y"), (102, "x nothing known about this nameless item y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    got = sorted(((r["doc_id"], r["item_id"]) for r in registry.op5_decontaminate(spark, str(tmp_path)).collect()), key=key)
    want = [(d, i) for d, t in docs for i in brute_hits(t, [(-1 if i is None else i, t2) for i, t2 in items])]
    assert [key(x) for x in got] == sorted(want) and len(want) > 30


def test_items_and_shards_never_change_another_items_hits(spark):
    items, docs = planted(9)
    long = (99, " ".join(f"long{i}" for i in range(1000)))
    halves = (98, "first half of an item with many words in it. second half of the same item with some others")
    docs += [(200, "first half of an item with many words in it " + "pad " * 300 + "second half of the same item with some others")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")

    def hits(bench, **more):
        bench = spark.createDataFrame(bench, "item_id long, text string")
        return {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in decontaminate.with_hits(frame, bench, **more).collect()}

    few = hits([*items, halves])
    assert few == {d: brute_hits(t, [*items, halves]) for d, t in docs} and any(few.values())
    assert hits([*items, halves, long]) == few
    assert hits([*items, halves, long], shard_words=300) == few
    assert hits([*items, halves, long], shard_words=300, scan_shards=2) == few
    assert hits(items[:10]) == {d: [i for i in h if i < 10] for d, h in few.items()}


def test_a_scan_keeps_what_shares_a_shingle_with_an_item(spark):
    """Whole text, short items, and question and answer apart; texts without a shared shingle meet no shard."""
    items = [(1, "Who wrote it? Anna did."), (2, "yes"), (3, "one two three four five six seven eight nine ten"), (4, "Is it? yes"), (5, " "), (6, None)]
    texts = ["anna did and who wrote it", "YES", "one two three four six five seven eight nine", "five six seven eight nine", "is it no", "it is", "", None, "wrote it anna"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = decontaminate.build_shards(spark.createDataFrame(items, "item_id long, text string"), shard_words=4).cache()
    assert shards.count() > 1

    def shared(text):
        words = re.findall(r"\w+", text.lower())
        for _, item in items:
            q, a = decontaminate.question_and_answer(item or "")
            for part in (re.findall(r"\w+", (item or "").lower()), q or a):
                width = min(5, len(part))
                if width and {tuple(part[i : i + width]) for i in range(len(part) - width + 1)} & {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}:
                    return True
        return False

    near = decontaminate.sharing(docs.where("text is not null"), "text", shards)
    assert near.columns == docs.columns
    kept = {r["doc_id"] for r in near.collect()}
    assert kept == {i for i, t in enumerate(texts) if t is not None and shared(t)}
    assert {0, 1, 3} <= kept and not {2, 5, 6, 8} & kept
    assert {i for i, t in enumerate(texts) if brute_hits(t, [(n, t2) for n, t2 in items if t2])} <= kept


def test_hits_beside_columns_of_internal_names(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], 7, "a", "b"), (2, "clean", 8, "c", "d")], "doc_id long, text string, __hits int, __key string, __body string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [tuple(r) for r in decontaminate.drop_leaked(docs, bench).collect()] == [(2, "clean", 8, "c", "d")]
    got = decontaminate.with_hits(docs, bench, shard_words=5).orderBy("doc_id").collect()
    assert [(r["__hits"], r["__key"], r["__body"], [h["item_id"] for h in r["hits"]]) for r in got] == [(7, "a", "b", [2]), (8, "c", "d", [])]


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(901, None), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [1.0] * 3), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0")).toPandas()
    hit = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine["score"], d[mine["vec_id"]])
        hit += len(set(want) & set(mine["vec_id"]))
        if q in (0, 100):
            assert list(mine["vec_id"]) == want
    assert hit >= 0.9 * 180
    few = neighbours.search(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3 and neighbours.search(df.limit(0), df.limit(0)).count() == 0


def recall(spark, x, **more):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartitionByRange(3, "vec_id")
    got, hit, asked = neighbours.search(df, df.where("vec_id % 20 = 0"), **more).toPandas(), 0, range(0, len(x), 20)
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.array_equal(mine["score"], d[mine["vec_id"]])
        hit += len({i for i in np.lexsort((np.arange(len(x)), d)) if i != q} & set(mine["vec_id"]) & set([i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]))
    return hit / (10 * len(asked))


def test_search_finds_nine_of_ten_at_any_size(spark, monkeypatch):
    """Cells are skipped at every size; in blocks of 100 vectors."""
    rng = np.random.default_rng(10)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    flat = rng.normal(size=(2000, 16)).astype(np.float32)
    assert recall(spark, flat) >= 0.9
    centres = rng.normal(size=(40, 16)) * 6
    clustered = (centres[np.arange(2000) // 50] + rng.normal(size=(2000, 16))).astype(np.float32)
    assert recall(spark, clustered) >= 0.9 and recall(spark, clustered, probe=0.1) >= 0.9


def test_a_repeated_query_is_asked_once_with_its_least_vector(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)] + [(0, [3.2, 1.0]), (0, [3.2, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 4, 2] and got[0]["score"] == np.hypot(0.2000000000000002, 0.5)


def test_repeated_ids_leave_room_for_others(spark, monkeypatch):
    """An id of many vectors, equal and different, is one candidate, at its nearest vector, in every block and task."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "SHORTLIST", 40)
    rng = np.random.default_rng(12)
    rows = [(0, rng.normal(size=4).tolist())] + [(i, rng.normal(size=4).tolist()) for i in range(1, 300)]
    rows += [(7, rows[0][1])] * 300 + [(8, (np.array(rows[0][1]) + rng.normal(size=4) * s).tolist()) for s in np.linspace(0.01, 4, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.search(df, df.where("vec_id = 0"), k=10, probe=1.0).orderBy("rank").collect()
    near = {}
    for i, v in rows:
        if i:
            d = float(np.sqrt(((np.array(v) - np.array(rows[0][1])) ** 2).sum()))
            near[i] = min(d, near.get(i, d))
    want = sorted((d, i) for i, d in near.items())[:10]
    assert [r["vec_id"] for r in got[:2]] == [7, 8] and len({r["vec_id"] for r in got}) == 10
    assert all(np.isclose(r["score"], near[r["vec_id"]]) for r in got) and len({i for _, i in want} & {r["vec_id"] for r in got}) >= 9


@pytest.mark.parametrize("table", ["embeddings"])
def test_registered_neighbours_of_the_given_vectors(spark, data, table):
    vectors = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{data}/{table}.parquet").collect() if r["embedding"]]
    ids, x = np.array([i for i, _ in vectors]), np.stack([v for _, v in vectors])
    got = __spark_entry__.queries()["op10_neighbours"](spark, data)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found, hit, asked = got.toPandas(), 0, [i for i in ids.tolist() if i % 100 == 0]
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        want = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        mine = found[found.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        assert np.array_equal(mine["score"], [d[ids == i][0] for i in mine["vec_id"]])
        hit += len({*want} & {*mine["vec_id"]})
    assert hit >= 9 * len(asked) and len(asked) > 0


def test_registered_fingerprints(spark, data):
    docs = {r["doc_id"]: brute_fingerprint(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    roots = brute_components(docs)
    got = __spark_entry__.queries()["op1_simhash"](spark, data)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got.collect()} == {i: (f"{p:016x}", roots[i]) for i, p in docs.items()}


def test_items_of_one_template_are_all_found(spark):
    """2,000 items of 25 shared words and one of their own: nearly all of an item's score lies in one word."""
    shared = [f"s{i}" for i in range(25)]
    items = [(i, " ".join([*shared, f"own{i}"])) for i in range(2000)] + [(5000, "a b a b a b c"), (5001, "which one? " + " ".join(shared[5:] * 2) + ". yes"), (5002, "x x x x x x x x x x")]
    texts = [" ".join(shared), "pad " * 40 + " ".join(shared) + " own7", " ".join(shared[:20]), " ".join(shared[:23]), "a b a b a b", "x x x x x", "which one? " + " ".join(shared[5:] * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def hits(bench, **more):
        found = decontaminate.with_hits(docs, spark.createDataFrame(bench, "item_id long, text string"), **more).collect()
        assert all(0 <= h["score"] <= 1 + 1e-9 for r in found for h in r["hits"])
        return {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in found}

    want = {d: brute_hits(t, items) for d, t in enumerate(texts)}
    assert len(want[0]) >= 2000 and len(want[1]) >= 2000 and hits(items) == want
    assert hits(items[:3] + items[2000:]) == {d: [i for i in h if i < 3 or i >= 5000] for d, h in want.items()}
    assert hits(items[1990:], shard_words=60) == {d: [i for i in h if i >= 1990] for d, h in want.items()}
    assert decontaminate.drop_leaked(docs, spark.createDataFrame(items, "item_id long, text string")).count() == sum(not h for h in want.values())


def test_one_document_stays_whatever_the_columns_and_repeats(spark, monkeypatch):
    rows = [(1, "a b c d", 1), (1, "a b c d", 2), (2, "A b c d", 3), (3, "other words than those", 4), (3, "still other words here", 5), (None, "a b c d", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int").withColumn("stays", F.lit("x"))
    for most in (simhash.MOST_BROADCAST, 0):
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
        assert got == [(0, "a b c d"), (1, "a b c d"), (3, "other words than those")]
