"""Divergence of sources, mixing and ranked search, each against a plain computation."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siteweave.llm import divergence, lexical, mixing, registry

from ..oracle import connect, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, v string, g string, rank string, size string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def brute_audit(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least}
        of = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        smooth = lambda c: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = smooth(of[source]), smooth(whole)
        pairs = [(s, sum(f(p[t], r[t]) for t in kept)) for s in of if s != source for r in [smooth(of[s])]]
        terms = [(t, f(p[t], q[t])) for t in kept if of[source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def test_audit_equals_a_plain_count(spark):
    random.seed(5)
    words = ["Straße", "été", "a", "b", "The", "it's", "x1y", "naïve", "ÄÖ", "漢字", "q"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = [
        (i, " ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "S3", "é", None]))
        for i in range(300)
    ]
    rows += [(1, None, "en", "empty"), (2, "", "xx", "s1"), (3, "only here", "xx", "s2"), (4, "q " * 50_000, "en", "s1"), (4, "q " * 50_000, "en", "s1"), (None, "a", "fr", "s1")]
    got = divergence.audit(frame(spark, rows), least_docs=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 4, 3)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_runs_of_entries_and_blocks_of_pairs_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"t{chr(97 + (i * j) % 7)}" for j in range(9)), "en", f"s{i % 6}") for i in range(120)]
    want = brute_audit(rows, 2, 10)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), least_docs=2).collect())) == want
    for k in (2, 3, 9):
        pairs = [(int(a), int(b)) for i, j in divergence._blocks(k, 4) for a, b in zip(i, j, strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(k) for b in range(a + 1, k)]


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left, free = {}, Fraction(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return done | share
        for s in over:
            done[s] = Fraction(most * sizes[s])
            left -= done[s]
        free -= over
    return done


def mixed_rows(seed=9):
    random.seed(seed)
    rows = [(i, " ".join(["w"] * random.randint(0, 900)), "en", random.choice(["hot"] * 8 + ["b", "c", "tiny", None])) for i in range(400)]
    return rows + [(-1, None, "en", "b"), (-2, "", "en", "none"), (-3, " \t\n\x0b\x0c\r a\x1cb é x ", "en", "ctl"), (7, "w " * 200_000, "en", "hot"), (7, "w w", "en", "c"), (7, "w w", "en", "c"), (None, "w w w", "en", "b")]


def test_mix_meets_its_targets(spark):
    rows = mixed_rows()
    docs = frame(spark, rows)
    found, named = mixing.mix(docs)
    out = mixing.taken(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in out) == sorted((r[0] is None, r[0], words(r[1])) for r in rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += words(text)
    want = brute_targets(sizes)
    assert sum(want.values()) == sum(sizes.values())
    taken = Counter()
    for r in named.join(found.groupBy("sid", "row").agg(F.sum("n_words").alias("taken")), ["sid", "row"], "left").collect():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        taken[r["source"]] += r["taken"] or 0
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    again = mixing.taken(docs.repartition(7)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(again, key=key) == sorted(out, key=key)
    assert mixing.taken(docs.limit(0)).count() == 0


def test_schedule_keeps_shares_at_every_prefix_and_blocks_are_whole(spark):
    docs = frame(spark, mixed_rows(4))
    found, named = mixing.mix(docs, block=64)
    target = {r["sid"]: r["target"] for r in named.select("sid", "target").distinct().collect()}
    all_words, rows = sum(target.values()), found.orderBy("slot", "row", "epoch").collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["slot"]].append(r)
    for pieces in slots.values():
        assert len({(r["sid"], r["rank"]) for r in pieces}) == 1
        assert sum(r["n_words"] for r in pieces) <= 64
    n, seen = len(slots), Counter()
    for i, slot in enumerate(sorted(slots)):
        seen[slots[slot][0]["sid"]] += 1
        if slot < n:
            assert all(abs(seen[s] - (i + 1) * t / all_words) <= np.log2(n) + 2 for s, t in target.items())
    ranks = defaultdict(list)
    for r in found.select("sid", "rank", "slot").distinct().orderBy("slot").collect():
        ranks[r["sid"]].append(r["rank"])
    assert all(x == list(range(len(x))) for x in ranks.values())


def test_ranks_in_closed_form_are_counts():
    random.seed(1)
    k = np.arange(3000, dtype=np.int64)
    at = mixing.points(k)
    assert at[:5].tolist() == [0, 1 << 39, 1 << 38, 3 << 38, 1 << 37]
    for bound in [0, 1, 1 << 39, 1 << 40, *[random.randrange(1 << 40) for _ in range(20)]]:
        counts = np.concatenate(([0], np.cumsum(at < bound)[:-1]))
        assert (mixing.below(k, np.full_like(k, bound)) == counts).all()


def brute_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in rows]
    docs = [d for d in docs if d[2]]
    n, total, df = len(docs), sum(d[2] for d in docs), Counter(t for d in docs for t in d[1])
    out = []
    for item, text in items:
        scores = []
        for i, tf, size in docs:
            m = 50 + (50 * size * n) // total
            score = sum(lexical.weight_of(n, df[t]) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if tf[t])
            if score:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=lambda x: x[:2])


def search_rows(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(random.choices(words, odds, k=random.randint(0, 60))).upper(), None, None) for i in range(500)]
    rows += [(900 + i, "w3 w4 w5 é", None, None) for i in range(30)] + [(7, "w1 w2", None, None), (7, "w1 w2", None, None), (None, "w3 w4", None, None)]
    rows += [(800, None, None, None), (801, "", None, None), (802, "w50 " * 30_000 + "w51", None, None)]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 25)))) for i in range(25)] + [(100, "É w3, w4?"), (101, None), (102, ""), (103, "none of it"), (104, "w59")]
    return rows, items


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 7}, {"SHARD_POSTINGS": 50}, {"PAIR_ENTRIES": 3}])
def test_search_equals_scoring_everything(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    rows, items = search_rows(len(limits))
    queries = spark.createDataFrame([(*x, "r") for x in items], "item_id long, text string, rank string")
    want = brute_search(rows, items, 10)
    for parts in (1, 5):
        got = lexical.search(frame(spark, rows).repartition(parts), queries, k=10)
        assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == want
    some = lexical.search(frame(spark, rows), queries, k=10, pass_terms=40)
    assert sorted(map(tuple, some.collect()), key=lambda x: x[:2]) == want
    assert lexical.search(frame(spark, rows).limit(0), queries).count() == lexical.search(frame(spark, rows), queries.limit(0)).count() == 0


def test_pair_bounds_skip_more_than_single_maxima():
    """Terms whose maxima lie in different documents: the pair's bound is under their sum, and postings go unread."""
    log = lexical.QueryLog([1000, 1000, 5000], [[0, 1, 2]])
    n = 4000
    doc = np.concatenate((np.arange(0, n, 2), np.arange(1, n, 2), np.arange(0, 60)))
    term = np.concatenate((np.zeros(n // 2, int), np.ones(n // 2, int), np.full(60, 2)))
    shard = lexical.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 10), doc, term, np.ones(len(doc), int), log, n, 10 * n)
    assert shard.joint.tolist() == [0] and len(shard.listed(0)) == 0
    read = []
    postings = shard.postings
    shard.postings = lambda t: (read.append(t), postings(t))[1]
    least = int(shard.top[2]) + 1
    assert shard.top[:2].sum() < least < shard.top[:2].max() + shard.top[2]
    found, score = shard.search(0, 50, least)
    assert sorted(found.tolist()) == list(range(60)) and (score == shard.top[2] + shard.top[0]).all()


@pytest.mark.parametrize("name", ["op11_divergence", "op13_search"])
def test_registered_entries_equal_sql(spark, data, name):
    same(__spark_entry__.queries()[name](spark, data), connect(data), registry.oracle_sql()[name])


def test_registered_mix(spark, data):
    out = __spark_entry__.queries()["op12_mix"](spark, data)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot"]
    con = connect(data)
    sizes = dict(con.sql(r"select doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) from documents").fetchall())
    source = dict(con.sql("select doc_id, source from documents").fetchall())
    per = Counter()
    for i, s in source.items():
        per[s] += sizes[i]
    want, taken = brute_targets(per), Counter()
    for r in out.collect():
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == per[source[r["doc_id"]]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(float(want[source[r["doc_id"]]]), rel=1e-12)
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
