"""Spans, tokens, languages, chats, archives and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from siteweave.llm import chat, encoding, language, pieces, pii, registry, secrets, spans, token_counts, warc

from ..oracle import connect, same
from .test_pairs import brute_components, brute_fingerprint, brute_hits

PIECES = [
    "password", "Secret: ", "token=", 'api_key="', "AKIA", "ABCDEFGH1234567890", "deadbeef" * 4, "abcdef", "é𝄞", " ", ":", "=", "user@ex.com", "@", "a.b",
    "_x@y.z.w.", "1.2.3.4", "255.256.1.1", "10.0.0.00", "0.007.255.0255", ".5", "4111 1111 1111 1111", "+1 (743) 555-3824", "+44-20 7946.0018", " - ", "12", "\n", "tok", "9" * 17, "login: bob7 ",
]


def luhn(digits):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])


@pytest.mark.parametrize(("find", "brute"), [(secrets.find_secrets, brute_secrets), (pii.find_pii, brute_pii)])
def test_base_spans_equal_a_scan(spark, find, brute):
    random.seed(3)
    rows = [(i, "".join(random.choice(PIECES) for _ in range(random.randint(0, 14)))) for i in range(400)]
    rows += [(-1, None), (-2, ""), (-3, "a" * 20000 + "@"), (-4, "9" * 20000), (-5, "1 " * 9000), (-6, "token=abcdef"), (-6, "token=abcdef"), (None, "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as id", "'d' as h", "'e' as base")
    got = sorted(((r["id"] is None, r["id"]), sorted((s["start"], s["rank"], s["end"]) for s in r["base"])) for r in find(docs).collect())
    assert got == sorted(((i is None, i), brute(t or "")) for i, t in rows)
    assert find(docs.limit(0)).count() == 0


def test_weak_parts_need_each_other(spark):
    key = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8S9t0"
    rows = [(1, f"token = 'abcdefgh' {key} login: bob https://a.b/c"), (2, f"alone {key} https://a.b/c"), (3, f"login: bob {'x ' * 400}{key}"), (4, "login: bob https://a.b")]
    got = {r["id"]: spans.SPAN and sorted(s["kind"] for s in r["added"]) for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["endpoint", "weak_id", "weak_secret"], 2: [], 3: [], 4: []}


def test_parts_at_either_end_of_a_long_endpoint_meet_it(spark, tmp_path):
    key, long = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8S9t0", "https://a.b/" + "q-" * 494
    texts = [f"{long} login: bob7 {key}", f"login: bob7 {key} {long}", f"login: bob7 {long} {key}", f"{long} login: bob7 {'x ' * 200}{key}", f"{'x ' * 200}{long}{' ' * 240}login: bob7 token = '{'z' * 2000}' {long}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op3_secrets(spark, str(tmp_path))
    same(found, connect(str(tmp_path)), registry.OP3_SQL)
    assert {r["doc_id"]: r["spans"].count("endpoint") for r in found.collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 1}


def test_spans_of_one_text_take_linear_time(spark):
    """100,000 findings in one text, with base and weak ones overlapping; seconds where quadratic work takes hours."""
    import time

    one = "é token=abcdef1 login: bob7 +1 555 123 4567 𝄞"
    docs = spark.createDataFrame([(1, one * 50_000)], "doc_id long, text string")
    began = time.time()
    assert len(secrets.find_secrets(docs).first()["base"]) == 50_000
    text = pii.redact(docs).first()["text"]
    assert text == "é token=abcdef1 login: bob7 [PHONE] 𝄞" * 50_000
    assert time.time() - began < 120


def test_overlaps_and_redaction_equal_a_scan(spark):
    random.seed(11)
    spread = lambda n: [(a := random.randint(0, 60), 0, a + random.randint(1, 12), random.choice("abc"), None) for _ in range(n)]
    rows = [(i, "".join(random.choice("xyzé𝄞") for _ in range(80)), spread(random.randint(0, 9)), spread(random.randint(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, f"i int, t string, a {spans.NONE}, b {spans.NONE}")
    got = df.select(
        "i", spans.beside(F.col("a"), F.col("b")).alias("over"), spans.beside(F.col("a"), F.col("b"), inside=True).alias("inside"), spans.redacted(F.col("t"), F.col("a")).alias("t")
    )
    for r in got.collect():
        _, t, a, b = rows[r["i"]]
        assert sorted((tuple(x["span"])[:3], x["hit"]) for x in r["over"]) == sorted((x[:3], any(x[0] < y[2] and y[0] < x[2] for y in b)) for x in a)
        assert sorted((tuple(x["span"])[:3], x["hit"]) for x in r["inside"]) == sorted((x[:3], any(y[0] <= x[0] and y[2] >= x[2] for y in b)) for x in a)
        out, at = "", 0
        for x in sorted(a, key=lambda x: (x[0], x[1], x[2], x[3])):
            if x[0] >= at:
                out += t[at : x[0]] + f"[{x[3].upper()}]"
            at = max(at, x[2])
        assert r["t"] == out + t[at:]


def test_pieces_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 7)
    t = "abcdefé𝄞" * 9
    marks = [(a, 0, a + n, "k", None) for a, n in ((0, 3), (7, 7), (20, 1), (21, 28), (60, 12))]
    got = spark.createDataFrame([(t, marks)], f"t string, a {spans.NONE}").select(spans.redacted(F.col("t"), F.col("a"))).first()[0]
    out, at = "", 0
    for a, _, e, _, _ in marks:
        out, at = out + t[at:a] + "[K]", e
    assert got == out + t[at:]


def test_trusted_contexts_find_more(spark, monkeypatch):
    rows = [(i, f"contact: user{i}@mail.example.org and more") for i in range(5)] + [(10, "contact: jdoe77 x"), (11, "weather: t5000"), (12, "contact: none")]
    rows += [(20 + i, f"my number is +1 (974) 555-34{i}6 or so") for i in range(5)] + [(30, "her number is 5553456. Or not"), (31, "it was in 1999 or so"), (32, "now or so 12345" + " this or so that" * 20)]
    rows += [(40 + i, f"at 10.0.0.{i} on weekdays") for i in range(4)] + [(50, "(x71234 on weekdays)"), (51, "x71234 on weekdays it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("__base", "__spans", "__id", "__h")})
    got = {r["id"]: [(s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {10: [(9, 15)], 30: [(14, 21)], 51: [(0, 6)]}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    monkeypatch.setattr(pii, "MOST_PATTERNS", 0)
    again = pii.redact(docs)
    assert again.columns == docs.columns and all(r[c] == c for r in again.collect() for c in ("__base", "__spans", "__id", "__h"))
    assert {r["doc_id"]: r["text"] for r in again.collect()} == clean
    assert clean[0] == "contact: [EMAIL] and more" and clean[10] == "contact: [CONTEXT] x" and clean[11] == "weather: t5000"
    assert clean[20] == "my number is [PHONE] or so" and clean[30] == "her number is [CONTEXT]. Or not" and clean[31] == "it was in 1999 or so"


def brute_context_spans(rows):
    """Learned spans of (id, text) rows, step by step over plain sets."""
    trim = lambda x: re.sub(r"[.:!?)\]}]+$", "", x)
    found, pairs, used = [], {}, {}
    for i, t in rows:
        for line in re.split(r"[\t\n\x0b\f\r]", t.lower()):
            words = line.split(" ")
            for a, b in zip(words, words[1:], strict=False):
                pairs[f"{a} {b}"] = pairs.get(f"{a} {b}", 0) + 1
        base = brute_pii(t)
        for m in regex.finditer(pii.SLOT, t):
            label, sep, before, fill, after = (m[1] or "").lower(), m[2], (m[3] or "").lower(), m[4], (m[5] or "").lower()
            x, at = trim(fill), m.end() - len(fill)
            patterns = [p for p in (label and f"{label}{sep}_", before and f"{before} _", after and f"_ {after}") if p]
            if patterns and 4 <= len(x) <= 64 and re.search("[0-9@]", x):
                span = (at, at + len(x))
                found.append((i, span, x.lower(), tuple(patterns), any(a <= span[0] and e >= span[1] for a, _, e in base), any(a < span[1] and span[0] < e for a, _, e in base)))
    for _, _, _, ps, _, _ in found:
        for p in ps:
            used[p] = used.get(p, 0) + 1
    proven = {x for _, _, x, _, seed, _ in found if seed}
    contexts = {}
    for _, _, x, ps, _, _ in found:
        contexts.setdefault(x, set()).add(ps)
    members = {}
    for x, cs in contexts.items():
        for c in cs:
            for p in c:
                members.setdefault(p, set()).add(x)
    trust = dict.fromkeys(members, 0.0)
    for _ in range(pii.ROUNDS):
        new = {}
        for p, xs in members.items():
            scores = []
            for x in xs:
                miss = 1.0
                for c in contexts[x]:
                    if p not in c:
                        miss *= 1 - min(max(trust[q] for q in c), 0.999)
                scores.append(1.0 if x in proven else 1 - miss)
            new[p] = sum(scores) / len(scores) if len(xs & proven) >= pii.SUPPORT else 0.0
        trust = new
    words = lambda p: p.replace("_", "").strip()
    prose = lambda p: p.startswith("_ ") or p.endswith(" _")
    good = {p for p, v in trust.items() if v >= pii.CONFIDENCE - 1e-12 and (not prose(p) or used[p] >= pii.SPECIFIC * pairs[words(p)])}
    return sorted({(i, *span) for i, span, x, ps, _, known in found if not known and good & set(ps) and re.search("[0-9]", x)}), good


def test_learned_spans_equal_a_plain_computation(spark):
    random.seed(12)
    ids = [f"user{i}@mail.example.org" for i in range(6)] + [f"10.1.2.{i}" for i in range(6)] + ["+1 (743) 555-3824", "+44 20 7946 0018"]
    other = [f"ref{i}x" for i in range(5)] + ["1999", "12,000", "4-5", "x@", "(77771)"]
    words = ["write", "to", "my", "number", "is", "on", "weekdays", "the", "id:", "account id =", "phone #", "and", "it."]
    rows = []
    for i in range(250):
        parts = [random.choice(words) if random.random() < 0.7 else random.choice(ids if random.random() < 0.6 else other) for _ in range(random.randint(0, 12))]
        rows.append((i, random.choice([" ", " ", " ", "  ", "\n"]).join(parts)))
    rows += [(300 + i, f"call my line at {random.choice(ids if i % 5 else other)} before noon please") for i in range(60)]
    want, good = brute_context_spans(rows)
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    got = sorted((r["id"], s["start"], s["end"]) for r in pii.find_pii(docs).collect() for s in r["added"])
    assert got == want and len(want) > 10 and any(p.endswith(" _") for p in good) and any(":_" in p for p in good), good


def test_a_label_does_not_vote_for_itself(spark):
    rows = [("version", f"v{i}", i < 3) for i in range(10)] + [(x, f"{x}{i}", True) for x in "ab" for i in range(3)] + [("a", "both", False), ("b", "both", False)]
    rows += [("c\td", f"w{i}", i < 3) for i in range(10)]
    got = {r["label"]: (r["seeds"], round(r["confidence"], 9)) for r in pii.score_patterns(spark.createDataFrame(rows, "context string, instance string, seed boolean")).collect()}
    assert got == {"version": (3, 0.3), "a": (3, 0.984375), "b": (3, 0.984375), "c": (3, 0.3), "d": (3, 0.3)}
    docs = spark.createDataFrame([(i, f"version: 1.2.3.{i + 1}" if i < 3 else f"version: 7.{i}b") for i in range(10)], "doc_id long, text string")
    assert not any(r["added"] for r in pii.find_pii(docs).collect())
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {i: "version: [IP]" if i < 3 else f"version: 7.{i}b" for i in range(10)}


def test_encoding_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    random.seed(4)
    texts = [None, "", " ", "   a", "a   b    ", "\n \n x", "é𝄞x", "▁a ▁▁b", "a" * 300, "漢字かな交じり文" * 20, "x" + " " * 40 + "y"]
    texts += ["".join(random.choice("abcdeinorst  ABC.,-'0123\n=") for _ in range(random.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, encoded int")
    for r in encoding.encode(docs, registry.PIECE_MODEL).collect():
        assert list(r["encoded"]["ids"]) == model.encode(texts[r["doc_id"]] or "") and r["encoded"]["round_trip"]
        assert r["encoded"]["n_tokens"] == len(r["encoded"]["ids"])
    assert encoding.encode(docs.limit(0), registry.PIECE_MODEL).count() == 0


def test_decoding_and_refused_models(spark, tmp_path):
    texts = ["", " a  b", "é𝄞x\n", "x" * 200, "漢字かな"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = encoding.encode(docs, registry.PIECE_MODEL).select("doc_id", "encoded.ids", F.lit("kept").alias("text"))
    assert {r["doc_id"]: r["text"] for r in encoding.decode(ids, registry.PIECE_MODEL).collect()} == dict(enumerate(texts))
    odd = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["text"] for r in encoding.decode(odd, registry.PIECE_MODEL).collect()] == [None, ""]
    with pytest.raises(Exception, match="no piece has the id"):
        encoding.decode(spark.createDataFrame([([1 << 20],)], "ids array<int>"), registry.PIECE_MODEL).collect()
    with pytest.raises(ValueError, match="16 bits"):
        encoding.PieceModel(["x"] * (1 << 16), np.zeros(1 << 16), np.ones(1 << 16, bool))
    with pytest.raises(ValueError, match="byte fallback"):
        encoding.PieceModel(["x"], np.zeros(1), np.ones(1, bool))


def test_keys_that_collide_are_told_apart():
    table = pieces.PieceTable(["ab", "c"], [0, 1])
    table.keys[2][:] = table._prefix(pieces.code_matrix(["xy"], 2))[:, -1]
    table.filters[2][:] = True
    assert (table.lattice(pieces.code_matrix(["xyc"], 3))[2] == -1).all()


def test_token_counts_equal_the_library(spark):
    tokenizer = token_counts.load_tokenizer(registry.BYTE_BPE)
    texts = ["", None, " a<|endoftext|>b <|endoftext|><|endoftext|>", "it's  we'll\n\n x   ", "<|endof", "é" * 1000, " " * 300, "'''s 12ab٣", "A 　 b\x1c\x85", "z" * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, registry.BYTE_BPE).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_forward_sums_every_segmentation():
    lattice = language.Lattice(["a", "b", "ab", "ba", "aba"])
    prob = np.array([[0.3], [0.2], [0.1], [0.15], [0.05], [1e-3]])
    value = dict(zip(["a", "b", "ab", "ba", "aba"], prob[:, 0], strict=False))

    def total(w):
        return 1.0 if not w else sum((value[w[:k]] if w[:k] in value else 1e-3 if k == 1 else 0.0) * total(w[k:]) for k in range(1, len(w) + 1))

    words = ["a", "ab", "abab", "babax", "zz"]
    assert np.allclose(np.exp(lattice.log_probability(words, prob))[:, 0], [total(w) for w in words])
    counts = lattice.expected(["ab"], np.array([2.0]), prob[:, 0])
    assert np.allclose(counts[:3], np.array([0.06, 0.06, 0.1]) / 0.16 * 2)


def exact_log(word, value, width, unseen):
    """Log of the sum over all segmentations, in exact fractions of logarithms, place by place."""
    logs = [0.0]
    for end in range(1, len(word) + 1):
        terms = [logs[end - n] + np.log(value[word[end - n : end]]) for n in range(1, min(width, end) + 1) if word[end - n : end] in value]
        if word[end - 1] not in value:
            terms.append(logs[end - 1] + np.log(unseen))
        logs.append(float(np.logaddexp.reduce(terms)))
    return logs[-1]


def test_long_words_are_summed_whole(monkeypatch):
    lattice = language.Lattice(["a", "b", "ab", "ba", "aba", "▁"])
    prob = np.array([[0.3], [0.2], [0.1], [0.15], [0.05], [0.1], [1e-7]])
    value = dict(zip(["a", "b", "ab", "ba", "aba", "▁"], prob[:, 0], strict=False))
    random.seed(13)
    words = ["ab" * 3000, "aba" * 700 + "z" * 40 + "ba" * 500, "z" * 5000, "".join(random.choice("ab") for _ in range(997))]
    monkeypatch.setattr(language, "STRETCH", 64)
    got = language.Scorer(lattice, ["x"], prob).scores(words)[:, 0]
    assert np.allclose(got, [exact_log("▁" + w, value, 3, 1e-7) for w in words], rtol=1e-10)
    assert lattice.split("ab" * 30 + "zz") == ["▁", "ab" * 30, "z", "z"]
    counts = lattice.expected(["ab" * 400], np.array([1.0]), prob[:, 0])
    assert abs(counts[0] + counts[2] + counts[3] + 2 * counts[4] - 400) < 1e-6


def test_language_query_equals_an_exact_scorer(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scorer = language.learn(docs.where(language.fold() != 2), registry.PIECE_MODEL)
    names = scorer.lattice.pieces
    values = [dict(zip(names, scorer.prob[:-1, k], strict=True)) for k in range(len(scorer.langs))]
    cache = {}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in registry.op8_language(spark, data).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        if not t or len(t) > 3000:
            continue
        logs = []
        for k, value in enumerate(values):
            for w in language.words_of(t) if t.strip() else []:
                if (w, k) not in cache:
                    cache[w, k] = exact_log(w, value, max(map(len, names)), language.UNSEEN)
            logs.append(sum(cache[w, k] for w in (language.words_of(t) if t.strip() else [])))
        post = np.exp(np.array(logs) - max(logs))
        post /= post.sum()
        if any(c.isalpha() for c in t):
            assert abs(got[i]["score"] - post.max()) < 1e-6 and (got[i]["lang_pred"] == scorer.langs[int(post.argmax())] or post.max() < 0.5 + 1e-6)
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scorer = language.learn(docs.where(language.fold() != 2), registry.PIECE_MODEL, docs_per_lang=40, rounds=2)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 --", "en"), (4, "½ ² 5", "en"), (5, "①② Ⅷ", "en"), (6, "٣٤ १२", "en"), (None, "the and", None)], "doc_id long, text string, lang string")
    got = language.predict(docs.select("doc_id", "text", "lang").union(odd).withColumn("score", F.lit(1)), scorer).collect()
    right = [r["language"]["lang_pred"] == r["lang"] for r in got[:-7]]
    assert sum(right) >= 0.95 * len(right) and all(0 <= r["language"]["score"] <= 1 for r in got)
    assert [r["language"]["lang_pred"] for r in got[-7:-1]] == ["und"] * 6 and {r["language"]["score"] for r in got[-7:-1]} == {0.0}
    nothing = language.learn(odd.limit(0), registry.PIECE_MODEL)
    assert {r["language"]["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<␛s>", "<␛␛/s>", "[␛INST]", "<<SYS>> x <</SYS>>", "[ROLE]", "", None, "é𝄞\n", "plain"]
    rows = [(c, t, r, random.Random(c * 100 + t).choice(nasty)) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "tool", "assistant", None])]
    rows += [(None, None, "user", "x"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    segments = chat.format_turns(turns, registry.BYTE_RANKS, token_counts.PATTERN)
    got = {r["conv_id"]: r for r in chat.read_back(segments, registry.BYTE_RANKS, token_counts.PATTERN).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1]))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == digest(learned)
    lengths = {r["conv_id"]: r["n"] for r in segments.groupBy("conv_id").agg(F.sum("chars").alias("n")).collect()}
    assert lengths == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.read_back(chat.format_turns(turns.limit(0), registry.BYTE_RANKS, token_counts.PATTERN), registry.BYTE_RANKS, token_counts.PATTERN).count() == 0
    for text in nasty:
        said = chat.escape(text or "")
        assert chat.unescape(said) == (text or "") and not any(c in said for c in chat.CONTROLS)


def test_order_of_equal_and_unnumbered_turns(spark):
    rows = [(20, 0, "user", "b\nc"), (20, 0, "user\nb", "c"), (20, None, "", "x"), (20, 1, "", "y"), (20, 0, "assistant", "z"), (20, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    want = [(r["role"] or "", r["text"] or "") for r in turns.orderBy(F.col("turn").asc_nulls_first(), key).collect()]
    got = chat.read_back(chat.format_turns(turns.repartition(3), registry.BYTE_RANKS, token_counts.PATTERN), registry.BYTE_RANKS, token_counts.PATTERN).first()
    assert got["n_turns"] == 6 and got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()


def test_archives(spark):
    rows = [(1, "http://a\r\nb", None), (2, None, "x" * 2000), (3, "u", "x" * 2000), (3, "u", "x" * 2000), (None, "n", "x" * 2000), (5, "é", "short"), (6, "é", "short"), (7, "q", "P*M\x18" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    got = sorted(warc.round_trip(pages).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html.encode()).hexdigest())
        revisit = html.startswith("x") and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_revisits_of_more_payloads_than_are_broadcast(spark, monkeypatch, bits):
    """Two payloads are broadcast; 64 bits mistake nearly every page for a revisit."""
    monkeypatch.setattr(warc, "MOST_KNOWN", 2)
    monkeypatch.setattr(warc, "FILTER_BITS", bits)
    rows = [(i, "u", f"{i % 40:04d}" * (300 if i % 40 < 30 else 5)) for i in range(130)] + [(200 + i, "u", f"alone {i} " * 200) for i in range(30)]
    rows += [(None, "n", "0007" * 300), (127, "again", "0007" * 300), (300, "u", "0000" * 300), (None, "n", "none has an id" * 100), (None, "n", "none has an id" * 100)]
    rows += [(301 + i, "u", "0001" * 300) for i in range(50)] + [(None, None, None), (400, None, "0007" * 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    most = {}
    for i, _, h in rows:
        if h and len(h) >= 1000 and i is not None:
            most[h] = max(i, most.get(h, i))
    want = []
    for i, _, h in rows:
        other = most.get(h) if most.get(h) != i else None
        want.append((i, len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), "response" if other is None else "revisit", other))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_archives_are_bounded_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 8)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(14)
    rows = [(i, "u", "".join(chr(rng.randrange(33, 126)) for _ in range(rng.choice([10, 3000, 9000])))) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), f"{tmp_path}/w")
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert len(files) > 8
    for p in files:
        assert p.stat().st_size < 20_000 + 12_000 and p.read_bytes()[:4] == b"\x5d*M\x18"
        assert 0 < len(list(warc.frames(p.read_bytes()))) < 8
    got = warc.read_archives(spark, f"{tmp_path}/w", payloads=True)
    assert sorted((int(r["record_id"].removeprefix(warc.ID)), r["payload"].decode()) for r in got.collect()) == [(i, h) for i, _, h in rows]


def test_archives_of_others_are_read(spark, tmp_path):
    """Records of any type and id, with and without HTTP lengths, behind a dictionary that is itself compressed."""
    import struct

    import zstandard

    def rec(kind, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n"
    records = [
        rec("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), rec("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", http),
        rec("response", b"HTTP/1.1 200 OK\r\n\r\nbody", http, "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'body').hexdigest()}"),
        rec("metadata", b"k: v"), rec("resource", chunked, http.replace("response", "other")), rec("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:response>"),
    ]
    made = zstandard.ZstdCompressionDict(b"WARC/1.0 WARC-Type: " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor().compress(made.as_bytes())
    writer = zstandard.ZstdCompressor(dict_data=made)
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + b"".join(map(writer.compress, records)))
    got = {r["record_type"]: r for r in warc.read_archives(spark, str(tmp_path), payloads=True).collect()}
    assert len(got) == 6 and bytes(got["response"]["payload"]) == b"body" and got["response"]["target_uri"] == "http://a/"
    assert got["revisit"]["refers_to"] == "urn:uuid:response" and got["revisit"]["payload_bytes"] is None and bytes(got["metadata"]["payload"]) == b"k: v"
    assert got["request"]["payload_bytes"] == 0 and got["resource"]["payload_digest"] is None


def test_damaged_archives_are_refused():
    head, made = warc.dictionary_frame([b"abc" * 50])
    import zstandard

    raw = warc.record(1, "u", b"hello", hashlib.sha1(b"hello").digest(), None)
    frame = zstandard.ZstdCompressor(dict_data=made).compress(raw)
    good = head + frame + warc.SEPARATOR.encode() + frame
    assert [warc.parse_record(f)["payload"] for f in warc.frames(good)] == [b"hello"] * 2
    for bad in (good[:-3], frame + head):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))
    for broken in (raw.replace(b"hello", b"hallo"), raw[:-1], raw.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def brute_redacted(rows):
    """(id, text) rows with base and learned findings replaced; of overlapping ones the first names the whole."""
    learned = {}
    for i, a, e in brute_context_spans(rows)[0]:
        learned.setdefault(i, []).append((a, 4, e))
    out = {}
    for i, t in rows:
        done, at = "", 0
        for a, rank, e in sorted(brute_pii(t) + learned.get(i, [])):
            if a >= at:
                done += t[at:a] + f"[{pii.KINDS[rank].upper()}]"
            at = max(at, e)
        out[i] = done + t[at:]
    return out


def test_every_stage_equals_a_plain_computation(spark, data):
    """Each stage over what its predecessor kept, with repeated, null, empty and planted rows and a column of an internal name."""
    import sentencepiece

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    base = [tuple(r) for r in docs.where("length(text) < 900").orderBy("doc_id").limit(60).select("doc_id", "text", "lang").collect()]
    long = next(t for _, t, lang in base if lang == "en" and len(t) > 300)
    base += [(10001, long + " " + bench[0][1], "en"), (10002, "12345 67890", "en"), (10003, long + " mail some.one@mail.example.org", "en"), (10004, long + " mail some.one@mail.example.org", "en")]
    base += [(10005, None, "en"), (10006, "", None), base[0], (10007, long.upper(), None)]
    random.seed(15)
    random.shuffle(base)
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "kept") for i, t, lang in base], "doc_id long, text string, lang string, source string, n_chars long, __language string")
    scorer = language.learn(rows.where(language.fold() != 2), registry.PIECE_MODEL)
    width = max(map(len, scorer.lattice.pieces))
    values = [dict(zip(scorer.lattice.pieces, scorer.prob[:-1, k], strict=True)) for k in range(len(scorer.langs))]

    def clear(t):
        if not any(c.isalpha() for c in t or ""):
            return False
        logs = np.array([sum(exact_log(w, v, width, language.UNSEEN) for w in language.words_of(t)) for v in values])
        return 1 / np.exp(logs - logs.max()).sum() >= corpus_pipeline.LEAST_POSTERIOR

    def near(rows):
        prints = {i: brute_fingerprint(t) for i, t in rows}
        roots = brute_components(prints)
        return {(i, t) for i, t in rows if roots[i] == i}

    model = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    want = {
        "language": lambda rows: [r for r in rows if clear(r[1])], "simhash": near,
        "decontaminate": lambda rows: [r for r in rows if not brute_hits(r[1], bench)],
        "pii": lambda rows: list(brute_redacted(rows).items()), "sentencepiece": lambda rows: [(i, model.encode(t)) for i, t in rows],
    }
    now, kept = rows, [(i, t) for i, t, _ in base]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or out.columns == rows.columns
        now = corpus_pipeline.write_table(out, "test-stage")
        kept = sorted(want[name](kept))
        got = [(r["doc_id"], list(r["ids"]) if last else r["text"]) for r in now.collect()]
        assert sorted(got) == kept, name
        assert last or all(r["__language"] == "kept" and (name != "pii" or r["n_chars"] == len(r["text"])) for r in now.collect())
        assert stage(spark, rows.limit(0), data).count() == 0
    ids = {i for i, _ in kept}
    assert not ids & {10001, 10002, 10004, 10005, 10006} and len(ids) > 30


def test_registered_tokens_and_pieces(spark, data):
    import sentencepiece
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    library = Tokenizer.from_file(registry.BYTE_BPE)
    counts = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    got = __spark_entry__.queries()["op7_token_counts"](spark, data)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert {tuple(r) for r in got.collect()} == {(i, len(t.encode()), counts[i], counts[i] > 512) for i, t in docs.items()}
    model = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    pieces = __spark_entry__.queries()["op9_sentencepiece"](spark, data).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in pieces} == {i: model.encode(t) for i, t in docs.items()} and len(pieces) == len(docs)


def test_registered_personal_data(spark, data):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    learned = {(i, a, e) for i, a, e in brute_context_spans(rows)[0]}
    found = __spark_entry__.queries()["op4_pii"](spark, data)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {r["doc_id"]: r for r in found.collect()}
    kinds = ["email", "ip", "card", "phone", pii.KINDS[4]]
    for i, t in rows:
        base = brute_pii(t)
        text = lambda spans: ",".join(f"{kinds[k]}:{a}:{e}" for a, k, e in sorted(spans))
        assert [got[i][f"n_{k}"] for k in kinds[:4]] == [sum(s[1] == n for s in base) for n in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert got[i]["spans"] == text(base + [(a, 4, e) for j, a, e in learned if j == i])
    assert len(got) == len(rows) and sum(bool(brute_pii(t)) for _, t in rows) > 3


def test_registered_languages(spark, data):
    import zlib

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = __spark_entry__.queries()["op8_language"](spark, data)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = found.collect()
    assert len(got) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held) > 0


def test_registered_pipeline(spark, data):
    """The registered run over the whole given table: its stages one after another, and their outcome by plain means."""
    import sentencepiece

    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in __spark_entry__.queries()["pipeline"](spark, data).collect()}
    said = {r["doc_id"]: r for r in corpus_pipeline.identify_language(spark, docs, data).collect()}
    rows = [(i, r["text"]) for i, r in said.items()]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    roots = brute_components(prints)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if roots[i] == i and not brute_hits(t, bench)]
    model = sentencepiece.SentencePieceProcessor(model_file=registry.PIECE_MODEL)
    assert got == {i: model.encode(t) for i, t in brute_redacted(rows).items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "simhash", "decontaminate", "pii", "sentencepiece"] and 0 < len(got) < docs.count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(spark, data, name):
    same(registry.queries()[name](spark, data), connect(data), registry.oracle_sql()[name])
