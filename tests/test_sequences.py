"""Records of FASTA files in pieces, k-mers as codes, streamed hashes, attributes and repeated columns."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siteweave.functions import scalars as fn
from siteweave.functions import sequence as sq
from siteweave.sources import files, ingest


def plain_fasta(text):
    """(accession, sequence) by the start of each line."""
    out = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append([(line[1:].split() or [""])[0], ""])
        elif out:
            out[-1][1] += "".join(line.split()).upper().replace("U", "T")
    return sorted(map(tuple, out))


@pytest.mark.parametrize("split", [40, 333, 1 << 20])
@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_fasta_records_start_at_lines_and_cross_splits(spark, tmp_path, split, chunk):
    rng = random.Random(split)
    text = "acgt before any record\n"
    for i in range(12):
        text += f">NM_{i}.1 variant A->G > {'x' * rng.randint(0, 30)}\n"
        text += "\n".join("".join(rng.choice("ACGUacgun") for _ in range(rng.randint(0, 60))) for _ in range(rng.choice([0, 1, 3, 40]))) + rng.choice(["\n", "\r\n", "\n\n"])
    text += ">NM_3.1 again\nAC GT\n>\nTT\n>last"
    (tmp_path / "a.fa").write_bytes(text.encode())
    (tmp_path / "b.fa").write_text("GGG\n>B 1\nAC\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        chunks = files.fasta_chunks(spark, str(tmp_path), chunk).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    records = {}
    for r in sorted(chunks, key=lambda r: (r["record"], r["offset"])):
        name, seq = records.setdefault(r["record"], (r["accession"], ""))
        assert r["offset"] == len(seq) and len(r["chunk"]) <= chunk
        records[r["record"]] = name, seq + r["chunk"]
    assert sorted(records.values()) == sorted(plain_fasta(text) + [("B", "AC")])


def test_fasta_header_with_a_sign_inside(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">NM_1.1 variant A->G\nacgu\n>NM_2.1\nGG\n")
    wanted = spark.createDataFrame([("NM_1",), ("NM_2.7",)], "accession string")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "x.fa"), wanted).collect())) == [("NM_1.1", "ACGT"), ("NM_2.1", "GG")]
    (tmp_path / "empty.fa").write_text("")
    assert files.fasta_chunks(spark, str(tmp_path / "empty.fa")).count() == 0


def plain_kmers(text, k):
    return Counter(text[i : i + k] for i in range(len(text) - k + 1) if set(text[i : i + k]) <= set("ACGT"))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13, 31])
def test_kmer_codes(k):
    rng = random.Random(k)
    text = "".join(rng.choice("ACGTACGTACGTN") for _ in range(400))
    got = Counter("".join("ACGT"[c >> 2 * (k - 1 - i) & 3] for i in range(k)) for c in sq.kmer_codes(text.encode(), k).tolist())
    assert got == plain_kmers(text, k) and len(sq.kmer_codes(text[: k - 1].encode(), k)) == 0


def test_kmer_codes_of_other_alphabets():
    rng = random.Random(9)
    text = "".join(rng.choice("abcde?") for _ in range(300))
    for k in (1, 3, 6, 20):
        got = Counter("".join("abcde"[c >> 3 * (k - 1 - i) & 7] for i in range(k)) for c in sq.kmer_codes(text.encode(), k, "abcde").tolist())
        assert got == Counter(text[i : i + k] for i in range(len(text) - k + 1) if "?" not in text[i : i + k])


def test_kmers_of_whole_and_cut_sequences_agree(spark):
    rng = random.Random(2)
    seqs = {f"s{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate([0, 1, 4, 5, 37, 400])}
    whole = spark.createDataFrame([*seqs.items(), ("null", None)], "record string, seq string")
    pieces = spark.createDataFrame([(r, i, s[i : i + 9]) for r, s in seqs.items() for i in range(0, max(len(s), 1), 9)], "record string, offset long, chunk string")
    want = {(r, m, n, n / (len(s) - 4)) for r, s in seqs.items() for m, n in plain_kmers(s, 5).items()}
    assert {tuple(r) for r in sq.kmer_frequencies(whole, "record", "seq", 5).collect()} == want
    assert {tuple(r) for r in sq.chunk_kmers(pieces, 5).collect()} == want
    assert sq.chunk_kmers(pieces.limit(0), 5).count() == sq.kmer_frequencies(whole.limit(0), "record", "seq", 5).count() == 0


def test_onehot_around_an_anchor(spark):
    df = spark.createDataFrame([("ACGTACGT", 0), ("ACGTACGT", 3), ("ACGTACGT", 7), ("ACGTACGT", 20), ("AC", -9), ("", 0), (None, 1), ("ACNT", 2)], "s string, a int")
    for r in df.select("s", "a", *sq.positional_onehot(F.col("s"), F.col("a"), (-3, 0, 2), "p")).collect():
        for off in (-3, 0, 2):
            at, s = r["a"] + off, r["s"] or ""
            assert [r[f"p_{off:+d}_{b}"] for b in "ACGT"] == [int(0 <= at < len(s) and s[at] == b) for b in "ACGT"], (r, off)


def test_large_files_are_hashed_in_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 1000)
    monkeypatch.setattr(files, "_READ", 64)
    for name, n in (("small", 10), ("edge", 1000), ("large one", 5000)):
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    expected = spark.createDataFrame([("large one", want["large one"]), ("edge", "0"), ("gone", "1")], "name string, sha256 string")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    got = {r["name"]: (r["status"], r["found_sha256"]) for r in files.manifest(spark, str(tmp_path), expected, name).collect()}
    assert got == {"large one": ("HASH_OK", want["large one"]), "edge": ("HASH_MISMATCH", want["edge"]), "small": ("PRESENT", want["small"]), "gone": ("MISSING", None)}


def test_attributes_of_all_three_kinds(spark):
    cases = {
        "gene_id bare%20v; tag t": {"gene_id": "bare v", "tag": "t"}, 'gene_id "bare" x; tag t': {"gene_id": "bare"}, "Parent=a;Parent=a": {"Parent": "a,a"},
        'k "a"; k "a"; k "b"': {"k": "a,b"}, 'k=a%2Cb;k="c+d" ; x = 100% ': {"k": "a,b,c+d", "x": "100%"}, 'k=a; k "a"; k "z"; k "z"': {"k": "a,a", 'k "a"': ""},
        "a x y ; a x y;;b": {"a": "x y,x y"}, "": {}, "=v;k=": {"k": ""},
    }
    cases['k=a; k "a"; k "z"; k "z"'] = {"k": "a,z"}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", fn.attributes("c").alias("a")).collect()
    assert {r["c"]: r["a"] for r in rows} == cases
    labels = spark.createDataFrame([("high-est lower",), ("High er",), ("low-er",), ("Highest",), ("none",), ("odd",), ("xhigh-er",)], "c string")
    got = [tuple(r["z"]) for r in labels.select(fn.confidence("c").alias("z")).collect()]
    assert got == [("lower", 1.0), ("higher", 2.0), ("lower", 1.0), ("highest", 3.0), (None, None), ("unresolved:odd", None), ("unresolved:xhigh-er", None)]


def test_repeated_rows_tell_columns_apart(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 1.0), (1, 1.0, 5.0, 1.0), (2, 2.0, 7.0, 2.0), (2, 2.0, 7.0, 2.0)], "k int, a double, b double, c double")
    assert ingest.distinct_columns(df, "k", ["a", "b", "c"]) == ["a", "b"]
    assert ingest.distinct_columns(df.union(df.limit(1)), "k", ["a", "b", "c"]) == ["a", "b"]
