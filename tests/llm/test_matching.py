"""Decontamination, WARC packages and token counts."""

import gzip
import hashlib
import random
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessitura.llm import decontamination as D
from tessitura.llm import token_counts as T
from tessitura.llm import warc


def brute(words, items, window=10):
    hit, found = set(), set()
    for item, w in items:
        size = min(window, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize(("segment", "chunk"), [(1 << 20, 1 << 21), (50, 20)])
def test_contamination(spark, segment, chunk):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 10, 11, 25])))) for i in range(30)] + [(30, None), (None, "a b c d e f g h i j k"), (5, "x y")]
    texts = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(20))) for _ in range(3)]
        texts.append((i % 50, ", ".join([parts[0], (rng.choice(items)[1] or "").upper(), parts[1], parts[2]])))
    texts += [(90, None), (91, ""), (None, "A-b.c d e f g h i j k l")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("matches", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench, segment_words=segment, chunk_words=chunk).collect()
    pairs = [("null" if i is None else str(i), D.words(t.encode() if t else None)) for i, t in items]
    want = [(i if i is not None else -1, *brute(D.words(t.encode() if t else None), pairs)) for i, t in texts]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], list(r["items"])) for r in got) == sorted(want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "j i h g f e d c b a")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "a b c d e f g h i j")], "item_id long, text string")
    index = D.build_index(docs)
    near = {r["id"] for r in D.find_matches(index, bench, slop=1).where(F.size("matches") > 0).collect()}
    exact = {r["id"] for r in D.find_matches(index, bench).where(F.size("matches") > 0).collect()}
    assert exact == {2} and {1, 2} >= near >= {2}


def test_contamination_odd_tables(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).where("n_hit > 0").count() == 0 and D.contamination(docs, none).count() == docs.count()
    assert D.contamination(empty, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    bench = spark.createDataFrame([(1, "fox jumps over the lazy dog again and again until")], "item_id long, text string")
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 10, None}


def test_contaminated_rows_go_not_ids(spark):
    """A row without an id goes if its text matches; a clean row stays though it shares the id of one that goes."""
    bad = "b c d e f g h i j k l"
    d = spark.createDataFrame([(None, bad, "a"), (None, "clean", "b"), (1, bad, "c"), (1, "clean too", "d"), (2, None, "e")], "doc_id long, text string, id string")
    kept = D.drop_contaminated(d, spark.createDataFrame([(0, bad)], "item_id long, text string"))
    assert kept.columns == d.columns and sorted(r["id"] for r in kept.collect()) == ["b", "d", "e"]


BIG = "<html>" + "x" * 2000 + "é</html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", BIG), (2, "http://b\r\nEvil: 1", BIG), (7, None, BIG), (7, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (8, "u", BIG + "y")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_warc_round_trip(spark, pages, size):
    manifest = warc.write_archives(pages, warc.archive_folder(spark), archive_bytes=size)
    got = sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(manifest).collect()), key=str)
    best = {BIG: 7}
    want = []
    for r in pages.collect():
        body, i = (r["html"] or ""), r["page_id"]
        b = best.get(body)
        revisit = b is not None and b != i
        want.append((str(i) if i is not None else None, len(body.encode()), hashlib.sha1(body.encode()).hexdigest(), "revisit" if revisit else "response", str(b) if revisit else None))
    assert got == sorted(want, key=str)
    texts = Counter(bytes(r["payload"]).decode() for r in warc.read_archives(manifest, payloads=True).where("payload is not null").collect())
    assert texts == Counter({BIG: 2, "small": 2, "": 2, BIG + "y": 1})


def test_any_text_is_an_id(spark):
    ids = ["null", "", "a\tb", "a\nb", "a\r\nWARC-Type: x", "a\u2028b", "*", "%41", "A", "日 本", None, "<>", "z" * 2000]
    rows = [(i, BIG if n % 2 else f"own {n}") for n, i in enumerate(ids)]
    d = spark.createDataFrame(rows, "page_id string, html string").withColumn("url", F.lit("http://ü/ x"))
    got = warc.read_archives(warc.write_archives(d, warc.archive_folder(spark))).collect()
    best = max(i.encode() for i, body in rows if body == BIG).decode()
    assert Counter(r["id"] for r in got) == Counter(ids)
    assert {r["id"] for r in got if r["record_type"] == "revisit"} == {i for i, body in rows if body == BIG and i != best} and {r["refers_to"] for r in got} == {None, best}
    assert {r["uri"] for r in got} == {"http://%C3%BC/%20x"}


def test_payloads_that_many_pages_have(spark):
    """Most rows share a payload, many are empty, and few share another."""
    d = spark.range(3000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("x"), 1500)).when(F.col("id") % 3 == 1, F.lit("")).otherwise(F.concat((F.col("id") % 700).cast("string"), F.repeat(F.lit("y"), 1200))).alias("html"))
    rows = d.collect()
    best = {}
    for r in rows:
        best[r["html"]] = max(best.get(r["html"], -1), r["page_id"])
    want = {r["page_id"]: best[r["html"]] if len(r["html"]) >= 1000 and best[r["html"]] != r["page_id"] else None for r in rows}
    got = warc.read_archives(warc.write_archives(d, warc.archive_folder(spark))).collect()
    assert len(got) == 3000 and {int(r["id"]): r["refers_to"] and int(r["refers_to"]) for r in got} == want


def test_archives_are_zip_files(spark, pages):
    for r in warc.write_archives(pages, warc.archive_folder(spark)).collect():
        with zipfile.ZipFile(r["path"].removeprefix("file:")) as z:
            assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert gzip.decompress(z.read(warc.DATA)).count(b"WARC/1.1\r\n") == r["n_records"]


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_reads_other_writers_zip(tmp_path):
    p = tmp_path / "x.zip"
    with zipfile.ZipFile(p, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"c" * 300
        z.writestr("a", b"hello")
        z.writestr("b", b"world" * 9, zipfile.ZIP_DEFLATED)
        with z.open("c", "w", force_zip64=True) as f:
            f.write(b"sixty-four")
    r = warc.ZipReader(Bytes(p.read_bytes()))
    assert r.read("a") == b"hello" and r.read("c") == b"sixty-four"
    with pytest.raises(ValueError, match="compressed"):
        r.read("b")
    with pytest.raises(ValueError, match="no end"):
        warc.ZipReader(Bytes(b"nothing"))


def test_zip64_offsets():
    """A directory whose sizes and offsets are only in the ZIP64 fields."""
    class Sink:
        def __init__(self):
            self.data = b""

        def write(self, d):
            self.data += d

    s = Sink()
    w = warc.ZipWriter(s)
    w.begin("m")
    w.write(b"abc")
    w.end()
    w.close()
    assert struct.pack("<L", 0xFFFFFFFF) in s.data and warc.ZipReader(Bytes(s.data)).read("m") == b"abc"


def test_warc_of_nothing(spark, pages):
    m = warc.write_archives(pages.limit(0), warc.archive_folder(spark))
    assert m.count() == 0 and warc.read_archives(m).count() == 0
    assert warc.archive_folder(spark).startswith("file:")


def best_count(word, pieces, unknown):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + unknown * n, best[i - 1][1] - n)]
        options += [(best[j][0] + pieces[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_trie_equals_brute_force():
    model = T.load_vocabulary()
    pieces = {k: v for k, v in model.ends.items() if v is not None}
    trie, rng = T.Trie(model), random.Random(2)
    for _ in range(400):
        w = T.BOUNDARY + "".join(rng.choices("abcdeinorst日é-", k=rng.randrange(12)))
        assert trie.count(w) == best_count(w, pieces, model.unknown)


def test_a_certain_piece():
    """The only piece has probability 1, the logarithm of which is 0."""
    assert T.Trie(T.unigram(["ab"])).count("ab") == 1 and T.Trie(T.unigram([])).count("ab") == 2


def test_bytes_that_are_no_text(spark):
    """Strings that aren't UTF-8 pass through every reader of texts."""
    from tessitura.llm import lm, quality, rules, simhash, toxicity

    d = spark.sql("select 1L as doc_id, cast(X'61FF62200A61' as string) as text union all select 2L, 'plain words'")
    assert {r["doc_id"]: r["n_pretokens"] for r in T.count_tokens(d, T.unigram(["a", "b"])).collect()} == {1: 2, 2: 2}
    assert {r["n_tokens"] for r in lm.score_documents(d, F.lit(True)).collect()} == {3}
    assert rules.ledger(d).count() == simhash.similar_documents(d).count() == 2
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.classify(d, none).where("is_toxic").count() == 0
    assert quality.score_documents(d, quality.train(d, none, F.col("quality") == 1)).count() == 2
    assert D.contamination(d, d.withColumnRenamed("doc_id", "item_id")).where("n_hit > 0").count() == 2


def test_token_counts(docs, empty, monkeypatch):
    model = T.load_vocabulary()
    got = T.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), model).collect()
    pieces = {k: v for k, v in model.ends.items() if v is not None}
    memo = {}
    for r in got:
        words = (r["text"] or "").encode().split()
        for w in set(words) - memo.keys():
            memo[w] = best_count(T.BOUNDARY + w.decode(), pieces, model.unknown)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(memo[w] for w in words))
    assert T.count_tokens(empty, model).count() == 0


def test_bounded_tables_change_nothing(monkeypatch):
    model = T.load_vocabulary()
    texts = [f"alpha{i} beta{i % 3} gamma".encode() for i in range(50)]
    want = [T.Counter(model).text(t) for t in texts]
    monkeypatch.setattr(T, "NODES", 10)
    monkeypatch.setattr(T, "WORDS", 2)
    c = T.Counter(model)
    assert [c.text(t) for t in texts] == want
