"""Collisions, large groups, ties, empty tables and long texts of the corpus operators; order and held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from interfera.llm import decontam, langid, lattice, license, minhash, pii, quality, secrets, sharding, spans, words

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS)


def thue_morse():
    """Two words of 1,024 letters that polynomial hashes modulo 2^64 take for one."""
    t = [0]
    while len(t) < 1024:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_words_are_compared_by_their_bytes(spark):
    a, b = thue_morse()
    w = words.words([f"{a} {b}"], words.SOLID)
    assert w.hash[0] != w.hash[1] and words.same(w, np.array([0, 0]), w, np.array([0, 1])).tolist() == [True, False]
    docs = table(spark, [(1, f"{a} x"), (2, f"{b} x"), (3, f"{b} x")])
    found = {r.doc_id: r.n_hit for r in decontam.find_benchmark(docs, spark.createDataFrame([(1, a)], "item_id long, text string")).collect()}
    assert found == {1: 1, 2: 0, 3: 0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}


def test_equal_hashes_of_unlike_words_are_told_apart(monkeypatch):
    """Even if every word of the text has one hash."""
    bench = decontam.Benchmark([("x", "aa bb cc")], 10)
    plain = decontam.words
    monkeypatch.setattr(decontam, "words", lambda texts, rule, seed=0: _one_hash(plain(texts, rule, seed), bench.known[0]))
    got = decontam.match_shard(["aa bb cc", "dd ee ff"], bench)
    assert [f[1] for f in got] == [[], []]  # bb and cc aren't at their hashes; nothing false is found


def _one_hash(w, h):
    w.hash[:] = h
    return w


def test_families_larger_than_a_block(spark, monkeypatch):
    """Near copies of few texts, by stars and by blocks, against brute force."""
    rng = np.random.default_rng(1)
    base = [[f"w{k}x{i}" for i in range(40)] for k in range(3)]
    texts = []
    for n in range(150):
        t = list(base[n % 3])
        for i in rng.choice(40, size=rng.integers(0, 4), replace=False):
            t[i] = f"n{n}"
        texts.append(" ".join(t))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    low = list(range(len(texts)))
    for _ in range(6):
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    docs = table(spark, list(enumerate(texts)))
    for block in (minhash.BLOCK, 300):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(low))


def test_short_texts_in_one_family(spark):
    """Many short texts that share all but a word."""
    lead = " ".join(f"a{i}" for i in range(30))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit(lead + " z"), F.col("id").cast("string")).alias("text"))
    assert minhash.near_duplicates(docs).where("component_id <> 0").count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BENCHMARK_BLOCK", 40)
    items = [(i, " ".join(f"b{i}x{k}" for k in range(12))) for i in range(4)]
    docs = table(spark, [(1, f"zz {items[0][1]} yy"), (2, f"{items[1][1]} {items[3][1]}"), (3, "none of it"), (None, None)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.find_benchmark(docs, bench).collect()}
    assert got == {1: (14, 12, ["0"]), 2: (24, 24, ["1", "3"]), 3: (3, 0, []), None: (0, 0, [])}
    assert sorted(r.doc_id or 0 for r in decontam.remove_contaminated(docs, bench).collect()) == [0, 3]


def test_shards_hold_the_mixture_in_order(spark):
    """Against the order by fractional rank within the source, worked out row by row."""
    rows = [(i, f"t{i % 7}", "en", ["a", "b", None][i % 13 % 3], i) for i in range(500)] + [(None, None, None, "a", 0)] * 40 + [(7, "t0", None, "b", 0)] * 3
    docs = spark.createDataFrame(rows, FIELDS)
    got = sharding.interleave(docs, 8).collect()
    by = {}
    for i, t, _, s, _ in rows:
        crc, size = zlib.crc32((t or "").encode()), len((t or "").encode()) + 8
        d = hashlib.md5(f"{sharding.SEED}:{'' if i is None else i}:{crc}:{size}".encode()).hexdigest()
        by.setdefault("-" if s is None else f"+{s}", []).append((d, i, crc, size))
    order = sorted(((r + 0.5) / len(v), s, r, *x[1:]) for s, v in by.items() for r, x in enumerate(sorted(v, key=str)))
    n = len(order)
    want = sorted(((p * 8 // n, p - -(-(p * 8 // n) * n // 8), s, i, crc) for p, (_, s, _, i, crc, _) in enumerate(order)), key=str)
    assert sorted(((r.shard, r.slot, r.stratum, r.doc_id, r.text_crc32) for r in got), key=str) == want


def test_rows_alike_in_all_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 50)
    docs = spark.createDataFrame([(None, None, None, None, 0)] * 400 + [(1, "x", None, "a", 0)] * 20, FIELDS)
    rows = sharding.interleave(docs, 6).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(6) for k in range(70)]


def test_whole_licenses():
    marks = re.compile(r"<</?opt>>|<<var:[^>]*>>")
    for name, template in license.LICENSES:
        whole = marks.sub(lambda m: "one two three four" if m[0].startswith("<<var:4") else "two words" if m[0].startswith("<<var:2") else "word" if "var" in m[0] else " ", template)
        assert name in license.scan_text(f"Before it. {whole} And after.")[5], name
        ws = whole.split()
        assert name not in license.scan_text(" ".join(ws[: len(ws) // 2]))[5] and name not in license.scan_text(" ".join([*ws[:6], "other", *ws[6:]]))[5], name


def test_quality_on_held_out_rows_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        word = lambda: "".join(rng.choice(list("etaoinshr"), size=rng.integers(2, 8)))
        t = " ".join(word() if good or rng.random() < 0.5 else "$$$***" for _ in range(60))
        rows.append((i, t if good else t.upper(), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i < 200] + [(0, 1, 0), (0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert np.mean([(got[i] >= quality.CUT) == bool(y) for i, _, y in rows if i >= 200]) > 0.95 and got[1000] == got[0]


def test_language_counts_in_blocks(monkeypatch):
    """The same bundles however small the tables, also of scripts with many letters."""
    texts = ["the quick brown fox", "der schnelle braune fuchs", "".join(chr(0x4E00 + i * 7 % 2000) for i in range(900)), None, "a"]
    want = langid.bundles(texts, np.arange(5), 5)
    monkeypatch.setattr(langid, "_TABLE", 1 << 10)
    assert np.array_equal(langid.bundles(texts, np.arange(5), 5), want)
    slow = np.zeros(langid.DIMENSIONS)
    vector = lambda c: langid.letter_vectors(np.array([ord(c) if c != " " else 0], dtype=np.uint32))[0]
    t = " a b "
    for i in range(len(t) - 2):
        slow += np.roll(vector(t[i]), 2) * np.roll(vector(t[i + 1]), 1) * vector(t[i + 2])
    assert np.array_equal(langid.bundles(["a b"], np.zeros(1, int), 1)[0], slow)


def test_language_on_held_out_rows_and_ties(spark):
    say = {"en": "the of and that with which from this", "de": "der die und nicht mit ein auch sich"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(say[k].split(), size=12)), k) for i in range(200) for k in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.profiles(docs.where("doc_id < 100"))).collect()}
    assert all(got[i] == k for i, _, k in rows if i >= 100)
    both = spark.createDataFrame([(1, "same text", "xx"), (2, "same text", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(both, langid.profiles(both)).collect()} == {"aa"}  # a tie goes to the first name


def test_disguised_data_are_found(spark):
    """Disguises on documents that no rule says anything of, beside numbers that are none."""
    plain = [(i, f"mail to jo{i}@host{i}.example.com, host 10.{i % 200}.3.{i % 250}, call +1 (555) 123-{4000 + i} today; version 1.2.{i}") for i in range(300)]
    odd = [(900, "mail to ann (at) site.example.com today"), (901, "host 10 . 20 . 30 . 40 is up"), (902, "version 1.2.3 of page 77"), (903, None)]
    rows = {r.doc_id: [(pii.KINDS[x["k"]], x["s"], x["e"]) for x in r["found"]] for r in pii.detect(spark.createDataFrame(plain + odd, "doc_id long, text string")).collect()}
    assert rows[900] == [("email", 8, 33)] and rows[901] == [("ip", 5, 22)] and rows[902] == rows[903] == []
    assert all([k for k, *_ in rows[i]] == ["email", "ip", "phone"] for i in range(300))


def test_cuts_and_maxima(spark):
    text = "".join(chr(97 + i % 26) for i in range(9000)) + "é" * 4000
    df = spark.createDataFrame([(text, [3, 1, 4, 1, 5, 9, 2, 6] * 60)], "t string, v array<int>")
    at = [(0, 0), (0, 5), (4095, 4097), (4096, 8192), (10, 12500), (8192, 13000), (13000, 13000)]
    got = df.select(*[spans.cut(spans.parts(F.col("t")), F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate(at)], spans.maxima(F.col("v")).alias("m")).first()
    assert [got[f"c{i}"] for i in range(len(at))] == [text[a:b] for a, b in at]
    assert got["m"] == np.maximum.accumulate([3, 1, 4, 1, 5, 9, 2, 6] * 60).tolist()


def test_redacted_long_text(spark):
    one = "write to me.x@host.example.com or call +1 (555) 123-4567 now\n"
    docs = table(spark, [(1, one * 300), (2, "x" * 50_000)])
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: one.replace("me.x@host.example.com", "[EMAIL]").replace("+1 (555) 123-4567", "[PHONE]") * 300, 2: "x" * 50_000}


def test_empty_tables(spark):
    docs = table(spark, [(1, "x")]).limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (pii.detect(docs), pii.redact(docs), secrets.scan(docs), lattice.near_vectors(vectors), minhash.near_duplicates(docs), license.scan(docs), langid.identify(docs, langid.profiles(docs)), quality.keep_good(docs, quality.fit(np.zeros((0, quality.FEATURES)), np.zeros(0)))):
        assert out.count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, tmp_path, k):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.STAGES[k][1](spark, table(spark, [(1, "x")]).limit(0), path).count() == 0


def test_vectors_of_many_lengths_and_singles(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.05, 0.0]), (4, [0.0, 1.0]), (5, [3e38, 0.0]), (6, [-0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 0, 4), (4, 1, 3), (5, 2, 1), (6, 0, 6)]


def test_secrets_by_postings(spark):
    docs = spark.createDataFrame([(1, "token = abcdef123"), (1, "nothing"), (None, 'xx api_key:"q1w2e3r4"'), (2, "toke n=abcdefgh")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, [(x["s"], x["e"]) for x in r["assign"]]) for r in secrets.scan(docs).collect()), key=str)
    assert got == [(0, [(3, 20)]), (1, [(0, 17)]), (1, []), (2, [])]
    query = secrets.trigram_query("token")
    wanted = sorted(secrets.trigrams(query))
    index = secrets.postings(docs, wanted, "doc_id", "text")
    assert [r.k for r in secrets.answer(index, [query], wanted).collect()] == [1]
