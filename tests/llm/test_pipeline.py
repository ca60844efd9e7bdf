"""Stages of the pipeline on small tables with null and repeated ids."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(seed, n=80):
    return " ".join(f"w{seed}x{k}" for k in range(n))


def test_unique_keeps_one_row_of_each_group(spark):
    a, b, c, d, e = (prose(s) for s in "abcde")
    rows = [
        (None, a), (None, a), (None, a + " more"),  # only null ids
        (5, b), (None, b), (7, b + " more"), (3, b + " again"),  # the smallest id, not null
        (9, c), (9, c),  # a row given twice
        (11, d), (11, e), (12, e + " more"), (10, e + " again"),  # an id with unlike texts, one of them a copy
        (None, None), (None, None), (20, ""), (20, ""),  # no words: like nothing
    ]
    docs = table(spark, rows)
    out = corpus_pipeline.unique(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    few = [x for x in got if not (x[0] is None and (x[1] or "").startswith(a))]
    want = [(3, b + " again"), (9, c), (10, e + " again"), (11, d), (None, None), (None, None), (20, ""), (20, "")]
    assert few == sorted(want, key=str) and len(got) - len(few) == 1


PASSAGE = "every river of the old province runs north before it turns and meets the sea"
MAIL = "People who write to me.x@host.example.com get a plain answer.\nAnd another one follows it."


def plain(i):
    return f"This is a plain sentence number {i}, as people write them.\nAnd another one follows it."


def junk(i):
    return f"BUY!! NOW!! {i}!! ### $$$ BUY!! NOW!!" * 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables, and the rows that each stage is to leave."""
    out = str(tmp_path_factory.mktemp("corpus"))
    first = [(i, plain(i)) for i in range(40)]
    extra = [(None, plain(3)), (None, plain(3)), (5, plain(5)), (7, plain(77)), (None, plain(88)), (60, plain(60) + " " + PASSAGE), (None, MAIL), (61, MAIL), (61, MAIL)]
    docs = first + extra + [(100 + i, junk(i)) for i in range(40)] + [(None, junk(1)), (101, junk(1))]
    table(spark, docs).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    good = first + extra
    unique = first + [(7, plain(77)), (None, plain(88)), (60, plain(60) + " " + PASSAGE), (61, MAIL)]
    unseen = [x for x in unique if PASSAGE not in x[1]]
    private = [(i, t.replace("me.x@host.example.com", "[EMAIL]")) for i, t in unseen]
    return out, [docs, good, unique, unseen, private]


def rows(df):
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)


def counted(pairs):
    return sorted(((i, t, len(t)) for i, t in pairs), key=str)


def own():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(pairs, encoding):
    return sorted(((i, encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs), key=str)


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, folder, k):
    path, want = folder
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, table(spark, want[k]), path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows(out) == counted(want[k + 1]), name


def test_run(spark, folder):
    path, want = folder
    encoding = own()
    last = corpus_pipeline.tokens(spark, table(spark, want[4]), path)
    for out in (last, corpus_pipeline.run(spark, path)):
        assert sorted(((r.doc_id, list(r.ids), r.decoded_sha256) for r in out.collect()), key=str) == coded(want[4], encoding)
