"""Long values, all pieces, ids of any type, and columns that clash."""

import itertools
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm.bpe import read_vocabulary
from graphloom.llm.decontaminate import scan_benchmark
from graphloom.llm.language_id import Pieces, word_scores
from graphloom.llm.secrets import scan_secrets

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_long_secrets_go_as_a_whole(spark):
    draw = random.Random(1)
    words = " ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(1250))
    body = "\n".join("".join(draw.choice("ABCabc123+/") for _ in range(64)) for _ in range(500))
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f'password = "{words}" end'), (2, f"begin {key} end"), (3, f'secret: "{words[:174]}"')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["redacted"] for r in scan_secrets(df).collect()}
    assert got == {1: 'password = "[SECRET]" end', 2: "begin [SECRET] end", 3: 'secret: "[SECRET]"'}


def test_forward_pass_sums_over_all_segmentations():
    pieces = Pieces(read_vocabulary(WORD_BPE))
    assert pieces.longest > 8 and len(pieces.ids) > 48_000
    log_p = np.log(np.random.default_rng(2).random((len(pieces.ids) + 1, 3)) / 1000)
    at = {}
    for size, (hashes, first) in pieces.tables.items():
        at.update({(size, int(h)): first + i for i, h in enumerate(hashes)})
    words = [b"a", b"the", b"international", b"understanding", b"zzqx", "straße".encode(), b"responsibilities"]
    got = word_scores(pieces, log_p, words)
    for word, scores in zip(words, got, strict=True):
        n, total = len(word), np.zeros(3)
        # P of a prefix by its last piece: the same sum as over all 2**(n-1) ways to cut.
        prefix = [np.ones(3)] + [np.zeros(3)] * n
        for end, begin in itertools.product(range(1, n + 1), range(n)):
            if begin < end:
                value = Pieces._hash(word[begin:end], end == n)
                found = at.get((end - begin, value), -1 if end - begin == 1 else None)
                if found is not None:
                    prefix[end] = prefix[end] + prefix[begin] * np.exp(log_p[found])
        total = prefix[n]
        assert np.allclose(scores, np.log(total), rtol=1e-9), word
    short = words[1]
    ways = np.zeros(3)
    for cuts in itertools.product([0, 1], repeat=len(short) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(short)]
        p = np.ones(3)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found = at.get((b - a, Pieces._hash(short[a:b], b == len(short))), -1 if b - a == 1 else None)
            p = p * (0 if found is None else np.exp(log_p[found]))
        ways = ways + p
    assert np.allclose(got[1], np.log(ways), rtol=1e-9)


def test_benchmark_ids_of_any_type(spark):
    words = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"x {words} y", 5, "z")], "doc_id long, text string, items int, item string")
    bench = spark.createDataFrame([("mmlu-1", words), ("a", words), (None, words)], "item_id string, text string")
    row = scan_benchmark(docs, bench).first()
    assert row["items"] == ["a", "mmlu-1"] and row["hit_words"] == list(range(1, 14)) and row["item"] == "z"


def test_pipeline_stages_keep_columns_that_clash(spark):
    import corpus_pipeline

    names = ["label", "score", "predicted", "findings", "redacted", "row", "statistics", "id", "a.b"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns(
        {name: F.lit(f"own {name}") for name in names}
    )
    extra = docs.limit(1).select([F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    docs = docs.unionByName(extra)
    for stage in (corpus_pipeline.quality, corpus_pipeline.redact_secrets):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        kept = out.filter("doc_id IS NOT NULL").select(*[f"`{n}`" for n in names]).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(f"own {n}" for n in names)]
        assert stage(spark, docs.filter("false"), "/root/testdata/sf0.001").count() == 0


def test_words_go_to_the_library_in_lines(monkeypatch):
    """Ids do not hang on how many words share a call; raw chunks and marks behind words are cut as before."""
    import public_tokenizers

    from graphloom.llm import token_files
    from graphloom.llm.bpe import read_vocabulary

    data = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"w{i}x Word{i}. don't K: a;b İx été? <|endoftext|>.".encode() for i in range(90)] + [b"", b". ..."]
    made = []
    for line in (1, 7, 256):
        monkeypatch.setattr(token_files, "LINE", line)
        made.append([x.tolist() for x in token_files.library_cache(data).texts(texts)])
    assert made[0] == made[1] == made[2] and made[0][1][-2] == 0
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(data.decode()).encode_batch([t.decode() for t in texts], add_special_tokens=False)
    assert made[0][0] == [i for e in whole for i in e.ids] and made[0][1] == [len(e.ids) for e in whole]


def test_chunks_are_those_between_white_space():
    """As ``bytes.split`` cuts, for nulls, white space at the ends and bytes that only look like it."""
    import pyarrow as pa

    from graphloom.llm.batches import chunks

    texts = [" a\tB\n c ", None, "", "  ", "é\xa0x\x0bq\x1cz\x85 k", "a B", "c\r\nc", "İ K a"]
    for some in (texts, texts[1:3], ["", "x"], ["x", None], []):
        for lower in (False, True):
            raw = [(t or "").encode() for t in some]
            numbers, sizes, pieces = chunks(pa.array(some, pa.string()), lower)
            want = [(t.lower() if lower else t).split() for t in raw]
            assert sizes.tolist() == [len(w) for w in want] and len(set(pieces)) == len(pieces)
            assert [pieces[i] for i in numbers.tolist()] == [c for w in want for c in w]


def test_latin_words_need_no_pattern(monkeypatch):
    """Letters, alone or before one mark, were cut one by one by the pattern if they were not ASCII."""
    from tokenizers import Tokenizer

    from graphloom.llm import bpe, token_files

    texts = ["Été, straße. ŁÓDŹ naïve! Ǆ ȺB? Plain word: x;", "été Été étÉ,"]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "_WORD", None)
    data = read_vocabulary(WORD_BPE)
    coder = bpe.Bpe(data)
    for cache in (token_files.library_cache(data), bpe.chunk_cache(coder.raw_or_words, coder.specials)):
        flat, counts = cache.texts([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want


def test_texts_travel_once(spark, monkeypatch):
    """Texts went to the tasks twice, and three times in the first stage of the pipeline."""
    import corpus_pipeline

    from graphloom.llm.bpe import encode_texts
    from graphloom.llm.quality import with_statistics

    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long")
    for out in (encode_texts(docs, WORD_BPE), with_statistics(docs, "text")):
        assert "__in" not in out._jdf.queryExecution().analyzed().toString()
    seen = []

    def score(rows, labels, *names):
        seen.append([f.dataType.simpleString() for f in rows.schema.fields])
        return rows.withColumn("predicted", F.lit(1))

    monkeypatch.setattr(corpus_pipeline, "score_quality", score)
    got = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.001")
    assert seen == [["bigint", "string", "bigint"]] and got.collect() == docs.collect()


def test_lm_words_are_looked_up_once_for_a_slice(monkeypatch):
    """Each occurrence of a word went through the table of words; now each distinct one of a slice does."""
    import pyarrow as pa

    from graphloom.llm import batches

    seen = []

    def numbered(table, items):
        seen.append(len(items))
        return np.array([table[i] for i in items], np.int64)

    monkeypatch.setattr(batches, "numbered", numbered)
    cache = batches.PieceCache(lambda words: (np.arange(len(words), dtype=np.int32), np.ones(len(words), np.int64)))
    numbers, sizes = cache.cut(pa.array(["A b a " * 50, None, "c"]), lower=True)
    assert seen == [3] and sizes.tolist() == [150, 0, 1] and numbers[:4].tolist() == [0, 1, 0, 0]
    flat, counts = cache.of(numbers, sizes)
    assert counts.tolist() == [150, 0, 1] and flat[-1] == 2
