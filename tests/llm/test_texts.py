"""Operators that work on each text by itself, against the libraries they stand for."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsieve.llm import byte_convnet, edit_counts, huffman_ids, url_filter
from mailsieve.llm.sentence_pieces import ChunkTable, encode_pieces, load

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\n b\t", "▁", "a▁ b", " ▁", "é😀ﬁ", "x\u0000y", "İstanbul ΣΑΣ.", "don't <s> </s>", "ab" * 3000, "A <|endoftext|> B", "A <|ENDOFTEXT|> b", "ÀÉ Straße ǅ"]


def test_pieces_of_odd_strings():
    with open(PIECES, "rb") as f:
        library = load(f.read())
    counts, ids, decoded = ChunkTable(library).encode(ODD)
    edges = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(ODD):
        want = library.encode(text)
        assert ids[edges[i] : edges[i + 1]].tolist() == want
        assert decoded[i] == library.decode(want)


def test_pieces_with_a_tiny_table():
    with open(PIECES, "rb") as f:
        library = load(f.read())
    table = ChunkTable(library, rows=3)
    for text in ("one two three four five", "six seven one", "one two"):
        assert table.encode([text])[1].tolist() == library.encode(text)


def test_pieces(odd_documents, no_documents):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_pieces(odd_documents.withColumn("copy", F.col("text")), PIECES).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r.ids == library.encode(r.copy or "") and r.decoded == library.decode(r.ids)
    assert encode_pieces(no_documents, PIECES).count() == 0


def test_language(spark, odd_documents, no_documents, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    network = byte_convnet.train(byte_convnet.training_windows(docs.where(~held), "doc_id", "text", "lang"))
    found = byte_convnet.identify(docs.where(held), network)
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    rows = byte_convnet.identify(odd_documents, network).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert byte_convnet.training_windows(no_documents, "doc_id", "text", "lang") == []
    nothing = byte_convnet.identify(odd_documents, byte_convnet.train([])).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_network_tables_equal_the_plain_convolution():
    rows = [("der die das und ist nicht", "de"), ("the of and to in is", "en")] * 20
    network = byte_convnet.train(rows)
    symbols, _, _ = byte_convnet._windows([b"the und of", b"x" * 300], network.fold)
    got = network.predict(symbols, network.tables())
    maxima = []
    for width, f in network.filters.items():
        sums = sum(f[j][symbols[:, j : byte_convnet.WINDOW - width + 1 + j]] for j in range(width))
        maxima.append(sums.max(axis=1))
    hidden = np.maximum(np.concatenate(maxima, axis=1) + network.bias, 0)
    want = byte_convnet._softmax(hidden @ network.weights + network.offset)
    assert np.allclose(got, want, atol=1e-5)


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@pytest.fixture(scope="module")
def weights():
    return url_filter.train(url_filter.labelled_urls())


def test_urls(spark, weights):
    cases = {
        "http://A.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://a.example.net/de/1": ("a.example.net", "/de/1", "net/", "block"),
        "https://example.com/de/#t": ("example.com", "/de/", "example.com/de/", "block"),
        "https://badexample.com/de/": ("badexample.com", "/de/", None, None),
        "x://b.org/fr/?q": ("b.org", "/fr/", "org/fr/", "allow"),
        "http://b.net": ("b.net", "", None, None),
        "http://b.net?x/en/": ("b.net", "", None, None),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://cheap-pills-casino.com/": ("cheap-pills-casino.com", "/", None, "block"),
        "http://library.history.com/a": ("library.history.com", "/a", None, "allow"),
        "http://" + "a" * 100_000: ("a" * 100_000, "", None, None),
    }
    df = spark.createDataFrame([(u, "x", "y") for u in cases], "url string, host string, rule string")
    for r in url_filter.judge(df, weights, RULES).collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert url_filter.judge(df.limit(0), weights, RULES).count() == 0


def test_url_probabilities_do_not_depend_on_neighbours(weights):
    hosts, paths = ["win-casino.com", "", "museum.org"], ["/a", "", "/b/c"]
    together = url_filter.probabilities(weights, hosts, paths)
    for i in range(3):
        assert np.isclose(url_filter.probabilities(weights, hosts[i : i + 1], paths[i : i + 1])[0], together[i])
    assert together[1] == 0.5


def _counter():
    with open(RANKS, "rb") as f:
        return edit_counts.Counter(f.read(), public_tokenizers.PATTERN)


def test_edits_equal_encoding_anew():
    counter, rng = _counter(), random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "'", "re", "'s", "1", "é", "!", "don't ", "\t\n"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(0, 120)))
        tree = edit_counts.SegmentTree(*counter.leaves(text))
        for _ in range(6):
            at, cut = rng.randrange(-2, len(text) + 3), rng.choice([0, 0, 1, 3, 40])
            put = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 300])))
            text, _ = tree.edit(counter, text, at, cut, put)
            chars, tokens = counter.leaves(text)
            own = tree.columns()
            assert (own["chars"], own["tokens"]) == (chars, tokens)
            assert tree.total() == sum(tokens) == len(counter.library.encode_ordinary(text))
            assert tree.chars[1] == len(text)
            assert edit_counts.SegmentTree(**own).columns()["chars"] == chars


def test_an_edit_touches_little():
    counter = _counter()
    text = "some words follow each other " * 2000
    tree = edit_counts.SegmentTree(*counter.leaves(text))
    _, encoded = tree.edit(counter, text, 30_000, 5, "new")
    assert encoded < 8


def test_trees_go_through_columns_and_their_slices():
    counter = _counter()
    texts = ["", "a", "One two, three. " * 60, "\U0001f600 x", "it's 1234567"]
    trees = [edit_counts.SegmentTree(*counter.leaves(t)) for t in texts]
    column = edit_counts._to_column(trees)
    assert column.to_pylist() == [t.columns() for t in trees]
    back = edit_counts._from_column(column.slice(1, 3))
    assert [t.columns() for t in back] == [t.columns() for t in trees[1:4]]


def test_counts(spark, odd_documents, no_documents):
    edits = F.array(
        F.struct(F.lit(0).alias("at"), F.lit(2).alias("cut"), F.lit("Zz ").alias("put")),
        F.lit(None).cast("struct<at:int,cut:int,put:string>"),
    )
    docs = odd_documents.withColumn("edits", F.when(F.col("doc_id") != 4, edits)).withColumn("old", F.col("text"))
    counted = edit_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN)
    rows = edit_counts.apply_edits(counted, RANKS, public_tokenizers.PATTERN).collect()
    encode = _counter().library.encode_ordinary
    assert len(rows) == odd_documents.count()
    for r in rows:
        want = r.old or "" if r.edits is None else "Zz " + (r.old or "")[2:]
        assert r.text == want and r.n_tokens == len(encode(want)) and r.n_before == len(encode(r.old or ""))
    assert edit_counts.count_tokens(no_documents, RANKS, public_tokenizers.PATTERN).count() == 0


def test_code_lengths_are_optimal_and_limited():
    assert huffman_ids.code_lengths(np.array([5])).tolist() == [1]
    assert sorted(huffman_ids.code_lengths(np.array([1, 1, 2, 4]))) == [1, 2, 3, 3]
    counts = np.array([2**i for i in range(40)])
    for limit in (6, 8, 18):
        lengths = huffman_ids.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0**-lengths) <= 1
    assert huffman_ids.code_lengths(np.ones(1000, int), 10).max() <= 10
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(1000, int), 9)


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 127, 128, 129, 5000):
        ids = (rng.pareto(0.7, n) * 3).astype(np.int64) % 49_408
        used, counts = np.unique(ids, return_counts=True)
        code = huffman_ids.Code(used, huffman_ids.code_lengths(counts))
        bits, offsets = code.pack(ids)
        assert code.unpack(bits, offsets, n).tolist() == ids.tolist()
        assert len(bits) * 8 <= 18 * n + 7


def test_token_files(spark, odd_documents, no_documents, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    huffman_ids.write_token_files(odd_documents, str(tmp_path / "a"), WORDS, 2, block_ids=50)
    rows = huffman_ids.read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()
    texts = sorted(odd_documents.select("doc_id", "text").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))
    assert [r.doc_id for r in rows] == [r.doc_id for r in texts]
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = tokenizer.encode(t.text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.start == start
        start += len(ids)
    huffman_ids.write_token_files(no_documents, str(tmp_path / "b"), WORDS, 2)
    assert huffman_ids.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_word_table_on_odd_strings():
    import pyarrow as pa

    tokenizer = Tokenizer.from_file(WORDS)
    counts, ids = huffman_ids.WordTable(tokenizer).encode(pa.array(ODD))
    edges = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(ODD):
        assert ids[edges[i] : edges[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_digest_query(spark, sf):
    from mailsieve.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_sentence_pieces"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_words_parted_at_marks_keep_their_ids():
    tokenizer = Tokenizer.from_file(WORDS)
    draw = random.Random(11)
    marks = list("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~ ") + ["'s", "'re", "n't", "\u0338", "\u0301", "é", "Ω", "7", "42", "ab", "Word", "the", "\u00a0", "<|"]
    texts = ["".join(draw.choices(marks, k=draw.randint(0, 30))) for _ in range(1500)] + ["x" * 500 + "," + "y" * 300] * 2
    table = huffman_ids.WordTable(tokenizer)
    for sliced in (pa.array(texts), pa.array(["first", *texts]).slice(1)):
        counts, ids = table.encode(sliced)
        ends = np.cumsum(counts)
        for text, a, b in zip(texts, ends - counts, ends):
            assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_the_query_of_token_files_equals_the_library(spark, sf):
    import zlib

    from mailsieve.llm.queries import QUERIES

    tokenizer = Tokenizer.from_file(WORDS)
    start = 0
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = got.pop(r.doc_id)
        digest = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (own.start, own.n_tokens, own.ids_crc32) == (start, len(ids), digest)
        start += len(ids)
    assert not got


def test_piece_digests(odd_documents, no_documents):
    from mailsieve.llm.sentence_pieces import piece_digests

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_digests(odd_documents.withColumn("copy", F.col("text")), PIECES).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        ids = library.encode(r.copy or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_digests(no_documents, PIECES).count() == 0
