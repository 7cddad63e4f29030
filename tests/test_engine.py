"""Fixtures of the text steps, both tokenizers, pooling and the readers."""

import base64
import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphon.functions import charsmap
from glyphon.functions import text as T
from glyphon.operators.embed import Encoder, encode_rows, pool
from glyphon.operators.tokenize import RowTokenizer, tokenize, tokenize_rows
from glyphon.sources.model import VOCAB_SCHEMA, Model, Tokenizer, ensure_files, load_model, model_dir, read_tensors, read_tokenizer

WORDS = [
    ("", []), ("  spaced   out  ", ["spaced", "out"]), ("hello!", ["hello", "!"]), ("...", [".", ".", "."]), ("a...b", ["a", ".", ".", ".", "b"]), ("it's", ["it", "'", "s"]), ("1+2=3", ["1", "+", "2", "=", "3"]),
    ("$5", ["$", "5"]), ("«quoted»", ["«", "quoted", "»"]), ("em—dash", ["em", "—", "dash"]), ("a€b", ["a€b"]), ("a b", ["a", "b"]), ("a b", ["a", "b"]), ("café tea", ["café", "tea"]), ("日本語", ["日本語"]), ("mixé!", ["mixé", "!"]),
]
NORMAL = [("", ""), ("Hello\tWorld", "hello world"), ("Hello世界", "hello 世  界"), ("HELLO", "hello"), ("ΣΟΦΟΣ", "σοφοσ"), ("a≠b", "a=b"), ("İ", "i"), ("　x ", "x")]
VOCAB = {"[UNK]": 0, "hello": 1, "world": 2, "!": 3, "un": 4, "##aff": 5, "##able": 6, "'": 7, "s": 8, "it": 9}
PIECES = [("", []), ("hello", [1]), ("HELLO World!", [1, 2, 3]), ("unaffable", [4, 5, 6]), ("it's", [9, 7, 8]), ("hello xyzzy world", [1, 2]), ("hello & world", [1, 2]), ("hello unaffordable world", [1, 2]), ("xyzzy", [])]


def model_of(spark, t, vec=None):
    rows = [(x, i, float(t.scores[i]) if t.scores else None, None, i) for x, i in t.vocab.items()]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(vec or [[1.0, 0.0]] * len(rows))], "row_id int, vec array<float>")
    return Model(t, spark.createDataFrame(rows, VOCAB_SCHEMA), vectors, 2)


def wordpiece(vocab=VOCAB, **more):
    return Tokenizer("WordPiece", vocab=vocab, unk_id=vocab.get("[UNK]", -1), normalizer=T.BertNormalizer(), **more)


def unigram(entries, **more):
    return Tokenizer("Unigram", [t for t, _ in entries], [s for _, s in entries], {t: i for i, (t, _) in enumerate(entries)}, 0, **{"normalizer": [], **more})


def test_text_steps(spark):
    df = spark.createDataFrame(WORDS, "text string, want array<string>")
    assert df.where(T.pretokenize(F.col("text")) != F.col("want")).count() == 0
    df = T.BertNormalizer().apply(spark.createDataFrame([*NORMAL, (None, None)], "text string, want string"), "text", "norm")
    assert df.where("NOT norm <=> want").collect() == []
    assert [T.BertNormalizer().python(a) for a, _ in NORMAL] == [b for _, b in NORMAL]
    with pytest.raises(ValueError):
        T.replace_literal(F.lit("a"), "", "b")


def test_wordpiece_both_ways(spark):
    model = model_of(spark, wordpiece())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PIECES)] + [(99, None)], "doc_id long, text string")
    for fn in (tokenize, tokenize_rows):
        got = {r["doc_id"]: r["tokens"] for r in fn(df, model).collect()}
        assert got == {**{i: w for i, (_, w) in enumerate(PIECES)}, 99: None}
    assert RowTokenizer(wordpiece(max_chars=5)).tokens("unaffable") == []
    assert RowTokenizer(wordpiece(max_chars=9)).tokens("unaffable") == [4, 5, 6]
    with pytest.raises(ValueError, match="xyzzy"):
        RowTokenizer(wordpiece({"a": 0})).tokens("xyzzy")


def test_unigram(spark):
    t = unigram([("<unk>", 0), ("a", 0), ("b", 0), ("c", 0), ("d", 0), ("cd", 1), ("ab", 2), ("abc", 5), ("abcd", 10)])
    r = RowTokenizer(t)
    assert r.pieces("abcdacdxx") == ["abcd", "a", "cd", "xx"]
    assert r.tokens("abcdacdxx") == [0, 8, 1, 5, 0]
    assert RowTokenizer(unigram([("<unk>", 0), ("a", -0.5), ("b", -0.5), ("ab", -1.0)])).pieces("ab") == ["ab"]
    t = unigram([("<unk>", 0), ("▁", -1), ("▁hello", -1), ("▁world", -1), ("!", -1), ("▁h", -2), ("ello", -2)])
    cases = [("hello", [2]), ("hello world!", [2, 3, 4]), ("hello!", [2, 4]), ("hello ~", [2, 1, 0]), ("hello ~~", [2, 1, 0]), ("   ", [1, 1, 1]), ("", [])]
    assert [RowTokenizer(t).tokens(a) for a, _ in cases] == [b for _, b in cases]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "doc_id long, text string")
    assert {x["doc_id"]: x["tokens"] for x in tokenize(df, model_of(spark, t)).collect()} == {i: b for i, (_, b) in enumerate(cases)}
    t = unigram([("<unk>", 0), ("▁", -1), ("<0x78>", -5), ("a", -1)], byte_fallback=True)
    assert RowTokenizer(t).tokens("a x") == [1, 3, 1, 2] and RowTokenizer(t).tokens("é") == [1, 0]
    steps = [{"type": "Replace", "pattern": {"String": "!"}, "content": " ! "}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Strip", "strip_left": True, "strip_right": True}]
    t = unigram([("<unk>", 0), ("▁", -1), ("▁hi", -1), ("!", -1)], normalizer=steps)
    assert RowTokenizer(t).tokens("  hi!! ") == [2, 1, 3, 1, 3] and RowTokenizer(t).tokens("   ") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab▁ c", max_size=3).filter(bool), min_size=1, max_size=6, unique=True), st.text(alphabet="ab c", max_size=12))
def test_segments_give_the_same_ids(tokens, text):
    entries = [("<unk>", 0.0), ("▁", -1.0), *[(t, -1.0 - k) for k, t in enumerate(tokens) if t != "▁" and "▁" not in t[1:] and " " not in t]]
    r = RowTokenizer(unigram(entries))
    if r.segmentable and text:
        import re

        assert [i for s in re.findall("▁?[^▁]*", r.prepared(text)) if s for i in r.ids(s)] == r.tokens(text)


def test_pooling(spark):
    t = wordpiece({"a": 0, "b": 1})
    tokens = spark.createDataFrame([(1, []), (2, [0]), (3, [0, 0, 1]), (4, None)], "doc_id long, tokens array<int>")
    got = {r["doc_id"]: r["embedding"] for r in pool(tokens, model_of(spark, t, [[1.0, 0.0], [0.0, 1.0]])).collect()}
    assert got[1] == [0, 0] and got[2] == [1, 0] and got[4] is None
    assert got[3] == pytest.approx([2 / 5**0.5, 1 / 5**0.5], abs=1e-6)
    got = pool(spark.createDataFrame([(1, [0, 1])], "doc_id long, tokens array<int>"), model_of(spark, t, [[1.0, 0.0], [-1.0, 0.0]])).first()
    assert all(np.isnan(got["embedding"]))


def test_both_encoders_agree(spark):
    vec = [[1.0, 0.0], [0.5, 0.5], [-1.0, 0.25], [0.0, 1.0], [0.1, 0.2], [0.3, -0.4], [0.9, 0.9], [0.0, 0.0], [1.0, 1.0], [2.0, 0.0]]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PIECES)] + [(98, "HÉLLO wörld!\u00ad\u200b hel\x0blo it\x1cs\u3000unaffable"), (99, None)], "doc_id long, text string")
    for weighted in (False, True):
        m = model_of(spark, wordpiece(), vec)
        if weighted:
            m = Model(m.tokenizer, m.vocab.withColumn("weight", 1.0 / (1 + F.col("token_id"))), m.vectors, 2, True)
        a, b = ({r["doc_id"]: r["embedding"] for r in fn(df).collect()} for fn in (Encoder(m).encode, Encoder(m).encode_joined))
        assert a.keys() == b.keys() and a[99] is None and b[99] is None
        assert all(np.allclose(a[k], b[k], atol=1e-6) for k in a if k != 99)
    with pytest.raises(Exception, match="document 1: cannot tokenize word xyzzy"):
        encode_rows(spark.createDataFrame([(1, "xyzzy")], "doc_id long, text string"), model_of(spark, wordpiece({"a": 0}))).collect()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB\u00c9\u0301\u0130\u03a3\u4e16\u302e\u0323 \t\x0b\x1c\x85\u00a0\u200b\ufffd!-\u2014\u1100\uac00", max_size=14), st.booleans(), st.booleans(), st.sampled_from([None, True, False]), st.booleans())
def test_row_local_steps_equal_the_plain_ones(text, clean, cjk, strips, lower):
    """Every set of flags: the table of code points and the memo of chunks against the steps one by one."""
    n = T.BertNormalizer(clean, cjk, strips, lower)
    want = n._clean(text)
    want = T._bare(want) if n.strips else want
    want = (T.python_lower(want) if lower else want).strip(T._SPACES)
    assert n.python(text) == want
    vocab = {x: i for i, x in enumerate(["a", "b", "B", "##a", "##b", "é", "e", "##e", "世", "!", "-"])}
    r = RowTokenizer(Tokenizer("WordPiece", vocab=vocab, unk_id=0, normalizer=n))
    assert r.tokens(text) == [i for w in T.python_pretokenize(want) for i in r._word(w)]


def test_model_files(spark, tmp_path, monkeypatch):
    vectors = np.array([[1, 2], [3, 4], [5, 6]], "<f4")
    weights, mapping = np.array([1.0, 0.5], "<f8"), np.array([2, 0], "<i8")
    head = json.dumps({n: {"dtype": k, "shape": list(x.shape), "data_offsets": [a, a + x.nbytes]} for n, k, x, a in (("embeddings", "F32", vectors, 0), ("weights", "F64", weights, 24), ("mapping", "I64", mapping, 40))}).encode()
    files = {"tokenizer.json": json.dumps({"model": {"vocab": {"[UNK]": 0, "a": 1}}}).encode(), "model.safetensors": struct.pack("<Q", len(head)) + head + vectors.tobytes() + weights.tobytes() + mapping.tobytes()}
    asked = []

    def fetch(kind, name):
        asked.append(name)
        yield files[name][:5]
        if name == "model.safetensors" and asked.count(name) == 1:
            raise OSError("the line broke")
        yield files[name][5:]

    with pytest.raises(OSError):
        ensure_files("BASE2M", fetch, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "base2m").iterdir()) == ["tokenizer.json"]
    folder = ensure_files("BASE2M", fetch, str(tmp_path))
    assert asked == ["tokenizer.json", "model.safetensors", "model.safetensors"] and ensure_files("BASE2M", fetch, str(tmp_path)) == folder and len(asked) == 3
    m = load_model(spark, folder)
    assert m.dimensions == 2 and m.weighted and [r["row_id"] for r in m.vocab.orderBy("token_id").collect()] == [2, 0] and m.vectors.count() == 3
    got = Encoder(m).encode(spark.createDataFrame([(1, "a a")], "doc_id long, text string")).first()["embedding"]
    assert got == pytest.approx([1 / 5**0.5, 2 / 5**0.5], abs=1e-6)
    assert load_model(spark, "file://" + folder).dimensions == 2
    (tmp_path / "base2m" / "model.safetensors").unlink()
    with pytest.raises(FileNotFoundError, match="model.safetensors"):
        load_model(spark, folder)
    with pytest.raises(ValueError):
        ensure_files("NONE", fetch, str(tmp_path))
    monkeypatch.setenv("GLYPHON_MODELS", "/somewhere")
    assert model_dir("BASE2M") == "/somewhere/base2m"


def test_readers():
    odd = np.array([[np.inf, -np.inf, np.nan, 65504, 2**-24, -0.0]], "<f2")
    top = json.dumps({"embeddings": {"dtype": "F16", "shape": [1, 6], "data_offsets": [0, 12]}}).encode()
    assert np.array_equal(read_tensors(struct.pack("<Q", len(top)) + top + odd.tobytes())["embeddings"], odd.astype(np.float32), equal_nan=True)
    with pytest.raises(ValueError, match="ends within"):
        read_tensors(struct.pack("<Q", len(top)) + top + odd.tobytes()[:-1])
    data = np.array([[1, -2], [2**-24, -0.0]], "<f2").tobytes()
    head = json.dumps({"embeddings": {"dtype": "F16", "shape": [2, 2], "data_offsets": [0, 8]}}).encode()
    got = read_tensors(struct.pack("<Q", len(head)) + head + data)["embeddings"]
    assert got.dtype == np.float32 and got.tolist() == [[1, -2], [2**-24, 0]]
    with pytest.raises(ValueError):
        read_tensors(struct.pack("<Q", len(head)) + head.replace(b"F16", b"F64") + data)
    t = read_tokenizer(json.dumps({"model": {"vocab": {"a": 0}}, "normalizer": {"type": "BertNormalizer", "lowercase": False}}))
    assert t.max_chars == 100 and t.unk_id == -1 and not t.normalizer.strips
    for vocab in ([], [[1, -1.5]], [["tok", "x"]], [["tok"]], ["tok"]):
        with pytest.raises(ValueError):
            read_tokenizer(json.dumps({"model": {"type": "Unigram", "vocab": vocab}, "pre_tokenizer": {"type": "Metaspace"}}))
    with pytest.raises(ValueError):
        read_tokenizer(json.dumps({"model": {"type": "Unigram", "vocab": [["a", 0]]}, "pre_tokenizer": {"type": "Metaspace"}, "normalizer": {"type": "NFKC"}}))


def double_array(entries):
    """A charsmap of {key: replacement}: each node's children lie in a block of 256 units of its own."""
    trie = {}
    for key in entries:
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[None] = key
    blocks, pool, where = [trie], b"", {}
    for key, new in entries.items():
        where[key] = len(pool)
        pool += new + b"\0" if new is not None else b""
    units, k = [0] * 256, 0
    units[0] = (1 << 8) << 10  # the root's children lie in block 1
    while k < len(blocks):
        at = len(units)
        units += [0] * 256
        for c, child in blocks[k].items():
            if c is None:
                continue
            if None in child:
                units[at + c] = c | 0x100
            else:
                blocks.append(child)
                units[at + c] = c
        blocks[k] = (at, blocks[k])
        k += 1
    at_of = {id(b): a for a, b in blocks}
    for a, b in blocks:
        for c, child in b.items():
            if c is None:
                continue
            if None in child:
                units.append(where[child[None]])
                target = len(units) - 1
                offset = target ^ (a + c)
            else:
                offset = at_of[id(child)] ^ (a + c)
            units[a + c] |= offset << 10
    data = struct.pack(f"<{len(units)}I", *units)
    return base64.b64encode(struct.pack("<I", len(data)) + data + pool).decode()


def test_charsmap():
    keys = {b"A": b"x", b"B": b"yz", "\u0301".encode(): b""}
    look = lambda s: charsmap.lookup(keys, 2, s.encode())
    assert [look(s) for s in ("A", "B", "\u0301", "C", "", "AB", "\0A")] == [b"x", b"yz", b"", None, None, b"x", None]
    assert [charsmap.normalizer(keys)(s) for s in ("AB", "e\u0301A", "A\u0301")] == ["xyz", "ex", "x"]
    entries = {b"A": b"x", "ﬁ".encode(): b"fi", "é".encode(): "e".encode(), b"Z": None}
    got = charsmap.decode_charsmap(double_array(entries))
    assert got == {k: v or b"" for k, v in entries.items()}  # a value at the pool's end deletes
    assert charsmap.normalizer(got)("AﬁZq") == "xfiq"
    assert charsmap.decode_charsmap(double_array({"é".encode()[:1]: b"?", "é".encode(): b"e"})) == {"é".encode()[:1]: b"?"}
    for bad in (b"\1", struct.pack("<I", 99)):
        with pytest.raises(ValueError):
            charsmap.decode_charsmap(base64.b64encode(bad).decode())


def test_stream(spark, tmp_path):
    from glyphon.streaming.encode import encode_stream, tokenize_stream

    spark.createDataFrame([(1, "hello world")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = encode_stream(stream, model_of(spark, wordpiece())).writeStream.format("memory").queryName("vectors").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("vectors").collect()] == [(1, [1.0, 0.0])]
    q = tokenize_stream(stream, model_of(spark, wordpiece())).writeStream.format("memory").queryName("toks").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("toks").collect()] == [(1, [1, 2])]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
