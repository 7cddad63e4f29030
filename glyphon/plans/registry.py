"""Every query of the engine by name, and its SQL where SQL can say it.

Inline rows stand beside ``documents`` where those hold too few kinds of characters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphon.functions import text as T
from glyphon.operators.embed import Encoder, dot, l2_norm, pool, token_counts
from glyphon.operators.tokenize import tokenize, tokenize_rows
from glyphon.sources.model import MODELS, VOCAB_SCHEMA, Model, Tokenizer, demo_model, model_registry

#: Inputs that the test tables lack: (name, text).
PROBES = [
    ("tab", "Hello\tWorld"), ("cjk", "Hello世界"), ("kana", "日本あ가"), ("wide", "a　 b c"), ("zero width", "a​b"), ("vertical", "a\u000bb\u0085c"),
    ("dash", "em—dash a€b «q» 1+2"), ("sigma", "ΣΟΦΟΣ"), ("accents", "Crème Brûlée ñandú"), ("ends", "  x y 　"), ("quote", "it's $5..."), ("empty", ""),
]


#: Bytes of input up to which rows are dealt out anew: a small file may be one row group, thus one task.
SMALL_INPUT = 1 << 30


def _docs(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(2 * spark.sparkContext.defaultParallelism) if size <= SMALL_INPUT else docs


def _probes(spark):
    return spark.createDataFrame(PROBES, "name string, text string")


def _sql_text(s: str) -> str:
    return "''" if not s else "concat(" + ", ".join(f"chr({ord(c)})" for c in s) + ")"


_PROBE_SQL = "probes(name, text) AS (VALUES " + ", ".join(f"('{n}', {_sql_text(t)})" for n, t in PROBES) + ")"
_WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PUNCT = r"!-/:-@\[-`{-~"


def _column(fn):
    """A query of a Column function over the documents and the probes."""

    def query(spark, sf_dir):
        both = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), "text").unionByName(_probes(spark))
        return both.select("name", fn(F.col("text")).alias("result"))

    return query


def _column_sql(expr: str) -> str:
    return f"WITH {_PROBE_SQL}, rows AS (SELECT doc_id::VARCHAR AS name, text FROM documents UNION ALL SELECT name, text FROM probes) SELECT name, {expr} AS result FROM rows"


_SQL_CLEAN = rf"regexp_replace(regexp_replace(text, '[\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}\x{{FFFD}}]', '', 'g'), '{_WS}', ' ', 'g')"
_SQL_PAD = r"regexp_replace(text, '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])', ' \1 ', 'g')"


# -- queries over the demo model -------------------------------------------------------

_NORM = "lower(strip_accents(text))"
_WORDS = rf"regexp_extract_all({_NORM}, '[{_PUNCT}]|[^\s{_PUNCT}]+')"
_VOCAB_SQL = f"""
words AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS pos FROM documents),
size AS (SELECT count(*) AS n FROM embeddings),
top AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS r FROM words WHERE NOT regexp_matches(word, '^[a-z]$') GROUP BY word),
vocab AS (
  SELECT '[UNK]' AS token, 0 AS token_id UNION ALL
  SELECT chr((96 + i)::INTEGER), i::INTEGER FROM range(1, 27) r(i) UNION ALL SELECT '##' || chr((96 + i)::INTEGER), (26 + i)::INTEGER FROM range(1, 27) r(i) UNION ALL
  SELECT word, (52 + r)::INTEGER FROM top, size WHERE r <= n - 53
),
walk AS (
  SELECT word, 1 AS place, 0 AS k, NULL::INTEGER AS token_id FROM (SELECT DISTINCT word FROM words WHERE length(word) <= 100)
  UNION ALL
  SELECT w.word, w.place + m.len, w.k + 1, m.token_id FROM walk w, LATERAL (
    SELECT v.token_id, l.len FROM range(1, length(w.word) - w.place + 2) l(len) JOIN vocab v ON v.token = (CASE WHEN w.place > 1 THEN '##' ELSE '' END) || substr(w.word, w.place, l.len) ORDER BY l.len DESC LIMIT 1) m
  WHERE w.place <= length(w.word)
),
whole AS (SELECT word FROM walk WHERE place = length(word) + 1),
tokens AS (SELECT d.doc_id, d.pos, k, token_id FROM words d JOIN whole USING (word) JOIN walk USING (word) WHERE k > 0)"""


def _tokens(spark, sf_dir, rows: bool = False):
    model = demo_model(spark, sf_dir)
    return (tokenize_rows if rows else tokenize)(_docs(spark, sf_dir).select("doc_id", "text"), model)


def _flat(tokens):
    return tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token_id")).withColumn("pos", F.col("pos").cast("long"))


_FLAT_SQL = f"WITH RECURSIVE {_VOCAB_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS pos, token_id FROM tokens"


def _exploded(df):
    return df.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))


def _embed(weighted: bool = False, mapped: bool = False):
    def query(spark, sf_dir):
        model = demo_model(spark, sf_dir, weighted, mapped)
        return _exploded(Encoder(model).encode(_docs(spark, sf_dir).select("doc_id", "text")))

    return query


def _embed_sql(weight: str = "1.0::DOUBLE", row: str = "token_id") -> str:
    return f"""WITH RECURSIVE {_VOCAB_SQL},
counts AS (SELECT doc_id, token_id, count(*) AS n FROM tokens GROUP BY ALL),
rows AS (SELECT doc_id, n * {weight} AS w, n, embedding FROM counts, (SELECT max(token_id) AS last FROM vocab) JOIN embeddings ON vec_id = {row}),
cells AS (SELECT doc_id, d - 1 AS dim, sum(w * embedding[d]) / sum(n) AS x FROM rows, range(1, 65) r(d) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY doc_id)
SELECT doc_id, dim, round((x / norm)::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS value FROM cells JOIN norms USING (doc_id)
UNION ALL SELECT doc_id, d, 0.0::DOUBLE FROM documents, range(64) r(d) WHERE doc_id NOT IN (SELECT doc_id FROM tokens)"""


def _embed_empty(spark, sf_dir):
    model = demo_model(spark, sf_dir)
    rows = spark.createDataFrame([(1, ""), (2, " 　 "), (3, "☃"), (4, None)], "doc_id long, text string")
    return Encoder(model).encode(rows).select("doc_id", l2_norm(F.col("embedding")).alias("norm"))


UNIGRAM = [["<unk>", 0.0], ["▁", -1.0], ["th", -1.1], ["the", -1.6], ["in", -1.2], ["ing", -1.9], ["er", -1.3], ["on", -1.4], ["tion", -2.1], *[[chr(97 + i), -3.0 - i / 16] for i in range(26)]]


def _unigram(spark, sf_dir):
    t = Tokenizer("Unigram", [x for x, _ in UNIGRAM], [s for _, s in UNIGRAM], {x: i for i, (x, _) in enumerate(UNIGRAM)}, 0, normalizer=[])
    vocab = spark.createDataFrame([(x, i, s, None, i) for i, (x, s) in enumerate(UNIGRAM)], VOCAB_SCHEMA)
    model = Model(t, vocab, spark.createDataFrame([], "row_id int, vec array<float>"), 64)
    return _flat(tokenize(_docs(spark, sf_dir).select("doc_id", F.lower("text").alias("text")), model))


def _l2(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return emb.select("vec_id", F.round(l2_norm(F.col("embedding")), 5).alias("norm"))


def _cosine_topk(spark, sf_dir):
    """Extra: the ten nearest of vector 0. The limit is the feature."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = F.broadcast(emb.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    score = F.round(dot(F.col("embedding"), F.col("q")), 5)
    return emb.where("vec_id <> 0").join(one).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


QUERIES = {
    "model_registry": lambda spark, sf_dir: model_registry(spark),
    "clean_text": _column(T.clean_text),
    "pad_cjk": _column(T.pad_cjk),
    "trim_unicode": _column(T.trim_unicode),
    "strip_left": _column(lambda c: T.trim_unicode(c, right=False)),
    "strip_right": _column(lambda c: T.trim_unicode(c, left=False)),
    "lower_codepoint": _column(T.lower_codepoint),
    "strip_accents": lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.strip_accents(F.col("text")).alias("result")),
    "pretokenize": _column(lambda c: F.array_join(T.pretokenize(c), "\x01")),
    "replace_literal": _column(lambda c: T.replace_literal(c, "the", "THE")),
    "replace_regex": _column(lambda c: T.replace_regex(c, r"\s+", " ")),
    "metaspace": _column(T.metaspace),
    "word_counts": lambda spark, sf_dir: _docs(spark, sf_dir).select(F.explode(T.pretokenize(T.lower_codepoint(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")),
    "chunk_256": lambda spark, sf_dir: T.chunk_words(_docs(spark, sf_dir), "doc_id", "text"),
    "wordpiece_tokens": lambda spark, sf_dir: _flat(_tokens(spark, sf_dir)),
    "wordpiece_row_local": lambda spark, sf_dir: _flat(_tokens(spark, sf_dir, rows=True)),
    "token_histogram": lambda spark, sf_dir: _flat(_tokens(spark, sf_dir)).groupBy("token_id").agg(F.count(F.lit(1)).alias("n")),
    "doc_token_counts": lambda spark, sf_dir: token_counts(_tokens(spark, sf_dir)),
    "unigram_tokens": _unigram,
    "embed_mean": _embed(),
    "embed_weighted": _embed(weighted=True),
    "embed_mapped": _embed(mapped=True),
    "embed_empty": _embed_empty,
    "l2_norm": _l2,
    "cosine_topk": _cosine_topk,
}
SQL = {
    "model_registry": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', {d}, '{t}')" for m, d, t in MODELS) + ") t(model, dimensions, tokenizer)",
    "clean_text": _column_sql(_SQL_CLEAN),
    "pad_cjk": _column_sql(_SQL_PAD),
    "trim_unicode": _column_sql(f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"),
    "strip_left": _column_sql(f"regexp_replace(text, '^{_WS}+', '')"),
    "strip_right": _column_sql(f"regexp_replace(text, '{_WS}+$', '')"),
    "lower_codepoint": _column_sql("lower(text)"),
    "strip_accents": "SELECT doc_id, strip_accents(text) AS result FROM documents",
    "pretokenize": _column_sql(rf"array_to_string(regexp_extract_all(text, '[{_PUNCT}\p{{P}}]|[^{_WS[1:-1]}{_PUNCT}\p{{P}}]+'), chr(1))"),
    "replace_literal": _column_sql("replace(text, 'the', 'THE')"),
    "replace_regex": _column_sql(f"regexp_replace(text, '{_WS}+', ' ', 'g')"),
    "metaspace": _column_sql("CASE WHEN text = '' THEN '' WHEN starts_with(replace(text, ' ', chr(9601)), chr(9601)) THEN replace(text, ' ', chr(9601)) ELSE chr(9601) || replace(text, ' ', chr(9601)) END"),
    "word_counts": rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[{_PUNCT}]|[^\s{_PUNCT}]+')) AS word FROM documents) GROUP BY word",
    "chunk_256": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 255) // 256)) AS chunk FROM w) SELECT doc_id, chunk::INTEGER AS chunk, array_to_string(w[chunk * 256 + 1 : chunk * 256 + 256], ' ') AS text FROM c",
    "wordpiece_tokens": _FLAT_SQL,
    "wordpiece_row_local": _FLAT_SQL,
    "token_histogram": f"WITH RECURSIVE {_VOCAB_SQL} SELECT token_id, count(*) AS n FROM tokens GROUP BY token_id",
    "doc_token_counts": f"WITH RECURSIVE {_VOCAB_SQL} SELECT doc_id, token_id, count(*) AS n FROM tokens GROUP BY ALL",
    "embed_mean": _embed_sql(),
    "embed_weighted": _embed_sql(weight="1.0::DOUBLE / (1 + token_id % 7)"),
    "embed_mapped": _embed_sql(row="last - token_id"),
    "embed_empty": "SELECT * FROM (VALUES (1::BIGINT, 0.0::DOUBLE), (2, 0.0), (3, 0.0), (4, NULL)) t(doc_id, norm)",
    "l2_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings",
    "cosine_topk": "SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY score DESC, e.vec_id LIMIT 10",
}
__all__ = ["QUERIES", "SQL", "pool"]
