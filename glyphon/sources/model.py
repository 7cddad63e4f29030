"""Models as tables: vocabulary, vectors, options; and readers of their files.

A model's files are a tokenizer JSON and a tensor file: eight bytes with the length of a
JSON header, the header with dtype, shape and offsets of each tensor, and the data.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphon.functions.text import BertNormalizer, pretokenize

# The model kinds, their dimensions and tokenizer families.
MODELS = [
    ("BASE2M", 64, "WordPiece"),
    ("BASE4M", 128, "WordPiece"),
    ("BASE8M", 256, "WordPiece"),
    ("BASE32M", 512, "WordPiece"),
    ("RETRIEVAL32M", 512, "WordPiece"),
    ("SCIENCE32M", 256, "WordPiece"),
    ("CODE16M", 256, "WordPiece"),
    ("CODE16MV2", 256, "WordPiece"),
    ("MULTILINGUAL128M", 256, "Unigram"),
]
VOCAB_SCHEMA = "token string, token_id int, score double, weight double, row_id int"
_DTYPES = {"embeddings": {"F32": "<f4", "F16": "<f2"}, "weights": {"F64": "<f8"}, "mapping": {"I64": "<i8"}}


def model_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, dimensions int, tokenizer string")


def model_dir(kind: str, root: str | None = None) -> str:
    """Where a kind's files are: below ``root``, $GLYPHON_MODELS or the user's cache."""
    if kind not in {m[0] for m in MODELS}:
        raise ValueError(f"unknown model kind {kind!r}")
    root = root or os.environ.get("GLYPHON_MODELS") or os.path.join(os.path.expanduser("~"), ".cache", "glyphon")
    return os.path.join(root, kind.lower())


def read_tensors(data) -> dict[str, np.ndarray]:
    """embeddings as float32 (from F32 or F16), optional weights (F64) and mapping (I64)."""
    size = int.from_bytes(bytes(data[:8]), "little")
    if len(data) < 8 + size:
        raise ValueError("the tensor file ends within its header")
    header, out = json.loads(bytes(data[8 : 8 + size])), {}
    for name, kinds in _DTYPES.items():
        if name not in header:
            continue
        t = header[name]
        if t["dtype"] not in kinds:
            raise ValueError(f"unsupported tensor dtype {t['dtype']} of {name}")
        a, b = t["data_offsets"]
        if 8 + size + b > len(data):
            raise ValueError(f"the tensor file ends within {name}")
        x = np.frombuffer(data[8 + size + a : 8 + size + b], kinds[t["dtype"]]).reshape(t["shape"])
        out[name] = x.astype(np.float32, copy=False) if name == "embeddings" else x
    if "embeddings" not in out:
        raise ValueError("tensor embeddings is missing")
    return out


@dataclass
class Tokenizer:
    family: str
    tokens: list[str] | None = None
    scores: list[float] | None = None
    vocab: dict[str, int] = field(default_factory=dict)
    unk_id: int = -1
    max_chars: int = 100
    byte_fallback: bool = False
    mark: str = "\u2581"
    prepend: bool = True
    normalizer: object = None


def _steps(n: dict | None) -> list[dict]:
    """The flat list of normalizer steps."""
    if not n:
        return []
    if n["type"] == "Sequence":
        return [s for x in n["normalizers"] for s in _steps(x)]
    if n["type"] not in ("Replace", "Strip", "Precompiled"):
        raise ValueError(f"unsupported normalizer {n['type']}")
    if n["type"] == "Replace" and not ({"String", "Regex"} & set(n.get("pattern") or {})):
        raise ValueError("Replace without a pattern")
    return [n]


def read_tokenizer(text: str) -> Tokenizer:
    """Only normalizer, pre_tokenizer and model count; other sections are passed over."""
    config = json.loads(text)
    model = config["model"]
    kind = model.get("type", "")
    if kind in ("", "WordPiece"):
        n = config.get("normalizer") or {}
        flags = BertNormalizer()
        if n.get("type") == "BertNormalizer":
            flags = BertNormalizer(n.get("clean_text", True), n.get("handle_chinese_chars", True), n.get("strip_accents"), n.get("lowercase", True))
        most = model.get("max_input_chars_per_word") or 0
        vocab = model["vocab"]
        return Tokenizer("WordPiece", vocab=vocab, unk_id=vocab.get(model.get("unk_token", "[UNK]"), -1), max_chars=most if most > 0 else 100, normalizer=flags)
    if kind != "Unigram":
        raise ValueError(f"unsupported tokenizer model {kind!r}")
    entries = model.get("vocab") or []
    if not entries:
        raise ValueError("empty vocabulary")
    for e in entries:
        if not (isinstance(e, list) and len(e) == 2 and isinstance(e[0], str) and isinstance(e[1], (int, float)) and not isinstance(e[1], bool)):
            raise ValueError(f"bad vocabulary entry {e!r}")
    unk = model.get("unk_id")
    if unk is not None and not 0 <= unk < len(entries):
        raise ValueError("unk_id lies outside the vocabulary")
    pre = config.get("pre_tokenizer") or {}
    if pre.get("type") != "Metaspace":
        raise ValueError("the pre-tokenizer must be Metaspace")
    if pre.get("split"):
        raise ValueError("Metaspace with split isn't supported")
    scheme = "never" if pre.get("add_prefix_space") is False else pre.get("prepend_scheme") or "always"
    tokens = [t for t, _ in entries]
    return Tokenizer("Unigram", tokens, [float(s) for _, s in entries], {t: i for i, t in enumerate(tokens)}, -1 if unk is None else unk, byte_fallback=bool(model.get("byte_fallback")), mark=pre.get("replacement", "\u2581"), prepend=scheme != "never", normalizer=_steps(config.get("normalizer")))


@dataclass
class Model:
    """``vocab`` (VOCAB_SCHEMA) and ``vectors`` (row_id, vec); tokens without a row are refused."""

    tokenizer: Tokenizer
    vocab: DataFrame
    vectors: DataFrame
    dimensions: int
    weighted: bool = False
    _table: tuple | None = field(default=None, repr=False)

    def matrix_bytes(self) -> int:
        """What the matrix takes as 32-bit numbers; each entry of the vocabulary has a row."""
        return 4 * self.dimensions * len(self.tokenizer.vocab)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(matrix, row of each token id, weight of each token id) for pooling in place; for
        models of a checked size. Rows come over as Arrow columns, and are kept with the model."""
        if self._table is None:
            vectors, vocab = self.vectors.select("row_id", "vec").toArrow(), self.vocab.select("token_id", "row_id", "weight").toArrow()
            rows, cells = vectors["row_id"].to_numpy(), vectors["vec"].combine_chunks()
            flat = (cells if isinstance(cells, pa.ListArray) else pa.concat_arrays(cells.chunks)).flatten().to_numpy().astype(np.float32)
            matrix = np.zeros((int(rows.max()) + 1 if len(rows) else 1, self.dimensions), np.float32)
            matrix[rows] = flat.reshape(len(rows), self.dimensions)
            ids = vocab["token_id"].to_numpy()
            row = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
            row[ids] = vocab["row_id"].to_numpy()
            weight = None
            if self.weighted:
                weight = np.ones(len(row))
                weight[ids] = vocab["weight"].to_numpy()
            self._table = matrix, row, weight
        return self._table

    def check(self) -> Model:
        missing = self.vocab.join(self.vectors, "row_id", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"token {missing[0]['token']!r} has no vector")
        return self


FILES = ("tokenizer.json", "model.safetensors")


def ensure_files(kind: str, fetch, root: str | None = None) -> str:
    """The folder of a kind's files, each of which ``fetch(kind, name)`` (an iterator of
    bytes) is asked for only if it is missing.

    A file appears under its name only once it is whole: it is written beside it under a
    name of its own, then renamed; a fetch that fails leaves nothing behind.
    """
    folder = model_dir(kind, root)
    os.makedirs(folder, exist_ok=True)
    for name in FILES:
        if os.path.exists(path := os.path.join(folder, name)):
            continue
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                for block in fetch(kind, name):
                    f.write(block)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, path)
        except BaseException:
            if os.path.exists(part):
                os.remove(part)
            raise
    return folder


def _read(spark: SparkSession, path: str):
    """A file's bytes: mapped if it is local, through Spark's readers in any other store."""
    if "://" not in path:
        if not os.path.exists(path):
            raise FileNotFoundError(f"model file {path} is missing")
        return np.memmap(path, np.uint8, "r")
    return spark.read.format("binaryFile").load(path).first()["content"]


def load_model(spark: SparkSession, path: str) -> Model:
    """Read ``tokenizer.json`` and ``model.safetensors`` below ``path`` into tables, by Arrow."""
    text, data = (_read(spark, f"{path}/{name}") for name in FILES)
    tokenizer, tensors = read_tokenizer(bytes(text).decode()), read_tensors(data)
    matrix, weights, mapping = tensors["embeddings"], tensors.get("weights"), tensors.get("mapping")
    by_id = sorted(tokenizer.vocab.items(), key=lambda x: x[1])
    for t, i in by_id:
        if mapping is not None and i >= len(mapping) or not 0 <= (row := int(mapping[i]) if mapping is not None else i) < len(matrix):
            raise ValueError(f"token {t!r} has no vector")
        if weights is not None and i >= len(weights):
            raise ValueError(f"token {t!r} has no weight")
    ids = np.array([i for _, i in by_id], np.int32)
    none = pa.nulls(len(ids), pa.float64())
    columns = {
        "token": pa.array([t for t, _ in by_id], pa.string()),
        "token_id": pa.array(ids),
        "score": pa.array([tokenizer.scores[i] for i in ids.tolist()], pa.float64()) if tokenizer.scores else none,
        "weight": none if weights is None else pa.array(np.asarray(weights)[ids]),
        "row_id": pa.array(ids if mapping is None else np.asarray(mapping)[ids].astype(np.int32)),
    }
    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))
    vectors = spark.createDataFrame(pa.table({"row_id": pa.array(np.arange(len(matrix), dtype=np.int32)), "vec": cells}), "row_id int, vec array<float>")
    row, weight = np.zeros(int(ids.max()) + 1, np.int64), None
    row[ids] = columns["row_id"].to_numpy()
    if weights is not None:
        weight = np.ones(len(row))
        weight[ids] = np.asarray(weights)[ids]
    return Model(tokenizer, spark.createDataFrame(pa.table(columns), VOCAB_SCHEMA), vectors, matrix.shape[1], weights is not None, _table=(matrix, row, weight))


#: Demo models by application, folder and kind: made of a folder's tables once, like a load.
_DEMOS: dict[tuple, Model] = {}


def demo_model(spark: SparkSession, sf_dir: str, weighted: bool = False, mapped: bool = False) -> Model:
    """The demo model of a folder, made once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, weighted, mapped)
    if key not in _DEMOS:
        _DEMOS[key] = make_demo_model(spark, sf_dir, weighted, mapped)
    return _DEMOS[key]


def make_demo_model(spark: SparkSession, sf_dir: str, weighted: bool = False, mapped: bool = False) -> Model:
    """Made of the test tables: it shows the mechanics, not the quality of embeddings.

    Token 0 is [UNK], then a to z, their continuations, and the most frequent words of
    ``documents`` by count and then alphabet, up to the number of rows of ``embeddings``.
    """
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = emb.count()
    flags = BertNormalizer()
    docs = flags.apply(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").repartition(spark.sparkContext.defaultParallelism), "text", "norm")
    letters = [chr(97 + i) for i in range(26)]
    words = docs.select(F.explode(pretokenize(F.col("norm"))).alias("w")).groupBy("w").count().where(~F.col("w").rlike("^[a-z]$"))
    top = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(n - 53).collect()]
    tokens = ["[UNK]", *letters, *[f"##{x}" for x in letters], *top]
    # the limit is the size of the demo vocabulary
    rows = [(t, i, None, 1.0 / (1 + i % 7) if weighted else None, (len(tokens) - 1 - i) if mapped else i) for i, t in enumerate(tokens)]
    vectors = emb.select(F.col("vec_id").cast("int").alias("row_id"), F.col("embedding").alias("vec"))
    return Model(Tokenizer("WordPiece", vocab={t: i for i, t in enumerate(tokens)}, unk_id=0, normalizer=flags), spark.createDataFrame(rows, VOCAB_SCHEMA), vectors, 64, weighted)
