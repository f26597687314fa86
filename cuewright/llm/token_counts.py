"""Token counts of whole texts, as a sentencepiece BPE model gives them.

A text of up to `step` code points is encoded in one call. A longer one is cut into
chunks that begin every `step` code points and reach `overlap` beyond the next one's
start, so that its chunks are encoded by many tasks. Two neighbours are spliced at a
token that both have at the same place in their overlap. That is proven to be right:
BPE applies merges by (score, place), so the merges inside a run of tokens are the
same alone as in the whole text as long as none crosses the run's borders, and tokens
are a text's encoding exactly if each is its own encoding and so are all pairs of
neighbours. Every pair of the spliced row stands in one of the two encodings: those
up to the common token in the left one, the others in the right one. It doesn't
matter that a chunk begins with a blank which the model puts before each text, nor
that its ends are cut anywhere.

Where an overlap has no common token, or the model changed a chunk's characters, the
text is cut again with steps and overlaps WIDER times as long, and at last in one
piece. Only places and counts of an overlap's tokens go between chunks.

A null text is empty and has no tokens. Rows are kept apart, with whatever ids, and
equal long texts are encoded once. Other columns are not read.
"""

from __future__ import annotations

import functools
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, slices, text_or_empty, tidy

MODEL = "piece_bpe_32k.model"
#: Code points from one chunk's start to the next one's, and those that both have.
STEP, OVERLAP = 1 << 14, 1 << 9
WIDER = 4
#: Tokens of a context of the usual size; `over_limit` says that a text has more.
LIMIT = 4096
#: A token's place is one number, its start shifted by so many bits, plus its length.
SHIFT = 16


@functools.lru_cache(maxsize=2)
def _model(name: str):
    """The processor of a model file, and the code points of each id; a name without a folder is a public tokenizer's.

    Bytes that stand for an unknown character count 1 at the first and 0 at the
    others. Models without them, or of another kind than BPE, are refused.
    """
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = name if os.path.dirname(name) else public_tokenizers.path(name)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.trainer_spec
    if spec.model_type != spec.BPE or not spec.byte_fallback:
        raise ValueError(f"{name} is no BPE model with bytes for unknown characters")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = lambda p: int(int(p[3:5], 16) & 0xC0 != 0x80)
    return sp, np.array([byte(p) if sp.is_byte(i) else len(p) for i, p in enumerate(map(sp.id_to_piece, range(len(sp))))], np.int64)


def places(model: str, text: str, start: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of ids of a chunk that begins at `start`; the places of its tokens in the text and the ids up to each one's end.

    The bytes of one character are one token here. There are no places if the model
    changed the text's characters.
    """
    sp, sizes = _model(model)
    ids = np.asarray(sp.encode(text), np.int64)
    size = sizes[ids]
    if int(size.sum()) != len(text) + bool(text):  # a blank comes first
        return len(ids), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero(np.append(size[1:] > 0, True)) if len(ids) else np.zeros(0, np.int64)
    ends = np.cumsum(size)[last] - 1 + start
    starts = np.concatenate([[start - 1], ends])[: len(ends)]
    return len(ids), (starts << SHIFT) + (ends - starts), last + 1


def _whole(docs: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """id, n_bytes, n_tokens of texts that are encoded in one call each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        sp, _ = _model(model)
        for b in batches:
            for part in slices(b, 1):
                n = [len(ids) for ids in sp.encode(part.column(1).to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def _chunks(texts: DataFrame, step: int, overlap: int) -> DataFrame:
    """key, i, text: the overlapping chunks of texts (key, text)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py()
                for i in range(max(1, -(-(len(text) - overlap) // step))):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([i], pa.int64()), pa.array([text[i * step : (i + 1) * step + overlap]])], ["key", "i", "text"])

    return texts.select("key", "text").mapInArrow(run, "key binary, i long, text string")


def _edges(chunks: DataFrame, model: str, step: int, overlap: int) -> DataFrame:
    """key, i, n (ids of the chunk), and the tokens of its overlaps with the chunk before and the one behind: left, left_ids, right, right_ids."""
    import pyarrow as pa

    names = ["left", "left_ids", "right", "right_ids"]

    def run(batches):
        for b in batches:
            out = []
            for i, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, at, ids = places(model, text, i * step)
                starts = at >> SHIFT
                ends = starts + (at & ((1 << SHIFT) - 1))
                left, right = (starts >= i * step) & (ends <= i * step + overlap), starts >= (i + 1) * step
                out.append((n, at[left], ids[left], at[right], ids[right]))
            n, *lists = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], ["key", "i", "n", *names])

    return chunks.repartition("key", "i").mapInArrow(run, "key binary, i long, n long, " + ", ".join(f"{x} array<long>" for x in names))


def _spliced(edges: DataFrame) -> DataFrame:
    """key, n_tokens of each text; null if two of its chunks have no common token in their overlap."""
    before = edges.select("key", (F.col("i") + 1).alias("i"), F.col("n").alias("before"), "right", "right_ids")
    joints = edges.where("i > 0").select("key", "i", "left", "left_ids").join(before, ["key", "i"])
    common = F.get(F.array_intersect("right", "left"), F.lit(0))
    up_to = lambda side: F.get(F.col(f"{side}_ids"), F.array_position(F.col(side), F.col("common")).cast("int") - 1)
    joints = joints.withColumn("common", common).select("key", F.col("common").isNull().alias("apart"), (F.col("before") - up_to("right") + up_to("left")).alias("twice"))
    twice = joints.groupBy("key").agg(F.sum("twice").alias("twice"), F.bool_or("apart").alias("apart"))
    rows = edges.groupBy("key").agg(F.sum("n").alias("n")).join(twice, "key", "left")
    return rows.select("key", F.when(~F.coalesce("apart", F.lit(False)), F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))


def spliced_counts(texts: DataFrame, *, model: str = MODEL, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """key, n_tokens of texts (key, text) with distinct keys, all by chunks; a chunk of the last round may be a whole text."""
    if not 0 < overlap < step:
        raise ValueError("an overlap has to be shorter than a step")
    found = []
    while True:
        edges = durable(_edges(_chunks(texts, step, overlap), model, step, overlap))
        counts = durable(_spliced(edges))
        discard(edges)
        found.append(counts.where("n_tokens is not null"))
        again = counts.where("n_tokens is null")
        if again.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        texts, step, overlap = texts.join(again.select("key"), "key", "left_semi"), step * WIDER, overlap * WIDER


@tidy
def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str = MODEL, limit: int = LIMIT, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: its id, n_bytes (UTF-8), n_tokens, over_limit."""
    length = F.coalesce(F.length(text_col), F.lit(0))
    rows = _whole(docs.where(length <= step), id_col, text_col, model)
    long = docs.where(length > step).select(F.col(id_col).alias("id"), F.octet_length(text_col).cast("long").alias("n_bytes"), F.unhex(F.sha2(text_col, 256)).alias("key"), F.col(text_col).alias("text"))
    texts = durable(long.select("key", "text").dropDuplicates(["key"]))
    if not texts.isEmpty():
        counts = spliced_counts(texts, model=model, step=step, overlap=overlap)
        rows = rows.unionByName(long.drop("text").join(counts, "key").drop("key"))
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
