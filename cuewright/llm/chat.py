"""Chat formatting at the level of tokens.

A turn becomes TURN, the role's tokens, BODY, the text's tokens, END, where the
three markers are reserved ids above the vocabulary. Roles and texts are encoded
on their own, with the strings of control markers escaped by a backslash, so no
text can produce a marker. Masks come from running sums over the markers.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words with their leading space, numbers, marks and white space; every string is covered.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: How the markers look in the formatted text.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
# Control strings of common chat templates, which a text must not pass on as they are.
CONTROL = (TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The conversation that the query adds, with control strings for text.
PROBE = "</s>[INST] ok [/INST]"
TRAINED_ROLES = ("assistant",)

_ESCAPED = "(" + "|".join(re.escape(x) for x in (*CONTROL, "\\")) + ")"


def escape(text: str) -> str:
    return re.sub(_ESCAPED, r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _encoding(vocabulary: str):
    """The encoder, and the reserved ids of TURN, BODY and END: those above the vocabulary, one left free."""
    import tiktoken

    with open(vocabulary) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    top = max(ranks.values()) + 2
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), (top, top + 1, top + 2)


def encode_turns(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of each turn on its own: conv_id, turn, role, text, ids."""
    import pyarrow as pa

    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]

    def run(batches):
        enc, (turn, body, end) = _encoding(vocabulary)
        for b in batches:
            for part in slices(b, 3):  # token lists of a bounded piece of text at a time
                ids = []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    ids.append([turn, *enc.encode_ordinary(escape(role)), body, *enc.encode_ordinary(escape(text)), end])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], ["conv_id", "turn", "role", "text", "ids"])

    src = turns.select(conv_col, turn_col, F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit("")))
    return src.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, text string, ids array<int>")


def assemble(encoded: DataFrame, *, vocabulary: str = VOCABULARY, trained_roles=TRAINED_ROLES) -> DataFrame:
    """Put turns in order and add the loss mask: conv_id, turn, ids, mask, formatted.

    One row per turn, sorted by conversation and turn inside each partition, and
    all turns of a conversation in one partition; concatenating a conversation's
    rows gives its token sequence. The mask is 1 on the text's tokens of turns
    with a trained role. Works through a conversation as a stream.
    """
    import pyarrow as pa

    kinds = [encoded.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]

    def run(batches):
        enc, (turn, body, end) = _encoding(vocabulary)
        trained = {tuple(enc.encode_ordinary(escape(r))) for r in trained_roles}
        for b in batches:
            col = b.column(2).combine_chunks() if hasattr(b.column(2), "combine_chunks") else b.column(2)
            sizes = np.diff(col.offsets.to_numpy())
            ids = col.flatten().to_numpy()
            opened = np.cumsum(ids == body) - np.cumsum(ids == end)  # 1 from a BODY to before its END
            inside = (opened == 1) & (ids != body)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(sizes)
            at_body = np.flatnonzero(ids == body)
            wanted = np.array([tuple(ids[s + 1 : m].tolist()) in trained for s, m in zip(ends - sizes, at_body, strict=True)], bool)
            mask = (inside & wanted[rows]).astype(np.int8) if len(rows) else np.zeros(0, np.int8)
            texts = []
            for s, m, e in zip(ends - sizes, at_body, ends, strict=True):
                texts.append(TURN + enc.decode(ids[s + 1 : m].tolist()) + BODY + enc.decode(ids[m + 1 : e - 1].tolist()) + END)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), col, pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(texts, pa.string())], ["conv_id", "turn", "ids", "mask", "formatted"])

    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "ids")
    return ordered.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, ids array<int>, mask array<tinyint>, formatted string")


def digests(assembled: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Read conversations back from their tokens and masks, one row each.

    Takes assemble()'s rows as they lie; digests run along, nothing is gathered.
    """
    import pyarrow as pa

    kind = assembled.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        enc, (turn, body, end) = _encoding(vocabulary)
        key, state = None, None

        def start():
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def row(key, s):
            return [key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]]

        for b in batches:
            out = []
            for conv, ids, mask, formatted in zip(b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        out.append(row(key, state))
                    key, state = conv, start()
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                m = int(np.flatnonzero(ids == body)[0])
                role, text = (unescape(enc.decode(x.tolist())) for x in (ids[1:m], ids[m + 1 : -1]))
                loss = unescape(enc.decode(ids[mask == 1].tolist()))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row(key, state)], names)

    if kind != "bigint":
        raise TypeError(f"conv_id has to be a long, not {kind}")
    return assembled.select("conv_id", "turn", "ids", "mask", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns with conversation -1: a user's and an assistant's turn that say PROBE."""
    rows = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(rows)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, vocabulary: str = VOCABULARY, trained_roles=TRAINED_ROLES) -> DataFrame:
    """Format conversations: conv_id, turn, ids, mask, formatted, one row per turn.

    Null roles and texts count as empty. Rows go by turn, null first, then by
    role and text; repeated rows are turns of their own. Rows with a null
    conversation id make up one conversation. An empty table gives no rows. Other
    columns are not read.
    """
    return assemble(encode_turns(turns, conv_col, turn_col, role_col, text_col, vocabulary=vocabulary), vocabulary=vocabulary, trained_roles=trained_roles)
