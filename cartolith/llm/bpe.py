"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding by the byte table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import documents_of, worker_cache

MEMORY = 200_000   # pieces a worker remembers; more are encoded again


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library; pattern cuts a text into pieces that are encoded one by one."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True   # their names in a text are ordinary text
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)   # pieces come cut
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        table = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        size = max(vocabulary.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(table[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers. Equal pieces of a batch are encoded once."""
        for text in texts:
            pieces = self.cut(text)
            new = list(set(pieces).difference(self.known))
            if new:
                if len(self.known) > MEMORY:
                    self.known.clear()
                    new = list(set(pieces))
                for piece, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)):
                    self.known[piece] = np.array(e.ids, "<u4").tobytes()
            yield np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind the ids; a character whose bytes are spread over several tokens comes back whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def ends(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each token ends in the UTF-8 bytes and in the characters of its text. A character counts as reached once its first byte is."""
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        begun = np.cumsum((raw & 0xC0) != 0x80)
        return ends, begun[ends - 1] if len(ends) else ends


def codec(path: str, pattern: str) -> Codec:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
    made = worker_cache().setdefault("codecs", {})
    if (path, pattern, MEMORY) not in made:
        made[path, pattern, MEMORY] = Codec(path, pattern)
    return made[path, pattern, MEMORY]


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>; with offsets also byte_ends and char_ends, where each token ends.

    Whole texts; null counts as empty and has no tokens. Repeated rows are encoded row by row; other columns are not read."""
    schema = "doc_id long, ids array<int>" + ", byte_ends array<long>, char_ends array<long>" * offsets

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                ids = list(c.encode(texts))
                columns = [part.column(0), lists(ids, pa.int32())]
                if offsets:
                    ends = [c.ends(i, t) for i, t in zip(ids, texts)]
                    columns += [lists([e[k] for e in ends], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "byte_ends", "char_ends"][: len(columns)])

    return documents_of(docs, doc_id, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, data binary: the bytes behind the ids (null ids: empty)."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = [c.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit numbers), decoded_sha256 (the decoded bytes).

    Encoded and decoded in one pass, so the ids of a long text never cross to Spark."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                n, a, b = [], [], []
                for ids in c.encode(part.column(1).to_pylist()):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def counts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                n = [len(ids) for ids in c.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents_of(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that Python objects of long texts don't pile up."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def default_files() -> tuple[str, str]:
    """The public 50k byte-level vocabulary for the tokenizers library, and its pattern."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def ranks_agree(path: str, ranks: str) -> bool:
    """Whether the vocabulary file and a rank file name the same bytes for the same ids."""
    import base64
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table = {c: b for b, c in enumerate(byte_letters())}
    with open(ranks, "rb") as f:
        return {bytes(table[c] for c in t): i for t, i in vocabulary.items()} == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
