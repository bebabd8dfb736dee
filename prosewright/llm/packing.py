"""Vector bin packing of examples into training sequences.

Every item has a size in several dimensions: tokens, segments (one each) and
loss-bearing tokens. Each sequence has a limit in each dimension. The
dot-product heuristic fills one sequence at a time: of the pooled items that
fit, take the one whose size has the largest dot product with what is left,
both in units of the limits, so an item is preferred that uses up what is
plentiful. With ``cut`` the item that no longer fits whole is divided, and the
sequence is filled to the last token.

Work is local to a partition: items stream through a pool of bounded size, so
memory does not grow with the input, nothing is shuffled, and a lost task is
done again with the same result. The sequence id carries the partition's
number in its upper bits.

Defined results: a null text counts as empty (one separator); a null
``loss`` value counts as none; an item that is larger than a limit is cut
(``cut``) or gets a sequence of its own (otherwise, so no row is lost);
repeated rows and ids are packed as often as they occur; other columns are not
read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words a worker keeps with their ids; beyond that it starts anew.
WORDS_KEPT = 1_000_000
#: Sequence ids of one partition.
SEQUENCES = 1 << 40


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. ``pool``: open items a task looks at."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    pool: int = 256


class Encoder:
    """Ids of a byte-level BPE vocabulary, equal to the library's own for every text.

    Its pre-tokenizer cuts at each space or line feed that stands alone between
    other characters, and what it makes of ``" word"`` depends on nothing
    around it. So texts whose only white space is single spaces and line feeds
    are encoded word by word from a table; all others go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._full = Tokenizer.from_file(path)
        self._full.encode_special_tokens = True  # their strings in a text are ordinary text
        self._spaced: dict[str, bytes] = {}  # words that a space precedes
        self._bare: dict[str, bytes] = {}
        self.whole, self._piece = _rank_encoder(path) or (self.library, self.library)
        self._line_feed = self.library("\n")
        self._stops = {c: self.library(c) for c in ".,!?"}

    def library(self, text: str) -> bytes:
        return np.array(self._full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, table: dict[str, bytes], prefix: str, word: str) -> bytes:
        if word.isalpha():
            ids = self._piece(prefix + word)
        elif word[-1] in self._stops and word[:-1].isalpha():
            ids = self._piece(prefix + word[:-1]) + self._stops[word[-1]]
        elif word.split() != [word]:
            raise ValueError("other white space")
        else:
            ids = self.whole(prefix + word)
        if len(table) >= WORDS_KEPT:
            table.clear()
        if len(word) < 64:
            table[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        spaced, parts = self._spaced, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                if "" in words:
                    return self.whole(text)
                first = words.pop(0)
                if parts:
                    parts.append(self._line_feed)
                parts.append(self._bare.get(first) or self._learn(self._bare, "", first))
                ids = list(map(spaced.get, words))
                if None in ids:
                    ids = [i or spaced.get(w) or self._learn(spaced, " ", w) for i, w in zip(ids, words, strict=True)]
                parts += ids
        except ValueError:
            return self.whole(text)
        return b"".join(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _rank_encoder(path: str) -> tuple[Callable[[str], bytes], Callable[[str], bytes]] | None:
    """Faster encoders of the same vocabulary, for a text and for one pre-token, where its rank file lies beside ``path``."""
    import base64
    import os
    from array import array

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path) or array("I").itemsize != 4 or array("I", [1]).tobytes()[0] != 1:
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (
        lambda text: array("I", own.encode_ordinary(text)).tobytes(),
        lambda piece: array("I", own._core_bpe.encode_single_piece(piece.encode())).tobytes(),
    )


@dataclass(slots=True)
class Item:
    key: object
    start: int
    tokens: int
    loss: int
    data: object = None


def pack(items: Iterator[Item], limits: Limits, cut: bool) -> Iterator[tuple[int, int, Item]]:
    """(sequence, offset, item) for every item, or for every piece of it with ``cut``.

    With ``cut``, loss-bearing tokens are taken to be all or none of an item's
    tokens, or its last ones: a piece carries those that lie in it. At the end
    the rest is laid out in sequences of powers of two if ``cut``.
    """
    pool: list[Item] = []
    sizes = np.zeros((limits.pool, 3))
    unit = np.array([limits.tokens, 1.0 * limits.segments, limits.loss])
    items, sequence, more = iter(items), 0, True

    def fill() -> bool:
        """Fills the pool; whether there may be more items."""
        while len(pool) < limits.pool:
            item = next(items, None)
            if item is None:
                return False
            sizes[len(pool)] = (item.tokens, 1, item.loss)
            pool.append(item)
        return True

    while True:
        more = more and fill()
        if not pool:
            return
        left, offset = unit.copy(), 0
        room = limits.tokens
        if cut and not more and (rest := int(sizes[: len(pool), 0].sum())) < room:
            room = 1 << (rest.bit_length() - 1)
            left[0] = room
        while pool and left[0] >= 1 and left[1] >= 1:
            own = sizes[: len(pool)]
            fits = (own <= left).all(axis=1)
            value = np.where(fits, (own / unit) @ (left / unit), -1.0)
            k = int(value.argmax())
            if fits[k]:
                item = _take(pool, sizes, k)
            elif not cut and offset == 0:
                item = _take(pool, sizes, 0)  # larger than a limit: alone
                left[:] = 0
            elif cut and (k := _divisible(own, left)) is not None:
                item = _split(pool, sizes, k, left)
            else:
                break
            yield sequence, offset, item
            left -= (item.tokens, 1, item.loss)
            offset += item.tokens
            if more and len(pool) < limits.pool // 2:
                more = fill()  # a sequence of small items takes more of them than the pool holds
                whole = offset + int(sizes[: len(pool), 0].sum())
                if cut and not more and whole < room and (power := 1 << (whole.bit_length() - 1)) >= offset:
                    left[0] = power - offset
        sequence += 1


def _take(pool: list[Item], sizes: np.ndarray, k: int) -> Item:
    item, last = pool[k], pool.pop()
    if last is not item:
        pool[k] = last
        sizes[k] = sizes[len(pool)]
    return item


def _divisible(own: np.ndarray, left: np.ndarray) -> int | None:
    """The item with the most tokens of which at least one fits."""
    ok = (own[:, 2] == 0) | (left[2] >= 1) | (own[:, 0] > own[:, 2])
    return int(np.where(ok, own[:, 0], -1).argmax()) if ok.any() else None


def _split(pool: list[Item], sizes: np.ndarray, k: int, left: np.ndarray) -> Item:
    item = pool[k]
    n = int(min(left[0], item.tokens))
    quiet = item.tokens - item.loss  # tokens before the loss-bearing ones
    n = int(min(n, quiet + left[2]))
    head_loss = max(0, n - quiet)
    head = Item(item.key, item.start, n, head_loss, item.data)
    if n == item.tokens:
        return _take(pool, sizes, k)
    pool[k] = Item(item.key, item.start + n, item.tokens - n, item.loss - head_loss, item.data)
    sizes[k] = (item.tokens - n, 1, item.loss - head_loss)
    return head


def _pieces_schema() -> str:
    return "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    limits: Limits | None = None,
    separator: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize whole documents, end each with ``separator``, cut and pack them.

    One row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``ids_crc32`` of its ids (little-endian, 32 bits each),
    ``doc_tokens`` (with the separator), ``sequence_id``, ``offset``. A
    document of more than one sequence is first cut into whole sequences; the
    rests are packed. Without ``limits`` those of ``DOCUMENTS`` hold.
    """
    limits = limits or DOCUMENTS
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * SEQUENCES
        encode, whole, out = encoder(tokenizer), [], deque()

        def items() -> Iterator[Item]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for key, text in zip(ids, texts, strict=True):
                    data = encode(text.as_py() or "") + end
                    n, start = len(data) // 4, 0
                    while limits.loss >= limits.tokens and n - start > limits.tokens:
                        whole.append((key, start, limits.tokens, crc32(data[start * 4 : (start + limits.tokens) * 4]), n))
                        start += limits.tokens
                    yield Item(key, start, n - start, n - start, data)

        packed, n_whole, names = pack(items(), limits, cut=True), 0, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        # even numbers for sequences that one document fills, odd ones for packed sequences
        for sequence, offset, p in packed:
            piece = p.data[p.start * 4 : (p.start + p.tokens) * 4]
            out.append((p.key, p.start, p.tokens, crc32(piece), len(p.data) // 4, base + 2 * sequence + 1, offset))
            for row in whole:
                out.append((*row, base + 2 * n_whole, 0))
                n_whole += 1
            whole.clear()
            if len(out) >= 20_000:
                yield batch_of(list(out))
                out.clear()
        if out:
            yield batch_of(list(out))

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, _pieces_schema())


def pack_examples(
    examples: DataFrame,
    limits: Limits = Limits(),
    id_col: str = "id",
    tokens_col: str = "tokens",
    loss_col: str = "loss_tokens",
) -> DataFrame:
    """Instruction examples, each kept whole: ``id``, ``tokens``, ``loss_tokens``, ``sequence_id``, ``offset``.

    All three limits hold in every sequence, save that an example which is
    itself above a limit stands alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * SEQUENCES

        def items() -> Iterator[Item]:
            for batch in batches:
                for key, tokens, loss in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    yield Item(key, 0, tokens or 0, loss or 0)

        out = []
        for sequence, offset, p in pack(items(), limits, cut=False):
            out.append((p.key, p.tokens, p.loss, base + sequence, offset))
            if len(out) >= 20_000:
                yield _examples_batch(out)
                out = []
        if out:
            yield _examples_batch(out)

    plain = examples.select(F.col(id_col).cast("long").alias("id"), F.col(tokens_col).cast("long").alias("tokens"), F.col(loss_col).cast("long").alias("loss_tokens"))
    return plain.mapInArrow(run, "id long, tokens long, loss_tokens long, sequence_id long, `offset` long")


def conversation_sizes(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", bearing: str = "assistant") -> DataFrame:
    """One row per conversation: ``id``, ``tokens`` (each turn ends with a separator) and ``loss_tokens``, those of the turns of role ``bearing``.

    Turns are counted where they lie and added up by a partial aggregate: a conversation of any length is one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            counts = [len(encode(t.as_py() or "")) // 4 + 1 for t in batch.column(2)]
            loss = [n if r == bearing else 0 for n, r in zip(counts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(loss, pa.int64())], names=["id", "tokens", "loss_tokens"])

    plain = turns.select(F.col(id_col).cast("long").alias("id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    sizes = plain.mapInArrow(run, "id long, tokens long, loss_tokens long")
    return sizes.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))


def _examples_batch(rows: list) -> pa.RecordBatch:
    names = ["id", "tokens", "loss_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


#: Of instruction examples: sequences as for documents, few examples in one, and at most half of it to be learned.
EXAMPLES = Limits(tokens=1024, segments=12, loss=512)
#: Of documents: every token is learned, and a sequence may hold as many as it has tokens.
DOCUMENTS = Limits(tokens=1024, segments=1024, loss=1024)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all documents: sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each whole, under limits on tokens, examples and tokens of the assistant's turns."""
    sizes = conversation_sizes(spark.read.parquet(f"{sf_dir}/conversations.parquet"), vocabulary_path())
    return pack_examples(sizes, EXAMPLES)
