"""Packing: vector bin packing of token pieces into sequences by the dot-product heuristic.

Every piece asks for three resources at once: tokens, one segment, and loss-bearing tokens. A sequence offers
max_tokens, max_segments and max_loss. The next piece placed is the one that fits and whose demand vector has the
largest dot product with what the sequence still offers, both scaled by the limits. When nothing fits, the piece with
the largest product is cut to fill the sequence exactly, so sequences are padded only at the end of a task.

Packing is a map: each task tokenizes its rows and packs them with bounded memory (a pool of `pool` pieces), so there
is no shuffle at any size, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import kept_by_worker, table

SCHEMA = "doc_id long, start long, length long, loss_tokens long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Cached words in a worker; a bound on its memory, without any effect on the ids.
CACHE = 150_000


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers, by the byte-level BPE vocabulary at path.

    Special tokens' strings in a text are ordinary text. Text is split before single spaces that follow no white space
    and precede none: no pre-token crosses such a place, so the pieces between can be looked up in a cache.
    """
    import re

    import public_tokenizers
    import tiktoken

    from_file = json.load(open(path, encoding="utf-8"))
    special = {x["id"] for x in from_file.get("added_tokens", ())}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(to_byte[c] for c in word): i for word, i in from_file["model"]["vocab"].items() if i not in special}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    raw = lambda text: np.array(bpe(text), "<u4").tobytes()
    unsafe = re.compile(r" \s").search

    class Words(dict):
        def __missing__(self, word):
            if len(self) >= CACHE:
                self.clear()
            self[word] = out = raw(" " + word)
            return out

    words = Words()

    def encode(text: str) -> bytes:
        if unsafe(text):
            return raw(text)
        first, *parts = text.split(" ")
        return raw(first) + b"".join([words[x] for x in parts])

    return encode


def worker_encoder(path: str) -> Callable[[str], bytes]:
    """encoder(path), kept by the Python worker for its later tasks."""
    return kept_by_worker(path, lambda: encoder(path))


class Packer:
    """Packs pieces one task at a time. Pieces come as (document, first id, ids, loss-bearing ids at their end)."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int, first_sequence: int):
        self.limit = np.array([max_tokens, 1, max_loss], float) / [1, 1 / max_segments, 1]
        self.max_tokens, self.max_segments, self.max_loss, self.pool = max_tokens, max_segments, max_loss, pool
        self.sequence, self.items, self.out = first_sequence, [], []

    def add(self, doc, n: int, no_loss: int) -> None:
        """A document of n ids of which the first no_loss bear no loss. Pieces that fill a sequence alone are emitted at once."""
        start = 0
        while start < n:
            quiet = max(0, no_loss - start)
            length = min(n - start, self.max_tokens, quiet + self.max_loss)
            loss = max(0, length - quiet)
            if length == self.max_tokens or loss == self.max_loss:
                self.emit([(doc, start, length, loss)])
            else:
                self.items.append((doc, start, length, loss))
            start += length
        if len(self.items) >= self.pool:
            self.pack(self.pool // 2)

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, length, loss in pieces:
            self.out.append((doc, start, length, loss, self.sequence, offset))
            offset += length
        self.sequence += 1

    def pack(self, leave: int) -> None:
        """Fill sequences until at most `leave` pieces are left, or too few to fill one."""
        size = np.array([(x[2], 1, x[3]) for x in self.items], float).reshape(-1, 3)
        live = np.ones(len(self.items), bool)
        n_live, tokens = len(self.items), size[:, 0].sum()
        scaled = size / self.limit
        while n_live > leave and tokens >= self.max_tokens:
            room, chosen = self.limit.copy(), []
            while room.min() > 0 and n_live:
                worth = scaled @ (room / self.limit)
                fits = live & (size <= room).all(1)
                if fits.any():
                    i = int(np.where(fits, worth, -1).argmax())
                    piece = self.items[i]
                    live[i] = False
                    n_live -= 1
                else:
                    i = int(np.where(live, worth, -1).argmax())
                    doc, start, length, loss = self.items[i]
                    quiet = length - loss
                    cut = int(min(room[0], quiet + room[2]))
                    piece = (doc, start, cut, max(0, cut - quiet))
                    self.items[i] = (doc, start + cut, length - cut, loss - piece[3])
                    size[i] = self.items[i][2], 1, self.items[i][3]
                    scaled[i] = size[i] / self.limit
                chosen.append(piece)
                room -= (piece[2], 1, piece[3])
                tokens -= piece[2]
            self.emit(chosen)
        self.items = [x for x, keep in zip(self.items, live) if keep]

    def finish(self) -> None:
        """Pack what is left. The last, partly filled sequences are cut at powers of two, where no padding is needed."""
        self.pack(0)
        while self.items:
            have, segments, loss, used = 0, 0, 0, []
            for i, (doc, start, length, bears) in enumerate(self.items):
                take = min(length, self.max_tokens - have, length - bears + self.max_loss - loss)
                if segments == self.max_segments or take <= 0:
                    break
                used.append((i, take))
                have, segments, loss = have + take, segments + 1, loss + max(0, take - (length - bears))
            have, pieces, rest = 1 << (have.bit_length() - 1), [], []
            for i, take in used:
                doc, start, length, bears = self.items[i]
                take = min(take, have)
                have -= take
                bear = max(0, take - (length - bears))
                if take:
                    pieces.append((doc, start, take, bear))
                if take < length:
                    rest.append((doc, start + take, length - take, bears - bear))
            self.items = rest + self.items[len(used):]
            self.emit(pieces)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, text: str = "text", prompt: str | None = None, end_id: int = 0,
    max_tokens: int = 1024, max_segments: int = 64, max_loss: int | None = None, pool: int = 512,
) -> DataFrame:
    """One row per piece: doc_id, start, length, loss_tokens, doc_tokens, sequence_id, offset, ids (u32, little-endian).

    docs: doc_id and the text column; with `prompt`, that column's tokens come first and bear no loss. tokenizer: path
    of a byte-level BPE vocabulary. A document's ids are its text's and then end_id. Null or empty text is a document
    of end_id alone; a null doc_id is kept as null; repeated rows are packed as often as they come; other columns are
    ignored; an empty table gives no rows. Documents of any length are cut into pieces, each id lying in just one.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss, pool)
    end = np.array([end_id], "<u4").tobytes()
    columns = ["doc_id", F.col(text).alias("text"), (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(tokenizer)
        packer = Packer(*limits, TaskContext.get().partitionId() << 33)
        held: dict[int, tuple] = {}  # documents with pieces still in the pool
        serial = 0

        def rows() -> pa.RecordBatch:
            done, packer.out = packer.out, []
            cols = {k: [] for k in ("doc_id", "start", "length", "loss_tokens", "doc_tokens", "sequence_id", "offset", "ids")}
            for key, start, length, loss, sequence, offset in done:
                doc_id, ids = held[key]
                for k, v in zip(cols, (doc_id, start, length, loss, len(ids) // 4, sequence, offset, ids[4 * start: 4 * (start + length)])):
                    cols[k].append(v)
            needed = {x[0] for x in packer.items}
            for key in [k for k in held if k not in needed]:
                del held[key]
            kinds = [pa.binary() if k == "ids" else pa.int64() for k in cols]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], list(cols))

        for batch in batches:
            for doc_id, body, ask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                head = encode(ask) if ask else b""
                held[serial] = doc_id, ids = doc_id, head + encode(body or "") + end
                packer.add(serial, len(ids) // 4, len(head) // 4)
                serial += 1
                if len(packer.out) >= 2000:
                    yield rows()
        packer.finish()
        yield rows()

    return docs.select(*columns).mapInArrow(pack, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents, a row for each piece."""
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
