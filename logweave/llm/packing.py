"""Packing of tokenised documents into sequences of a fixed length.

A document's ids and one end id are cut into full sequences; the rest, shorter
than a sequence, is packed with the rests of other documents by first-fit
decreasing: the longest first, each into the first sequence that still has
room. The first such sequence is found with a tournament tree over the free
space of all sequences (a node holds the greater of its two children), in
logarithmic time. Documents are dealt into random groups of bounded expected
size and every group is packed on its own, so no task sees more than a group.

First-fit decreasing leaves few gaps; these are closed by cutting the pieces of
a group's emptiest sequences. What then remains of a group is less than one
sequence; it is laid out in sequences whose lengths are powers of two, which
need no padding.

Texts are tokenised once, in `mapInArrow`; the rests' ids travel to their group
in the shuffle, full sequences stay where they are. The vocabulary file is read
on the driver and broadcast (its size is a constant of the tokenizer). Texts
are encoded piece by piece, so a very long one needs memory for one piece and
its ids.

Defined cases: a null or empty text is the end id alone; repeated rows and rows
without an id are documents of their own; an empty table gives an empty result.
Which sequence a document comes to depends on how the input is split into
tasks. Only doc_id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Scratch

#: Fixed value: how byte-level tokenizers cut text before they merge bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longer texts are encoded in pieces of about this many code points.
PIECE_CHARS = 1 << 20

#: A place where no token of a byte-level tokenizer can begin earlier and end later.
_BETWEEN_WORDS = re.compile(r"(?<=\w) (?=\w)")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable
    Latin-1 characters stand for themselves, the others for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked_bytes(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level vocabulary whose merges come in the
    order of their ids; None for any other tokenizer."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    added = spec.get("added_tokens") or []
    if model.get("type") != "BPE" or not plain or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    letters = _byte_letters()
    if None in ids or ids != sorted(set(ids)) or any(not set(w) <= set(letters) for w in model["vocab"]):
        return None
    return {bytes(letters[c] for c in w): i for w, i in model["vocab"].items()}


def encoder(tokenizer: bytes) -> Callable[[str], np.ndarray]:
    """text -> ids of the tokenizer file, without added special tokens.

    A plain byte-level vocabulary is run by the faster of the two libraries
    that read it, which gives the same ids; texts that it refuses, and every
    other tokenizer, take the tokenizer file itself.
    """
    import tiktoken                     # where texts are encoded, not on the driver
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer)
    whole = Tokenizer.from_str(tokenizer.decode())
    ranks = _ranked_bytes(spec)

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return slow
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    fast = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            found = fast.encode(text, allowed_special="all")
        except ValueError:       # runs of spaces beyond the limit of its pattern engine
            return slow(text)
        return np.array(found, np.uint32)

    def pieces(text: str) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > PIECE_CHARS and (m := _BETWEEN_WORDS.search(text, at + PIECE_CHARS)):
            out.append(ids(text[at:m.start()]))
            at = m.start()
        return np.concatenate([*out, ids(text[at:])])

    return pieces


class FreeSpace:
    """Tournament tree over the free space of up to `bins` bins."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """The first bin with room for `length`, which it then takes."""
        tree, node = self.tree, 1
        if tree[1] < length:
            raise ValueError("no bin has room")
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        tree[node] -= length
        found = node - self.size
        while node > 1:
            node >>= 1
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (places in `lengths`) of every bin, longest items first."""
    free, bins = FreeSpace(len(lengths), capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = free.place(lengths[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


Span = tuple[int, int, int]     # item, first id, number of ids


def without_gaps(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[Span]]:
    """The bins as lists of spans, none with a gap: the emptiest bins are cut
    to fill the others, and what remains becomes bins whose sizes are powers
    of two."""
    spans = [[(i, 0, lengths[i]) for i in b] for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    out = [s for s, f in zip(spans, fill) if f == capacity]
    part = sorted((b for b, f in enumerate(fill) if f < capacity), key=lambda b: (-fill[b], b))
    whole, rest = divmod(sum(fill[b] for b in part), capacity)
    stock = [s for b in reversed(part[whole:]) for s in spans[b]]

    def take(n: int) -> list[Span]:
        got = []
        while n:
            item, first, size = stock.pop()
            if size > n:
                stock.append((item, first + n, size - n))
                size = n
            got.append((item, first, size))
            n -= size
        return got

    out += [spans[b] + take(capacity - fill[b]) for b in part[:whole]]
    return out + [take(1 << k) for k in reversed(range(rest.bit_length())) if rest >> k & 1]


#: Columns of a piece, without the document's id.
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def _tokenised(docs: DataFrame, tokenizer: bytes, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Pieces of every document: full sequences, with their number, and the
    rest, with its ids and a number of its own in place of a sequence's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            owner, cols = [], [[] for _ in _NAMES]
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start:start + length].tobytes()
                    whole = len(piece) == 4 * length
                    owner.append(row)
                    for col, v in zip(cols, (start, len(piece) // 4, zlib.crc32(piece), len(ids), 2 * number + 1, 0 if whole else None,
                                             None if whole and not keep_ids else piece)):
                        col.append(v)
                    number += 1
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *_NAMES])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {PIECE}")


def pack(docs: DataFrame, tokenizer: bytes, length: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 7,
         keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])
    of every piece of the documents in `docs` (doc_id, text).

    A piece is ids start .. start + length - 1 of its document, at `offset` of
    its sequence; `ids` has them as unsigned 32-bit little-endian integers,
    ids_crc32 is their checksum. Every sequence has `length` ids or a power of
    two. About `group_docs` documents are packed together.
    """
    if length < 1 or group_docs < 1:
        raise ValueError("length and group_docs must be positive")
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(_tokenised(docs, tokenizer, length, end_id, keep_ids), "pieces")
    rests = pieces.where("offset IS NULL")
    groups = max(1, -(-rests.count() // group_docs))

    def run(rows: pa.Table) -> pa.Table:
        # the order of arrival differs from run to run
        rows = rows.sort_by([("sequence_id", "ascending")])
        lengths, blobs = rows.column("length").to_pylist(), rows.column("ids").to_pylist()
        bins = without_gaps(first_fit_decreasing(lengths, length), lengths, length)
        base = rows.column("grp")[0].as_py() << 32
        item, at, size, crc, seq, offset, kept = [], [], [], [], [], [], []
        for k, spans in enumerate(bins):
            place = 0
            for i, first, n in spans:
                piece = blobs[i][4 * first:4 * (first + n)]
                for col, v in zip((item, at, size, crc, seq, offset, kept),
                                  (i, first, n, zlib.crc32(piece), 2 * (base + k), place, piece if keep_ids else None)):
                    col.append(v)
                place += n
        own = rows.take(pa.array(item, pa.int64()))
        start = np.array(at, np.int64) + own.column("start").to_numpy()
        return pa.table([own.column("doc_id"), pa.array(start), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), own.column("doc_tokens"),
                         pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", *_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = rests.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "sequence_id"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(run, f"doc_id {kind}, {PIECE}")
    out = pieces.where("offset IS NOT NULL").unionByName(packed)
    return out if keep_ids else out.drop("ids")
