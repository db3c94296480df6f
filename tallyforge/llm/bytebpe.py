"""Byte-level BPE encoding and decoding, by monoid tree reduction.

A piece (a match of the splitting pattern) is halved down to a few bytes; the parts' tokens are joined up the tree. To join
two neighbours, a window of tokens around their boundary is encoded anew from its bytes; it grows on the side where it
doesn't fit the tokens outside, and is the whole piece at most. Joining is associative and an empty text its unit, so a text
may be cut anywhere within a piece and put together in any order (``Codec.joined``).

When the tokens outside are proven: call neighbours (a, b) stable if the bytes of a and b encode to just (a, b). Tokens of
which all neighbours are stable are the encoding of their bytes. For take the first merge over any of their boundaries, say
that of a and b. All merges before it were within tokens, and those within a and b came in the order in which they come
when a and b are encoded alone, since the lowest rank, leftmost, of all is the lowest rank, leftmost, of any part that it
is in. So this merge would be made there too, and (a, b) wouldn't be stable. Neighbours within an encoding are stable for the
same reason; so only those at the window's two edges are looked at.

Decoding concatenates the tokens' bytes up a tree of halves.

Defined results: a null or empty text has no tokens and decodes to nothing; repeated rows are encoded apart; control strings
in a text are ordinary text; an empty table gives an empty result; extra columns stay, and one that is named like an output
gives way to it. A task holds a batch of 256 texts at most and bounded caches; the tokens of a text are four bytes each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import ROWS_AT_ONCE, quoted, table, with_outputs

#: Parts of so many bytes aren't halved.
LEAF = 5
#: Up to so many bytes are merged by looking at all neighbours each time.
FEW = 16
#: What a cache keeps at most, and the longest piece in it in characters.
MOST_KEPT, LONGEST_KEPT = 250_000, 64


class Kept(dict):
    """Values of ``make`` by key. A full cache becomes the old one, of which what is still asked for comes over."""

    def __init__(self, make: Callable, keeps: Callable[..., bool] = lambda key: True):
        super().__init__()
        self.make, self.keeps, self.old = make, keeps, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if self.keeps(key):
            if len(self) >= MOST_KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Codec:
    """Ranks of tokens by their bytes, and a pattern whose matches are encoded each for itself."""

    _own: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.beyond = max(ranks.values()) + 1
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known = Kept(lambda piece: tuple(self.piece(piece.encode("utf-8"))), lambda piece: len(piece) <= LONGEST_KEPT)
        self.leaves = Kept(self.merged)
        #: The encoding of the bytes of a and b; they are stable if it is a and b.
        self.pairs = Kept(lambda pair: self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]))

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """The codec of a file with a token in base64 and its rank on each line; read once in a process."""
        if (path, pattern) not in cls._own:
            with open(path, "rb") as f:
                cls._own[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
        return cls._own[path, pattern]

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by merges: of all neighbours that are a token together the one of lowest rank, leftmost, again and
        again. Takes n log n steps at most."""
        n, ranks = len(piece), self.ranks
        if n <= FEW:
            parts, none = [piece[i : i + 1] for i in range(n)], self.beyond
            while len(parts) > 1:
                found = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
                if (least := min(found)) == none:
                    break
                k = found.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            return [ranks[p] for p in parts]
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each byte
        heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if stop[i] != middle or stop[middle] != end:
                continue
            stop[i], stop[middle] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, stop[end]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heapq.heappush(heap, (r, j, i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left + right
        i, j, window = 1, 1, self.pairs[left[-1], right[0]]  # i and j tokens on either side are in the window
        if len(window) == 2 and window[0] == left[-1] and window[1] == right[0]:
            return left + right
        while True:
            fits_left = i == len(left) or self.pairs[left[-i - 1], window[0]] == [left[-i - 1], window[0]]
            fits_right = j == len(right) or self.pairs[window[-1], right[j]] == [window[-1], right[j]]
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if fits_left else min(2 * i, len(left))
            j = j if fits_right else min(2 * j, len(right))
            window = self.merged(self.decode(left[len(left) - i :] + right[:j]))

    def piece(self, piece: bytes) -> list[int]:
        """The encoding of a piece by its halves."""
        if len(piece) <= LEAF:
            return self.leaves[piece]
        half = len(piece) // 2
        return self.joined(self.piece(piece[:half]), self.piece(piece[half:]))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text)))) if text else []

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' bytes, concatenated by halves."""
        if len(ids) <= 1024:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, vocabulary: tuple[str, str], text: str = "text") -> DataFrame:
    """The columns of ``docs``, and the text's n_tokens and ids (little-endian, unsigned, 32 bits each)."""

    def make() -> Callable[[list], list]:
        codec = Codec.of(*vocabulary)

        def work(texts: list) -> list:
            found = [np.fromiter(codec.encode(t), "<u4") for t in texts]
            return [[len(x) for x in found], [x.tobytes() for x in found]]

        return work

    return with_outputs(docs, text, make, "n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: tuple[str, str], ids: str = "ids") -> DataFrame:
    """The columns of ``encoded`` but the ids, and the digest of the decimal ids, joined by one space, and ``decoded``: the
    bytes of the text. Null ids are no ids."""

    new = T._parse_datatype_string("ids_sha256 string, decoded binary")
    gone = {"ids_sha256", "decoded", ids.lower()}
    kept = [c for c in encoded.columns if c.lower() not in gone]
    schema = T.StructType([encoded.schema[c] for c in kept] + list(new.fields))
    names = to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(*vocabulary)
        decimal = {i: b"%d" % i for i in codec.bytes_of}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(len(kept)).to_pylist()]
                told = pa.array([hashlib.sha256(b" ".join(map(decimal.__getitem__, x))).hexdigest() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], told, pa.array(map(codec.decode, found), pa.binary())], names=names)

    return encoded.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(ids))).mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = default_vocabulary()
    encoded = encode_texts(docs, vocabulary).drop("text")
    return decode_ids(encoded, vocabulary).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
