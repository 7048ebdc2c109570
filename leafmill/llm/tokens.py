"""Token ids in files of fixed-width numbers: each id takes the fewest bits that the vocabulary needs.

A file holds the ids of whole documents, one after another, in blocks of a fixed number of ids; every block begins at a byte. A table at the
end of the file has the offset and the checksum of each block, and the id and first position of each document, so any run of ids is read by fetching the
blocks that hold it and unpacked by numpy at once. Rows are range-sorted by document id; a task encodes and writes its range and begins a new
file at a size; files are committed through temporary names and a manifest (see files.py).

Ids come from the tokenizers library. A text of plain characters is cut into the vocabulary's own pieces first, and each
distinct piece is encoded once a task; other texts are encoded whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .common import Scratch, need_whole_numbers, partitions, prepare

VOCABULARY, END_ID = "word_bpe_49k", 1
#: Ids of a block; a multiple of 8, so that neighbouring whole blocks are one run of bits.
BLOCK = 1 << 15
ROLL_BYTES = 64 << 20
#: Ids that a reader unpacks at once.
PIECE = 1 << 20
#: Distinct words, and pieces of words, whose ids a task remembers; beyond, it forgets all and begins anew.
REMEMBERED = 1 << 19

MANIFEST = files.MANIFEST + ", n_ids bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

MAGIC = b"IDBITS01"
#: bits, ids a block, documents, ids, offset and checksum of the table, mark of the format.
TRAILER = struct.Struct("<IIQQQI8s")


# --- fixed width


def bits_of(vocabulary_size: int) -> int:
    """Bits that hold ids from 0 to ``vocabulary_size`` - 1."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as little-endian numbers of ``bits`` bits each, at most 32, filled up with zeros to a whole byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} doesn't fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    # Eight ids take exactly ``bits`` bytes: column k of a table of eights goes to a fixed place of the row.
    eights = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    eights.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(eights), bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = eights[:, k] << np.uint64(shift)
        for j in range((bits + shift + 7) // 8):
            out[:, byte + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :bits].tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids of packed ``data`` after the first ``skip``."""
    if len(data) * 8 < (skip + n) * bits:
        raise ValueError("packed ids are cut short")
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, skip * bits // 8).astype("<u4")
    padded = np.frombuffer(bytes(data) + bytes(8), np.uint8)
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at = (np.arange(skip, skip + n, dtype=np.int64)) * bits
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


class TokenWriter:
    """Writes one file; ``write`` takes packed bytes and a number of records."""

    def __init__(self, write, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = write, bits, block
        self.held, self.n_held, self.n_ids, self.size = [], 0, 0, 0
        self.offsets, self.sums, self.docs, self.nulls, self.starts = [], [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            whole = len(every) // self.block * self.block
            for at in range(0, whole, self.block):
                self._put(every[at : at + self.block])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.size)
        self.sums.append(zlib.crc32(data))
        self._write(data, 0)

    def _write(self, data: bytes, records: int) -> None:
        self.out(data, records)
        self.size += len(data)

    def close(self) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        table = b"".join(np.array(x, t).tobytes() for x, t in ((self.offsets, "<u8"), (self.sums, "<u4"), (self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")))
        at = self.size
        self._write(table, 0)
        self._write(TRAILER.pack(self.bits, self.block, len(self.docs), self.n_ids, at, zlib.crc32(table), MAGIC), len(self.docs))


class TokenFile:
    """Random access to a file, given as anything with seek(), read() and size(). What doesn't agree with its checksums raises ValueError."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < TRAILER.size:
            raise ValueError("a file of token ids is cut short")
        self.bits, self.block, self.n_docs, self.n_ids, at, crc, magic = TRAILER.unpack(self._read(size - TRAILER.size, TRAILER.size))
        n = -(-self.n_ids // self.block) if self.block else 0
        if magic != MAGIC or at + n * 12 + self.n_docs * 17 + TRAILER.size != size:
            raise ValueError("not a whole file of token ids")
        table = self._read(at, size - TRAILER.size - at)
        if zlib.crc32(table) != crc:
            raise ValueError("the table of a file of token ids is damaged")
        cut = np.cumsum([0, 8 * n, 4 * n, 8 * self.n_docs, self.n_docs, 8 * self.n_docs])
        part = [table[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.offsets = np.append(np.frombuffer(part[0], "<u8"), np.uint64(at)).astype(np.int64)
        self.sums, self.docs, self.nulls = np.frombuffer(part[1], "<u4"), np.frombuffer(part[2], "<i8"), np.frombuffer(part[3], "u1").astype(bool)
        self.starts = np.append(np.frombuffer(part[4], "<u8"), np.uint64(self.n_ids)).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from position ``start`` to before ``stop``, from the blocks that hold them alone."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"{start} to {stop} of {self.n_ids} ids")
        if start == stop:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block
        data = self._read(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        for k in range(a, b + 1):
            if zlib.crc32(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]]) != self.sums[k]:
                raise ValueError(f"block {k} of a file of token ids is damaged")
        return unpack(data, self.bits, stop - start, start - a * self.block)

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's document number k."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# --- ids

#: Characters of plain texts: each is its own composed form, and all but ASCII letters keep their kind when lower-cased, one for one.
_PLAIN = r"^[\t-\r -~\x{A1}-\x{12F}\x{131}-\x{24F}\x{400}-\x{45F}\x{2010}-\x{2027}\x{20AC}\x{3001}\x{3002}\x{4E00}-\x{9FA5}]*$"
#: The pieces of a lower-cased word of plain characters, by the vocabulary's own rule.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")


class Memory:
    """The ids of strings seen before."""

    def __init__(self):
        self.known: dict[str, int] = {"": 0}
        self.at, self.flat, self.n_flat = [np.zeros(2, np.int64)], [np.zeros(0, "<u4")], 0

    def add(self, strings: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """``ids`` of new strings, one after another; those of the first go up to ``stops[0]``."""
        self.known.update(zip(strings, range(len(self.known), len(self.known) + len(strings)), strict=True))
        self.at.append(self.n_flat + stops)
        self.flat.append(ids)
        self.n_flat += len(ids)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings known by these numbers, ids before each)."""
        self.at, self.flat = [np.concatenate(self.at)], [np.concatenate(self.flat)]
        at, flat = self.at[0], self.flat[0]
        start = at[places]
        before = np.concatenate([[0], np.cumsum(at[places + 1] - start)])
        return flat[np.repeat(start - before[:-1], np.diff(before)) + np.arange(before[-1])], before


class Encoder:
    """Ids of many texts. Of words and of pieces ``remembered`` are kept with their ids, or what one batch has; then all are forgotten."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        import public_tokenizers as public
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public.path(f"{vocabulary}.json"))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Only the vocabulary that marks the ends of words and whose rule is the one above is cut into pieces.
        self.by_piece = vocabulary == VOCABULARY
        self.remembered = remembered
        self.words, self.pieces = Memory(), Memory()

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]

    def _learn_pieces(self, new: list[str]) -> None:
        """Many pieces are encoded as one text, whose words the ids that end words part again."""
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                one = self.encode_whole(some)
                ids, stops = np.concatenate(one), np.cumsum([len(x) for x in one])
            self.pieces.add(some, ids, stops)

    def _learn_words(self, new: list[str]) -> None:
        parts, counts, known = [], [], self.pieces.known
        for w in new:
            if w.isalpha():
                own = [w]
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                own = [w[:-1], w[-1]]
            else:
                own = _PIECES.findall(w)
            parts += own
            counts.append(len(own))
        if len(known) > self.remembered:
            self.pieces = Memory()
            known = self.pieces.known
        self._learn_pieces(list(dict.fromkeys(p for p in parts if p not in known)))
        ids, before = self.pieces.ids(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
        self.words.add(new, ids, before[np.cumsum(counts)])

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts)).cast(pa.large_list(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        # What stands after a text's last blank is an empty word.
        strings = coded.dictionary.to_pylist()
        if len(self.words.known) > self.remembered:
            self.words = Memory()
        if new := [w for w in strings if w not in self.words.known]:
            self._learn_words(new)
        places = np.fromiter(map(self.words.known.__getitem__, strings), np.int64, len(strings))
        ids, before = self.words.ids(places[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, before[np.asarray(lists.offsets)]

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text and ``end_id``. Nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.match_substring_regex(texts, _PLAIN) if self.by_piece else pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, s)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        ids, at = self._by_piece(texts.filter(plain)) if is_plain.any() else (None, None)
        k = 0
        for i, simple in enumerate(is_plain):
            if simple:
                own = ids[at[k] : at[k + 1]]
                k += 1
            else:
                own = self.encode_whole([texts[i].as_py()])[0]
            yield np.append(own, np.uint32(end_id)).astype("<u4")


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


# --- tables


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the ids of every row of ``docs``, in ascending order of ids, and return the manifest of the files.

    Null and empty texts are the end id alone. Rows without an id come first; those of one id, or of none, are in the order of a hash of their text, each
    a document of its own, and may lie in several shards. Ids must be whole numbers, else TypeError. Other columns are ignored, whatever their
    names; an empty table gives an empty manifest. A text is encoded whole and so must fit a task's memory.
    """
    spark = docs.sparkSession
    prepare(spark)
    need_whole_numbers(docs, doc_id)
    own = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Rows of one id and text are alike, so which input partition they come from may decide between them.
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    ordered = own.withColumn("_part", F.spark_partition_id()).repartitionByRange(partitions(spark), *order, "_part").sortWithinPartitions(*order).select("_id", "_text")
    temporary = files.temporary_of(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, attempt, ids_of = TaskContext.get().partitionId(), uuid.uuid4().hex, encoder(vocabulary)
        bits, part, out, writer, done = bits_of(max(ids_of.size, end_id + 1)), 0, None, None, []

        def close() -> None:
            nonlocal out
            if out is not None:
                writer.close()
                done.append((*out.close(), writer.n_ids))
                out = None

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1), end_id), strict=True):
                if out is not None and writer.size >= roll_bytes:
                    close()
                    part += 1
                if out is None:
                    out = files.Output(temporary, f"shard-{shard:06d}-{part:05d}.ids", attempt, shard, part)
                    writer = TokenWriter(out.write, bits, block)
                writer.add(key, ids)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], files.arrow_schema(MANIFEST).names).cast(files.arrow_schema(MANIFEST))

    return files.commit(spark, folder, lambda: ordered.mapInArrow(run, MANIFEST), MANIFEST)


def located(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``base``, the ids of all files before each."""
    own = files.manifest(spark, folder, MANIFEST)
    # As many shards as the writer had partitions.
    shards = own.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_shards"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")
    return own.withColumn("_within", within).join(shards, "shard").withColumn("base", F.col("_shards") + F.col("_within")).drop("_shards", "_within")


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ``ids`` the ids themselves.

    A folder without a committed manifest, a missing file, one of another size or digest than the manifest says, and damaged tables or blocks
    raise; no rows come from a folder of no documents.
    """
    prepare(spark)
    schema = ROWS + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, at = files.opened(folder)
                path = f"{at}/{row['name']}"
                with store.open_input_stream(path, compression=None) as stream:
                    files.Checked(stream, row).close()
                with store.open_input_file(path) as source:
                    file = TokenFile(source)
                    if (file.n_docs, file.n_ids) != (row["n_records"], row["n_ids"]):
                        raise ValueError(f"{row['name']} holds {file.n_docs} documents of {file.n_ids} ids, not what the manifest says")
                    a = 0
                    while a < file.n_docs:
                        b = max(a + 1, int(np.searchsorted(file.starts, file.starts[a] + PIECE, "right")) - 1)
                        b = min(b, file.n_docs)
                        first = int(file.starts[a])
                        some = file.ids(first, int(file.starts[b]))
                        cut = file.starts[a : b + 1] - first
                        columns = [
                            pa.array(file.docs[a:b], pa.int64(), mask=file.nulls[a:b]),
                            pa.array(file.starts[a:b] + row["base"]),
                            pa.array(np.diff(cut)),
                            pa.array([zlib.crc32(some[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                        ]
                        if ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(some.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
                        a = b

    return located(spark, folder).repartition(partitions(spark)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back, without the ids."""
    spark = docs.sparkSession
    folder = f"{Scratch(spark, 'tokens').root}/ids"
    write(docs, folder, **options)
    return read(spark, folder)
