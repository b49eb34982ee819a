"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

A record is: 8 bytes length, 4 bytes masked CRC-32C of the length, the data, 4 bytes masked CRC-32C of
the data, all little-endian. The data are the ids of one document, 2 bytes each when the vocabulary
allows it, else 4. The index file has, for each record, the document's number and the record's offset
and data length as three 64-bit integers, so that a reader can fetch any record without the others.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.files import opened, written
from voxloom.llm.words import KnownWords, Words, slices, words_of
from voxloom.session import materialize, new_scratch

#: Fixed: the polynomial of CRC-32C (reflected) and the mask of the record format.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
#: Bytes that one look-up folds into a register of four, and those looked up at once (so they stay in the cache).
FOLD = 64
AT_ONCE = 1 << 18
#: Marks that may end a word of letters and are a piece of their own.
MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("length", "<i8")])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


_T = _crc_table()


def _shifted(registers: np.ndarray, n: int) -> np.ndarray:
    """Registers after ``n`` more zero bytes."""
    for _ in range(n):
        registers = (registers >> np.uint32(8)) ^ _T[registers & np.uint32(255)]
    return registers


def _moved(registers: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that ``step`` tells the effect of, bit by bit."""
    on = (registers[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(on * step, axis=1)


def _folds(levels: int) -> list[np.ndarray]:
    """For each level, what a byte at each of FOLD places leaves in the register after the last place.

    On the first level the places are bytes of data; above, they are the bytes of the registers of
    FOLD / 4 neighbours of the level below, each as many bytes of data after the one before it.
    """
    out = [np.zeros((FOLD, 256), dtype=np.uint32)]
    out[0][FOLD - 1] = _T
    for place in range(FOLD - 2, -1, -1):
        out[0][place] = _shifted(out[0][place + 1], 1)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _shifted(bits, FOLD)  # what each bit of a register becomes by a neighbour's bytes
    values = np.arange(256)
    for _ in range(levels - 1):
        table, now = np.zeros((FOLD, 256), dtype=np.uint32), bits
        for first in range(FOLD - 4, -1, -4):
            for bit in range(32):
                table[first + bit // 8] ^= np.where(values >> (bit % 8) & 1, now[bit], 0).astype(np.uint32)
            now = _moved(now, step)
        out.append(table)
        step = now
    return out


#: Enough for stretches of 64 * 16 ** 8 bytes (274 GB).
_FOLDS = [t.ravel() for t in _folds(9)]
_PLACES = np.arange(FOLD) * 256


def _in_front(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch behind as many zero bytes as fill its last fold, and the number of folds of each."""
    folds = -(-lengths // FOLD)
    stops = np.cumsum(folds) * FOLD
    out = np.zeros(int(stops[-1]), dtype=np.uint8)
    for s, n, e in zip(starts.tolist(), lengths.tolist(), stops.tolist(), strict=True):
        out[e - n : e] = data[s : s + n]
    return out, folds


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each stretch of ``data``, all of them side by side.

    All stretches are folded together, whatever their sizes: 64 bytes become a register of four, sixteen
    neighbouring registers become one on the next level, until each stretch has one. Zero bytes fill the
    front: they leave a zero register zero. The start value of the register is worked in by flipping the
    first four bytes (shorter stretches go byte by byte).
    """
    out = np.zeros(lengths.size, dtype=np.uint32)
    own = np.flatnonzero(lengths >= 4)
    if own.size:
        n = lengths[own]
        part, folds = _in_front(data, starts[own], n)
        heads = np.cumsum(folds) * FOLD - n
        part[(heads[:, None] + np.arange(4)).ravel()] ^= 255
        for table in _FOLDS:
            registers = np.zeros(part.size // FOLD, dtype="<u4")
            rows = part.reshape(-1, FOLD)
            for at in range(0, rows.shape[0], AT_ONCE // FOLD):
                np.bitwise_xor.reduce(table[rows[at : at + AT_ONCE // FOLD] + _PLACES], axis=1, out=registers[at : at + AT_ONCE // FOLD])
            first = np.cumsum(folds) - folds
            done = folds == 1
            out[own[done]] = registers[first[done]]
            if done.all():
                break
            own, first, folds = own[~done], first[~done], folds[~done]
            part, folds = _in_front(registers.view(np.uint8), first * 4, folds * 4)
    out ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(lengths < 4).tolist():
        crc = 0xFFFFFFFF
        for byte in data[starts[k] : starts[k] + lengths[k]].tolist():
            crc = (crc >> 8) ^ int(_T[(crc ^ byte) & 255])
        out[k] = crc ^ 0xFFFFFFFF
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters up to U+00FF: the library cuts a run of them as one word, whatever its normalisation."""
    ascii_ = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    after = np.r_[False, data[:-1] == 0xC3] & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    lead = (data == 0xC3) & np.r_[after[1:], False]
    return ascii_ | after | lead


class Encoder:
    """A library tokenizer that white space always splits, asked once for each new word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self._last = np.zeros(size, dtype=bool)  # tokens that end a word
        if suffix:
            self._last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # the same model behind a plain cut at spaces, for words that are in lower case and cut already
        self._bare = Tokenizer.from_file(path)
        self._bare.no_truncation()
        self._bare.no_padding()
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "It was, as ever; THE END! Ça va? Straße ÀÖØÞ ÿ."
        cut = "it was , as ever ; the end ! ça va ? straße àöøþ ÿ ."
        if self._bare.encode(cut, add_special_tokens=False).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self._last[:] = False  # another kind of vocabulary: every word goes through the whole of the library
        self._known = KnownWords(2_000_000)

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Plain words in one call, cut again where tokens end a word; ``pieces`` is 2 for letters and a mark, else 1."""
        sizes = ends - starts
        stops = np.cumsum(sizes + pieces)  # a space after every word, and before a mark
        joined = np.full(int(stops[-1]), 0x20, dtype=np.uint8)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = data[within + np.repeat(starts, sizes)]
        capital = ((own >= 0x41) & (own <= 0x5A)) | (np.r_[False, own[:-1] == 0xC3] & (own <= 0x9E) & (own >= 0x80) & (own != 0x97))
        place = within + np.repeat(stops - sizes - pieces, sizes)
        place[np.cumsum(sizes)[pieces == 2] - 1] += 1
        joined[place] = np.where(capital, own + 32, own)
        ids = np.array(self._bare.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, dtype=np.int64)
        last = np.flatnonzero(self._last[ids]) + 1
        told = np.cumsum(pieces)
        if last.size != told[-1] or last[-1] != ids.size:
            return None
        return ids, np.diff(np.r_[0, last[told - 1]])

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.r_[0, np.cumsum(~plain_letters(data))]
        marked = MARK[data[ends - 1]] & (ends - starts > 1)
        plain = np.flatnonzero((odd[ends - marked] == odd[starts]) & self._last.any())
        ids, owner, done = [], [], np.zeros(starts.size, dtype=bool)
        for at in range(0, plain.size, 2000):
            own = plain[at : at + 2000]
            if found := self._together(data, starts[own], ends[own], 1 + marked[own]):
                ids.append(found[0])
                owner.append(np.repeat(own, found[1]))
                done[own] = True
        raw, rest = data.tobytes(), np.flatnonzero(~done).tolist()
        words = [raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, dtype=np.int64))
            owner.append(np.full(len(e.ids), k))
        if not ids:
            return np.zeros(0, dtype=np.int64), np.zeros(starts.size, dtype=np.int64)
        owners = np.concatenate(owner)
        return np.concatenate(ids)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=starts.size)

    def encode(self, w: Words, end: int) -> list[bytes]:
        """The serialized ids of each text, with ``end`` last."""
        flat, n = self._known.ids(w.data, w.starts, w.ends, self._new)
        stops = np.r_[0, np.cumsum(n)][w.first]
        ids = np.insert(flat, stops[1:], end).astype(self.dtype)
        stops = (stops + np.arange(stops.size)).tolist()
        return [ids[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]


_LOADED: dict[str, Encoder] = {}


def _loaded(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def framed(rows: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Records around the data, and the length of each record."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    heads = np.frombuffer(lengths.astype("<u8").tobytes(), dtype=np.uint8)
    head_crc = masked(crc32c(heads, np.arange(lengths.size) * 8, np.full(lengths.size, 8)))
    data = np.frombuffer(b"".join(rows), dtype=np.uint8)
    crc = masked(crc32c(data, np.cumsum(lengths) - lengths, lengths))
    out = [struct.pack("<QI", n, h) + r + struct.pack("<I", c) for n, h, r, c in zip(lengths.tolist(), head_crc.tolist(), rows, crc.tolist(), strict=True)]
    return out, lengths + 16


def write_records(docs: DataFrame, folder: str, vocabulary: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending order of ``key``; returns a row per file: ``part, n_records, n_ids, width``.

    The rows are dealt out by ranges of the key, one file and one index file a range, named after the
    range: a task that runs again puts the same file in place. Null text is empty (only ``end``), null
    keys come first, rows that repeat a key are all written, in the order of their text.
    """
    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    ordered = ordered.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches):
        part = TaskContext.get().partitionId()
        encoder, n, total, offset = _loaded(vocabulary), 0, 0, 0
        width = np.dtype(encoder.dtype).itemsize
        first = next(batches, None)
        if first is None:
            return
        with written(f"{folder}/part-{part:06d}.records") as out, written(f"{folder}/part-{part:06d}.index") as index:
            while first is not None:
                keys = np.array(first.column(0).fill_null(np.iinfo(np.int64).min), dtype=np.int64)
                for w in words_of(first.column(1)):
                    rows = w.rows
                    records, sizes = framed(encoder.encode(w, end))
                    out.write(b"".join(records))
                    entry = np.zeros(len(rows), dtype=INDEX_ROW)
                    entry["doc_id"], entry["offset"], entry["length"] = keys[rows.start : rows.stop], offset + np.cumsum(sizes) - sizes, sizes - 16
                    index.write(entry.tobytes())
                    offset, n, total = offset + int(sizes.sum()), n + len(rows), total + int(sizes.sum() - 16 * len(rows)) // width
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_records": [n], "n_ids": [total], "width": [width]}, schema=manifest)

    manifest = pa.schema([("part", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())])
    return materialize(ordered.mapInArrow(run, "part int, n_records long, n_ids long, width int"), "records-manifest")


def read_part(folder: str, part: int, width: int, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a file: document numbers, number of ids of each, and all ids. Raises where a checksum or length is wrong."""
    with opened(f"{folder}/part-{part:06d}.index") as f:
        index = np.frombuffer(f.read(), dtype=INDEX_ROW)
    with opened(f"{folder}/part-{part:06d}.records") as f:
        for rows in slices(np.append(index["offset"], f.size()), most):
            own = index[rows.start : rows.stop]
            base = int(own["offset"][0])
            f.seek(base)
            block = np.frombuffer(f.read(int(own["offset"][-1] + own["length"][-1]) + 16 - base), dtype=np.uint8)
            at, n = own["offset"] - base, own["length"]

            def number(where: np.ndarray, size: int, block=block) -> np.ndarray:
                return block[where[:, None] + np.arange(size)].copy().view(f"<u{size}")[:, 0]

            ok = (number(at, 8) == n.astype(np.uint64)) & (number(at + 8, 4) == masked(crc32c(block, at, np.full(n.size, 8))))
            ok &= number(at + 12 + n, 4) == masked(crc32c(block, at + 12, n))
            if not ok.all():
                raise ValueError(f"damaged record {int(rows.start + np.flatnonzero(~ok)[0])} in part {part} of {folder}")
            parts = [block[a : a + k] for a, k in zip((at + 12).tolist(), n.tolist(), strict=True)]
            yield own["doc_id"], n // width, np.concatenate(parts).view(f"<u{width}")


def read_records(spark, manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, read from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all records before; the sums over files are the only step that sees all
    of them, a row per file. ``ids_crc32`` is over the ids as little-endian 32-bit integers.
    """
    files = manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for part, start, width in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for docs, n, ids in read_part(folder, part, width):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(n) * 4
                    crc = [zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    keys = pa.array(docs, mask=docs == np.iinfo(np.int64).min)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], schema=schema)
                    start += int(n.sum())

    spread = files.select("part", "start", "width").repartitionByRange(max(1, manifest.count()), "part")  # a task for each file
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_records(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_scratch(spark, "token-records")
    manifest = write_records(docs, folder, vocabulary or public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_records(spark, manifest, folder)


QUERIES = {"op9_records": op9_records}
ORACLE: dict[str, str] = {}
