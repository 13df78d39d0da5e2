"""Token ids in a binary file format, and the reader for it.

Ids are replaced by their frequency rank in the corpus (commonest first), so
most fit one byte.  Ranks are coded with a byte-aligned variable length: two
control bits a rank give its length (1 to 4 bytes); control bytes and data
bytes are kept apart, so the reader finds lengths and byte positions of four ranks
at a time in a table indexed by the control byte.

A file is a Parquet file whose rows are blocks: (part, block, first, doc_ids,
lengths, n_ids, control, data), first = ids of its part before it, documents in ascending id order; the Spark
committer makes a lost task harmless.  ``id_of_rank`` is a small table beside the
blocks, bounded by the vocabulary.

Texts are tokenised once, by the library, each distinct pre-token once as long as the
worker remembers it; plain texts are cut at their spaces, only their distinct units are
cut further, and unseen pre-tokens are encoded many at a time.  The ids are counted by the task that
makes them, stored, then coded and written.  Order comes from a range partition on the id, so a hot source
or text plays no part.  Null texts are empty; a null id sorts first; rows with
equal ids keep no particular order among themselves beyond their coded bytes.
The tokenizer's added tokens (``<|endoftext|>``) become their ids where they stand
in a text, as in the library's own ``encode``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import kept, map_batches, map_rows, shared_path, store

BLOCK_IDS = 1 << 20
#: characters of text that are encoded together
STEP = 1 << 24
#: unseen pre-tokens that are encoded together
BATCH = 10_000
#: pre-tokens of one of the two generations that a worker keeps
KEPT = 700_000
#: Texts of these characters only are cut into the pre-tokens of ``BYTE_LEVEL`` by ``_PIECES``, its pattern: what is
#: letter, digit, white space or none of them is the same for these in all Unicode tables.
_LETTERS = ("A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff"
            "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3")
_PLAIN = re.compile(rf"[\t\n\r -~\u2010-\u2027\u3001\u3002{_LETTERS}]+")
_PIECES = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: A plain text without these, and without a space at its end, has a pre-token begin at each space.
_RAGGED = ("  ", " \n", " \r", " \t")
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _alphabet() -> dict[int, int]:
    """Byte -> the character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(hidden)}}


class PreTokens(dict):
    """pre-token of ``BYTE_LEVEL`` -> packed ids, by the library's model.

    When ``KEPT`` are held they become the older generation, which replaces the one before;
    those met again move back from there."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.older, self.alphabet = model.tokenize, {}, _alphabet()
        self.space = chr(self.alphabet[32])

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece.isascii() and piece[1:].isalnum():
                word = piece.replace(" ", self.space)
            else:
                word = piece.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.tokenize(word)]).tobytes()
        self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids


class Library:
    """The tokenizers library behind a cache of pre-tokens or of white-space delimited units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        added = list(self.tok.get_added_tokens_decoder().values())
        # added tokens are found first, the longest where several begin; the text between them is encoded apart
        names = sorted((re.escape(a.content) for a in added), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(names) + ")") if names else None
        self.added = {a.content: array("I", (i,)).tobytes() for i, a in self.tok.get_added_tokens_decoder().items()}
        # such tokens depend on what stands around them, so cutting would not do
        self.whole = self.tok.normalizer is not None or any(a.lstrip or a.rstrip or a.single_word or any(map(str.isspace, a.content)) for a in added)
        lengths = np.zeros(self.size, np.int64)
        for t, i in self.tok.get_vocab().items():
            lengths[i] = len(t)  # the byte alphabet has one character a byte
        self.lengths = lengths
        with open(path, encoding="utf-8") as f:
            cut = json.load(f).get("pre_tokenizer") or {}
        self.byte_level = {k: cut.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL
        self.pieces = PreTokens(self.tok.model)
        # the model alone, for pre-tokens in the byte alphabet, which has no raw line feed
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.chunks = ChunkEncoder(self.encode_units)

    @classmethod
    def of(cls, path: str) -> Library:
        return kept((cls, path), lambda: cls(path))

    def parts(self, text: str) -> list[str]:
        """Plain text and added tokens by turns, plain text first and last."""
        return self.cut.split(text) if self.cut else [text]

    def encode(self, text: str) -> bytes:
        if self.whole:
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[p] if k % 2 else self.chunks.encode(p) for k, p in enumerate(self.parts(text)))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: texts of plain characters by their units or pre-tokens, each distinct one encoded once."""
        plain = [self.byte_level and not self.whole and _PLAIN.fullmatch(t) is not None and not any(a in t for a in self.added)
                 for t in texts]
        even = [ok and " " in t and t[-1] != " " and not any(r in t for r in _RAGGED) for t, ok in zip(texts, plain)]
        by_units = iter(self._by_units([t for t, ok in zip(texts, even) if ok]))
        by_pieces = iter(self._join([_PIECES.findall(t) for t, ok, unit in zip(texts, plain, even) if ok and not unit]))
        if not all(plain) and not self.whole:
            self.chunks.warm([p for t, ok in zip(texts, plain) if not ok for p in self.parts(t)[::2]])
        return [next(by_units) if unit else next(by_pieces) if ok else self.encode(t) for t, ok, unit in zip(texts, plain, even)]

    def _by_units(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are cut at their spaces; each distinct unit (a space and all up to the next) is
        looked up once, and a column of its ids spread over the places where it stands."""
        if not texts:
            return []
        heads, _, rests = zip(*[t.partition(" ") for t in texts])
        cut = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        words, at = coded.dictionary, cut.offsets.to_numpy()
        # the first of a text has no space before it
        place = np.insert(coded.indices.to_numpy(), at[:-1], np.arange(len(words), len(words) + len(texts), dtype=np.int32))
        starts = np.frombuffer(words.buffers()[1], "<i8")[:len(words)]
        spaced = np.insert(np.frombuffer(words.buffers()[2], np.uint8), starts, 32)  # they start with no white space
        pieces = _PIECES.findall(spaced.tobytes().decode())
        ends = np.cumsum(pc.utf8_length(words).to_numpy() + 1)
        units = np.append(0, np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), ends) + 1)
        firsts = list(map(_PIECES.findall, heads))
        units = np.append(units, len(pieces) + np.cumsum([*map(len, firsts)]))
        for each in firsts:
            pieces += each
        ids = pa.array(self._ids(pieces), pa.large_binary())
        starts = np.frombuffer(ids.buffers()[1], "<i8")[units]
        ids = pa.Array.from_buffers(pa.large_binary(), len(units) - 1, [None, pa.py_buffer(starts), ids.buffers()[2]])
        ids = ids.take(pa.array(place))
        ends = np.frombuffer(ids.buffers()[1], "<i8")[at + np.arange(len(at))].tolist()
        raw = memoryview(ids.buffers()[2])
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token; unseen ones are encoded together."""
        new = [p for p in set(pieces) if p not in self.pieces and p not in self.pieces.older] if len(pieces) >= BATCH else []
        for k in range(0, len(new), BATCH):
            part = new[k:k + BATCH]
            words = "\0".join(part).encode().decode("latin-1").translate(self.pieces.alphabet | {0: "\n"})  # plain ones have no zero byte
            ids = np.array(self.model.encode_batch_fast([words], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(list(map(len, words.split("\n")))))
            cut, raw = [0, *(4 * (ends + 1)).tolist()], ids.tobytes()
            for piece, a, b in zip(part, cut, cut[1:]):
                self.pieces.keep(piece, raw[a:b])
        return list(map(self.pieces.__getitem__, pieces))

    def _join(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens."""
        return [b"".join(self._ids(ps)) for ps in cut]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit; pre-tokens met before are not encoded again."""
        plain = [self.byte_level and _PLAIN.fullmatch(u) is not None for u in units]
        others = iter(self._library([u for u, ok in zip(units, plain) if not ok]))
        return [b"".join(self._ids(_PIECES.findall(u))) if ok else next(others) for u, ok in zip(units, plain)]

    def _library(self, units: list[str]) -> list[bytes]:
        """Units are encoded together, then cut where their bytes end.

        Each unit must begin where the one before ends a pre-token: with white
        space, after a non-space character.  No unit holds an added token, and a joint
        can't make one: it has no white space."""
        if len(units) == 1 or not all(u[0] == " " and not u[-1].isspace() for u in units):
            return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
        out: list[bytes] = []
        for k in range(0, len(units), 500):
            part = units[k:k + 500]
            ids = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.lengths[ids])
            cut = [0, *(4 * (np.searchsorted(ends, np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in part])) + 1)).tolist()]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cut, cut[1:])]
        return out


def _encoded(rows, path: str, end_id: int | None):
    """(key, packed ids) for each row; pre-tokens not seen before are encoded together."""
    lib = Library.of(path)
    tail = b"" if end_id is None else array("I", (end_id,)).tobytes()
    group, size = [], 0

    def done():
        return zip([k for k, _ in group], [ids + tail for ids in lib.encode_many([t for _, t in group])])

    for key, text in rows:
        group.append((key, text or ""))
        size += len(text or "")
        if size > STEP:
            yield from done()
            group, size = [], 0
    yield from done()


def _binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column of runs of values, n in each."""
    offsets = (np.append(0, np.cumsum(n)) * values.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a column of ``_binary``, one row after the other."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind)
    at = np.frombuffer(offsets, "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind)


def encode(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int | None) -> DataFrame:
    """(doc, n, ids, counts): ids packed in two bytes each where the vocabulary allows it, else four.

    counts: null but for one more row a task, which has nothing else: how often each id occurs in the task, packed."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
    kind = _kind(path, end_id)

    def run(rows):
        total, held, size = np.zeros(0, np.int64), [], 0

        def counted():
            got = np.bincount(np.concatenate(held))
            wide = max(len(got), len(total))
            return np.pad(got, (0, wide - len(got))) + np.pad(total, (0, wide - len(total)))

        for i, ids in _encoded(rows, path, end_id):
            v = np.frombuffer(ids, "<u4").astype(kind)
            held.append(v)
            size += len(v)
            if size >= BLOCK_IDS:
                total, held, size = counted(), [], 0
            yield i, len(v), v.tobytes(), None
        if held:
            total = counted()
        yield None, None, None, total.astype("<i8").tobytes()

    return map_rows(df.select(id_col, text_col), run, schema)


def _kind(path: str, end_id: int | None) -> str:
    return "<u2" if max(Library.of(path).size, end_id or 0) < 1 << 16 else "<u4"


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n) over all texts, from the tasks' counts; ids that never occur are not listed."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(it):
        total = np.zeros(0, np.int64)
        for b in it:
            for raw in b.column(0):
                got = np.frombuffer(raw.as_buffer(), "<i8")
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[:len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], schema=schema)

    return map_batches(encoded.where("counts is not null").select("counts"), run, schema).groupBy("id").agg(F.sum("n").alias("n"))


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    width = 4 if v.max(initial=0) > 0xFFFF else 2  # no value has more bytes
    code = (v > 0xFF).astype(np.uint8)
    if width > 2:
        code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[:len(v)] = code
    # four codes, a byte each, come together in the upper byte of a product
    control = (padded.view("<u4") * np.uint32(0x01041040) >> np.uint32(24)).astype(np.uint8)
    keep = np.ones((len(v), width), bool)
    for k in range(1, width):
        np.greater_equal(code, k, out=keep[:, k])
    return control.tobytes(), v.astype(f"<u{width}").view(np.uint8)[keep.reshape(-1)].tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each control byte: the bytes of its four values, for each of 16 output
    bytes its place in the data (16: no such byte), and the bytes of its longest value."""
    control = np.arange(256)
    lengths = np.stack([(control >> 2 * k & 3) + 1 for k in range(4)], 1)
    starts = np.cumsum(lengths, 1) - lengths
    byte = np.arange(4)
    place = np.where(byte[None, None, :] < lengths[:, :, None], starts[:, :, None] + byte[None, None, :], 16)
    return lengths.sum(1), place.reshape(256, 16), lengths.max(1)


_TOTAL, _PLACE, _LONGEST = _tables()


def unpack(control: bytes, data: bytes, n: int, step: int = 1 << 13) -> np.ndarray:
    """The values again, by table lookup on the control bytes."""
    c = np.frombuffer(control, np.uint8)
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(17, np.uint8)])
    total = _TOTAL[c]
    starts = np.cumsum(total) - total
    width = 4 if (_LONGEST[c] > 2).any() else 2  # no byte beyond is read
    table = _PLACE.reshape(256, 4, 4)[:, :, :width].reshape(256, 4 * width)
    some = np.where(table < 16, 0xFF, 0).astype(np.uint8)
    table = np.where(table < 16, table, 0)
    out = np.empty((len(c), 4 * width), np.uint8)
    for k in range(0, len(c), step):
        group = c[k:k + step]
        np.bitwise_and(d.take(starts[k:k + step, None] + table[group], mode="clip"), some[group], out=out[k:k + step])
    return out.view(f"<u{width}").reshape(-1)[:n]


def write(df: DataFrame, id_col: str, text_col: str, path: str, out: str | None = None,
          end_id: int | None = None, partitions: int | None = None) -> str:
    """Encode all rows and write the files; returns their folder."""
    spark = df.sparkSession
    out = out or shared_path(spark, "tokens")
    kind = _kind(path, end_id)
    encoded = store(encode(df, id_col, text_col, path, end_id), "token-ids")  # texts are tokenised and counted once
    counts = count_ids(encoded).collect()  # at most one row per vocabulary entry
    ranked = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.parquet(f"{out}/id_of_rank")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[np.array(ranked, np.int64)] = np.arange(len(ranked), dtype=np.uint32)

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.where("counts is null").drop("counts").repartitionByRange(n, "doc").sortWithinPartitions("doc").withColumn("part", F.spark_partition_id())
    blocks = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()),
                        ("control", pa.binary()), ("data", pa.binary())])

    def block(it):
        k, part, docs, lens, vals = 0, 0, [], [], []
        first = size = held = 0

        def done():
            control, data = pack(np.concatenate(vals))
            each = pa.array([0, held], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([k]), pa.array([first]),
                pa.ListArray.from_arrays(each, pa.concat_arrays(docs)),
                pa.ListArray.from_arrays(each, pa.array(np.concatenate(lens))),
                pa.array([size]), pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=blocks)

        for b in it:
            if not b.num_rows:
                continue
            n, part = b.column(1).to_numpy(), b.column(3)[0].as_py()
            ranks, ends = rank_of[_values(b.column(2), kind)], np.cumsum(n)
            at = taken = 0
            while at < len(n):
                # to the row that fills the block
                m = min(int(np.searchsorted(ends, taken + BLOCK_IDS - size)) + 1, at + (1 << 16) - held, len(n))
                docs.append(b.column(0).slice(at, m - at))
                lens.append(n[at:m])
                vals.append(ranks[taken:ends[m - 1]])
                held, size = held + m - at, size + int(ends[m - 1]) - taken
                at, taken = m, int(ends[m - 1])
                if size >= BLOCK_IDS or held >= 1 << 16:
                    yield done()
                    k, first, docs, lens, vals, size, held = k + 1, first + size, [], [], [], 0, 0
        if docs:
            yield done()

    map_batches(ordered, block, blocks).write.parquet(f"{out}/blocks")
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids) of each document in the files; ids packed
    as little-endian unsigned 32-bit integers, start = ids of all before it."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    id_of = np.array([r["id"] for r in spark.read.parquet(f"{folder}/id_of_rank").orderBy("rank").collect()], np.uint32)
    docs = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("local", pa.int64()),
                      ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(it):
        for b in it:
            for i in range(b.num_rows):
                part, at, n, control, data = (b.column(c)[i].as_py() for c in ("part", "first", "n_ids", "control", "data"))
                own, lens = b.column("doc_ids")[i].values, b.column("lengths")[i].values.to_numpy()
                ids = id_of[unpack(control, data, n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(lens), part, np.int32)), own, pa.array(at + np.cumsum(lens) - lens),
                    pa.array(lens), _binary(ids, lens)], schema=docs)

    # one row per part, that is, per writing task: its size does not follow the rows, so documents stay in place
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return map_batches(blocks.select("part", "first", "doc_ids", "lengths", "n_ids", "control", "data"), run, docs).join(
        F.broadcast(parts), "part").select("doc", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")
