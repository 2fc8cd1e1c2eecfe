"""Token ids in Arrow stream files of fixed-size lists (operator 2).

Documents are ordered by id over shards (range partitions).  A shard is one file whose
record batches have two columns, ``ids`` (fixed-size list of 16- or 32-bit integers) and
``mask`` (fixed-size list of booleans: real token or padding at the shard's end), and a
second file with the first id and the number of ids of each document.  Both are written
with the Arrow file framing, uncompressed, so a reader maps a file and reaches any
sequence without copying or decoding what is before it.

Files are written under an attempt's own name and renamed, so a repeated task leaves one
complete file.  Null text: only the end id.  Null ids come first; rows of equal id are
ordered by text.  Empty table: no file, no row.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopeforge.session import materialize, qualified, shared_dir

from .common import remembered, table, text_buffer, text_slices

#: Ids of a sequence, and sequences of a record batch.
SEQUENCE = 2048
BATCH_SEQUENCES = 64
#: Bytes of text whose distinct parts are looked up together.
TEXT_BYTES = 8 << 20
#: Chunks whose ids are put together at a time.
GATHERED = 1 << 17
#: Distinct chunks whose ids a worker remembers.
CACHE_CHUNKS = 600_000
END_ID = 0
_SPACES = re.compile(r"\s\s")


#: Classes of characters as the byte-level pre-tokeniser tells them apart; a character that
#: is none of them for certain is _OTHER, and there is no cut beside it.
_OTHER, _SPACE, _LINE, _LETTER, _DIGIT, _MARK, _QUOTE, _HIGH = range(8)


def _classes() -> np.ndarray:
    out = np.full(256, _HIGH, np.uint8)  # not white, but of unknown kind
    out[:128] = [_LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK for c in map(chr, range(128))]
    out[:32] = out[127] = _OTHER
    out[9:14], out[32], out[ord("'")] = _LINE, _SPACE, _QUOTE
    return out


def _pairs() -> np.ndarray:
    """Whether a text may be cut between characters of two classes (first * 8 + second).  A
    pre-token is letters, digits or marks, with a space in front, or white space; marks that
    end in a quote can take letters along ('s, 're).  After white space see ``cuts``."""
    out = np.zeros((8, 8), bool)
    out[_LETTER:, [_SPACE, _LINE]] = True
    for kind in (_LETTER, _DIGIT, _MARK):
        out[kind, [k for k in (_LETTER, _DIGIT, _MARK, _QUOTE) if k != kind]] = True
    out[_MARK, _QUOTE] = False
    return out.ravel()


_CLASS, _PAIR = _classes(), _pairs()
#: Lead bytes of U+00C0 to U+024F, letters but for two, and of the white space beyond ASCII.
_LATIN = np.isin(np.arange(256), range(0xC3, 0xCA))
_WIDE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_ONE_WORD = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def classes_of(buf: np.ndarray) -> np.ndarray:
    """The class of each character of UTF-8 bytes, at each of its bytes."""
    out = _CLASS[buf]
    lead = np.flatnonzero(_LATIN[buf])
    second = buf[lead + 1]
    out[lead] = out[lead + 1] = np.where((buf[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7)), _HIGH, _LETTER)
    lead = np.flatnonzero(_WIDE[buf])
    first, second = buf[lead], buf[lead + 1]
    white = np.select([first == 0xC2, first == 0xE1, first == 0xE2],
                      [(second == 0x85) | (second == 0xA0), (second == 0x9A) | (second == 0xA0),
                       (second == 0x80) | (second == 0x81)], second == 0x80)
    lead = lead[white]
    third = buf[np.where(buf[lead] == 0xC2, lead, lead + 2)]
    lead = lead[~((buf[lead] == 0xE2) & (buf[lead + 1] == 0x80)  # dashes and quotation marks
                  & (((third >= 0x90) & (third < 0xA8)) | (third >= 0xB0)))]
    long = lead[buf[lead] != 0xC2]
    out[lead] = out[lead + 1] = out[long + 2] = _OTHER
    return out


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte of the texts at ``off``: at a text's start and
    where, whatever is before and after, a pre-token ends.  A run of white space gives its
    last character to what follows, unless it is one character that is not a space."""
    n = len(buf)
    kind = classes_of(buf)
    out = np.zeros(n, bool)
    out[1:] = _PAIR[kind[:-1] << 3 | kind[1:]]
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    line = np.flatnonzero(kind[:-1] == _LINE)
    line = line[(kind[line + 1] >= _LETTER) & (begins[line] | (kind[line - 1] >= _LETTER))]
    out[line + 1] = True
    return out | begins[:n]


class ChunkTable:
    """Ids of text chunks, remembered.  Where the byte-level pre-tokeniser always ends a
    pre-token, a text can be cut; the ids of the parts are the ids of the text."""

    def __init__(self, tokenizer: str, limit: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer, self.limit = Tokenizer.from_file(tokenizer), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.vocabulary = max(vocabulary.values()) + 1
        #: Bytes of text that an id stands for: a character of a byte-level token is a byte.
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.encode()) if token in self.added else len(token)
        form = json.loads(self.tokenizer.to_str())
        split = form["pre_tokenizer"] or {}
        #: Whether the pre-tokeniser is the one that ``cuts`` is made for.
        self.plain = (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                      and not split["add_prefix_space"] and not form["normalizer"])
        text = "".join(map(chr, [*range(0x21), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]))
        letters = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]
        #: The character that the model has for each byte of ``_ONE_WORD`` and white space.
        self.letter = np.zeros(256, "<u4")
        self.letter[np.frombuffer(text.encode(), np.uint8)] = [*map(ord, letters)]
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        #: Calls that found each chunk here.
        self.found = np.zeros(0, np.uint16)

    def forget(self) -> None:
        """Keep the half of the table, at most, that was found most often; most chunks come once."""
        order = np.sort(self.found)
        least = max(1, int(order[-(self.limit // 2)]) + 1 if len(order) > self.limit // 2 else 1)
        rows = np.flatnonzero(self.found >= least)
        n = np.diff(self.start)[rows]
        ends = np.cumsum(n)
        keep = np.zeros(len(self.found), bool)
        keep[rows] = True
        self.ids = self.ids[np.repeat(self.start[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.start = np.concatenate([[0], ends])
        chunks = [c for c, kept in zip(self.row, keep.tolist()) if kept]  # a dict is in order of its rows
        self.row = dict(zip(chunks, range(len(chunks))))
        self.found = np.zeros(len(chunks), np.uint16)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of chunks that are one word each: one pre-token, which the model takes as it is."""
        spelled = self.letter[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w)] for w in spelled.split(chr(self.letter[10]))]

    def _add(self, new: set[str]) -> None:
        """Of chunks that are not one word, those that begin with one space and end with
        another character are encoded as one text, each being cut off in front of its space,
        and told apart by bytes."""
        words = [c for c in new if _ONE_WORD.fullmatch(c)] if self.plain else []
        rest = new.difference(words)
        joins = [c for c in rest if c[1:] == c.strip() and len(c) > 1 and c[0] == " "]
        alone = list(rest.difference(joins))
        if joins:
            ids = np.array(self.encode(["".join(joins)])[0], np.uint32)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, joins)), np.int64, len(joins)))
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            self._put(joins, ids, ends)
        for chunks, got in ((words, words and self.words(words)), (alone, alone and self.encode(alone))):
            if chunks:
                self._put(chunks, np.fromiter(chain.from_iterable(got), np.uint32), np.cumsum([*map(len, got)]))

    def _put(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.row.update(zip(chunks, range(len(self.row), len(self.row) + len(chunks))))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + ends])
        self.found = np.concatenate([self.found, np.zeros(len(chunks), np.uint16)])

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The row of each chunk, after the new ones are added."""
        need = set(filterfalse(self.row.__contains__, chunks))
        known = len(self.row)
        if need:
            if known + len(need) > self.limit:
                self.forget()
                known = len(self.row)
                need = set(filterfalse(self.row.__contains__, chunks))
            self._add(need)
        rows = np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))
        self.found[rows[rows < known]] += 1  # once a call
        return rows

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each row."""
        out, count = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(rows), GATHERED):
            own = rows[at:at + GATHERED]
            first, n = self.start[own], self.start[own + 1] - self.start[own]
            ends = np.cumsum(n)
            out.append(self.ids[np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))])
            count.append(n)
        return np.concatenate(out), np.concatenate(count)

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.ids_of(self.rows(chunks))


def chunk_table(tokenizer: str) -> ChunkTable:
    """The table of this worker process, shared by its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return remembered(f"chunks {tokenizer}", lambda: ChunkTable(tokenizer))


def cut_at_spaces(text: str) -> list[str]:
    """Parts of ``text``, each but the first with its leading space; white space other
    than single spaces stays inside a part."""
    if not _SPACES.search(text) and "\0" not in text:
        return text.replace(" ", "\0 ").split("\0")
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and held and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held = f"{held} {p}"
    out.append(held)
    return out


def encode_documents(texts: list[str] | pa.Array, chunks: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    """All ids (without end ids) and the number of ids of each document.

    Texts are cut on their bytes and the chunks told apart by Arrow, so that only distinct
    ones become Python strings; texts that may hold an added token are cut at spaces."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    buf, off = text_buffer(column)
    if not len(buf):
        return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
    if chunks.plain:
        begins = cuts(buf, off)
        odd = np.zeros(len(column), bool)
        for token in chunks.added:
            odd |= pc.match_substring(column, token).fill_null(False).to_numpy(zero_copy_only=False)
    else:
        begins, odd = np.zeros(len(buf), bool), np.ones(len(column), bool)
    for i in np.flatnonzero(odd & (np.diff(off) > 0)).tolist():
        ends = np.cumsum([len(c.encode()) for c in cut_at_spaces(column[i].as_py())])
        begins[off[i]:off[i + 1]] = False
        begins[off[i]] = True
        begins[off[i] + ends[:-1]] = True
    starts = np.flatnonzero(begins)
    spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf))),
                                               pa.py_buffer(buf)).dictionary_encode()
    rows = chunks.rows(spelled.dictionary.to_pylist())
    ids, n = chunks.ids_of(rows[spelled.indices.to_numpy()])
    total = np.concatenate([[0], np.cumsum(n)])
    return ids, np.diff(total[np.searchsorted(starts, off)])


class _Store:
    """Shard files on any file system that Arrow opens by URI."""

    def __init__(self, uri: str):
        from pyarrow import fs
        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def put(self, name: str, write) -> None:
        tmp = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(tmp) as out:
            write(out)
        self.fs.move(tmp, f"{self.root}/{name}")

    def get(self, name: str) -> pa.ipc.RecordBatchFileReader:
        from pyarrow import fs
        path = f"{self.root}/{name}"
        source = pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path)
        return pa.ipc.open_file(source)


def _batches(ids: np.ndarray, sequence: int, schema: pa.Schema):
    """Record batches of whole sequences; ``ids`` is padded to a multiple by the caller."""
    kind = schema.field("ids").type.value_type
    step = sequence * BATCH_SEQUENCES
    for at in range(0, len(ids[0]), step):
        part, real = ids[0][at:at + step], ids[1][at:at + step]
        yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part, kind), sequence),
                               pa.FixedSizeListArray.from_arrays(pa.array(real), sequence)], schema=schema)


def write_token_files(docs: DataFrame, tokenizer: str, uri: str, sequence: int = SEQUENCE,
                      end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as shards below ``uri`` in ascending id order.
    Returns, once written, (shard, name, documents, tokens), one row per file."""
    spark = docs.sparkSession

    def shard(batches):
        from pyspark import TaskContext
        chunks = chunk_table(tokenizer)
        wide = max(chunks.vocabulary, end_id + 1) > 1 << 16
        kind, np_kind = (pa.uint32(), np.uint32) if wide else (pa.uint16(), np.uint16)
        schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        number, store = TaskContext.get().partitionId(), _Store(uri)
        name = f"shard-{number:06d}.arrow"
        index: list[tuple[pa.Array, np.ndarray]] = []

        def tokens():
            for batch in batches:
                for part in text_slices(batch, "text", TEXT_BYTES):
                    ids, n = encode_documents(part.column("text"), chunks)
                    index.append((part.column("doc_id"), n + 1))
                    yield np.insert(ids, np.cumsum(n), end_id).astype(np_kind)

        first = next(tokens_of := tokens(), None)
        if first is None:
            return

        def write(out):
            held = [first]
            size = len(first)
            step = sequence * BATCH_SEQUENCES
            with pa.ipc.new_file(out, schema) as sink:
                for ids in tokens_of:
                    held.append(ids)
                    size += len(ids)
                    if size >= step:
                        flat = np.concatenate(held)
                        whole = len(flat) // step * step
                        for b in _batches((flat[:whole], np.ones(whole, bool)), sequence, schema):
                            sink.write_batch(b)
                        held, size = [flat[whole:]], len(flat) - whole
                flat = np.concatenate(held)
                pad = -len(flat) % sequence
                real = np.concatenate([np.ones(len(flat), bool), np.zeros(pad, bool)])
                flat = np.concatenate([flat, np.zeros(pad, np_kind)])
                for b in _batches((flat, real), sequence, schema):
                    sink.write_batch(b)

        store.put(name, write)
        lengths = np.concatenate([n for _, n in index])
        starts = np.cumsum(lengths) - lengths
        rows = pa.table({"doc_id": pa.chunked_array([c for c, _ in index]), "start": starts, "n_tokens": lengths})

        def write_index(out):
            with pa.ipc.new_file(out, rows.schema) as sink:
                sink.write_table(rows, max_chunksize=1 << 16)

        store.put(f"{name}.index", write_index)
        yield pa.record_batch({"shard": pa.array([number], pa.int32()), "name": pa.array([name]),
                               "documents": pa.array([len(lengths)], pa.int64()),
                               "tokens": pa.array([int(lengths.sum())], pa.int64())})

    ordered = (docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    written = ordered.mapInArrow(shard, "shard int, name string, documents long, tokens long")
    return materialize(written, "token-shards")


def read_token_files(shards: DataFrame, uri: str, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.
    ``start`` counts the ids of all earlier shards; there is one row per shard to add up."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = shards.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))

    def read(batches):
        store = _Store(uri)
        for batch in batches:
            for row in batch.to_pylist():
                file, index = store.get(row["name"]), store.get(f"{row['name']}.index")
                window, base, b = np.zeros(0, np.uint32), 0, 0
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    starts, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = np.zeros(len(n), np.int64)
                    for j, (s, k) in enumerate(zip(starts.tolist(), n.tolist())):
                        while s + k > base + len(window):
                            more = file.get_batch(b).column("ids")
                            b += 1
                            flat = more.values.to_numpy()[more.offset * more.type.list_size:
                                                          (more.offset + len(more)) * more.type.list_size]
                            keep = max(0, min(len(window), s - base))
                            window, base = np.concatenate([window[keep:], flat.astype("<u4")]), base + keep
                        crc[j] = zlib.crc32(window[s - base:s - base + k].data)
                    yield pa.record_batch({"doc_id": part.column("doc_id"), "start": pa.array(starts + row["before"]),
                                           "n_tokens": pa.array(n), "ids_crc32": pa.array(crc)})

    # the files are the unit of work
    many = at.repartition(max(1, shards.count()), "shard")
    return many.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    folder = f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex[:12]}"
    uri = qualified(spark, folder)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:"):]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    shards = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), uri)
    return read_token_files(shards, uri, kind)
