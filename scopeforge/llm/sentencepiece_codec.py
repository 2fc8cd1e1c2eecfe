"""SentencePiece encoding with source offsets, and decoding (operator 1).

Normalisation walks a text with the longest prefixes of the model's compiled character
map (a double-array trie), adds the dummy prefix, escapes spaces, and keeps for every
normalised byte the original span that it came from.  The normalised text is cut into
units in front of each run of spaces; when no piece of the model has a space behind
another character, no merge crosses such a cut, so a unit has the same pieces in every
text.  Units' pieces come from the library and are remembered; ids, pieces' lengths and
spans of whole documents are then gathered as arrays.

Each piece gets ``[begin, end)`` in bytes of the original text; a piece of the dummy
prefix alone is an empty span, and pieces that share one mapped prefix share its span.

Nulls and empty texts: no piece but the end id.  Repeated rows and ids are kept.  Only
the named columns are read, so further columns cannot clash.  Empty table: empty result.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remembered, table, text_buffer, text_slices

SPACE = "▁"
#: Distinct units that a worker remembers.
CACHE_UNITS = 200_000
#: Bytes of text that a task works on at a time: a piece takes about 40 bytes of arrays.
TASK_BYTES = 1 << 20
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie over UTF-8
    bytes whose values are places in a list of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist() if blob else []
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest mapped prefix at ``at`` and its value; 0 and 0 if none."""
        units, best, value = self.units, 0, 0
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return best, value

    def replacement(self, value: int) -> bytes:
        return self.replacements[value:self.replacements.index(b"\0", value)]


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        with open(path, "rb") as f:
            blob = f.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.dummy, self.squeeze, self.escape, char_map = True, True, True, b""
        self.suffix, self.unknown_surface = False, " ⁇ "
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.suffix = bool(trainer.get(24, 0))
                self.unknown_surface = trainer.get(44, self.unknown_surface.encode()).decode()
            elif number == 3:
                norm = dict(_fields(value))
                char_map = norm.get(2, b"")
                self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.map = CharacterMap(char_map)
        own = [p for p, k in zip(self.pieces, self.kinds) if k in (_NORMAL, _USER)]
        #: Whether texts may be cut in front of runs of spaces.
        self.cuts = (self.escape and self.dummy and not self.suffix and _USER not in self.kinds
                     and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in own))
        self.surface = [self.unknown_surface.encode() if k == _UNKNOWN else b"" if k == _CONTROL
                        else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode()
                        for p, k in zip(self.pieces, self.kinds)]
        self.controls = [i for i, k in enumerate(self.kinds) if k == _CONTROL]
        self.end = self.processor.eos_id()

    def normalise(self, text: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
        """The normalised text and, for each of its bytes, begin and end of its source.
        Without a character map the spans are None: they follow from the bytes alone."""
        if not text:
            return "", None, None
        if not self.map.units and not self.squeeze and SPACE not in text:
            if not self.escape:
                return " " * self.dummy + text, None, None
            return SPACE * self.dummy + text.replace(" ", SPACE), None, None
        data, at = text.encode(), 0
        parts: list[bytes] = []
        begins: list[int] = []
        ends: list[int] = []
        space = SPACE.encode() if self.escape else b" "

        def put(part: bytes, begin: int, end: int) -> None:
            parts.append(part)
            begins.extend([begin] * len(part))
            ends.extend([end] * len(part))

        pending: list[tuple[bytes, int, int]] = []
        while at < len(data):
            size, value = self.map.longest(data, at) if self.map.units else (0, 0)
            if size:
                part = self.map.replacement(value)
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                part = data[at:at + size]
            pending.append((part, at, at + size))
            at += size
        if self.squeeze:  # runs of spaces to one, none at either end
            kept: list[tuple[bytes, int, int]] = []
            after_space = True
            for part, begin, end in pending:
                body = part.lstrip(b" ") if after_space else part
                if body:
                    body = re.sub(rb" +", b" ", body)
                    kept.append((body, begin, end))
                    after_space = body.endswith(b" ")
            while kept and kept[-1][0].rstrip(b" ") != kept[-1][0]:
                body = kept[-1][0].rstrip(b" ")
                kept[-1:] = [(body, *kept[-1][1:])] if body else []
            pending = kept
        if self.dummy and pending:
            put(space, pending[0][1], pending[0][1])
        for part, begin, end in pending:
            put(part.replace(b" ", space), begin, end)
        return b"".join(parts).decode(), np.array(begins, np.int32), np.array(ends, np.int32)


class UnitTable:
    """Ids and lengths in normalised bytes of the pieces of units, remembered."""

    def __init__(self, model: Model, limit: int = CACHE_UNITS):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _add(self, new: list[str]) -> None:
        got = self.model.processor.encode([self._input(u) for u in new], out_type=int, num_threads=1)
        if self.model.cuts:  # the library's dummy prefix alone gives no piece
            got = [g or [self.model.processor.piece_to_id(SPACE)] for g in got]
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        counts = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((i for g in got for i in g), np.int32, int(counts.sum()))
        sizes = self._sizes[ids]
        # a piece that is unknown covers what the others of its unit leave
        if (ids == self._unknown).any():
            sizes = self._with_unknown(new, got)
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, sizes])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def _input(self, unit: str) -> str:
        """A cut unit without its first space, which the library's dummy prefix puts back."""
        return unit[1:] if self.model.cuts else unit

    @property
    def _unknown(self) -> int:
        return self.model.processor.unk_id()

    @property
    def _sizes(self) -> np.ndarray:
        if not hasattr(self, "_size_of"):
            self._size_of = np.array([1 if k == _BYTE else len(p.encode()) for p, k in
                                      zip(self.model.pieces, self.model.kinds)], np.int32)
        return self._size_of

    def _with_unknown(self, units: list[str], got: list[list[int]]) -> np.ndarray:
        sizes: list[int] = []
        for unit in units:
            proto = self.model.processor.encode(self._input(unit), return_type="proto")
            sizes += [len(SPACE.encode())] if not proto.pieces else [len(p.piece.encode()) if p.id == self._unknown else int(self._sizes[p.id])
                      for p in proto.pieces]
        return np.array(sizes, np.int32)

    def lookup(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        need = set(units)
        need.difference_update(self.row)
        if need:
            if len(self.row) + len(need) > self.limit:
                self.clear()
                need = set(units)
            self._add(list(need))
        rows = np.fromiter(map(self.row.__getitem__, units), np.int64, len(units))
        first, n = self.start[rows], self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], self.size[at], n


def unit_table(model_path: str) -> UnitTable:
    """The table of this worker process, shared by its tasks."""
    return remembered(f"units {model_path}", lambda: UnitTable(Model(model_path)))


def encode_texts(texts: list[str], units: UnitTable):
    """Ids, begins, ends (flat) and the number of pieces of each text, without end ids."""
    model = units.model
    forms = [model.normalise(t) for t in texts]
    if model.cuts:
        cut = [_UNIT.findall(f) if f else [] for f, _, _ in forms]
    else:
        cut = [[t] if f else [] for t, (f, _, _) in zip(texts, forms)]
    ids, sizes, n = units.lookup([u for parts in cut for u in parts])
    total = np.concatenate([[0], np.cumsum(n)])
    counts = np.diff(np.concatenate([[0], total[np.cumsum([len(c) for c in cut], dtype=np.int64)]]))
    ends = np.cumsum(sizes, dtype=np.int64)
    before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
    ends = ends - np.repeat(before, counts)  # in normalised bytes of the own text
    begins = ends - sizes
    own = begins, ends
    begins, ends = (begins, ends) if not len(ids) else _identity_spans(forms, begins, ends, counts, model)
    at = 0
    for (_, source_begin, source_end), k in zip(forms, counts.tolist()):
        if source_begin is not None and k:
            # a byte of a mapped prefix stands for the whole prefix
            begins[at:at + k], ends[at:at + k] = source_begin[own[0][at:at + k]], source_end[own[1][at:at + k] - 1]
        at += k
    return ids, begins, ends, counts


def _identity_spans(forms, begins, ends, counts, model: Model):
    """Spans without a character map: a space symbol of the normalised text is three
    bytes, and one byte of the source unless the source holds the symbol itself."""
    data = np.frombuffer("".join(f for f, _, _ in forms).encode(), np.uint8)
    if not model.escape:
        return begins - model.dummy, ends - model.dummy
    mark = np.frombuffer(SPACE.encode(), np.uint8)
    head = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        head[:len(data) - 2] = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    # bytes by which the normalised text up to a place is longer than the source
    longer = np.concatenate([[0], np.cumsum(head[:-1])]) * 2
    sizes = np.array([len(f.encode()) for f, _, _ in forms], np.int64)
    origin = np.cumsum(sizes) - sizes
    base = np.repeat(origin, counts)
    shift = longer[base]
    dummy = int(model.dummy)
    begin = begins - (longer[base + begins] - shift) - dummy * (begins > 0)
    end = ends - (longer[base + ends] - shift) - dummy
    return begin, end


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text",
           add_end: bool = True, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, begins, ends): ids of every text with an end id, and the original
    byte span of each piece (the end id has the empty span behind the text).  ``decoded``
    adds the text that the ids decode to, in the same task, so that the ids need not
    travel to another Python stage."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        units = unit_table(model_path)
        model = units.model
        for batch in batches:
            for part in text_slices(batch, text, TASK_BYTES):
                texts = part.column(text).fill_null("").to_pylist()
                ids, begins, ends, n = encode_texts(texts, units)
                off = np.concatenate([[0], np.cumsum(n)])
                if add_end:
                    sizes = np.diff(text_buffer(part.column(text))[1])
                    ids = np.insert(ids, off[1:], model.end)
                    begins, ends = np.insert(begins, off[1:], sizes), np.insert(ends, off[1:], sizes)
                    off = off + np.arange(len(off))
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x.astype(np.int32)))
                         for x in (ids, begins, ends)]
                names = [id_column, "ids", "begins", "ends"]
                if decoded:
                    back = [decode_ids(x.tolist(), model) for x in np.split(ids, off[1:-1])]
                    lists.append(pa.array(back, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([part.column(id_column), *lists], names=names)

    return docs.select(id_column, text).mapInArrow(
        run, f"`{id_column}` {kind}, ids array<int>, begins array<int>, ends array<int>" + ", decoded string" * decoded)


def decode_ids(ids: list[int], model: Model) -> str:
    """The text of a list of ids, as the library's decode gives it."""
    surface, kinds = model.surface, model.kinds
    if any(c in ids[:-1] for c in model.controls):
        return model.processor.decode(ids)  # a control id inside parts runs of byte pieces
    data = b"".join([surface[i] for i in ids])
    if model.dummy or model.squeeze:
        first = next((i for i in ids if kinds[i] != _CONTROL), None)
        if first is not None and kinds[first] == _NORMAL and model.pieces[first].startswith(SPACE):
            data = data[1:]
    try:
        return data.decode()
    except UnicodeDecodeError:
        return model.processor.decode(ids)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``decoded`` to rows with a column ``ids``."""
    def run(batches):
        model = unit_table(model_path).model
        for batch in batches:
            column = batch.column("ids")
            ids, off = column.flatten().to_numpy(), column.value_lengths().fill_null(0).to_numpy().cumsum()
            texts = [decode_ids(part.tolist(), model) for part in np.split(ids, off[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{_ddl(encoded)}, decoded string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode(table(spark, sf_dir, "documents"), model, decoded=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("bytes_covered"))
