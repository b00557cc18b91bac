"""Alignment of two tokenizers' tokens over a corpus, counted through external spills.

Each text is encoded by both tokenizers; the byte offsets where tokens of both end cut it into groups, and
every A and B token of a group are linked. How many documents hold a pair of ids linked is counted outside
memory: a task collects (pair, document) records, sorts ``SPILL`` of them at a time and writes a run, dealt by
the low bits of the A id into ``RADIX`` parts, each compressed with zstd. The runs of a part are merged through
a heap, at most about ``FAN`` at a time, over as many rounds as that takes. Pairs arrive ordered by A id first, so
the highest count of an A id is known when the next id begins, and the counted pairs leave as one stream a part.
Last, each run meets the counts of its part and adds up what its documents get: a large part is split by a
salt of the run, so no task holds more than ``MET_BYTES`` of runs, however frequent one A id is.

A text is cut before a space between two plain characters. No token of either tokenizer reaches over such a
place (A begins a new word there; B has no piece with a space after another character, which is checked), so
the pieces are encoded once and kept by each worker. A text of which any piece does not give its own bytes back is
encoded again as a whole.

Defined cases: a null or empty text, or one whose tokens do not give back the space and the text, has no
tokens: zeros and an empty digest; repeated rows and ids are judged row by row, and each row counts as a
document; null ids stay; an empty table gives no rows; other columns are left out of the result. Ids of both
vocabularies must be below 2**20.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.plans.scratch import discard, materialize

#: folder of the vocabulary files
TOKENIZERS = "/opt/tokenizers"
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: parts by A id, records of a run, runs merged at once, bytes of runs that meet their counts in one task
RADIX, SPILL, FAN, MET_BYTES = 32, 1 << 21, 64, 64 << 20
#: pieces a worker keeps, the longest of them, and the characters of a text that are cut into pieces at once
PIECES, PIECE_CHARS, SEGMENT = 250_000, 200, 1 << 20
#: pairs of a group above which they are listed by distinct ids
LARGE = 4096
#: characters below this are letters, numbers, white space or others alike for both engines of A
_PLAIN = "\u0250"
#: fixed value: the words that byte-level tokenizers merge within
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOW = RADIX.bit_length() - 1
_ID_BITS, _DOC_BITS = 20, 23
_BESIDE = re.compile("[!-~À-ɏ](?:[\0-ɏ]*[!-~À-ɏ])?")
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_ENTRY = np.dtype([("a", "<u4"), ("b", "<u4"), ("n", "<u8")])
_COUNTED = np.dtype([("pair", "<i8"), ("n", "<i8"), ("best", "?")])
_RECORD = np.dtype([("doc", "<u4"), ("links", "<u4")])
_MARKS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level entry: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Both tokenizers, from the bytes of their files.

    A is encoded by a faster engine with the merges of the same file where :func:`agrees` holds and the text has only
    characters below ``_PLAIN``, whose classes are the same in both engines; else by the file's own library.
    """

    def __init__(self, a_file: bytes, b_file: bytes, fast: bool = False):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        byte = _byte_of()
        special = {i: w.encode() for w, i in self.a.get_vocab().items() if not all(c in byte for c in w)}
        self.a_bytes = {i: bytes(byte[c] for c in w) for w, i in self.a.get_vocab().items() if i not in special} | special
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.quick = quick_engine(a_file) if fast else None
        self.top = max(max(self.a_bytes, default=0), len(pieces)) + 1
        if self.top > 1 << _ID_BITS:
            raise ValueError(f"token ids must be below {1 << _ID_BITS}")
        self.a_size = np.zeros(self.top, dtype=np.int64)
        self.b_size = np.zeros(self.top, dtype=np.int64)
        for i, w in self.a_bytes.items():
            self.a_size[i] = len(w)
        self.b_size[: len(pieces)] = [len(w) for w in self.b_bytes]
        #: each id followed by each of the signs between ids
        self.shown = [f"{i}{sign}" for i in range(self.top) for sign in ",|;\n"]

    def joined_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """A ids of space and each of some texts that may stand side by side, encoded as one text."""
        ids = self.quick.encode_to_numpy(" " + " ".join(texts)).astype(np.int64)
        ends = np.cumsum(self.a_size[ids])
        upto = np.cumsum([len(t.encode()) + 1 for t in texts])
        last = np.searchsorted(ends, upto)
        return (ids, np.diff(last + 1, prepend=0)) if (ends[last] == upto).all() else None

    def a_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space and each text one after the other, and how many each text has."""
        if self.quick is None:
            return _flat([x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)])
        encode, slow = self.quick.encode_ordinary, self.a.encode
        return _flat([encode(" " + t) if max(t, default=" ") < _PLAIN else slow(" " + t, add_special_tokens=False).ids for t in texts])

    def beside(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Texts that may stand between spaces beside others without changing their ids, and the others."""
        if self.quick is None or not self.cuts:
            return [], texts
        fits = list(map(_BESIDE.fullmatch, texts))
        return [t for t, f in zip(texts, fits) if f], [t for t, f in zip(texts, fits) if not f]

    def b_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.b.encode(texts, num_threads=1))


def _flat(some: list) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(some), dtype=np.int64), np.array([len(x) for x in some], dtype=np.int64)


def quick_engine(a_file: bytes):
    """The byte-level merges of a tokenizer file in the faster engine; None where the file has other steps."""
    import json

    import tiktoken

    told = json.loads(a_file)
    split, model = told["pre_tokenizer"] or {}, told["model"]
    plain = told["normalizer"] is None and model["type"] == "BPE" and split.get("type") == "ByteLevel"
    if not plain or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    byte = _byte_of()
    special = {t["id"] for t in told["added_tokens"]}
    ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if i not in special}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):  # the engine merges by id
        return None
    return tiktoken.Encoding("side_a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


def agrees(a_file: bytes) -> bool:
    """Whether the faster engine encodes every entry of the vocabulary as the file's own library does."""
    from tokenizers import Tokenizer

    quick, own = quick_engine(a_file), Tokenizer.from_str(a_file.decode())
    if quick is None:
        return False
    own.encode_special_tokens = True
    byte = _byte_of()
    texts = [bytes(byte[c] for c in w).decode(errors="ignore") for w in own.get_vocab() if all(c in byte for c in w)]
    return [x.ids for x in own.encode_batch(texts, add_special_tokens=False)] == [quick.encode_ordinary(t) for t in texts]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of pairs inside the runs: part, A id, B id."""
    a = a.astype(np.int64)
    return ((a & (RADIX - 1)) << (2 * _ID_BITS - _LOW)) | ((a >> _LOW) << _ID_BITS) | b.astype(np.int64)


class _Pieces:
    """Aligned pieces that a worker has met: counts, rendered groups and linked pairs."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.times_cleared += 1
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.marks = np.zeros((0, 4), dtype=np.int64)
        self.ends = np.zeros(1, dtype=np.int64)
        self.pairs, self.links = np.zeros((2, 0), dtype=np.int64)
        self.size = self.n_pairs = 0

    def _append(self, shown: list[str], marks: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> None:
        def room(x: np.ndarray, n: int) -> np.ndarray:
            return x if n <= len(x) else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), dtype=x.dtype)])

        n, m = self.size + len(shown), self.n_pairs + len(pairs)
        self.marks, self.ends, self.pairs, self.links = room(self.marks, n), room(self.ends, n + 1), room(self.pairs, m), room(self.links, m)
        self.marks[self.size : n] = marks
        self.ends[self.size + 1 : n + 1] = self.n_pairs + np.cumsum(sizes)
        self.pairs[self.n_pairs : m], self.links[self.n_pairs : m] = pairs, links
        self.shown += shown
        self.size, self.n_pairs = n, m

    def learn(self, new: list[str]) -> None:
        """Align pieces; one that does not give its bytes back gets the number -1."""
        encoder = self.encoder
        beside, other = encoder.beside(new)
        joined = encoder.joined_ids(beside) if beside else None
        if joined is not None:
            new = beside + other
            a_flat, a_counts = (np.concatenate(x) for x in zip(joined, encoder.a_ids(other)))
        else:
            a_flat, a_counts = encoder.a_ids(new)
        b_flat, b_counts = encoder.b_ids(new)
        flat, counts = [a_flat, b_flat], [a_counts, b_counts]
        wanted = [(" " + p).encode() for p in new]
        size = np.array([len(w) for w in wanted])
        lengths = [self.encoder.a_size[flat[0]], self.encoder.b_size[flat[1]]]
        good = np.ones(len(new), dtype=bool)
        for n, long in zip(counts, lengths):
            good &= np.bincount(np.repeat(np.arange(len(new)), n), weights=long, minlength=len(new)) == size
        whole = b"".join(wanted)
        tables = encoder.a_bytes, encoder.b_bytes
        if not good.all() or any(b"".join(map(t.__getitem__, f.tolist())) != whole for t, f in zip(tables, flat)):
            for t, f, n in zip(tables, flat, counts):
                parts = np.split(f, np.cumsum(n)[:-1])
                good &= np.array([b"".join(map(t.__getitem__, x.tolist())) == w for x, w in zip(parts, wanted)])
            keep = np.flatnonzero(good).tolist()
            self.number.update((p, -1) for p, ok in zip(new, good) if not ok)
            if keep:
                self.learn([new[k] for k in keep])
            return
        self.number.update(zip(new, range(self.size, self.size + len(new))))
        self._append(*self.aligned(flat, counts, lengths, size))

    def aligned(self, flat: list, counts: list, lengths: list, size: np.ndarray):
        """(rendered groups, marks, pairs of each piece, pairs, links) of pieces whose tokens lie one after the other."""
        ends = [np.cumsum(x) for x in lengths]
        both = np.zeros((2, int(size.sum()) + 1), dtype=bool)
        for k in (0, 1):
            both[k, ends[k]] = True
        last = [both[1, ends[0]], both[0, ends[1]]]  # whether a token ends its group
        group = [np.cumsum(x) - x for x in last]
        n_groups = int(last[0].sum())
        n = [np.bincount(g, minlength=n_groups) for g in group]
        first = [np.cumsum(x) - x for x in n]
        piece_ends = np.cumsum(size)
        piece = np.searchsorted(piece_ends, ends[0][last[0]])  # of each group
        # every A token with every B token of its group; large groups by their distinct ids
        large = np.flatnonzero(n[0] * n[1] > LARGE)
        times = np.where(n[0] * n[1] > LARGE, 0, n[1])[group[0]]
        at = np.repeat(first[1][group[0]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        owner = [np.repeat(piece[group[0]], times)]
        pairs, links = [pair_keys(np.repeat(flat[0], times), flat[1][at])], [np.ones(len(at), dtype=np.int64)]
        for g in large.tolist():
            (x, of_x), (y, of_y) = (np.unique(flat[k][first[k][g] : first[k][g] + n[k][g]], return_counts=True) for k in (0, 1))
            pairs.append(pair_keys(np.repeat(x, len(y)), np.tile(y, len(x))))
            links.append((of_x[:, None] * of_y).ravel())
            owner.append(np.full(len(pairs[-1]), piece[g]))
        owner, pairs, links = (np.concatenate(x) for x in (owner, pairs, links))
        if len(large):
            order = np.argsort(owner, kind="stable")
            owner, pairs, links = owner[order], pairs[order], links[order]
        marks = np.stack([*counts, np.bincount(piece, minlength=len(size)), np.bincount(piece, weights=n[0] * n[1], minlength=len(size)).astype(np.int64)], axis=1)
        # ids in the order of groups, A before B, each with the sign that follows it
        code = np.empty(len(flat[0]) + len(flat[1]), dtype=np.int64)
        code[np.arange(len(flat[0])) + first[1][group[0]]] = flat[0] * 4 + last[0]
        closing = np.where(np.append(piece[1:] != piece[:-1], True), 3, 2)[group[1]] if n_groups else np.zeros(0, dtype=np.int64)
        code[np.arange(len(flat[1])) + (first[0] + n[0])[group[1]]] = flat[1] * 4 + np.where(last[1], closing, 0)
        shown = "".join(map(self.encoder.shown.__getitem__, code.tolist())).split("\n")[:-1]
        return shown, marks, np.bincount(owner, minlength=len(size)), pairs, links

    def meet(self, pieces: list[str]) -> None:
        """Learn what is new among some pieces."""
        new = set(pieces).difference(self.number)
        if self.size + len(new) > PIECES or any(len(p) > PIECE_CHARS for p in self.long):
            self.clear()
            new = set(pieces)
        self.long = [p for p in new if len(p) > PIECE_CHARS]
        if new:
            self.learn(list(new))

    long: list[str] = []
    times_cleared = 0

    def read(self, pieces: list[str]):
        """(marks, rendered groups, pairs, links) of consecutive pieces that were met; None where one does not give its bytes back."""
        at = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if at.min() < 0:
            return None
        shown = ";".join(map(self.shown.__getitem__, at.tolist()))
        some, times = np.unique(at, return_counts=True)
        first = self.ends[some]
        size = self.ends[some + 1] - first
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return times @ self.marks[some], shown, self.pairs[place], self.links[place] * np.repeat(times, size)


def segments(text: str, cuts: bool) -> Iterator[list[str]]:
    """The pieces of a text, some at a time."""
    at = 0
    while cuts and len(text) - at > SEGMENT and (found := _CUT.search(text, at + SEGMENT)):
        yield _CUT.split(text[at : found.start()])
        at = found.end()
    rest = text[at:]
    yield _CUT.split(rest) if cuts else [rest]


def align_text(pieces: _Pieces, text: str | None, met: list[str] | None = None):
    """(marks, digest, pairs, links) of a text; None without tokens. A pair may stand in several rows.

    ``met``: the pieces of a text of one segment, where they are known and met.
    """
    if not text:
        return None
    for parts in (segments(text, pieces.encoder.cuts) if met is None else iter([met]), iter([[text]])):
        digest, marks, pairs, links = hashlib.sha256(), np.zeros(4, dtype=np.int64), [], []
        for k, some in enumerate(parts):
            if some is not met:
                pieces.meet(some)
            read = pieces.read(some)
            if read is None:
                break
            marks = marks + read[0]
            digest.update((";" * (k > 0) + read[1]).encode())
            pairs.append(read[2])
            links.append(read[3])
        else:
            return marks, digest.hexdigest(), np.concatenate(pairs), np.concatenate(links)
    return None


def align_texts(pieces: _Pieces, texts: list[str | None]) -> Iterator:
    """:func:`align_text` of each text; short texts meet their new pieces together."""
    at = 0
    while at < len(texts):
        if len(texts[at] or "") > SEGMENT:
            yield align_text(pieces, texts[at])
            at += 1
            continue
        some, size = [], 0
        while at < len(texts) and size <= SEGMENT and len(texts[at] or "") <= SEGMENT:
            text = texts[at]
            some.append((text, next(segments(text, pieces.encoder.cuts)) if text else []))
            size += len(text or "")
            at += 1
        pieces.meet(list(chain.from_iterable(x[1] for x in some)))
        cleared = pieces.times_cleared
        for text, parts in some:  # one that is read again as a whole may make the worker forget the pieces of the others
            yield align_text(pieces, text, parts if cleared == pieces.times_cleared else None)


def _packed(rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rows).tobytes())


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def sorted_run(keys: np.ndarray, links: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, entries, records) of a run: entries (pair, number of documents), records (document, links) in their order."""
    keys, links = _summed(keys, links)
    pair, doc = keys >> _DOC_BITS, keys & ((1 << _DOC_BITS) - 1)
    part = pair >> (2 * _ID_BITS - _LOW)
    edges = np.searchsorted(part, np.arange(RADIX + 1))
    for r in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[r], edges[r + 1])
        first = np.flatnonzero(np.diff(pair[own], prepend=-1))
        entries = np.empty(len(first), dtype=_ENTRY)
        entries["a"], entries["b"] = _ids(pair[own][first])
        entries["n"] = np.diff(np.append(first, own.stop - own.start))
        records = np.empty(own.stop - own.start, dtype=_RECORD)
        records["doc"], records["links"] = doc[own], np.minimum(links[own], 2**32 - 1)
        yield r, _packed(entries), _packed(records)


def _ids(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, b = pair >> (2 * _ID_BITS - _LOW), pair & ((1 << _ID_BITS) - 1)
    high = (pair >> _ID_BITS) & ((1 << (_ID_BITS - _LOW)) - 1)
    return (high << _LOW) | low, b


_encoders: dict[int, _Pieces] = {}


def _spiller(files, id_type: pa.DataType, limit: int):
    fields = ["run", "local", "doc_id", *_MARKS, "groups_sha256", "part", "entries", "records"]
    types = dict(zip(fields, [pa.int64(), pa.int32(), id_type, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.binary(), pa.binary()]))

    def rows(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), type=t) for c, t in types.items()], names=fields
        )

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(files.value)
        if key not in _encoders:  # a worker keeps its tokenizers from task to task
            _encoders.clear()
            _encoders[key] = _Pieces(Encoder(*files.value))
        pieces = _encoders[key]
        run, local, size = TaskContext.get().partitionId() << 32, 0, 0
        keys: list[np.ndarray] = []
        links: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if size:
                for part, entries, records in sorted_run(np.concatenate(keys), np.concatenate(links)):
                    yield rows(1, {"run": [run], "part": [part], "entries": [entries], "records": [records]})

        for batch in batches:
            out: dict[str, list] = {c: [] for c in ["run", "local", *_MARKS, "groups_sha256"]}
            for found in align_texts(pieces, batch.column(1).to_pylist()):
                marks, digest = ([0] * 4, "") if found is None else (found[0].tolist(), found[1])
                for c, v in zip(out, [run, local, *marks, digest]):
                    out[c].append(v)
                if found is not None:
                    keys.append((found[2] << _DOC_BITS) | local)
                    links.append(found[3])
                    size += len(found[2])
                local += 1
                if size >= limit or local == 1 << _DOC_BITS:
                    yield from flush()
                    keys, links, size, local, run = [], [], 0, 0, run + 1
            if batch.num_rows:
                yield rows(batch.num_rows, out | {"doc_id": batch.column(0)})
        yield from flush()

    return spill


_SPILLED = T.StructType().add("run", T.LongType()).add("local", T.IntegerType())


def spill_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, spill: int = SPILL) -> DataFrame:
    """A written table: rows of documents (run, local, doc_id, n_a ...) and of run parts (run, part, entries, records)."""
    from pyspark.sql.pandas.types import to_arrow_type

    a_file, b_file = (open(f"{folder}/{f}", "rb").read() for f in (SIDE_A, SIDE_B))
    files = docs.sparkSession.sparkContext.broadcast((a_file, b_file, agrees(a_file)))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([*_SPILLED.fields, T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in _MARKS)])
    schema = schema.add("groups_sha256", T.StringType()).add("part", T.IntegerType()).add("entries", T.BinaryType()).add("records", T.BinaryType())
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_spiller(files, to_arrow_type(kind), spill), schema), "runs")


def read_entries(packed: bytes, at_once: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """(pair, n) of one run part, unpacked some at a time."""
    with zstandard.ZstdDecompressor().stream_reader(packed) as stream:
        left = b""
        while data := stream.read(at_once * _ENTRY.itemsize):
            data = left + data
            whole = len(data) - len(data) % _ENTRY.itemsize
            rows, left = np.frombuffer(data[:whole], dtype=_ENTRY), data[whole:]
            yield from zip(((rows["a"].astype(np.int64) << _ID_BITS) | rows["b"]).tolist(), rows["n"].tolist())


def merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Every pair of some runs with its sum, in order, through a heap of their heads."""
    heads = [read_entries(r) for r in runs]
    heap = [(*first, k) for k, h in enumerate(heads) if (first := next(h, None)) is not None]
    heapq.heapify(heap)
    now, total = -1, 0
    while heap:
        pair, n, k = heap[0]
        following = next(heads[k], None)
        if following is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, (*following, k))
        if pair != now:
            if now >= 0:
                yield now, total
            now, total = pair, 0
        total += n
    if now >= 0:
        yield now, total


def with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(pair, n, whether n is the highest of its A id), from pairs in order."""
    for _, own in groupby(pairs, key=lambda x: x[0] >> _ID_BITS):
        own = list(own)
        top = max(n for _, n in own)
        yield from ((pair, n, n == top) for pair, n in own)


def _merger(last: bool):
    def flush(part: int, group: int, runs: list[bytes]) -> pa.RecordBatch:
        if last:
            rows = np.fromiter(with_best(merged(runs)), dtype=_COUNTED)
        else:
            pairs = np.fromiter(merged(runs), dtype=[("pair", "<i8"), ("n", "<i8")])
            rows = np.empty(len(pairs), dtype=_ENTRY)
            rows["a"], rows["b"], rows["n"] = pairs["pair"] >> _ID_BITS, pairs["pair"] & ((1 << _ID_BITS) - 1), pairs["n"]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([group], pa.int64()), pa.array([_packed(rows)], pa.binary())], names=["part", "run", "entries"]
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, group, packed in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if now is not None and now != (part, group):
                    yield flush(*now, held)
                    held = []
                now = part, group
                held.append(packed)
        if held:
            yield flush(*now, held)

    return merge


def count_pairs(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """(part, run 0, entries): the counted pairs of each part, of the run parts (run, part, entries)."""
    left = runs.select("run").distinct().count()
    now = runs.select("part", "run", "entries")
    while True:
        groups = -(-left // fan)
        group = F.pmod(F.xxhash64("run"), F.lit(max(1, groups)))
        dealt = now.select("part", group.alias("run"), "entries").repartition("part", "run").sortWithinPartitions("part", "run")
        after = materialize(dealt.mapInArrow(_merger(groups <= 1), "part int, run long, entries binary"), "merged")
        if now is not runs:
            discard(now)
        if groups <= 1:
            return after
        now, left = after, groups


def pair_counts(counted: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best) rows of the counted parts."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                rows = _unpacked(packed.as_py(), _COUNTED)
                columns = [rows["pair"] >> _ID_BITS, rows["pair"] & ((1 << _ID_BITS) - 1), rows["n"], rows["best"]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["a_id", "b_id", "n_docs", "best"])

    return counted.select("entries").mapInArrow(unpack, "a_id long, b_id long, n_docs long, best boolean")


def _unpacked(packed: bytes, dtype: np.dtype) -> np.ndarray:
    with zstandard.ZstdDecompressor().stream_reader(packed) as stream:
        return np.frombuffer(stream.read(), dtype=dtype)


def contributions(entries: np.ndarray, records: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, links to best pairs, sum of counts over links) of one run part."""
    pair = (entries["a"].astype(np.int64) << _ID_BITS) | entries["b"]
    at = np.searchsorted(counted["pair"], pair)
    size = entries["n"].astype(np.int64)
    links = records["links"].astype(np.int64)
    best, total = np.repeat(counted["best"][at], size) * links, np.repeat(counted["n"][at], size) * links
    docs, where = np.unique(records["doc"], return_inverse=True)
    sums = np.zeros((2, len(docs)), dtype=np.int64)
    np.add.at(sums[0], where, best)
    np.add.at(sums[1], where, total)
    return docs.astype(np.int32), sums[0], sums[1]


def _giver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, salt, counted, run, entries, records) in order: the counts of a part, then its runs."""
    counted = None
    for batch in batches:
        for _, _, first, run, entries, records in zip(*(batch.column(c) for c in range(6))):
            if first.as_py():
                counted = _unpacked(entries.as_py(), _COUNTED)
                continue
            found = contributions(_unpacked(entries.as_py(), _ENTRY), _unpacked(records.as_py(), _RECORD), counted)
            yield pa.RecordBatch.from_arrays(
                [run_of(run, 1), *(pa.array([x.tobytes()], pa.binary()) for x in found)], names=["run", "docs", "best", "total"]
            )


def run_of(run: pa.Scalar, n: int) -> pa.Array:
    return pa.array([run.as_py()] * n, pa.int64())


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, docs, best, total) in the order of runs; sums by document."""

    def flush(run: int, held: list) -> pa.RecordBatch:
        docs = np.concatenate([np.frombuffer(x[0], dtype=np.int32) for x in held])
        some, where = np.unique(docs, return_inverse=True)
        sums = np.zeros((2, len(some)), dtype=np.int64)
        for k in (0, 1):
            np.add.at(sums[k], where, np.concatenate([np.frombuffer(x[k + 1], dtype=np.int64) for x in held]))
        columns = [pa.array(np.full(len(some), run)), pa.array(some), pa.array(sums[0]), pa.array(sums[1])]
        return pa.RecordBatch.from_arrays(columns, names=["run", "local", "n_best", "count_sum"])

    now, held = None, []
    for batch in batches:
        for run, *found in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if held and run != now:
                yield flush(now, held)
                held = []
            now = run
            held.append(found)
    if held:
        yield flush(now, held)


def align(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, spill: int = SPILL, fan: int = FAN, met_bytes: int = MET_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and :func:`pair_counts`."""
    spilled = spill_runs(docs, doc_id, text, folder, spill)
    runs = spilled.where("part is not null").select("run", "part", "entries", "records")
    counted = count_pairs(runs, fan)
    size = runs.agg(F.sum(F.length("records") + F.length("entries")).alias("n")).first().n or 0
    salts = 1 + size // (RADIX * met_bytes)
    salt = F.pmod(F.xxhash64("run"), F.lit(salts))
    none = F.lit(None).cast("binary")
    first = counted.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
                           F.lit(True).alias("first"), F.lit(0).cast("long").alias("run"), "entries", none.alias("records"))
    then = runs.select("part", salt.alias("salt"), F.lit(False).alias("first"), "run", "entries", "records")
    met = first.unionByName(then).repartition("part", "salt").sortWithinPartitions("part", "salt", F.desc("first"))
    given = met.mapInArrow(_giver, "run long, docs binary, best binary, total binary")
    summed = given.repartition("run").sortWithinPartitions("run").mapInArrow(_adder, "run long, local int, n_best long, count_sum long")
    own = spilled.where("part is null").select("run", "local", "doc_id", *_MARKS, "groups_sha256")
    zero = F.lit(0).cast("long")
    out = own.join(summed, ["run", "local"], "left").select(
        "doc_id", *_MARKS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
    return out, pair_counts(counted)


def report(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
