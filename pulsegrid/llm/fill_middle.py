"""Fill-in-middle samples from texts stored as seekable compressed frames.

``store_frames`` keeps each text as independent zstandard frames of about ``FRAME_BYTES`` bytes of UTF-8, cut between code points,
and for every frame how many units and code points stand before it. A unit is a run of ASCII letters or any other single
code point; a unit belongs to the frame in which it starts, and a frame knows whether its first letters go on with the
run of the one before. So a cut at a number of units is found from the counts, and only its frame is decompressed.

``fill_in_middle`` draws cuts and form from hashes of the id and returns the output as frames again: frames without a cut are taken
over compressed, pieces around cuts and marks are compressed anew. Concatenated, they are one ordinary zstandard
stream. ``digests`` streams the frames in order, one in memory at a time, finds the marks in what it reads, and rebuilds the text
by seeking to prefix, middle and suffix; ``text_of`` returns an output as a string.

Every row is worked on alone: no shuffle, and memory for one compressed text and one frame beside Arrow's batch. Null texts
are empty, empty texts have no frames, zero units and form ``plain``. Null ids draw like an empty id. Repeated rows give the same
output each; a text of one long run is one unit over many frames. Empty tables give no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize
from pulsegrid.llm.common import whole

FRAME_BYTES = 1 << 16
LEVEL = 3
#: Rows of a batch that is returned hold at most about this many bytes.
BATCH_BYTES = 1 << 24
#: Marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

FRAMES_SCHEMA = (
    "doc_id long, marked boolean, n long, n_chars long, units array<long>, chars array<long>, joined array<boolean>, frames array<binary>"
)
OUTPUT_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
DIGEST_SCHEMA = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, n_frames int"
)


def unit_starts(data: np.ndarray, joined: bool) -> np.ndarray:
    """Which bytes start a unit; ``joined``: the byte before the first is a letter."""
    lower = data | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A) & (data < 0x80)
    before = np.empty_like(letter)
    if len(data):
        before[0], before[1:] = joined, letter[:-1]
    return ((data & 0xC0) != 0x80) & ~(letter & before)


def ends_in_letter(data: np.ndarray) -> bool:
    return bool(len(data)) and chr(data[-1]).isascii() and chr(data[-1]).isalpha()


def n_chars(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut between code points."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def _rows(make: Callable[[dict], tuple[dict, int]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map rows one by one, in batches of bounded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row, size = make({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})
                out.append(row)
                held += size
                if held >= BATCH_BYTES or len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def frames_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Frames and cumulative counts of every text; ``marked`` if it holds one of the marks."""
    text = whole(text_col)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("marked", pa.bool_()), ("n", pa.int64()), ("n_chars", pa.int64()), ("units", pa.list_(pa.int64())),
        ("chars", pa.list_(pa.int64())), ("joined", pa.list_(pa.bool_())), ("frames", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def make(row: dict) -> tuple[dict, int]:
            units, chars, joins, frames = [], [], [], []
            n = c = 0
            joined = False
            for piece in pieces(row["bytes"], frame_bytes):
                data = np.frombuffer(piece, np.uint8)
                units.append(n)
                chars.append(c)
                joins.append(joined)
                frames.append(packer.compress(piece))
                n += int(unit_starts(data, joined).sum())
                c += n_chars(data)
                joined = ends_in_letter(data)
            return ({"doc_id": row["doc_id"], "marked": row["marked"], "n": n, "n_chars": c, "units": units, "chars": chars,
                     "joined": joins, "frames": frames}, sum(map(len, frames)))

        yield from _rows(make, schema)(batches)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), marked.alias("marked"), text.cast("binary").alias("bytes"))
    return rows.mapInArrow(run, FRAMES_SCHEMA)


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``frames_of`` written to the shared folder and read from there."""
    return materialize(frames_of(docs, id_col, text_col))


def draws(id_col: Column) -> list[Column]:
    """The first four 8-digit groups of the hash of the id, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_columns(plain_share: int = 10, spm_share: int = 20) -> dict[str, Column]:
    """Form and the two cuts, in units, of rows with ``doc_id``, ``n`` and ``marked``."""
    h1, h2, h3, h4 = draws(F.col("doc_id"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= 100 - plain_share)
    return {
        "form": F.when(plain, PLAIN).when(h4 % 100 < spm_share, SPM).otherwise(PSM),
        "cut1": F.least(a, b), "cut2": F.greatest(a, b),
    }


class _Output:
    """Collects pieces into new frames and takes whole frames over as they are."""

    def __init__(self, packer: zstandard.ZstdCompressor):
        self.packer, self.frames, self.waiting, self.size = packer, [], [], 0

    def put(self, piece: bytes) -> None:
        self.waiting.append(piece)
        self.size += len(piece)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.size:
            self.frames.append(self.packer.compress(b"".join(self.waiting)))
        self.waiting, self.size = [], 0

    def take(self, frames: list[bytes]) -> None:
        if frames:
            self.flush()
            self.frames += frames


def locate(row: dict, cut: int, opened: Callable[[int], bytes]) -> tuple[int, int, int]:
    """Frame, byte in it and code points before the place where unit number ``cut`` starts (the end of the text if there is none)."""
    if cut >= row["n"]:
        return len(row["frames"]), 0, row["n_chars"]
    # The last frame with at most this many units before it; frames inside a long run start none and come before it.
    at = int(np.searchsorted(row["units"], cut, side="right")) - 1
    data = np.frombuffer(opened(at), np.uint8)
    byte = int(np.flatnonzero(unit_starts(data, row["joined"][at]))[cut - row["units"][at]])
    return at, byte, row["chars"][at] + n_chars(data[:byte])


def fill_in_middle(frames: DataFrame, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the output as ``frames``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, reader = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

        def make(row: dict) -> tuple[dict, int]:
            stored, size = row["frames"], sum(map(len, row["frames"]))
            head = {"doc_id": row["doc_id"], "n": row["n"], "form": row["form"], "prefix_chars": None, "middle_chars": None}
            if row["form"] == PLAIN:
                return head | {"frames": stored}, size
            seen: dict[int, bytes] = {}

            def opened(k: int) -> bytes:
                if k not in seen:
                    seen[k] = reader.decompress(stored[k])
                return seen[k]

            (f1, b1, c1), (f2, b2, c2) = (locate(row, row[cut], opened) for cut in ("cut1", "cut2"))
            out = _Output(packer)

            def span(start: tuple[int, int], end: tuple[int, int]) -> None:
                (f, b), (g, e) = start, end
                if f == g:
                    if e > b:
                        out.put(opened(f)[b:e])
                    return
                if b:
                    out.put(opened(f)[b:])
                    f += 1
                out.take(stored[f:g])
                if e:
                    out.put(opened(g)[:e])

            prefix, middle, suffix = ((0, 0), (f1, b1)), ((f1, b1), (f2, b2)), ((f2, b2), (len(stored), 0))
            order = [(PREFIX, prefix), (SUFFIX, suffix)] if row["form"] == PSM else [(SUFFIX, suffix), (PREFIX, prefix)]
            for mark, (start, end) in [*order, (MIDDLE, middle)]:
                out.put(mark.encode())
                span(start, end)
            out.flush()
            return head | {"prefix_chars": c1, "middle_chars": c2 - c1, "frames": out.frames}, size

        yield from _rows(make, schema)(batches)

    drawn = frames.withColumns(cut_columns(plain_share, spm_share)).drop("marked")
    return drawn.mapInArrow(run, OUTPUT_SCHEMA)


def find_marks(frames: list[bytes], marks: list[bytes], reader: zstandard.ZstdDecompressor, digest) -> list[tuple[int, int]]:
    """Places in the uncompressed stream (start, end) of the marks, each the first behind the one before it."""
    found: list[tuple[int, int]] = []
    rest, begin = b"", 0
    for f in frames:
        piece = reader.decompress(f)
        digest.update(piece)
        rest += piece
        while len(found) < len(marks) and (at := rest.find(marks[len(found)])) >= 0:
            end = at + len(marks[len(found)])
            found.append((begin + at, begin + end))
            rest, begin = rest[end:], begin + end
        keep = min(len(rest), 2) if len(found) < len(marks) else 0  # a mark may begin in the last bytes
        begin += len(rest) - keep
        rest = rest[len(rest) - keep:]
    if len(found) < len(marks):
        raise ValueError("an output lacks one of its marks")
    return found


def _stream(frames: list[bytes], sizes: list[int], start: int, end: int, reader: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """Bytes ``start`` to ``end`` of the uncompressed stream, from the frames that hold them."""
    at = 0
    for f, size in zip(frames, sizes, strict=True):
        if at < end and at + size > start:
            yield reader.decompress(f)[max(0, start - at):end - at]
        at += size


def digests(outputs: DataFrame) -> DataFrame:
    """Digests of every output and of the text rebuilt from it and its form alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
                        ("n_frames", pa.int32())])
    first = {PSM: [PREFIX, SUFFIX, MIDDLE], SPM: [SUFFIX, PREFIX, MIDDLE]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()

        def make(row: dict) -> tuple[dict, int]:
            frames, output, restored = row["frames"], hashlib.sha256(), hashlib.sha256()
            marks = first.get(row["form"], [])
            places = find_marks(frames, [m.encode() for m in marks], reader, output)
            sizes = [zstandard.frame_content_size(f) for f in frames]
            if not marks:
                restored = output
            else:
                ends = [p[0] for p in places[1:]] + [sum(sizes)]
                spans = {m: (p[1], e) for m, p, e in zip(marks, places, ends, strict=True)}
                for m in (PREFIX, MIDDLE, SUFFIX):
                    for piece in _stream(frames, sizes, *spans[m], reader):
                        restored.update(piece)
            kept = {k: row[k] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars")}
            return kept | {"output_sha256": output.hexdigest(), "restored_sha256": restored.hexdigest(), "n_frames": len(frames)}, 200

        yield from _rows(make, schema)(batches)

    return outputs.mapInArrow(run, DIGEST_SCHEMA)


def text_of(outputs: DataFrame) -> DataFrame:
    """``doc_id``, ``form`` and the output as ``text``."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()

        def make(row: dict) -> tuple[dict, int]:
            text = b"".join(map(reader.decompress, row["frames"])).decode()
            return {"doc_id": row["doc_id"], "form": row["form"], "text": text}, 4 * len(text)

        yield from _rows(make, schema)(batches)

    return outputs.select("doc_id", "form", "frames").mapInArrow(run, "doc_id long, form string, text string")
