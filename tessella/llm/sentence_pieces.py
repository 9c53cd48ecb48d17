"""SentencePiece encoding and decoding in bounded memory.

The encoder is a Viterbi search that walks a text once, chunk by chunk. At every position it keeps one
backpointer: the piece that ends there. In a BPE vocabulary the best path to a position is the one whose
neighbouring pieces are all *compatible*, that is, whose last two pieces are what the merges make of their
joined text; exactly one piece per position passes, because what the merges make of a text's beginning
does not depend on what follows. So paths need no scores of their own, and the result is that of merging,
piece for piece.

The window holds the positions from which a piece may still go on beyond the last character read, at most
as many as the longest piece has characters. Only their paths survive; where all of them lead through one
boundary, the ids before it are committed and forgotten. What is held is a chunk, the window and the
uncommitted stretch, whatever the length of the text.

What a walk commits between two places where the window is empty depends on the characters between them
alone, so it is kept in a bounded table. Blanks before a word and line feeds are such places if no piece of
the vocabulary holds them further in; a walk that starts there and is in the table is not repeated.

Characters outside the vocabulary become the byte pieces of their UTF-8 form. Decoding joins pieces and
bytes; bytes that aren't UTF-8 become U+FFFD, control pieces vanish. Null texts and empty ones have no
ids, and null or empty id lists give the empty text. Repeated rows are treated alike; an empty table
gives no rows. Other columns are kept, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.wordids import by_bytes, worker_once

SPACE = "▁"
#: Walks between two empty windows whose ids a worker keeps, and the longest of them in characters.
CACHE_WALKS, CACHE_LENGTH = 400_000, 48
#: Pairs of pieces whose compatibility is kept.
CACHE_PAIRS = 500_000
#: Characters of a text that are read at once.
CHUNK = 1 << 15
#: Characters between two looks for a boundary that all paths share.
COMMIT_EVERY = 64
#: Ids that are decoded at once.
DECODE_IDS = 1 << 19


class Vocabulary:
    """Pieces, merges and the tree of pieces by their characters."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.codes = [self.dtype.type(i).tobytes() for i in range(n)]
        self.byte_codes = [self.dtype.type(model.piece_to_id(f"<0x{b:02X}>")).tobytes() for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: whether a piece holds a blank behind other characters or a line feed beside any
        self.crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p[1:] or "\n" in p[:-1] for p in self.ids)
        #: neighbouring characters that some piece holds
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.tree: dict = {}  # a node has its characters' nodes, under 0 its depth, and under "" the id of the piece that ends there
        for piece in self.ids:
            node = self.tree
            for depth, c in enumerate(piece, 1):
                node = node.setdefault(c, {0: depth})
            if self.merged(piece) == [piece]:  # the others are never what merges lead to
                node[""] = self.ids[piece]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.sizes = list(map(len, self.pieces))
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces that the merges make of a short text: always the pair with the best score, leftmost first."""
        score, never = self.scores.get, -math.inf
        parts = list(text)
        pairs = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > never:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], never)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], never)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        first, second = self.pieces[a], self.pieces[b]
        fits = self.pairs[a << 32 | b] = self.merged(first + second) == [first, second]
        return fits

    def packed(self, pieces: Iterable[int]) -> bytes:
        """Ids of pieces; a character that is no piece, -1 less its code point, has those of its bytes."""
        codes, byte_codes = self.codes, self.byte_codes
        return b"".join([codes[x] if x >= 0 else b"".join([byte_codes[b] for b in chr(-1 - x).encode("utf-8", "replace")]) for x in pieces])

    def text(self, pieces: Iterable[int]) -> str:
        return "".join(self.pieces[x] if x >= 0 else chr(-1 - x) for x in pieces)


class Window:
    """The search over one stretch of text: characters in, committed pieces out."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.last: list[int] = [0]  # the piece that ends at each position since the last commit; a character that is none is negative
        self.open: list[dict] = []  # window: nodes of what may still go on, from the earliest beginning to the latest
        self.previous = -1  # the piece before the first position

    def push(self, text: str) -> list[int]:
        """Read text; returns the pieces that are committed."""
        vocabulary = self.vocabulary
        tree, known, compatible, sizes = vocabulary.tree, vocabulary.pairs, vocabulary.compatible, vocabulary.sizes
        last, window, out = self.last, self.open, []
        for c in text:
            end = len(last)
            window.append(tree)
            window = [below for node in window if (below := node.get(c)) is not None]
            best = None
            for node in window:  # the longest piece first
                if (piece := node.get("")) is not None:
                    begin = end - sizes[piece]
                    before = last[begin] if begin else self.previous
                    if before >= 0:  # beside a character that is no piece all goes
                        fits = known.get(before << 32 | piece)
                        if not (compatible(before, piece) if fits is None else fits):
                            continue
                    best = piece
                    break
            last.append(-1 - ord(c) if best is None else best)
            if end % COMMIT_EVERY == 0:
                self.open = window
                if cut := self.converged():
                    out += self._commit(cut)
                    last = self.last
        self.open = window
        return out

    def _size(self, piece: int) -> int:
        return self.vocabulary.sizes[piece] if piece >= 0 else 1

    def converged(self) -> int:
        """The last boundary that the paths of all positions of the window, and of the end, lead through."""
        last = self.last
        heap = [1 - len(last), *(1 - len(last) + node[0] for node in self.open)]
        heapify(heap)
        seen = set(heap)
        while len(heap) > 1:
            i = -heappop(heap)
            if i == 0:
                return 0
            j = i - self._size(last[i])
            if -j not in seen:
                seen.add(-j)
                heappush(heap, -j)
        return -heap[0]

    def _commit(self, cut: int) -> list[int]:
        pieces, end = [], cut
        while end:
            pieces.append(self.last[end])
            end -= self._size(self.last[end])
        self.previous = pieces[0]
        self.last = [0, *self.last[cut + 1 :]]
        return pieces[::-1]

    def finish(self) -> list[int]:
        """The rest of the text's pieces; the window starts anew."""
        self.open = []
        cut = self.converged()
        pieces = self._commit(cut) if cut else []
        self.previous = -1
        return pieces


class StreamingEncoder:
    def __init__(self, model_file: str):
        self.vocabulary = Vocabulary(model_file)
        self.walks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, chunks: Iterable[str]) -> Iterator[int]:
        """The pieces of the text that the chunks make up, by the search alone."""
        window = Window(self.vocabulary)
        for chunk in chunks:
            yield from window.push(chunk)
        yield from window.finish()

    def _walk(self, stretch: str) -> bytes:
        """Ids of a stretch between two places where the window is empty."""
        if (known := self._known(stretch)) is not None:
            return known
        inside, at, parts = self.vocabulary.inside, 0, []
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in inside:  # no piece goes on over this place: the window is empty here, too
                parts.append(stretch[at:i])
                at = i
        parts.append(stretch[at:])
        out = []
        for part in parts:
            ids = self._known(part) if len(parts) > 1 else None
            if ids is None:
                ids = self.vocabulary.packed(self.pieces((part,)))
                if len(part) <= CACHE_LENGTH:
                    self._keep(part, ids)
            out.append(ids)
        return b"".join(out)

    def _known(self, stretch: str) -> bytes | None:
        ids = self.walks.get(stretch)
        if ids is None and (ids := self.older.get(stretch)) is not None:
            self._keep(stretch, ids)
        return ids

    def _keep(self, stretch: str, ids: bytes) -> None:
        if len(self.walks) >= CACHE_WALKS // 2:  # what was not asked for since the last time is forgotten
            self.older, self.walks = self.walks, {}
        self.walks[stretch] = ids

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Committed ids of the text that the chunks make up."""
        if self.vocabulary.crossing:
            for piece in self.pieces(chunks):
                yield self.vocabulary.packed((piece,))
            return
        rest, window = "", None  # the stretch that may go on in the next chunk; a long one is in a window already
        for chunk in chunks:
            if window is not None:
                cut = _GOES_ON.match(chunk).end() if words else _BLANKS_GO_ON.match(chunk).end()
                words = words or not chunk[:cut].strip(SPACE) == ""
                yield self.vocabulary.packed(window.push(chunk[:cut]))
                if cut == len(chunk):
                    continue
                yield self.vocabulary.packed(window.finish())
                chunk, window = chunk[cut:], None
            stretches = _STRETCHES.findall(rest + chunk)
            rest = stretches.pop() if stretches else ""
            known = list(map(self.walks.get, stretches))
            yield b"".join(self._walk(x) if ids is None else ids for x, ids in zip(stretches, known, strict=True))
            if len(rest) > CHUNK and rest != "\n":
                window, words = Window(self.vocabulary), rest.strip(SPACE) != ""
                yield self.vocabulary.packed(window.push(rest))
                rest = ""
        if window is not None:
            yield self.vocabulary.packed(window.finish())
        elif rest:
            yield self._walk(rest)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, in the vocabulary's integer type."""
        if not text:
            return b""
        return b"".join(self.stream((SPACE * (at == 0) + text[at : at + CHUNK].replace(" ", SPACE) for at in range(0, len(text), CHUNK))))


_STRETCHES = re.compile(f"\n|{SPACE}*[^\n{SPACE}]+|{SPACE}+")
_GOES_ON, _BLANKS_GO_ON = re.compile(f"[^\n{SPACE}]*"), re.compile(f"{SPACE}*[^\n{SPACE}]*")


class Decoder:
    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        table = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i):
                table.append(b"")
            elif model.is_byte(i):
                table.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(i):
                table.append(" ⁇ ".encode())
            else:
                table.append(piece.replace(SPACE, " ").encode())
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.pool = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray([] if ids is None else ids, np.int64), [0, 0 if ids is None else len(ids)])[0]

    def decode_all(self, ids: np.ndarray, bounds) -> list[str]:
        """Texts of ids[a:b] for each two neighbouring bounds."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        data = self.pool[np.repeat(self.begins[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.asarray(bounds)].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def encode(docs: DataFrame, model_file: str, column: str = "text", to: str = "piece_ids") -> DataFrame:
    """docs with the ids of each whole text in column `to`; all other columns are kept."""
    kept = [c for c in docs.columns if c != to]
    schema = docs.select(kept).withColumn(to, F.array().cast("array<int>")).schema

    def run(batches):
        encoder = worker_once("pieces", model_file, lambda: StreamingEncoder(model_file))
        dtype = encoder.vocabulary.dtype
        for batch in batches:
            for part in by_bytes(batch, column, 2 << 20):
                coded = [encoder.encode(text.as_py()) for text in part.column(column)]
                bounds = np.concatenate(([0], np.cumsum([len(x) // dtype.itemsize for x in coded]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(coded), dtype).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, to])

    return docs.select(kept).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, column: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """rows with the text of each id list in column `to`; all other columns are kept."""
    kept = [c for c in rows.columns if c != to]
    schema = rows.select(kept).withColumn(to, F.lit("")).schema

    def run(batches):
        decoder = worker_once("unpieces", model_file, lambda: Decoder(model_file))
        for batch in batches:
            lists, texts, at = batch.column(column).fill_null([]), [], 0
            bounds, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            while at < len(lists):
                to_row = max(at + 1, int(np.searchsorted(bounds, bounds[at] + DECODE_IDS, "right")) - 1)
                texts += decoder.decode_all(ids[bounds[at] : bounds[to_row]].astype(np.int64), bounds[at : to_row + 1] - bounds[at])
                at = to_row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return rows.select(kept).mapInArrow(run, schema)
