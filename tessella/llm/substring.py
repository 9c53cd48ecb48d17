"""Near-duplicate passages through compact windows.

The tokens of a text are its five-word shingles. Under one hash function the Cartesian tree of a text's
token hashes groups its subsequences by their smallest token: node c stands for all subsequences
[i, j] with l <= i <= c <= j <= r, a *compact window* (l, c, r). Only nodes that are wide enough to hold
a passage of MIN_WORDS words are kept. Windows of several hash functions are found; each is indexed under
its token, and carries what stands SEED_GAP tokens before and after it. Its bounds don't travel: how far
two windows go together is seen on the tokens when they are verified.

Windows that agree in their token and in a neighbour, a *kind*, link to the one of the smallest doc_id:
n windows give at most n - 1 links, never all pairs. Windows whose whole surroundings of one passage's
length are equal are collapsed first, by each task and again where they meet, so a passage that a third of
all documents share arrives once per task. The links of a pair of documents from all hash functions and
windows are joined, and the pair is verified once on its tokens: runs of equal tokens grow over gaps in
either text, and a stretch counts if it holds MIN_WORDS words and its similarity to that of the other text
is at least 0.8.

A link that no verified stretch of its pair covers says that a window met a representative that is not its
like. Such windows go round again, without the representative, under a kind that names the first token in
which they differ from it, so that those which go on alike meet each other, and in two more rounds under
neighbours further away. After these, the documents of a small kind are linked each with every other, and its windows do not go round again
for it. Rounds end when no link is left to go round. Whether two passages meet is a matter of chance, as
with all min-hashes: the more alike and the longer they are, the surer (the README has figures).

Null, empty and shorter texts have no passages. Passages that repeat inside one document only are not
reported; rows with equal doc_ids are not compared with each other, and null doc_ids not at all. Repeated
rows give the same passages once. An empty table gives no rows; other columns are ignored. Working memory
is proportional to the longest text (some tens of bytes a character).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import unused
from tessella.storage import materialize

WORDS = 5
MIN_WORDS = 50
SIMILARITY = 0.8
#: Hash functions. Fifty words have one run of tokens, so one window each. At a similarity of 0.8 it is shared with a
#: neighbour in about 0.76 of all cases, so that all HASHES miss in fewer than 2 of 10,000.
HASHES = 6
#: Tokens from a window's token to the neighbours that are compared with it.
SEED_GAP = 5
#: The same in the second and third round, for windows whose link failed.
GAPS = (12, 22)
#: Bytes of text whose tokens are formed at once.
SLICE_BYTES = 1 << 17
#: Tokens whose windows are found at once.
BLOCK_TOKENS = 1 << 17
#: Windows that a task collapses before it sends them on.
POOL_WINDOWS = 1 << 20
#: Windows that a task links in later rounds, which have fewer and fewer.
WINDOWS_A_TASK = 1 << 16
#: Pairs that a task verifies, where there are tasks enough.
PAIRS_A_TASK = 512
#: Pairs of documents up to which those that an earlier round has verified are not looked up.
BROADCAST_PAIRS = 10_000
#: Words of 64 bits that tell which documents a later round needs: all that is broadcast, however many those are.
FILTER_WORDS = 1 << 20
#: Documents of a kind up to which each is linked with every other, in WHOLE_ROUND and the rounds that follow it.
WHOLE_KIND = (4, 8, 16, 32, 64)
#: The first round whose windows no neighbour further away tells apart any more.
WHOLE_ROUND = 2 + len(GAPS)
#: Members of a document's pairs that are verified with one copy of its text.
SALT_PAIRS = 256
#: Tokens of representatives that a worker keeps.
KEPT_TOKENS = 1 << 20
#: Pairs of equal tokens of two texts that are looked at at once.
PAIRS = 1 << 20

_SEEDS = np.random.default_rng(20240).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grown as needed, at most doubled."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, in order; A-Z count as a-z, white space of any length parts words.

    A word's hash is a polynomial in its bytes, taken out of running sums over the whole text; a shingle's is one in its words.
    """
    return next(token_arrays([text], words))


def token_arrays(texts: Iterable[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The tokens of each text; those of several short ones are formed at once."""
    some, size = [], 0
    for text in texts:
        some.append((text or "").encode("utf-8", "surrogatepass").lower())
        size += len(some[-1])
        if size >= SLICE_BYTES:
            yield from _shingles(some, words)
            some, size = [], 0
    yield from _shingles(some, words)


def _shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    n = len(starts) - words + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * len(texts)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _power(_ODD, len(data)), dtype=np.uint64)))
    each = _mix((prefix[ends] - prefix[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    whole = each[:n].copy()
    for k in range(1, words):
        whole = whole * np.uint64(_ODD) + each[k : n + k]
    # A text's shingles are those that begin with one of its words, but for the last ones.
    upto = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])).tolist()
    whole = _mix(whole)
    return [whole[a : max(a, b - words + 1)] for a, b in zip([0, *upto], upto)]


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (leftmost of equals) of every run of `width` values.

    Position and value share 64 bits, so that one vector minimum per doubling does.
    """
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    packed = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    if span < width:
        packed = np.minimum(packed[: len(packed) - (width - span)], packed[width - span :])
    return (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def compact_windows(values: np.ndarray, owner: np.ndarray, width: int, bounds: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of the Cartesian trees of all documents that hold `width` tokens or more,
    and for each run of `width` tokens (by its start) the index of its node, -1 across documents.

    owner is the document of each token, ascending. A node's bounds are the nearest smaller values on
    either side; they are searched run by run among the nodes, since what bounds a wide window is the
    smallest value of a neighbouring run. Without `bounds` l and r are those of the runs that the node is
    the smallest value of, which is all of a window that can hold a passage of `width` tokens around it.
    """
    at = minima(values, width)
    inside = owner[: len(at)] == owner[width - 1 :]
    node = np.full(len(at), -1, np.int64)
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, node
    starts = np.flatnonzero(inside)
    where = at[starts]
    new = np.concatenate(([True], where[1:] != where[:-1]))
    center = where[new]
    node[starts] = np.cumsum(new) - 1
    low, high = starts[new], starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1] + width - 1
    if not bounds:
        return low, center, high, node
    # The first run of a node starts right after a smaller value, unless the node is that run's last
    # token; then smaller values lie further left. The right side is the mirror image.
    bits = np.uint64(max(1, int(len(values)).bit_length()))
    order = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    for side in (-1, 1):
        bound = low if side < 0 else high
        active = np.flatnonzero((center - low == width - 1) if side < 0 else (high - center == width - 1))
        while len(active):
            nxt = bound[active] + side
            ok = (nxt >= 0) & (nxt < len(values))
            ok[ok] = owner[nxt[ok]] == owner[center[active[ok]]]
            active, nxt = active[ok], nxt[ok]
            larger = order[nxt] > order[center[active]]
            active, nxt = active[larger], nxt[larger]
            bound[active] = nxt
            # a whole run of larger values is passed in one step
            run = nxt - width + 1 if side < 0 else nxt
            whole = (run >= 0) & (run < len(node))
            whole[whole] = node[run[whole]] >= 0
            whole[whole] = order[at[run[whole]]] > order[center[active[whole]]]
            bound[active[whole]] = run[whole] if side < 0 else run[whole] + width - 1
    return low, center, high, node


def _surroundings(prefix: np.ndarray, first: np.ndarray | int, last: np.ndarray | int, at: np.ndarray, width: int) -> np.ndarray:
    """Digest of the `width` tokens around each position, and of where it stands in them; first and last are its document's bounds."""
    start = np.clip(at - width // 2, first, last - width)
    return (_mix(prefix[start + width] - prefix[start] + (at - start).astype(np.uint64) * np.uint64(_ODD)) >> np.uint64(32)).astype(np.uint32)


def _short(values: np.ndarray) -> np.ndarray:
    """16 bits of each token, never 0."""
    return np.maximum(values >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def windows(values: np.ndarray, owner: np.ndarray, width: int, hashes: int = HASHES) -> tuple[np.ndarray, ...]:
    """(key, right, left, near, position) of the compact windows of every hash function; positions are in values.

    right and left are 16 bits of the tokens SEED_GAP after and before, 0 at the text's end.
    """
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    sizes = np.bincount(owner)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    keys, places = [], []
    for k in range(hashes):
        _, center, _, _ = compact_windows(_mix(values ^ _SEEDS[k]), owner, width, bounds=False)
        keys.append(_mix(values[center] + np.uint64(k + 1)))
        places.append(center)
    key, at = np.concatenate(keys), np.concatenate(places)
    first, last = begin[owner[at]], begin[owner[at]] + sizes[owner[at]]
    right = np.where(at + SEED_GAP < last, _short(values[np.minimum(at + SEED_GAP, len(values) - 1)]), 0).astype(np.uint16)
    left = np.where(at - SEED_GAP >= first, _short(values[np.maximum(at - SEED_GAP, 0)]), 0).astype(np.uint16)
    return key, right, left, _surroundings(prefix, first, last, at, width), at


def star(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the index of an entry of its key with the smallest doc, and which entries those are."""
    order = np.argsort(key)
    if not len(key):
        return order, order
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group, docs = np.cumsum(new) - 1, doc[order]
    least = np.flatnonzero(docs == np.minimum.reduceat(docs, np.flatnonzero(new))[group])
    one = group[least]
    heads = order[least[np.concatenate(([True], one[1:] != one[:-1]))]]
    out = np.empty(len(key), np.int64)
    out[order] = heads[group]
    return out, heads


_SEED = "bucket int, links boolean, key binary, right binary, left binary, near binary, doc binary, at binary"
_SEED_TYPES = (pa.int32(), pa.bool_()) + (pa.binary(),) * 6
_SEED_NAMES = [x.split()[0] for x in _SEED.split(", ")]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _SEED_TYPES, strict=True)], names=_SEED_NAMES)


def _by_bucket(bucket: np.ndarray, buckets: int):
    """(bucket, indexes of its entries as they came) of every bucket that has any."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by digits
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def _entry_rows(key, right, left, near, doc, at, buckets: int) -> list[tuple]:
    """Entries packed by bucket; within a bucket 32 bits of the key and 16 of a neighbour tell kinds apart."""
    short = (key >> np.uint64(32)).astype(np.uint32)
    return [(k, False, *(x[i].tobytes() for x in (short, right, left, near, doc, at))) for k, i in _by_bucket((key % np.uint64(buckets)).astype(np.int64), buckets)]


def _link_rows(doc, other, at, place, buckets: int) -> list[tuple]:
    """Links (doc, other, position in doc, position in other) packed by doc."""
    return [(k, True, b"", b"", b"", b"", np.stack((doc[i], other[i])).tobytes(), np.stack((at[i], place[i])).tobytes()) for k, i in _by_bucket(doc % buckets, buckets)]


def _links(of: np.ndarray, to: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    use = doc[of] != doc[to]
    of, to = of[use], to[use]
    return doc[of], doc[to], at[of], at[to]


def _every_pair(kind: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, to): all pairs of entries of each kind that has up to `most`, to being of no larger doc; and the entries of larger kinds."""
    order = np.lexsort((doc, kind))
    if not len(order):
        return order, order, order
    new = np.concatenate(([True], kind[order][1:] != kind[order][:-1]))
    group = np.cumsum(new) - 1
    small = np.bincount(group)[group] <= most
    rest, order, group = order[~small], order[small], group[small]
    of, to = [order[:0]], [order[:0]]
    for step in range(1, most):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        of.append(order[same + step])
        to.append(order[same])
    return np.concatenate(of), np.concatenate(to), rest


def _whole_kinds(kind: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, to): all pairs of documents of each kind that up to `most` have, with a window of each, to being of the smaller doc; and the
    entries of larger kinds.

    A pair is verified on its whole texts, so that one link is enough however often a document has the kind.
    """
    order = np.lexsort((doc, kind))
    first = order[np.concatenate((np.ones(min(1, len(order)), bool), (kind[order][1:] != kind[order][:-1]) | (doc[order][1:] != doc[order][:-1])))]
    of, to, larger = _every_pair(kind[first], doc[first], most)
    return first[of], first[to], np.flatnonzero(np.isin(kind, kind[first[larger]]))


def _collapse(key, right, left, near, doc, at):
    """The entries that stand for those with equal surroundings, and the links of the others to them."""
    same = _mix(key.astype(np.uint64) + _mix(near.astype(np.uint64) + (right.astype(np.uint64) << np.uint64(32)) + (left.astype(np.uint64) << np.uint64(48))))
    head, stand = star(same, doc)
    return stand, _links(np.arange(len(doc)), head, doc, at)


def gather(docs: DataFrame, buckets: int, words: int = WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows of all texts, packed by bucket, and the links of those that a task has collapsed."""
    width = min_words - words + 1

    def run(batches):
        pool: list[tuple] = []
        size = 0

        def send():
            entries = tuple(np.concatenate(x) for x in zip(*pool, strict=True))
            stand, found = _collapse(*entries)
            yield _packed(_link_rows(*found, buckets) + _entry_rows(*(x[stand] for x in entries), buckets))

        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
            at, found = 0, token_arrays((x.as_py() for x in texts), words)
            while at < len(ids):
                parts, total = [], 0
                while at < len(ids) and total < BLOCK_TOKENS:
                    values = next(found)
                    if len(values) >= width:
                        parts.append((ids[at], values))
                        total += len(values)
                    at += 1
                if not parts:
                    continue
                sizes = [len(v) for _, v in parts]
                owner = np.repeat(np.arange(len(parts)), sizes)
                key, right, left, near, place = windows(np.concatenate([v for _, v in parts]), owner, width)
                whose = owner[place]
                begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                pool.append((key, right, left, near, np.array([i for i, _ in parts], np.int64)[whose], (place - begin[whose]).astype(np.int32)))
                size += len(key)
                if size >= POOL_WINDOWS:
                    yield from send()
                    pool, size = [], 0
        if pool:
            yield from send()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, _SEED)


def _unpacked(batches, links: bool):
    kinds = (np.uint32, np.uint16, np.uint16, np.uint32, np.int64, np.int32)
    got: list[list] = [[np.zeros(0, t)] for t in kinds]
    passed = []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in _SEED_NAMES[1:]), strict=True):
            if row[0]:
                passed.append(row)
            else:
                for out, data, kind in zip(got, row[1:], kinds, strict=True):
                    out.append(np.frombuffer(data, kind))
    if not links:
        return [np.concatenate(x) for x in got], passed
    pairs = [np.zeros((2, 0), np.int64)] + [np.frombuffer(row[5], np.int64).reshape(2, -1) for row in passed]
    places = [np.zeros((2, 0), np.int32)] + [np.frombuffer(row[6], np.int32).reshape(2, -1) for row in passed]
    return np.concatenate(pairs, axis=1), np.concatenate(places, axis=1)


def linked(entries: DataFrame, buckets: int, tasks: int | None = None, whole: int = 0) -> DataFrame:
    """(doc_id, other, links): pairs of documents with other < doc_id, and the positions of their links, from packed entries.

    Documents with windows of a kind that up to `whole` of them have are linked each with every other. Such a link need not go round
    again, as nothing of its kind is left to meet; it has the complement of its position in other.
    """

    def meet(batches):
        entry, passed = _unpacked(batches, links=False)
        for row in passed:  # links that a task has found on its way; they are dealt out by doc
            yield _packed(_link_rows(*np.frombuffer(row[5], np.int64).reshape(2, -1), *np.frombuffer(row[6], np.int32).reshape(2, -1), buckets))
        stand, found = _collapse(*entry)
        if not len(stand):
            return
        out = [found]
        key, right, left, _, doc, at = (x[stand] for x in entry)
        for side, neighbour in enumerate((right, left)):
            use = np.flatnonzero(neighbour)
            kind = (key[use].astype(np.uint64) << np.uint64(32)) | (neighbour[use].astype(np.uint64) << np.uint64(1)) | np.uint64(side)
            if whole:
                of, to, rest = _whole_kinds(kind, doc[use], whole)
                *ids, place, other_place = _links(use[of], use[to], doc, at)
                out.append((*ids, place, ~other_place))
                use, kind = use[rest], kind[rest]
            head, _ = star(kind, doc[use])
            out.append(_links(use, use[head], doc, at))
        yield _packed(_link_rows(*(np.concatenate(x) for x in zip(*out, strict=True)), buckets))

    def pairs(batches):
        (doc, other), (at, place) = _unpacked(batches, links=True)
        order = np.lexsort((place, at, other, doc))
        rows = np.stack((doc[order], other[order], at[order], place[order]))
        rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))] if rows.shape[1] else rows
        new = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)))) if rows.shape[1] else np.zeros(0, np.int64)
        ends = np.append(new[1:], rows.shape[1])
        places = np.ascontiguousarray(rows[2:].T.astype(np.int32))
        for k in range(0, len(new), 4096):
            some = slice(k, k + 4096)
            links = [places[a:b].tobytes() for a, b in zip(new[some].tolist(), ends[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0, new[some]]), pa.array(rows[1, new[some]]), pa.array(links, pa.binary())], names=["doc_id", "other", "links"])

    n = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(n, "bucket").mapInArrow(meet, _SEED).repartition(n, "bucket").mapInArrow(pairs, "doc_id long, other long, links binary")


def _diagonals(mine: np.ndarray, theirs: Sorted, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, start in other, length) of all maximal runs of equal tokens of the positions that `use` marks, by start.

    A run is marked as a whole or not at all.

    Pairs of equal tokens are looked at a slice at a time; only where runs begin and end is kept.
    """
    order, numbers = theirs.order, theirs.numbers
    low, count, marked = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64), np.flatnonzero(use)
    low[marked] = np.searchsorted(theirs.ordered, mine[marked], "left")
    count[marked] = np.searchsorted(theirs.ordered, mine[marked], "right") - low[marked]
    # Each token's number, with one before the first and after the last that equals none.
    own = np.full(len(mine) + 2, -1, np.int64)
    place = np.minimum(np.searchsorted(theirs.ordered, mine), len(order) - 1)
    own[1:-1] = np.where(theirs.ordered[place] == mine, place, -1)
    upto = np.concatenate(([0], np.cumsum(count)))
    ends: list[list[np.ndarray]] = [[], []]
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        j = order[np.arange(upto[at], upto[to]) + np.repeat((low - upto[:-1])[at:to], count[at:to])]
        for found, step in ((ends[0], 0), (ends[1], 2)):
            edge = np.flatnonzero(np.repeat(own[at + step : to + step], count[at:to]) != numbers[step:][j])
            found.append(np.stack((i[edge], j[edge])))
        at = to
    (i, j), (k, m) = (np.concatenate(x, axis=1) for x in ends)
    first, last = np.lexsort((i, i - j)), np.lexsort((k, k - m))  # runs of a diagonal begin and end by turns
    i, j, n = i[first], j[first], k[last] - i[first] + 1
    order = np.lexsort((j, -n, i))
    return i[order], j[order], n[order]


class Sorted:
    """Tokens of a text with their order, which is found when it is first needed."""

    def __init__(self, values: np.ndarray):
        self.values = values

    @functools.cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.values, kind="stable")

    @functools.cached_property
    def ordered(self) -> np.ndarray:
        return self.values[self.order]

    @functools.cached_property
    def numbers(self) -> np.ndarray:
        """Each token's first place in `ordered`, with -2 before the first and after the last."""
        new = np.concatenate((np.ones(min(1, len(self.values)), bool), self.ordered[1:] != self.ordered[:-1]))
        out = np.full(len(self.values) + 2, -2, np.int64)
        out[1 + self.order] = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        return out

    @functools.cached_property
    def single(self) -> bool:
        """No token is repeated."""
        return bool((self.ordered[1:] != self.ordered[:-1]).all())


def _previous(values: np.ndarray) -> np.ndarray:
    """For each position that of the same value before it, -1 if there is none."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1, np.int64)
    again = np.flatnonzero(values[order][1:] == values[order][:-1]) + 1
    out[order[again]] = order[again - 1]
    return out


def shared_runs(mine: np.ndarray, theirs: Sorted, width: int, similarity: float = SIMILARITY, words=None) -> list[tuple[int, int, int, int, float]]:
    """Stretches of `mine` similar to a stretch of `theirs`: (start, end, start in theirs, end in theirs, similarity).

    From every run of equal tokens a stretch of both sequences grows over gaps on either side, to the
    nearest run that follows. It may fall below the similarity by what a passage of `width` tokens can make
    good again; a longer passage behind would be found without it. The longest stretch that is similar and
    reaches what isn't covered yet counts. One that is too short for a passage is judged with the tokens
    next to it (a changed word at the edge of a passage leaves fewer equal tokens); words() gives the hashes
    of both texts' words, by which it leans to the side that has more of them in common.
    """
    other = theirs.values
    if len(mine) < width or len(other) < width:
        return []
    if len(mine) == len(other) and (mine == other).all():
        return [(0, len(mine), 0, len(other), 1.0)]
    place = np.minimum(np.searchsorted(theirs.ordered, mine), len(other) - 1)
    inside = theirs.ordered[place] == mine
    hits = np.concatenate(([0], np.cumsum(inside)))
    if hits[-1] < width * similarity:
        return []
    ordered = np.sort(mine)
    single = bool((ordered[1:] != ordered[:-1]).all())
    # A stretch without repeated tokens has `similarity` of its tokens in theirs, and so some run of `width` tokens at least
    # half of that: n tokens are cut into no more than 2 n / width runs.
    if single and (hits[width:] - hits[:-width]).max() < width * similarity / 2:
        return []
    slack = (1 - similarity) * width

    def likeness(s: int, e: int, c: int, d: int) -> float:
        if plain:
            match = theirs.order[place[s:e][inside[s:e]]]
            both = int(((match >= c) & (match < d)).sum())
            return both / (e - s + d - c - both)
        first, second = np.unique(mine[s:e]), np.unique(other[c:d])
        both = len(np.intersect1d(first, second, assume_unique=True))
        return both / (len(first) + len(second) - both)

    def surplus(s: int, e: int, c: int, d: int) -> float:
        first, second = np.unique(mine[s:e]), np.unique(other[c:d])
        return (1 + similarity) * len(np.intersect1d(first, second, assume_unique=True)) - similarity * (len(first) + len(second))

    def widened(s: int, e: int, c: int, d: int) -> tuple[int, int, int, int]:
        """The stretch with as many tokens beside it as a passage needs."""
        lacks = width - (e - s)
        least, most = max(0, lacks - (len(mine) - e)), min(lacks, s)
        left = max(least, min(most, lacks - (len(other) - d)))
        if words is not None and least < most:
            a, b = words()
            long = len(a) - len(mine)  # words of a shingle beyond its first
            common = [sum(s >= k and c >= k and a[s - k] == b[c - k] for k in range(1, x + 1)) + sum(e + long + k < len(a) and d + long + k < len(b) and a[e + long + k] == b[d + long + k] for k in range(lacks - x)) for x in range(least, most + 1)]
            left = least + int(np.argmax(common))
        return s - left, e + lacks - left, max(0, c - left), min(len(other), d + lacks - left)

    # Without repeated tokens the equal ones of a stretch are those of its runs.
    plain = single and theirs.single
    if not single:
        gain, before = np.where(inside, 1 - similarity, -similarity), _previous(mine)
        most: dict[int, float] = {}  # by place, what a passage from there on gains at most; ascending
        poors: dict[int, bool] = {}

    def poor(s: int) -> bool:
        """Whether no passage from s on has enough of its different tokens anywhere in theirs."""
        found = poors.get(s)
        if found is None:
            t = next(reversed(most), s + 1)
            # From t to s a passage loses nothing but tokens, and of those only the missing ones make it better.
            found = t < s and most[t] + similarity * (s - t - int(hits[s] - hits[t])) < -1e-9
            if not found:
                most[s] = np.cumsum(np.where(before[s:] < s, gain[s:], 0))[width - 1 :].max(initial=-np.inf)
                found = most[s] < -1e-9
            poors[s] = found
        return found

    def hopeless(s: int) -> bool:
        """The same for a stretch from s on, which may get some tokens before it."""
        return all(poor(x) for x in range(max(0, s - int(slack)), s + 1))

    def parts(at: np.ndarray) -> list[np.ndarray]:
        """Positions with an equal token, parted where more different tokens lack one than the rest can outweigh."""
        if single:
            lack = np.diff(at) - 1
        else:
            gone = np.flatnonzero(~inside)
            gap = np.searchsorted(at, gone) - 1
            new = (gap >= 0) & (gap < len(at) - 1)
            gone, gap = gone[new], gap[new]
            lack = np.bincount(gap[before[gone] <= at[gap]], minlength=len(at))[: len(at) - 1]
        done, todo = [], [(0, len(at))]
        while todo:
            a, b = todo.pop()
            some = at[a:b]
            if some[-1] - some[0] + 1 < width - slack:
                continue
            kinds = b - a if single else len(np.unique(mine[some]))
            if single and kinds < width * similarity:
                continue
            cuts = (a + 1 + np.flatnonzero(lack[a : b - 1] * similarity > (1 - similarity) * kinds + 1e-9)).tolist()
            if cuts:
                todo += zip([a, *cuts], [*cuts, b], strict=True)
            else:
                done.append(some)
        return sorted(done, key=lambda x: x[0])

    out: list[tuple[int, int, int, int, float]] = []

    def grow(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
        starts, others, sizes = i.tolist(), j.tolist(), n.tolist()
        stops = i + n
        reach = int(stops.max())
        covered, p, again = 0, 0, -1
        while True:
            if again >= 0:  # once more from inside the last stretch
                at, again = again, -1
            else:
                while p < len(starts) and starts[p] + sizes[p] <= covered:
                    p += 1
                if p == len(starts) or covered >= reach:
                    break
                at, p = p, p + 1
            if not single and hopeless(starts[at]):
                continue
            box = (starts[at], starts[at] + sizes[at], others[at], others[at] + sizes[at])
            matched, steps = sizes[at], [(box, (1 - similarity) * sizes[at], at)]
            while box[1] < reach:
                s, e, c, d = box
                score = steps[-1][1]
                stop = np.searchsorted(i, e + (max(0.0, score) + slack) / similarity + width, "right")
                q = at + 1 + np.flatnonzero(stops[at + 1 : stop] > e)
                if not len(q):
                    break
                if len(q) > 1:
                    cost = np.maximum(0, i[q] - e) + np.maximum(0, j[q] - d) + np.maximum(0, c - j[q] - n[q])
                    near = q[cost == cost.min()]
                    best = int(near[np.argmax(n[near])])
                else:
                    best = int(q[0])
                box = (s, starts[best] + sizes[best], min(c, others[best]), max(d, others[best] + sizes[best]))
                matched += box[1] - max(e, starts[best])
                score = (1 + similarity) * matched - similarity * (box[1] - s + box[3] - box[2])
                if score < -slack and (plain or surplus(*box) < -slack):
                    break
                steps.append((box, score, best))
            for k in range(len(steps) - 1, -1, -1):
                box, score, _ = steps[k]
                if box[1] <= covered:
                    break
                short = width - (box[1] - box[0])
                if short > slack or len(mine) < width:
                    break
                if plain and score < 0:
                    continue
                if short > 0:
                    box = widened(*box)
                x = likeness(*box)
                if x >= similarity:
                    out.append((*box, x))
                    covered = box[1]
                    # What the stretch gains behind its worst beginning reaches farther than the whole, if anything does.
                    worst = min(range(k + 1), key=lambda m: steps[m][1] - (1 - similarity) * sizes[steps[m][2]])
                    if worst > 0:
                        again = steps[worst][2]
                    break

    def line(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
        """The same for runs that follow one another in both texts, without repeated tokens: a stretch's score is a difference of two sums."""
        ends, other_ends = i + n, j + n
        upto = np.cumsum(n)
        last = (1 + similarity) * upto - similarity * (ends + other_ends)
        first = (1 + similarity) * (upto - n) - similarity * (i + j)
        far = np.searchsorted(ends, i + int(np.ceil(width - slack - 1e-6)))  # the first run that reaches far enough
        best = np.append(np.maximum.accumulate(last[::-1])[::-1], -np.inf)
        covered = 0
        for a in np.flatnonzero(best[far] >= first - 1e-9).tolist():
            for b in (far[a] + np.flatnonzero(last[far[a] :] >= first[a] - 1e-9))[::-1].tolist():
                box = int(i[a]), int(ends[b]), int(j[a]), int(other_ends[b])
                short = width - (box[1] - box[0])
                if box[1] <= covered or short > slack or len(mine) < width:
                    break
                if short > 0:
                    box = widened(*box)
                    x = likeness(*box)
                else:
                    both = int(upto[b] - upto[a] + n[a])
                    x = both / (box[1] - box[0] + box[3] - box[2] - both)
                if x >= similarity:
                    out.append((*box, x))
                    covered = box[1]
                    break

    found = parts(np.flatnonzero(inside))
    if not found:
        return out
    if plain:
        i = np.flatnonzero(inside)
        j = theirs.order[place[i]]
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1, [len(i)]))
        i, j, n = i[cuts[:-1]], j[cuts[:-1]], np.diff(cuts)
    else:
        use = np.zeros(len(mine), bool)
        use[np.concatenate(found)] = True
        i, j, n = _diagonals(mine, theirs, use)
    for part in found:
        here = (i >= part[0]) & (i <= part[-1])
        runs = i[here], j[here], n[here]
        # The longest stretch that could be is all there is to find, if it is similar.
        box = int(runs[0].min()), int((runs[0] + runs[2]).max()), int(runs[1].min()), int((runs[1] + runs[2]).max())
        if box[1] - box[0] >= width and (x := likeness(*box)) >= similarity:
            out.append((*box, x))
        elif plain and (runs[1][1:] >= (runs[1] + runs[2])[:-1]).all():
            line(*runs)
        else:
            grow(*runs)
    return out


PASSAGES = "doc_id long, other long, start long, end long, other_start long, other_end long, similarity double"
#: What a verified pair has shown: a digest of both texts' tokens and which of doc_id's tokens its passages cover.
_MET = "digest long, covered binary"
_JUDGED = f"{PASSAGES}, {_SEED}, {_MET}"


def _equal_tokens(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sequences have in common from their first on."""
    whole = min(len(a), len(b))
    for n in (min(whole, 64), whole):
        differs = a[:n] != b[:n]
        if differs.any():
            return int(np.argmax(differs))
    return whole


def _runs(mine: np.ndarray, other: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in mine, of the run of equal tokens around each link."""
    begin, end = np.empty(len(links), np.int64), np.empty(len(links), np.int64)
    diagonal, low, high = None, 0, 0
    places = links.tolist()
    for k in np.lexsort((links[:, 0], links[:, 0] - links[:, 1])).tolist():
        p, q = places[k]
        if p - q != diagonal or p >= high:  # else it is in the last one's run
            diagonal, low, high = p - q, p + 1 - _equal_tokens(mine[p::-1], other[q::-1]), p + _equal_tokens(mine[p:], other[q:])
        begin[k], end[k] = low, high
    return begin, end


def _open_windows(pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], width: int, gap: int | None) -> tuple[np.ndarray, ...]:
    """(key, right, left, digest of the surroundings, doc, position) of the links' windows of some pairs (doc, its tokens, the other's,
    links) for the next round: under the first token on either side that isn't the representative's, and under the tokens `gap`
    after and before."""
    values = np.concatenate([mine for _, mine, _, _ in pairs])
    bounds = np.concatenate(([0], np.cumsum([len(mine) for _, mine, _, _ in pairs])))
    whose = np.repeat(np.arange(len(pairs)), [len(links) for *_, links in pairs])
    first, last = bounds[whose], bounds[whose + 1] - 1
    begin, end = (np.concatenate(x) + first for x in zip(*(_runs(*x) for _, *x in pairs), strict=True))
    at = np.concatenate([links[:, 0] for *_, links in pairs]) + first
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    near, none = _surroundings(prefix, first, last + 1, at, width), np.zeros(len(at), np.uint16)
    kinds = [
        (2 * (end - at) + (1 << 32), _short(values[np.minimum(end, last)]), none, end <= last),
        (2 * (at + 1 - begin) + 1 + (1 << 32), _short(values[np.maximum(begin - 1, first)]), none, begin > first),
    ]
    if gap is not None:
        right, left = (np.where((x >= first) & (x <= last), _short(values[np.clip(x, first, last)]), none) for x in (at + gap, at - gap))
        kinds.append((np.full(len(at), gap + (1 << 33)), right, left, np.ones(len(at), bool)))
    kind, right, left, use = (np.concatenate(x) for x in zip(*kinds, strict=True))
    docs = np.array([doc for doc, *_ in pairs], np.int64)[whose]
    near, docs, place, token = (np.tile(x, len(kinds))[use] for x in (near, docs, (at - first).astype(np.int32), values[at]))
    return _mix(token + _mix(kind[use].astype(np.uint64))), right[use], left[use], near, docs, place


class _Kept:
    """Tokens of texts that many rows share, up to a number of tokens."""

    def __init__(self):
        self.by_text: dict[str | None, Sorted] = {}
        self.size = 0

    def get(self, texts: list[str | None], words: int) -> list[Sorted]:
        if self.size > KEPT_TOKENS:
            self.by_text.clear()
            self.size = 0
        missing = [x for x in dict.fromkeys(texts) if x not in self.by_text]
        for text, values in zip(missing, token_arrays(missing, words), strict=True):
            self.by_text[text] = Sorted(values)
            self.size += len(values)
        return [self.by_text[x] for x in texts]


def _row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few bytes of both texts each; a longer row stands alone."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(x)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("text", "other_text"))
    block = (np.cumsum(sizes) - sizes) // (2 * SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def verify(docs: DataFrame, pairs: DataFrame, buckets: int, gap: int | None = None, words: int = WORDS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, met: DataFrame | None = None) -> DataFrame:
    """Passages of pairs (doc_id, other, links), in words: [start, end) of doc_id's text and of the other's (similarity is not null);
    as packed entries (bucket is not null), the windows whose links no passage covers; and what each pair has shown (digest is not null).

    A pair that is in `met` has been verified in an earlier round: its passages are known and not given again. For few pairs it is
    not looked up, as they are verified sooner; their passages may come again.
    """
    width = min_words - words + 1

    def run(batches):
        kept = _Kept()
        again: list[tuple] = []  # arrays of key, right, left, digest, doc, position
        held = 0

        def send():
            entries = tuple(np.concatenate(x) for x in zip(*again, strict=True))
            stand, found = _collapse(*entries)
            packed = _packed(_link_rows(*found, buckets) + _entry_rows(*(x[stand] for x in entries), buckets))
            return judged([*(pa.nulls(packed.num_rows, t) for t in _PASSAGE_TYPES), *packed.columns, *(pa.nulls(packed.num_rows, t) for t in _MET_TYPES)])

        def judged(columns):
            return pa.RecordBatch.from_arrays(columns, names=[*_PASSAGE_NAMES, *_SEED_NAMES, *_MET_NAMES])

        def filled(rows, types):
            return [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]

        for part in (x for batch in batches for x in _row_slices(batch)):
            rows, shown, failed = [], [], []
            ids, others, links, known, texts, other_texts = (part.column(c).to_pylist() for c in ("doc_id", "other", "links", "known", "text", "other_text"))
            found_tokens = kept.get(texts + other_texts, words)
            for i, (doc, text, other_text) in enumerate(zip(ids, texts, other_texts, strict=True)):
                mine, theirs = found_tokens[i].values, found_tokens[len(ids) + i]
                seeds = np.frombuffer(links[i], np.int32).reshape(-1, 2)
                last = seeds[:, 1] < 0  # every other window of its kind has been met
                seeds = np.column_stack((seeds[:, 0], np.where(last, ~seeds[:, 1], seeds[:, 1]), last))
                seeds = seeds[(seeds[:, 0] < len(mine)) & (seeds[:, 1] < len(theirs.values))]
                seeds = seeds[mine[seeds[:, 0]] == theirs.values[seeds[:, 1]]]  # other rows of these doc_ids have other texts
                if not len(seeds):
                    continue
                digest = xxhash.xxh64_intdigest(theirs.values.tobytes(), xxhash.xxh64_intdigest(mine.tobytes())) - (1 << 63)
                spans = next((x["covered"] for x in known[i] or () if x["digest"] == digest), None)
                if spans is None:
                    single = functools.cache(lambda a=text, b=other_text: (tokens(a, 1), tokens(b, 1)))
                    found = shared_runs(mine, theirs, width, similarity, single)
                    rows += [(doc, others[i], s, e + words - 1, c, d + words - 1, x) for s, e, c, d, x in found]
                    spans = np.array([x[:2] for x in found], np.int32).tobytes()
                    shown.append((doc, others[i], digest, spans))
                covered = np.zeros(len(mine), bool)
                for s, e in np.frombuffer(spans, np.int32).reshape(-1, 2).tolist():
                    covered[s:e] = True
                seeds = seeds[~covered[seeds[:, 0]] & (seeds[:, 2] == 0)]
                if len(seeds):
                    failed.append((doc, mine, theirs.values, seeds[:, :2]))
            if failed:
                again.append(_open_windows(failed, width, gap))
                held += len(again[-1][0])
            if rows:
                yield judged([*filled(rows, _PASSAGE_TYPES), *(pa.nulls(len(rows), t) for t in (*_SEED_TYPES, *_MET_TYPES))])
            if shown:
                doc, other, *seen = filled(shown, (pa.int64(), pa.int64(), *_MET_TYPES))
                yield judged([doc, other, *(pa.nulls(len(shown), t) for t in (*_PASSAGE_TYPES[2:], *_SEED_TYPES)), *seen])
            if held >= POOL_WINDOWS // 8:
                yield send()
                again.clear()
                held = 0
        if held:
            yield send()

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_pairs = pairs.count()
    texts = _likely(texts, pairs.select("doc_id").unionByName(pairs.select(F.col("other").alias("doc_id"))))
    # A document that very many others are compared with is copied, and they are dealt out over the copies.
    salts = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias("salts"))
    if met is None or n_pairs <= BROADCAST_PAIRS:
        pairs = pairs.withColumn("known", F.lit(None).cast("array<struct<digest:long,covered:binary>>"))
    else:
        both = pairs.unionByName(met, allowMissingColumns=True).groupBy("doc_id", "other")
        known = F.collect_list(F.when(F.col("digest").isNotNull(), F.struct(*_MET_NAMES)))
        pairs = both.agg(F.max("links").alias("links"), known.alias("known")).where("links is not null")
    right = texts.join(salts.withColumnRenamed("other", "doc_id").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("other"), F.col("text").alias("other_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(salts.hint("shuffle_hash"), "other").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts").cast("long")).cast("int")).drop("salts")
    left = salted.hint("shuffle_hash").join(texts, "doc_id")
    # Pairs take long for the few bytes that they have: tasks are dealt out by their number.
    n = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n_pairs // PAIRS_A_TASK)
    left, right = left.repartition(n, "other", "salt"), right.repartition(n, "other", "salt")
    return left.join(right.hint("shuffle_hash"), ["other", "salt"]).select("doc_id", "other", "links", "known", "text", "other_text").mapInArrow(run, _JUDGED)


_PASSAGE_NAMES = [x.split()[0] for x in PASSAGES.split(", ")]
_PASSAGE_TYPES = (pa.int64(),) * 6 + (pa.float64(),)
_MET_NAMES, _MET_TYPES = [x.split()[0] for x in _MET.split(", ")], (pa.int64(), pa.binary())


def _likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts of the doc_ids among ids, and some of others, the more the more ids there are: no text is shuffled for it.

    Each id sets one bit of FILTER_WORDS words, which are broadcast.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER_WORDS))
    word, flag = F.shiftright(bit, 6), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")
    bits = ids.groupBy(word.alias("_word")).agg(F.bit_or(flag).alias("_bits"))
    return texts.join(F.broadcast(bits), word == F.col("_word")).where(F.col("_bits").bitwiseAND(flag) != 0).drop("_word", "_bits")


def _open_ids(entries: DataFrame) -> DataFrame:
    """doc_id of all windows among packed entries, some repeated."""

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column("doc").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64))], names=["doc_id"])

    return entries.select("doc").mapInArrow(run, "doc_id long")


def passages(docs: DataFrame) -> DataFrame:
    """Passages of MIN_WORDS words or more that a document shares with another of smaller doc_id."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries, found, met, gaps, tasks = gather(docs, buckets), None, None, iter(GAPS), None
    for turn in itertools.count(1):
        whole = WHOLE_KIND[min(turn - WHOLE_ROUND, len(WHOLE_KIND) - 1)] if turn >= WHOLE_ROUND else 0
        pairs = materialize(linked(entries, buckets, tasks, whole), "passage-pairs", release=True)
        if found is not None and pairs.isEmpty():
            return found.distinct()
        judged = materialize(verify(docs, pairs, buckets, next(gaps, None), met=met), "passages", release=True)
        new = judged.where("similarity is not null").select(_PASSAGE_NAMES)
        found = new if found is None else found.unionByName(new)
        entries = judged.where("bucket is not null").select(_SEED_NAMES)
        left = entries.agg(F.sum(F.octet_length("at"))).first()[0]
        if not left:
            return found.distinct()
        tasks = min(buckets, 1 + left // 4 // WINDOWS_A_TASK)
        # The next round needs no texts of documents without an open window.
        docs = materialize(_likely(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _open_ids(entries)), "open-texts", release=True)
        # Nor what their pairs have shown.
        shown = judged.where("digest is not null").select("doc_id", "other", *_MET_NAMES)
        met = materialize(_likely(shown if met is None else met.unionByName(shown), _open_ids(entries)).coalesce(tasks), "met", release=True)


_WORD = "[^\\x20\\x09-\\x0D]+"


def cut_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the words of found passages (doc_id, start, end); texts left without a word go.

    Rows that share a doc_id are cut alike. White space before a cut word goes with it; the rest of the text is untouched. All columns are
    kept, and n_chars, where it exists, is that of the new text.
    """
    cut_id, cut_spans = unused(docs, "_cut_id", "_cut_spans")
    spans = found.groupBy(F.col("doc_id").alias(cut_id)).agg(F.collect_set(F.struct("start", "end")).alias(cut_spans))
    columns = docs.columns

    def run(batches):
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for text, cuts in zip(texts, batch.column(cut_spans).to_pylist(), strict=True):
                if not cuts or not text:
                    out.append(text)
                    continue
                ends = [0, *(m.end() for m in word.finditer(text))]
                kept, at = [], 0
                last = len(ends) - 1  # another text under the same doc_id may be shorter
                for a, b in sorted((min(c["start"], last), min(c["end"], last)) for c in cuts):
                    if a > at:
                        kept.append(text[ends[at] : ends[a]])
                    at = max(at, b)
                kept.append(text[ends[at] :])
                out.append("".join(kept).lstrip())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    joined = docs.join(spans.hint("shuffle_hash"), docs["doc_id"] == F.col(cut_id), "left").drop(cut_id)
    schema = joined.schema
    done = joined.mapInArrow(run, schema)
    done = done.where(F.col(cut_spans).isNull() | F.col("text").rlike(_WORD)).drop(cut_spans)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(columns)
