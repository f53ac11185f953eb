"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is that of its distinct runs of five words; two documents link when the
sets' Jaccard similarity is at least 4/5. Equal sets are one node. Tokens are ordered rare
first (hashed counts over all documents, then hash). With o the overlap that a pair needs,
the l-prefixes (size - o + l first tokens) of a linked pair share l tokens at least. Each
node takes the l (a power of two, up to a quarter of its size) whose estimated cost is
least: list entries to read, and candidates to verify, of which each needs l shared
tokens. It probes with its l-prefix the l-prefixes of smaller nodes, which are listed as
far as the largest l of a node that may link with them asks for. How many shared tokens a
pair needs follows from l and both sizes.

Links are looked for between different components only:
1. tokens in the prefixes of two texts or more are found (a bitmap of fixed size; false alarms
   only); of equal texts one row stands for all. The listed prefixes of a linked pair share a
   quarter of a node's size of them at least, and a node with fewer is done;
2. star rounds: each node is verified against the hub with which it shares most prefix
   tokens, hubs being a few nodes of each token's list; links bring nodes under one label;
3. the last round counts the shared prefix tokens of all pairs of different components
   and verifies those with as many as they need. Two nodes that were verified against one hub are
   left out if their distances from it differ by more than 1/5: Jaccard distance is a metric.
A group of near copies thus costs its size for most of its members, not its square, and
no link between different components is lost.

Nulls: null and empty texts have an empty set and link with nothing. A null id is never
the smallest. Repeated rows and equal sets are in one component. Texts of fewer words than
five are one run. A very long text is one set in one row, made a block at a time. Ties (equal ids,
equal counts) change which pairs are verified first and never a component. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.runcounts import RunCounts, run_counts, slot
from shelfwise.llm.state import bitmap, checkpointed
from shelfwise.llm.textkit import Words, blocks, mix, shingles

WIDTH = 5
#: Cost of verifying a candidate, in list entries read.
VERIFY_COST = 500.0
#: Bits of the bitmap of live tokens: by the number of runs, up to the second figure. Each token has two of them.
LEAST_LIVE_BITS, MOST_LIVE_BITS = 20, 28
#: Bits of the bitmap of rows that stand for their texts: by the number of rows, up to the second figure.
LEAST_CHOSEN_BITS, MOST_CHOSEN_BITS = 20, 26
#: Prefix tokens that a task holds before it sends them on: more of them at once take fewer bytes each.
HELD_TOKENS = 2_000_000
#: Prefix tokens that one bucket sorts, about.
BUCKET_TOKENS = 250_000
#: A longer list is dealt over tasks: each pair of its parts of about this length is a list of its own.
LONG_LIST = 4096
HUBS, STAR_ROUNDS = 4, 2
#: Labels of components that may be sent to all tasks (some 20 bytes each); into how many parts a component is dealt beyond it.
SENT_LABELS, SALTS = 50_000, 16


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n needs with any set that it links with."""
    return -(-4 * n // 5)


def largest_level(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n // 4)


def token_sets(texts: list[bytes], heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, text, first of each text): every text's distinct tokens, rare first."""
    w = Words([t.lower() for t in texts])
    token, doc = shingles(w, w.hashes(), WIDTH)
    rank = heavy[slot(token, len(heavy))].astype(np.int64) if len(token) else doc
    place = doc * 64 + rank
    order = np.lexsort((token, place))
    token, place = token[order], place[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (place[1:] != place[:-1])
    token, doc = token[keep], place[keep] // 64
    return token, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def levels_of(token: np.ndarray, first: np.ndarray, counts: RunCounts) -> np.ndarray:
    """The l of each text: the one of least estimated cost."""
    n = np.diff(first)
    # of a heavy token its list's length: h doublings of the mean, and half of the next one
    grade = np.arange(64)
    entries = 1 + np.where(grade > 0, 1.5 * 2.0**grade * counts.mean, 0.0)
    total = np.concatenate([[0.0], np.cumsum(entries[counts.heavy[slot(token, len(counts.heavy))]])])
    base, most = n - least_overlap(n), largest_level(n)
    best, level = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    k = 1
    while k <= most.max(initial=1):
        cost = (total[np.minimum(first[:-1] + base + k, first[1:])] - total[first[:-1]]) * (1 + VERIFY_COST / k)
        better = (cost < best) & (k <= most)
        best, level = np.where(better, cost, best), np.where(better, k, level)
        k *= 2
    return level


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """How many tokens a node lists.

    Of a linked pair's listed prefixes one ends first in the order of tokens; the other set
    lacks n - o of its tokens at most and lists all the others. So the prefixes share
    largest_level of either size at least (tests/llm goes through the sizes).
    """
    return np.minimum(n, n - least_overlap(n) + largest_level(5 * n // 4 + 1))


def _blob(*arrays: np.ndarray) -> list[bytes]:
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unblob(rows: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """The columns of packed rows laid end to end; the first column is the bucket."""
    out: list[list] = [[np.zeros(0, k)] for k in kinds]
    unpack = zstandard.ZstdDecompressor()
    for batch in rows:
        for j, kind in enumerate(kinds):
            out[j] += [np.frombuffer(unpack.decompress(x.as_py()), kind) for x in batch.column(j + 1)]
    return [np.concatenate(x) for x in out]


def _packed(bucket: np.ndarray, names: list[str], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    rows = [_blob(*[a[g] for a in arrays]) for g in groups]
    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups], pa.int64()), *[pa.array(list(c), pa.binary()) for c in zip(*rows, strict=True)]], ["bucket", *names])


def chosen_rows(rows: DataFrame) -> np.ndarray:
    """A bitmap of the marks (of id and text) of the rows that stand for their texts, those of least id.

    Every text has such a row. Others may be taken for one (false alarms, and rows that repeat an id), so
    what is found of a text's rows may be found twice and is never missed.
    """
    bits = min(MOST_CHOSEN_BITS, max(LEAST_CHOSEN_BITS, rows.count().bit_length() + 5))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield _chosen_places(batch.column("mark"), bits)

    least = rows.groupBy("digest").agg(F.min("id").alias("id"))
    return bitmap(least.select(_mark()), places, bits)


def _mark() -> Column:
    return F.xxhash64("digest", "id").alias("mark")


def _chosen_places(marks: pa.Array, bits: int) -> np.ndarray:
    return (marks.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _chosen(marks: pa.Array, known: np.ndarray) -> np.ndarray:
    """Which rows stand for their texts, by their marks."""
    return _are_set(known, _chosen_places(marks, (8 * len(known)).bit_length() - 1))


def _are_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


#: Slices of the bitmap of live tokens: by the first eight bits of a token.
LIVE_SLICES = 256


def _live_places(low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places in its slice of a token, of which the 32 bits behind the first eight are known."""
    shift = np.uint32(40 - bits)
    return low >> shift, (low * np.uint32(0x9E3779B1) ^ low >> np.uint32(15)) * np.uint32(0x85EBCA77) >> shift


def _are_live(token: np.ndarray, live: np.ndarray) -> np.ndarray:
    bits = (8 * len(live)).bit_length() - 1
    first = (token >> np.uint64(56)).astype(np.int64) << bits - 8
    one, two = _live_places((token >> np.uint64(24)).astype(np.uint32), bits)
    out = _are_set(live, first + one)
    out[out] = _are_set(live, (first + two)[out])
    return out


def _steps(token: np.ndarray) -> np.ndarray:
    """Sorted numbers as the steps between them, first bytes first: most first bytes are nought, so they pack well."""
    return np.diff(token, prepend=np.uint32(0)).astype(">u4").view(np.uint8).reshape(-1, 4).T


def _summed(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(">u4").reshape(-1), dtype=np.uint32)


def live_tokens(rows: DataFrame, counts: Broadcast, chosen: Broadcast, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits of the tokens that stand in the prefixes of two texts or more."""

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = np.sort(np.concatenate(held))
        # 40 bits of a token are enough for a bitmap of false alarms: bucket and 32 more
        bucket, low = (token >> np.uint64(56)).astype(np.int64), (token >> np.uint64(24)).astype(np.uint32)
        cut = np.searchsorted(bucket, np.arange(LIVE_SLICES + 1))
        some = [i for i in range(LIVE_SLICES) if cut[i + 1] > cut[i]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_blob(_steps(low[cut[i] : cut[i + 1]]))[0] for i in some], pa.binary())], ["bucket", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            own = batch.filter(pa.array(_chosen(batch.column("mark"), chosen.value)))
            texts = list(dict.fromkeys(own.column("body").to_pylist()))
            for a, b in blocks(texts):
                token, doc, first = token_sets(texts[a:b], counts.value.heavy)
                n = np.diff(first)
                held.append(token[np.arange(len(token)) - first[doc] < prefix_lengths(n)[doc]])
                if sum(map(len, held)) > HELD_TOKENS:
                    yield from sent(held)
                    held = []
        if sum(map(len, held)):
            yield from sent(held)

    def twice(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        token = np.sort(np.concatenate([_summed(unpack.decompress(x.as_py())) for batch in batches for x in batch.column("tokens")]))
        token = token[1:][token[1:] == token[:-1]]
        slice_ = np.zeros((1 << bits) // LIVE_SLICES, bool)
        for at in _live_places(token, bits):
            slice_[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(slice_).tobytes()], pa.binary())], ["bucket", "bits"])

    out = np.zeros((LIVE_SLICES, (1 << bits) // 8 // LIVE_SLICES), np.uint8)
    found = rows.select("body", _mark()).mapInArrow(run, "bucket long, tokens binary").groupBy("bucket").applyInArrow(twice, "bucket long, bits binary")
    for row in found.collect():  # slices of one bitmap, 2**bits / 8 bytes in all
        out[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


ROWS = "id {kind}, n long, node binary, level int, tokens binary, places binary, body binary"


def described(rows: DataFrame, kind: str, counts: Broadcast, chosen: Broadcast, live: Broadcast) -> DataFrame:
    """id, n and node (digest of the set) of every row; for nodes with tokens that others
    list too also level, those tokens, their places in the order, and the packed text, in one row of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies, ids = batch.column("body").to_pylist(), batch.column("id")
            stands = _chosen(batch.column("mark"), chosen.value)
            for a, b in blocks(bodies):
                texts = bodies[a:b]
                token, doc, first = token_sets(texts, counts.value.heavy)
                n = np.diff(first)
                level = levels_of(token, first, counts.value)
                place = np.arange(len(token)) - first[doc]
                good = place < prefix_lengths(n)[doc]
                good[good] = _are_live(token[good], live.value)
                good &= (np.bincount(doc[good], minlength=len(texts)) >= largest_level(n))[doc]
                shared, whose, places = token[good], doc[good], place[good].astype(np.int32)
                cut = np.searchsorted(whose, np.arange(len(texts) + 1))
                nodes, toks, plcs, packed, seen = [], [], [], [], set()
                for i, t in enumerate(texts):
                    node = hashlib.blake2b(token[first[i] : first[i + 1]].tobytes(), digest_size=16).digest()
                    new = stands[a + i] and node not in seen and cut[i + 1] > cut[i]
                    if new:
                        seen.add(node)
                    nodes.append(node)
                    toks.append(shared[cut[i] : cut[i + 1]].tobytes() if new else None)
                    plcs.append(places[cut[i] : cut[i + 1]].tobytes() if new else None)
                    packed.append(press.compress(t) if new else None)
                cols = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(level.astype(np.int32)), pa.array(toks, pa.binary()), pa.array(plcs, pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "node", "level", "tokens", "places", "body"])

    return rows.select("id", "body", _mark()).mapInArrow(run, ROWS.format(kind=kind))


ENTRY_KINDS = [np.uint64, np.int64, np.int32, np.int32, np.int32, np.int64, np.float64, np.int64, np.float64, np.int64, np.float64]
ENTRY_NAMES = ["token", "node", "n", "level", "place", "comp", "known", "pivot", "far", "pivot2", "far2"]
PAIR_KINDS = [np.int64, np.int64, np.int32, np.int32]
PAIR_NAMES = ["x", "y", "shared", "least"]
_binary = lambda names: "bucket long, " + ", ".join(f"{x} binary" for x in names)


def _long_lists(entries: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """entries without those of long lists, and the long lists dealt out: a list's nodes fall into
    parts, and each pair of parts is a list of its own, with the part of each entry as its side."""
    token = entries[0]
    _, at, size = np.unique(token, return_inverse=True, return_counts=True)
    long = size[at] > LONG_LIST
    if not long.any():
        return entries, []
    order = np.flatnonzero(long)[np.argsort(at[long], kind="stable")]
    dealt: list[list[np.ndarray]] = [[] for _ in range(len(entries) + 1)]
    for list_ in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        parts = -(-len(list_) // LONG_LIST)
        part = (mix(entries[1][list_].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        groups = [list_[part == g] for g in range(parts)]
        for g in range(parts):
            for h in range(g, parts):
                both = groups[g] if g == h else np.concatenate([groups[g], groups[h]])
                side = np.zeros(len(both), np.int8)
                if g != h:
                    side[: len(groups[g])], side[len(groups[g]) :] = 1, 2
                dealt[0].append(mix(token[both] ^ mix(np.full(len(both), (g << 32) + h + 1, np.uint64))))
                for out, column in zip(dealt[1:], [*entries[1:], None], strict=True):
                    out.append(side if column is None else column[both])
    return [x[~long] for x in entries], [np.concatenate(x) for x in dealt]


def _pairs_of(star: int | None, entries: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(x, y, shared tokens, least number needed) of one bucket's pairs of different components.

    star: the round's number, pairs of nodes with hubs only; None: all pairs. Entries of one
    side (but 0) make no pairs.
    """
    token, node, n, level, place, comp, known, pivot, far, pivot2, far2 = entries
    side = np.zeros(len(token), np.int8) if side is None else side
    names, node_at = np.unique(node, return_inverse=True)
    # hubs: in the first round the nodes that others share most of, the same in every bucket
    by = mix(names.view(np.uint64) ^ np.uint64(0x9E37 + (star or 0)))[node_at]
    if star == 0:
        by = np.unique(np.stack([-known, by.astype(np.float64)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((by, token))
    token, node, node_at, n, level, place, comp, pivot, far, pivot2, far2, side = (v[order] for v in (token, node, node_at, n, level, place, comp, pivot, far, pivot2, far2, side))
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([head, [len(token)]]))
    if len(head):  # lists of one component have nothing to say
        many = np.minimum.reduceat(comp, head) != np.maximum.reduceat(comp, head)
        head, size = head[many], size[many]
    longest = int(size.max()) if len(size) else 0
    codes: dict[int, int] = {}
    found_code, found_count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0

    def settle() -> None:
        code, at = np.unique(np.concatenate(found_code), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(found_count), minlength=len(code)).astype(np.int64)
        found_code[:], found_count[:] = [code], [total]

    for k in range(1, longest) if star is None else range(min(HUBS, longest - 1)):
        if star is None:  # entries k apart in a list
            reach = size - k
            some = reach > 0
            i = np.repeat(head[some] - np.concatenate([[0], np.cumsum(reach[some])[:-1]]), reach[some]) + np.arange(reach[some].sum())
            j = i + k
        else:  # the list's k-th entry, and those behind it
            reach = size - k - 1
            some = reach > 0
            j = np.repeat(head[some] + k + 1 - np.concatenate([[0], np.cumsum(reach[some])[:-1]]), reach[some]) + np.arange(reach[some].sum())
            i = np.repeat(head[some] + k, reach[some])
        ok = (comp[i] != comp[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        if star is None:
            # the larger one probes; equal sizes by node
            probe_i = (n[i] > n[j]) | ((n[i] == n[j]) & (node_at[i] > node_at[j]))
            x, y = np.where(probe_i, i, j), np.where(probe_i, j, i)
            ok &= place[x] < n[x] - least_overlap(n[x]) + level[x]
            ok &= place[y] < n[y] - least_overlap(n[y]) + level[x]
            ok &= (side[i] == 0) | (side[i] != side[j])
            for one, d_one in ((pivot, far), (pivot2, far2)):
                ok &= (one[i] != node[j]) & (one[j] != node[i])  # verified before
                for two, d_two in ((pivot, far), (pivot2, far2)):
                    ok &= (one[i] != two[j]) | (np.abs(d_one[i] - d_two[j]) <= 0.2 + 1e-9)
        else:
            x, y = j, i
        code, count = np.unique(node_at[x[ok]] * len(names) + node_at[y[ok]], return_counts=True)
        found_code.append(code)
        found_count.append(count)
        held += len(code)
        if held > 4_000_000:
            settle()
            held = 0
    settle()
    code, count = found_code[0], found_count[0]
    x, y = code // max(1, len(names)), code % max(1, len(names))
    sizes, levels = np.ones(len(names), np.int64), np.ones(len(names), np.int64)
    sizes[node_at], levels[node_at] = n, level
    # one of the two prefixes ends first; beyond it that node has least_overlap - level tokens
    needed = -(-4 * (sizes[x] + sizes[y]) // 9) - least_overlap(np.maximum(sizes[x], sizes[y])) + levels[x]
    return names[x], names[y], count.astype(np.int32), np.maximum(levels[x], needed).astype(np.int32)


def candidates(nodes: DataFrame, buckets: int, star: int | None) -> DataFrame:
    """x, y to verify: for each x the hub it shares most with, or every pair with l shared tokens."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("tokens").to_pylist()
            sizes = np.array([len(t) // 8 for t in toks], np.int64)
            token = np.frombuffer(b"".join(toks), np.uint64)
            place = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int32)
            rest = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(k), sizes) for c, k in (("node", np.int64), ("n", np.int32), ("level", np.int32), ("comp", np.int64), ("pivot", np.int64), ("far", np.float64), ("pivot2", np.int64), ("far2", np.float64))]
            # how much of what a node lists others list too
            known = np.repeat(sizes / np.maximum(1, prefix_lengths(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64))), sizes)
            yield from _packed((mix(token) % np.uint64(buckets)).astype(np.int64), ENTRY_NAMES, [token, *rest[:3], place, rest[3], known, *rest[4:]])

    def counted(x: np.ndarray, y: np.ndarray, shared: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        by = mix(x.view(np.uint64)) if star is not None else mix(x.view(np.uint64) * np.uint64(3) + y.view(np.uint64))
        yield from _packed((by % np.uint64(buckets)).astype(np.int64), PAIR_NAMES, [x, y, shared, least])

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _unblob(batches, ENTRY_KINDS)
        if star is not None:
            yield from counted(*_pairs_of(star, entries))
            return
        entries, dealt = _long_lists(entries)
        none = pa.nulls
        for batch in counted(*_pairs_of(star, entries)):
            yield pa.RecordBatch.from_arrays([*batch.columns, none(batch.num_rows, pa.list_(pa.binary()))], [*batch.schema.names, "parts"])
        if dealt:
            for batch in _packed((dealt[0] % np.uint64(buckets)).astype(np.int64), [*ENTRY_NAMES, "side"], dealt):
                rows = list(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[none(len(rows), pa.binary())] * len(PAIR_NAMES), pa.array(rows, pa.list_(pa.binary()))], ["bucket", *PAIR_NAMES, "parts"])

    def part_pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (pa.RecordBatch.from_arrays([b.column("bucket"), *[pa.array(c, pa.binary()) for c in zip(*b.column("parts").to_pylist(), strict=True)]], ["bucket", *ENTRY_NAMES, "side"]) for b in batches)
        *entries, side = _unblob(columns, [*ENTRY_KINDS, np.int8])
        yield from counted(*_pairs_of(None, entries, side))

    def chosen(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, shared, least = _unblob(batches, PAIR_KINDS)
        order = np.lexsort((y, x))
        x, y, shared, least = x[order], y[order], shared[order], least[order]
        head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        if not len(head):
            return
        x, y, least, shared = x[head], y[head], least[head], np.add.reduceat(shared, head)
        if star is None:
            good = shared >= least
            x, y = x[good], y[good]
        else:
            order = np.lexsort((y, -shared, x))
            x, y = x[order], y[order]
            best = np.concatenate([[True], x[1:] != x[:-1]])
            x, y = x[best], y[best]
        for i in range(0, len(x), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]), pa.array(y[i : i + 50_000])], ["x", "y"])

    slim = nodes.select("node", "n", "level", "tokens", "places", "comp", "pivot", "far", "pivot2", "far2")
    listed, schema = slim.mapInArrow(lists, _binary(ENTRY_NAMES)).groupBy("bucket"), _binary(PAIR_NAMES)
    if star is not None:
        found = listed.applyInArrow(pairs, schema)
    else:
        both = checkpointed(listed.applyInArrow(pairs, f"{schema}, parts array<binary>"))
        found, dealt = both.where("parts is null").drop("parts"), both.where("parts is not null")
        if not dealt.isEmpty():
            found = found.unionByName(dealt.groupBy("bucket").applyInArrow(part_pairs, schema))
    return found.groupBy("bucket").applyInArrow(chosen, "x long, y long")


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """x, y, shared and united sizes of the pairs' whole sets, from the texts of both."""
    left = pairs.join(bodies.select(F.col("node").alias("x"), F.col("body").alias("x_body")), "x")
    both = left.join(bodies.select(F.col("node").alias("y"), F.col("body").alias("y_body")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.zeros(1 << 10, np.uint8)  # here no order is needed
        unpack = zstandard.ZstdDecompressor()
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("x_body", "y_body")]
            fresh = [t for t in dict.fromkeys(sides[0] + sides[1]) if t not in sets]
            for i in range(0, len(fresh), 256):
                part = fresh[i : i + 256]
                token, _, first = token_sets([unpack.decompress(t) for t in part], heavy)
                for k, t in enumerate(part):
                    sets[t] = np.sort(token[first[k] : first[k + 1]])
                    held += sets[t].nbytes + len(t)
            inter = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(*sides, strict=True)], np.int64)
            total = np.array([len(sets[x]) + len(sets[y]) for x, y in zip(*sides, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(inter), pa.array(total - inter)], ["x", "y", "shared", "united"])
            if held > 64 << 20:
                sets.clear()
                held = 0

    return both.select("x", "y", "x_body", "y_body").mapInArrow(run, "x long, y long, shared long, united long")


def with_label(rows: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """rows with column of few, for those whose comp it has. A component may hold most rows, so few
    goes to all tasks if its rows are counted to be SENT_LABELS at most; else both sides are salted."""
    few = checkpointed(few.select("comp", column))
    if few.limit(SENT_LABELS + 1).count() <= SENT_LABELS:
        return rows.join(F.broadcast(few), "comp", "left")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("salt", salt), ["comp", "salt"], "left").drop("salt")


def relabelled(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after one step along links: a component takes the least label that it is linked
    with, and then that label's. Equal labels mean connected nodes; the converse may not hold yet."""
    of = comps.select("node", "comp")
    edges = links.join(of.select(F.col("node").alias("x"), F.col("comp").alias("a")), "x").join(of.select(F.col("node").alias("y"), F.col("comp").alias("b")), "y").where("a != b").select("a", "b")
    step = checkpointed(edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("l")))
    hop = step.join(step.select(F.col("a").alias("l"), F.col("l").alias("m")), "l", "left").select("a", F.coalesce("m", "l").alias("l"))
    return with_label(comps, hop.withColumnRenamed("a", "comp"), "l").withColumn("comp", F.coalesce("l", "comp")).drop("l")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) with the components that links (x, y) connect made one.

    Each pass gives a component the least label among those it is linked with, and then the
    label of that label; labels only fall, and the passes end when none has changed.
    """
    of = comps.select("node", "comp")
    edges = links.join(of.select(F.col("node").alias("x"), F.col("comp").alias("a")), "x").join(of.select(F.col("node").alias("y"), F.col("comp").alias("b")), "y").where("a != b").select("a", "b").distinct()
    both = checkpointed(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        lower = labels.join(near, "a").select("a", F.least("l", "m").alias("n"), F.col("l").alias("was"))
        hop = lower.select(F.col("a").alias("n"), F.col("n").alias("hop"))
        new = checkpointed(lower.join(hop, "n", "left").select("a", F.least("n", F.coalesce("hop", "n")).alias("l"), "was"))
        if not new.where("l != was").limit(1).count():
            break
        labels = new.select("a", "l")
    return with_label(comps, labels.select(F.col("a").alias("comp"), "l"), "l").withColumn("comp", F.coalesce("l", "comp")).drop("l")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """key, n_shingles and component_id (the smallest id that links reach) of every row."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.substring(F.unhex(F.sha2("body", 256)), 1, 16))
    kind = rows.schema["id"].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    counts = context.broadcast(run_counts(rows, "body", WIDTH, lower=True))  # of a bounded size, as is the bitmap
    chosen = context.broadcast(chosen_rows(rows))
    bits = min(MOST_LIVE_BITS, max(LEAST_LIVE_BITS, counts.value.total.bit_length() - 1))
    live = context.broadcast(live_tokens(rows, counts, chosen, bits))
    all_rows = checkpointed(described(rows, kind, counts, chosen, live))
    for sent in (counts, chosen, live):
        sent.destroy()

    alive = all_rows.where(F.col("tokens").isNotNull()).groupBy("node").agg(F.first(F.struct("n", "level", "tokens", "places", "body")).alias("p"))
    nodes = checkpointed(alive.select(F.col("node").alias("digest"), F.monotonically_increasing_id().alias("fresh"), "p.*"))
    # ids of a kept table's rows are the same whenever it is read; kept so that plans need not know
    nodes = nodes.withColumnRenamed("fresh", "node")
    buckets = max(12, int(nodes.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0) // BUCKET_TOKENS)
    bodies = nodes.select("node", "body")
    comps = nodes.select("node", F.col("node").alias("comp"), *[x for k in ("", "2") for x in (F.col("node").alias(f"pivot{k}"), F.lit(0.0).alias(f"far{k}"))])
    links = None
    for star in [*range(star_rounds), None]:
        todo = nodes.drop("body", "digest").join(comps, "node")
        seen = checkpointed(verified(checkpointed(candidates(todo, buckets, star)), bodies))
        new = seen.where("5 * shared >= 4 * united").select("x", "y")
        links = new if links is None else links.unionByName(new)
        # between rounds a step is enough; in the end all links of all rounds are followed
        comps = joined(comps, links) if star is None else relabelled(comps, new)
        if star in (0, 1):  # distances from the hubs of the first two rounds
            k = "2" if star else ""
            far = seen.select(F.col("x").alias("node"), F.col("y").alias("p"), (1 - F.col("shared") / F.col("united")).alias("d"))
            comps = comps.join(far, "node", "left").withColumns({f"pivot{k}": F.coalesce("p", f"pivot{k}"), f"far{k}": F.coalesce("d", f"far{k}")}).drop("p", "d")
        comps = checkpointed(comps)
    labels = nodes.select("node", "digest").join(comps.select("node", "comp"), "node").select(F.col("digest").alias("node"), "comp")
    firsts = all_rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    classes = firsts.join(labels, "node", "left")
    lowest = classes.where("comp is not null").groupBy("comp").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    reached = checkpointed(with_label(classes, lowest, "lowest").select("node", F.coalesce("lowest", "least").alias("component")))
    out = all_rows.select("id", "n", "node").join(reached, "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def op3_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
