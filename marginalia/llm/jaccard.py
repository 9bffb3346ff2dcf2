"""N-gram Jaccard join by grouped prefixes.

A document's set holds the hashes of its distinct word shingles.  Under one
global order two sets of the wanted similarity share an element of their
prefixes.  The order puts frequent shingles last: those that whole blocks of
documents share are counted first and their bounded list is sent to all tasks
(any list is right; a better one leaves fewer candidates).

 1. features: one row a document with set size, set signature and a bit
    sketch.  Documents with equal sets form a class, joined only as one.
 2. groups: documents with identical prefix and size collapse into one group;
    postings (token, group, size, position) go to bins, packed.
 3. group pairs: pairs that share a token pass the size and position filters.
    Short lists give pairs at once.  Long ones, and those of frequent tokens,
    are cut into blocks, and pairs of blocks are tested apart.
 4. members: groups are expanded to classes, pairs filtered by the sketch (an
    exact upper bound of the overlap) and verified with the full sets.

Only components are wanted, so a long list does not emit all its pairs: it
first emits a maximum spanning forest of the pairs that pass the bound.  What
is verified merges components; then every pair of a long list that passes the
bound and still lies across two components is verified too, so no link
between components is lost.

`jaccard_links` gives all links instead, with the number of each document's.

Words are runs outside space and 0x09-0x0D, A-Z folded.  With fewer words than
a shingle the whole sequence is one; a text without words has an empty set and
links with nothing.  Shingles are compared by 64-bit hashes, sets by two.  A
bin of postings too large for a task goes through scratch files, from which a
retried task starts anew.  Very long texts are hashed in bounded stretches.  Null
text is empty; repeated rows and equal sets are linked; extra columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, release_memory, scratch, staged, text_bytes
from .components import components
from .textkeys import batch_shingles, mix

#: Shingles of a stretch in which frequent ones are counted, the least total count, and the most that are sent to all tasks (16 bytes each).
STRETCH, FREQUENT, MOST_FREQUENT = 600_000, 3, 1 << 19
#: Lists of at most SHORT groups give their pairs at once; blocks of longer ones hold some BLOCK entries.
SHORT, BLOCK = 8, 2048
#: Prefixes are so long that similar sets share this many tokens (fewer in sets of fewer elements).
SHARED = 3
#: A pair of blocks gives all its pairs that pass at once if they are at most so many times its entries.
AT_ONCE = 4
#: Postings packed at a time, and postings in a bin.
FLUSH, BIN = 250_000, 400_000
#: Bytes of a bin's postings that a task holds before it moves them to so many scratch files.
SPILL_BYTES, SPILL_FILES = 64 << 20, 16
#: Blocks of a long list that meet in one row, on either side.
CELL = 6
#: With at most so many documents to verify (8 bytes each) their identifiers are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
SKETCH_BITS, SMALL_BITS, MOST_BITS = 4, 2048, 1 << 17
LONG = np.dtype("<i8")


def signature(found: np.ndarray, bits: int = 64, salt: int = 0) -> int:
    """A hash of the whole ascending set."""
    place = np.arange(1, len(found) + 1, dtype=np.uint64)
    whole = np.bitwise_xor.reduce(mix((found ^ np.uint64(salt)) + mix(place)))
    return int((mix(np.array([whole], dtype=np.uint64) + np.uint64(len(found))) >> np.uint64(64 - bits)).view(np.int64)[0])


def check(found: np.ndarray) -> int:
    """A second hash: sets whose signatures are equal by chance differ in it."""
    return signature(found, salt=0x5851F42D4C957F2D)


def identity(found: np.ndarray, bits: int, collided: frozenset[int]) -> int:
    sig = signature(found, bits)
    return check(found) if sig in collided else sig


def sketch(found: np.ndarray) -> bytes:
    """A bit for every element, in a power of two of bits near SKETCH_BITS times their number."""
    bits = 64
    while bits < min(SKETCH_BITS * len(found), MOST_BITS):
        bits *= 2
    marks = np.zeros(bits, dtype=bool)
    marks[(found >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def small_sketch(packed: bytes, n: int) -> bytes:
    """The sketch folded to about SMALL_BITS, or a bit for an element of a large set: enough to tell unlike sets apart."""
    size = len(packed)
    while size // 2 * 8 >= max(SMALL_BITS, n):
        size //= 2
    return folded(np.frombuffer(packed, dtype=np.uint8)[None, :], size)[0].tobytes()


def folded(packed: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) folded to `size` bytes."""
    return packed if packed.shape[1] == size else np.bitwise_or.reduce(packed.reshape(len(packed), -1, size), axis=1)


def shared_tokens(n: int, percent: int) -> int:
    """How many tokens the prefixes of a set of size n and of a similar one share at least."""
    return max(1, min(SHARED, -(-percent * n // 100)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + shared_tokens(n, percent)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("small", pa.binary()), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def features(docs: DataFrame, shingle: int, id_col: str, text_col: str, bits: int) -> DataFrame:
    """A row a document (doc_id, n, sig, check, sketch), and rows with the counts of shingles that recur in a stretch of documents."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(list(held.values())), return_counts=True)
            often = times > 1
            return pa.RecordBatch.from_pylist([{"tokens": values[often].view(np.int64), "counts": times[often]}], schema=_FEATURES)

        for batch in batches:
            sets = list(batch_shingles(text_bytes(batch, "text"), shingle))
            sigs = [signature(s, bits) if len(s) else None for s in sets]
            checks = [check(s) if len(s) else None for s in sets]
            sketches = [sketch(s) for s in sets]
            small = [small_sketch(x, len(s)) for x, s in zip(sketches, sets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary()), pa.array(small, pa.binary()), pa.nulls(len(sets), _FEATURES.types[6]), pa.nulls(len(sets), _FEATURES.types[7])], schema=_FEATURES)
            for sig, found in zip(checks, sets):
                if sig is not None and sig not in held:
                    held[sig] = found
                    size += len(found)
            if size >= STRETCH:
                yield counted()
                held, size = {}, 0
        if held:
            yield counted()
        held.clear()
        release_memory()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(extract, "doc_id long, n long, sig long, check long, sketch binary, small binary, tokens array<long>, counts array<long>")


#: What a posting is made of: in ordinary bins, and of frequent tokens.
ENTRY = np.dtype([("token", "<u4"), ("group", "<i8"), ("n", "<u4"), ("at", "<u2")])
OFTEN = np.dtype([("token", "<u8"), ("group", "<i8"), ("n", "<u4"), ("at", "<u2")])
MEMBER = np.dtype([("group", "<i8"), ("sig", "<i8"), ("n", "<u4")])


def postings(docs: DataFrame, frequent, known, bins: int, shingle: int, percent: int, text_col: str) -> DataFrame:
    """(bin, kind, data): packed postings of groups, of frequent tokens, and the groups' members."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = frequent.value  # ascending hashes, their counts
        bits, collided = known.value
        parts: dict[str, list[np.ndarray]] = {"E": [], "F": [], "M": []}
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for kind, own in parts.items():
                if not own:
                    continue
                data = np.concatenate([x[1] for x in own])
                place = np.concatenate([x[0] for x in own])
                order = np.argsort(place, kind="stable")
                data, place = data[order], place[order]
                edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
                rows += [{"bin": int(place[a]), "kind": kind, "data": data[a:b].tobytes()} for a, b in zip(edge[:-1], edge[1:])]
                own.clear()
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=_PACKED)

        for batch in batches:
            for found in batch_shingles(text_bytes(batch, "text"), shingle):
                n = len(found)
                sig = identity(found, bits, collided) if n else None
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                k = np.searchsorted(often, found)
                k[k == len(often)] = 0
                frequency = np.where(often[k] == found, counts[k], 0) if len(often) else np.zeros(n, dtype=np.int64)
                order = np.lexsort((found, frequency))[: prefix_length(n, percent)]
                tokens, frequency = found[order], frequency[order]
                one_bin = frequency <= BLOCK
                group = int(mix(np.array([signature(tokens)], dtype=np.int64).view(np.uint64) + np.uint64(n)).view(np.int64)[0])
                at = np.minimum(np.arange(len(tokens)), 65535)
                for kind, dtype, own in (("E", ENTRY, one_bin), ("F", OFTEN, ~one_bin)):
                    if not own.any():
                        continue
                    data = np.zeros(int(own.sum()), dtype=dtype)
                    token = tokens[own]
                    data["group"], data["n"], data["at"] = group, n, at[own]
                    if kind == "E":
                        data["token"] = (token & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                        place = ((token >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
                    else:
                        data["token"] = token
                        salts = (-(-frequency[own] // BLOCK)).astype(np.uint64)
                        place = (mix(token + (np.uint64(group & (2**64 - 1)) % salts)) % np.uint64(bins)).astype(np.int64)
                    parts[kind].append((place, data))
                    size += len(data)
                parts["M"].append((np.array([group % bins]), np.array([(group, sig, n)], dtype=MEMBER)))
            if size >= FLUSH:
                yield from flush()
                size = 0
            if len(seen) > 200_000:
                seen.clear()
        yield from flush()
        release_memory()

    return docs.select(docs[text_col].alias("text")).mapInArrow(emit, "bin long, kind string, data binary")


_PACKED = pa.schema([("bin", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])
_LISTS = pa.schema([("kind", pa.string()), ("list", pa.int64()), ("block", pa.int64()), ("g", pa.list_(pa.int64())), ("x", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))])
LISTS = "kind string, list long, block long, g array<long>, x array<long>, n array<long>, at array<long>"


def passes(n_a: np.ndarray, n_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, percent: int) -> np.ndarray:
    """Size and position filter of pairs that share the token at these places."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    most = np.minimum(n_a - at_a, n_b - at_b) + np.minimum(at_a, at_b)
    # places beyond the two bytes kept are only known to be large
    most = np.where((at_a >= 65535) | (at_b >= 65535), small, most)
    return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (n_a + n_b))


def match_bins(packed: DataFrame, percent: int) -> DataFrame:
    """Per bin: pairs of groups from short lists (P), blocks of long lists (B), members (M)."""

    def rows(kind: str, lists: list[int], blocks: list[int], *columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(lists)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(lists, pa.int64()), pa.array(blocks, pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], schema=_LISTS)

    def ordered(e: np.ndarray) -> np.ndarray:
        """By token and size, so blocks of a list have like sizes; of one group under one token (or two that collide) every place stays."""
        e = e[np.lexsort((e["at"], e["group"], e["n"], e["token"]))]
        return e[np.concatenate([[True], e[1:] != e[:-1]])]

    def settle(bin_id: int, parts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if parts.get("M"):
            m = np.unique(np.frombuffer(b"".join(parts["M"]), dtype=MEMBER))
            for at in range(0, len(m), 20_000):
                own = m[at : at + 20_000]
                yield rows("M", [bin_id], [0], [own["group"].astype(np.int64)], [own["sig"].astype(np.int64)], [own["n"].astype(np.int64)], [np.zeros(0, dtype=np.int64)])
        if parts.get("F"):
            e = ordered(np.frombuffer(b"".join(parts["F"]), dtype=OFTEN))
            edge = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1], [True]]))
            yield from blocks(e, edge, e["token"].view(np.int64), bin_id)
        if parts.get("E"):
            e = ordered(np.frombuffer(b"".join(parts["E"]), dtype=ENTRY))
            edge = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1], [True]]))
            length = np.diff(edge)
            group, n, place = (e[k].astype(np.int64) for k in ("group", "n", "at"))
            left, right, need = [], [], []
            for k in range(2, SHORT + 1):
                starts = edge[:-1][length == k]
                for i in range(k):
                    for j in range(i + 1, k):
                        a, b = starts + i, starts + j
                        ok = passes(n[a], n[b], place[a], place[b], percent) & (group[a] != group[b])
                        left.append(np.minimum(group[a], group[b])[ok]), right.append(np.maximum(group[a], group[b])[ok]), need.append(np.minimum(n[a], n[b])[ok])
            if left:
                pairs, times = np.unique(np.stack([np.concatenate(x) for x in (left, right, need)]), axis=1, return_counts=True)
                for at in range(0, pairs.shape[1], 20_000):
                    own = slice(at, at + 20_000)
                    yield rows("P", [bin_id], [0], [pairs[0, own]], [pairs[1, own]], [pairs[2, own]], [times[own]])
            long = np.flatnonzero(length > SHORT)
            names = (np.int64(bin_id) << 32) | e["token"].astype(np.int64)
            for k in long:
                yield from blocks(e, edge[k : k + 2], names, 0)

    def blocks(e: np.ndarray, edge: np.ndarray, names: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        lists, numbers, columns = [], [], ([], [], [])
        for a, b in zip(edge[:-1], edge[1:]):
            for k, at in enumerate(range(a, b, BLOCK)):
                own = e[at : min(b, at + BLOCK)]
                lists.append(int(names[a])), numbers.append(first * 1_000_003 + k)
                for column, key in zip(columns, ("group", "n", "at")):
                    column.append(own[key].astype(np.int64))
        for at in range(0, len(lists), 50):
            g, n, place = (c[at : at + 50] for c in columns)
            yield rows("B", lists[at : at + 50], numbers[at : at + 50], g, [[]] * len(g), n, place)

    def settled(bin_id: int, parts: dict[str, list[bytes]], spilled: list) -> Iterator[pa.RecordBatch]:
        if spilled:
            spill(parts, spilled)
        yield from settle(bin_id, parts)
        for file in spilled:  # each has some of the tokens, whole
            file.seek(0)
            data = file.read()
            file.close()
            if data:
                yield from settle(bin_id, {"E": [data]})

    def spill(parts: dict[str, list[bytes]], spilled: list) -> None:
        """Move a bin's postings to scratch files by token; a retried task makes them anew."""
        if not spilled:
            spilled += [tempfile.TemporaryFile() for _ in range(SPILL_FILES)]
        e = np.frombuffer(b"".join(parts.pop("E", [])), dtype=ENTRY)
        place = mix(e["token"].astype(np.uint64)) % np.uint64(SPILL_FILES)
        for k, file in enumerate(spilled):
            file.write(e[place == k].tobytes())

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, spilled, held = None, {}, [], 0
        for batch in batches:
            for bin_id, kind, data in zip(*[c.to_pylist() for c in batch.columns]):
                if bin_id != current:
                    if current is not None:
                        yield from settled(current, parts, spilled)
                    current, parts, spilled, held = bin_id, {}, [], 0
                parts.setdefault(kind, []).append(data)
                if kind == "E":
                    held += len(data)
                    if held > SPILL_BYTES:
                        spill(parts, spilled)
                        held = 0
        if current is not None:
            yield from settled(current, parts, spilled)
        parts.clear()
        release_memory()

    return packed.repartition("bin").sortWithinPartitions("bin").mapInArrow(reduce, LISTS)


def sketch_filter(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, n_a, n_b, sketch_a, sketch_b), the (a, b) that may reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            ok = []
            for x, y, s, t in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), n_a, n_b):
                size = min(len(x), len(y))
                p, q = (folded(np.frombuffer(v, dtype=np.uint8)[None, :], size)[0] for v in (x, y))
                most = min(s - int(np.bitwise_count(p & ~q).sum()), t - int(np.bitwise_count(q & ~p).sum()))
                ok.append((100 + percent) * most >= percent * (s + t))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)

    return pairs.mapInArrow(keep, "a long, b long")


_TESTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())])


def block_pairs(blocks: DataFrame, percent: int, first: bool) -> DataFrame:
    """Pairs (a, b, kind) of classes within pairs of blocks that pass all bounds and lie in different components.

    On the first round, a maximum spanning forest of them by the overlap bound
    (kind F) and the others (R), if they are few; where they are many, a row
    (list, list, L) asks for another look at the list.  Later rounds give all (R).
    """

    def columns(entries: list[dict]):
        sig, n, at, label = (np.array([e[k] for e in entries], dtype=np.int64) for k in ("sig", "n", "at", "label"))
        return sig, n, at, label, [np.frombuffer(e["sketch"], dtype=np.uint8) for e in entries]

    def survivors(left, right, same: bool):
        """(index in left, index in right, bound) of all pairs that pass."""
        out = []
        widths_a, widths_b = ({w: np.array([i for i, s in enumerate(side[4]) if len(s) == w]) for w in {len(s) for s in side[4]}} for side in (left, right))
        for wa, ia in widths_a.items():
            for wb, ib in widths_b.items():
                # a sketch has at most twice its share of bits, so these sets' sizes differ too much
                if percent * max(wa, wb) > 200 * min(wa, wb):
                    continue
                size = min(wa, wb)
                pa_, pb = (folded(np.stack([side[4][i] for i in own]), size).view(np.uint64) for side, own in ((left, ia), (right, ib)))
                step = max(1, (1 << 18) // max(1, len(ib) * pb.shape[1]))
                for at in range(0, len(ia), step):
                    a = ia[at : at + step]
                    ok = passes(left[1][a][:, None], right[1][ib][None, :], left[2][a][:, None], right[2][ib][None, :], percent)
                    ok &= left[0][a][:, None] != right[0][ib][None, :]
                    ok &= (left[3][a][:, None] != right[3][ib][None, :])
                    if same:
                        ok &= a[:, None] < ib[None, :]
                    x, y = np.nonzero(ok)
                    for cut in range(0, len(x), 1 << 16):
                        u, v = x[cut : cut + (1 << 16)], y[cut : cut + (1 << 16)]
                        p, q = pa_[at + u], pb[v]
                        n_a, n_b = left[1][a[u]], right[1][ib[v]]
                        most = np.minimum(n_a - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), n_b - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
                        good = (100 + percent) * most >= percent * (n_a + n_b)
                        out.append(np.stack([a[u][good], ib[v][good], (1_000_000 * most / (n_a + n_b - most)).astype(np.int64)[good]]))
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0), dtype=np.int64)

    def tested(name: int, left, right, same: bool) -> Iterator[pa.RecordBatch]:
        a, b, bound = survivors(left, right, same)
        x, y, lx, ly = left[0][a], right[0][b], left[3][a], right[3][b]
        kind = np.full(len(x), "R")
        if first and len(x):
            keep, root = [], {}

            def find(k):
                while root.setdefault(k, k) != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for k in np.argsort(-bound, kind="stable").tolist():
                p, q = find(int(lx[k])), find(int(ly[k]))
                if p != q:
                    root[p] = q
                    keep.append(k)
            kind[keep] = "F"
            if len(x) > AT_ONCE * (len(left[0]) + len(right[0])):
                x, y, kind = x[keep], y[keep], kind[keep]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([name]), pa.array(["L"])], schema=_TESTED)
        for at in range(0, len(x), 10_000):
            own = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[own], y[own])), pa.array(np.maximum(x[own], y[own])), pa.array(kind[own].tolist(), pa.string())], schema=_TESTED)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, entries in zip(batch.column("list").to_pylist(), batch.column("entries")):
                own = columns(entries.as_py())
                yield from tested(name, own, own, True)
        release_memory()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, g, h, blocks in zip(*[batch.column(k) for k in ("list", "g", "h", "blocks")]):
                sides = ([], [])
                for block in blocks:
                    sides[0 if block["g"].as_py() == g.as_py() else 1].append(columns(block["entries"].as_py()))
                if g.as_py() == h.as_py():
                    pairs = [(x, y) for k, x in enumerate(sides[0]) for y in sides[0][k + 1 :]]
                else:
                    pairs = [(x, y) for x in sides[0] for y in sides[1]]
                for x, y in pairs:
                    if 100 * min(x[1].max(), y[1].max()) >= percent * max(x[1].min(), y[1].min()):
                        yield from tested(name.as_py(), x, y, False)
        release_memory()

    # blocks of a list in order of their sets' sizes, CELL of them a group; a pair of groups is one row, and the pairs of a list are dealt out by group
    thin = blocks.select("list", "block", F.array_min("entries.n").alias("low"), F.array_max("entries.n").alias("high"))
    cut = staged(thin.groupBy("list").agg(F.count("*").alias("k")).filter("k > 1").select("list"), "cut-lists")
    few = cut.count() <= BROADCAST_IDS
    thin = thin.join(F.broadcast(cut) if few else cut, "list", "left_semi")
    place = F.row_number().over(Window.partitionBy("list").orderBy("low", "high", "block")) - 1
    thin = staged(thin.withColumn("g", F.floor(place / CELL).cast("int")), "cut-blocks")
    groups = thin.groupBy("list", "g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    other = groups.select("list", F.col("g").alias("h"), F.col("low").alias("low_h"), F.col("high").alias("high_h"))
    cells = groups.join(other, "list").filter("g <= h").filter(F.lit(100) * F.least("high", "high_h") >= percent * F.greatest("low", "low_h"))
    cells = cells.select("list", "g", "h", F.explode(F.array_distinct(F.array("g", "h"))).alias("own"))
    dealt = thin.select("list", "block", F.col("g").alias("own")).join(cells, ["list", "own"]).join(blocks, ["list", "block"])
    dealt = dealt.groupBy("list", "g", "h").agg(F.collect_list(F.struct(F.col("own").alias("g"), "entries")).alias("blocks"))
    made = "a long, b long, kind string"
    return blocks.select("list", "entries").mapInArrow(alone, made).union(dealt.mapInArrow(across, made)).groupBy("a", "b").agg(F.min("kind").alias("kind"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, known, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity."""
    need = staged(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(classes, "sig").select(F.col("first_id").alias("need_id")), "need")
    few = need.count() <= BROADCAST_IDS
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    texts = texts.join(F.broadcast(need) if few else need, F.col("doc_id") == F.col("need_id"), "left_semi").select("text")
    out = pa.schema([("sig", pa.int64()), ("found", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, collided = known.value
        seen: set[int] = set()  # repeated rows; what is left of them only repeats pairs
        for batch in batches:
            found = {identity(s, bits, collided): s.tobytes() for s in batch_shingles(text_bytes(batch, "text"), shingle) if len(s)}
            found = {k: v for k, v in found.items() if k not in seen}
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], schema=out)

    held = staged(texts.mapInArrow(sets, "sig long, found binary"), "sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("found_a").to_pylist(), batch.column("found_b").to_pylist()):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)

    joined = pairs.join(held.select(F.col("sig").alias("a"), F.col("found").alias("found_a")), "a").join(held.select(F.col("sig").alias("b"), F.col("found").alias("found_b")), "b")
    return joined.select("a", "b", "found_a", "found_b").mapInArrow(compare, "a long, b long").distinct()


def set_classes(docs: DataFrame, shingle: int, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(staged features, staged classes of equal sets, signatures that different sets had)."""
    made = staged(features(docs, shingle, id_col, text_col, bits), "features")

    def grouped(rows: DataFrame) -> DataFrame:
        sums = rows.filter("tokens is null and sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("copies"), (F.min("check") != F.max("check")).alias("mixed"))
        return staged(sums, "classes")

    classes = grouped(made)
    collided = [r["sig"] for r in classes.filter("mixed").select("sig").limit(MOST_FREQUENT).collect()]
    if collided:  # chance of some 1e-5 for 1e7 documents; these sets go by their second hash
        bad = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in collided], "bad long"))
        made = made.join(bad, F.col("sig") == F.col("bad"), "left").withColumn("sig", F.when(F.col("bad").isNull(), F.col("sig")).otherwise(F.col("check"))).drop("bad")
        classes = grouped(made)
        if not classes.filter("mixed").isEmpty():
            raise RuntimeError("two hashes of different sets are equal")
    return made, classes.drop("mixed"), frozenset(collided)


def linked_classes(docs: DataFrame, made: DataFrame, classes: DataFrame, collided: frozenset[int], *, shingle: int, percent: int, id_col: str, text_col: str, bits: int, every: bool = False) -> DataFrame:
    """(node, label) of all classes that link with another, or every link (a, b) of classes; `made` are the staged features."""
    spark = docs.sparkSession
    known_sets = spark.sparkContext.broadcast((bits, collided))
    thin = made.filter("tokens is null and sig is not null")
    classes = classes.filter("first_id is not null").select("sig", "first_id", "n")
    counted = made.filter("tokens is not null").select(F.inline(F.arrays_zip("tokens", "counts"))).groupBy("tokens").agg(F.sum("counts").alias("times")).filter(F.col("times") >= FREQUENT)
    top = counted.orderBy(F.desc("times"), "tokens").limit(MOST_FREQUENT).toPandas()
    keys = top["tokens"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], top["times"].to_numpy(dtype=np.int64)[order]))
    total = thin.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bins = max(32, -(-total * (100 - percent) // 100 // BIN))
    lists = staged(match_bins(postings(docs, frequent, known_sets, int(bins), shingle, percent, text_col), percent), "lists")
    members = lists.filter("kind = 'M'").select(F.inline(F.arrays_zip("g", "x", "n"))).distinct().toDF("g", "sig", "n")
    # groups of several classes are lists of their own
    sizes = members.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1")
    within = members.join(sizes, "g")
    # a pair that shares too few tokens in short lists is tested in a long list, or not similar
    short = lists.filter("kind = 'P'").select(F.inline(F.arrays_zip("g", "x", "n", "at"))).groupBy("g", "x").agg(F.sum("at").alias("times"), F.min("n").alias("n"))
    enough = F.greatest(F.lit(1), F.least(F.lit(SHARED), F.ceil(F.lit(percent) * F.col("n") / 100)))
    short = short.filter(F.col("times") >= enough).select(F.col("g").alias("ga"), F.col("x").alias("gb"))
    pairs = short.join(members.select(F.col("g").alias("ga"), F.col("sig").alias("a")), "ga").join(members.select(F.col("g").alias("gb"), F.col("sig").alias("b")), "gb").select("a", "b")
    few = within.filter(F.col("k") <= SHORT)
    pairs = pairs.union(few.select("g", F.col("sig").alias("a")).join(few.select("g", F.col("sig").alias("b")), "g").filter("a < b").select("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = staged(pairs, "pairs")
    long = lists.filter("kind = 'B'").select("list", "block", F.inline(F.arrays_zip("g", "n", "at"))).toDF("list", "block", "g", "n0", "at").join(members.select("g", "sig"), "g").select("list", "block", "sig", "at")
    many = within.filter(F.col("k") > SHORT)
    long = long.union(many.select(F.col("g").alias("list"), F.pmod(F.xxhash64("sig"), F.ceil(F.col("k") / BLOCK).cast("long")).alias("block"), "sig", F.lit(0).cast("long").alias("at")))
    long = staged(long, "long-lists")

    def known(sigs: DataFrame, *columns: str) -> DataFrame:
        """Facts of some classes, by the identifier of each one's first document."""
        asked = staged(sigs.distinct().join(classes, "sig").select(F.col("first_id").alias("asked_id"), "sig"), "asked")
        few = asked.count() <= BROADCAST_IDS
        right = asked.withColumnRenamed("sig", "asked_sig")
        same = (F.col("doc_id") == F.col("asked_id")) & (F.col("sig") == F.col("asked_sig"))
        return staged(thin.join(F.broadcast(right) if few else right, same, "left_semi").select("sig", *columns).dropDuplicates(["sig"]), "facts")

    facts = known(long.select("sig"), "n", "small")

    def near(candidates: DataFrame) -> DataFrame:
        candidates = staged(candidates, "candidates")
        wide = known(candidates.select(F.explode(F.array("a", "b")).alias("sig")), "n", "sketch")
        return sketch_filter(candidates.join(wide.toDF("a", "n_a", "sketch_a"), "a").join(wide.toDF("b", "n_b", "sketch_b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"), percent)

    def blocks(entries: DataFrame) -> DataFrame:
        entry = F.struct("sig", "n", "at", "label", F.col("small").alias("sketch"))
        return entries.join(facts, "sig").groupBy("list", "block").agg(F.collect_list(entry).alias("entries"))

    def compared(candidates: DataFrame) -> DataFrame:
        return verified(candidates, docs, classes, known_sets, shingle, percent, id_col, text_col)

    first_blocks = staged(blocks(long.withColumn("label", F.col("sig"))), "blocks")
    if every:
        found = block_pairs(first_blocks, percent, False).select("a", "b")
        return compared(staged(near(found.union(pairs).distinct()), "tried"))
    found = staged(block_pairs(first_blocks, percent, True), "found-pairs")
    tried = staged(near(found.filter("kind = 'F'").select("a", "b").union(pairs).distinct()), "tried")
    links = staged(compared(tried), "links")
    labels = components(links)

    def label(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(column), F.col("label").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    # what still lies across two components
    rest = found.filter("kind = 'R'").select("a", "b")
    again = long.join(found.filter("kind = 'L'").select(F.col("a").alias("list")), "list", "left_semi")
    if not again.isEmpty():
        again = block_pairs(staged(blocks(label(again, "sig", "label")), "blocks"), percent, False)
        rest = rest.union(again.select("a", "b")).distinct()
    rest = label(label(rest, "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")
    rest = staged(near(rest.join(tried, ["a", "b"], "left_anti")), "rest")
    if rest.isEmpty():
        return labels
    return components(links.union(compared(rest)))


def jaccard_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row.

    Links are pairs with 100 * intersection >= percent * union.  class_id is
    the smallest identifier with the same set.
    """
    spark = prepare(docs.sparkSession)
    made, classes, collided = set_classes(docs, shingle, id_col, text_col, bits)
    with scratch(spark):
        labels = linked_classes(docs, made, classes, collided, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col, bits=bits)
        thin = made.filter("tokens is null").select("doc_id", "n", "sig")
        classes = classes.select("sig", F.col("first_id").alias("class_id"), "copies")
        found = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
        least = found.filter("label is not null").groupBy("label").agg(F.min("class_id").alias("least_id"))
        found = found.join(least, "label", "left").withColumn("component_id", F.coalesce("least_id", "class_id"))
        # a class of one row that links with nothing needs no join
        found = staged(found.filter((F.col("copies") > 1) | F.col("label").isNotNull()).select("sig", "class_id", "component_id"), "found", result=True)
    return thin.join(found, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The whole join: (class_a, class_b) of all links between different sets, and (doc_id, n_shingles, class_id, n_links) for every row.

    n_links counts rows: the other copies of the document's set, and all
    copies of the sets that link with it.  Rows without an identifier form
    classes but link with no other set.
    """
    spark = prepare(docs.sparkSession)
    made, classes, collided = set_classes(docs, shingle, id_col, text_col, bits)
    with scratch(spark):
        pairs = staged(linked_classes(docs, made, classes, collided, shingle=shingle, percent=percent, id_col=id_col, text_col=text_col, bits=bits, every=True), "class-links", result=True)
    facts = classes.select("sig", F.col("first_id").alias("class_id"), "copies")
    one, other = (facts.select(F.col("sig").alias(k), F.col("class_id").alias(f"class_{k}"), F.col("copies").alias(f"copies_{k}")) for k in ("a", "b"))
    full = pairs.join(one, "a").join(other, "b")
    counted = full.select(F.col("a").alias("sig"), F.col("copies_b").alias("more")).union(full.select("b", "copies_a")).groupBy("sig").agg(F.sum("more").alias("more"))
    members = made.filter("tokens is null").select("doc_id", F.col("n").alias("n_shingles"), "sig").join(facts.join(counted, "sig", "left"), "sig", "left")
    links = full.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    return links, members.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("copies") - 1 + F.coalesce("more", F.lit(0)), F.lit(0)).alias("n_links"))
