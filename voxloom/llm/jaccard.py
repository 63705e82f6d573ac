"""Set-similarity self-join on word shingles: token-combination prefixes, verification, components.

Every text is the set of its distinct ``width``-word shingles, hashed to 64 bits. Two texts link when
``100 * |x & y| >= percent * |x | y|``. The plan, exact for every size and every skew:

1. *Digests.* One pass gives each text its set's size, a 128-bit digest and a parity bitmap, and counts shingles
   into a fixed table of ``SLOTS`` counters. Texts with equal sets become one class with the smallest doc_id as its
   representative (an aggregation with map-side combination, so a third of all rows in one class is no hot task).
2. *Signatures.* Shingles are ordered by (counter, hash). A set of n may lack ``e = n - ceil(percent * n / 100)``
   shingles of a partner, so its prefix is extended until losing ``e`` of them cannot destroy every signature.
   Shingles of rare classes are signatures by themselves; those of frequent classes are only indexed as
   combinations of ``k = 2`` within one of m(n) hash groups: a group with g prefix members survives g - 1 losses.
   m(n) belongs to a size class; a set that may have partners in the next smaller class signs for both.
3. *Stars.* Sets that share a signature meet by a shuffle on it; combination signatures, the only ones that may be
   hot, meet in salted parts first and then the parts' representatives. Each meeting gives pairs with STARS members only. Verified pairs are links, links make components.
4. *Rest.* More stars join what is left in different components. What still shares a signature across components is
   compared exhaustively, in blocks, by size and parity bitmap (a lower bound on the symmetric difference): first for
   as many pairs as would join the components, then for all that are left. Only pairs that may link leave the block,
   and whole sets decide on them: no component is torn. A pair that shares many signatures is left out where both
   members' LEAST smallest ones have a common one that is smaller: it is made there.
5. *Links.* Only where links are asked for: every two different sets of a component meet once, in blocks that bring
   their whole sets along. What they share is counted exactly there, by matrix products over the items that many of a
   block have, so that no link is lost and pairs are listed only if they are the result.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fits, mix, shared_dir, shingle_sets, written
from .components import components

SLOTS = 1 << 18
STARS = 3
SALTS = 16
#: A single shingle's meeting is dealt over parts of so many members on the average.
PART = 1 << 16
SEEN = 200_000
BLOCK = 2048
#: Of each member so many of its least signatures are known where pairs are made.
LEAST = 8
#: Links are counted in blocks of so many sets of a component, TILE rows at a time; items that at most FEW have, one by one.
WITHIN, TILE, FEW = 4096, 512, 8
#: Bytes of sets that a block of a component has on the average at most.
HELD = 1 << 23
_U = np.uint64


def _missing(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100


def _smallest(percent: int) -> int:
    """The least size that can have a partner with another set."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def _bits(n: int) -> int:
    return max(512, 4 << (n - 1).bit_length())


def _thin(n: int) -> int:
    return max(512, 1 << (n - 1).bit_length())


def _bitmap(u: np.ndarray, size: int) -> bytes:
    """Parity of the hashes that fall on each of a power of two of bits; halves fold onto each other by xor."""
    parity = np.bincount((u & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(bool), bitorder="little").tobytes()


def _differences(a: bytes, b: bytes) -> int:
    """A lower bound on the size of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _size_class(n: int) -> int:
    return n.bit_length()


def _groups(size_class: int) -> int:
    return max(1, (1 << (size_class - 1)) // 8)


def signatures(u: np.ndarray, counts: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(single, combined) signatures of one set; ``counts``: the table of SLOTS counters."""
    n = len(u)
    if n < _smallest(percent):
        return np.empty(0, _U), np.empty(0, _U)
    often = counts[(u & _U(SLOTS - 1)).astype(np.int64)]
    order = np.lexsort((u, often))
    need = _missing(n, percent) + 1
    rare = int(np.count_nonzero(often < frequent))
    if rare >= need:
        return u[order[:need]], np.empty(0, _U)
    common, combined = u[order[rare:]], []
    hashed = mix(common)
    low = -(-percent * n // 100)
    for size_class in range(_size_class(low), _size_class(n) + 1):
        groups = _groups(size_class)
        group = (hashed % _U(groups)).astype(np.int64)
        first = np.zeros(len(group), bool)
        first[np.unique(group, return_index=True)[1]] = True
        reached = np.flatnonzero(rare + np.cumsum(~first) >= need)
        last = int(reached[0]) + 1 if len(reached) else len(group)
        by_group = np.argsort(group[:last], kind="stable")
        g, t = group[:last][by_group], common[:last][by_group]
        start = np.searchsorted(g, g)
        for back in range(1, int(np.bincount(g).max(initial=0))):
            later = np.flatnonzero(np.arange(len(g)) - start >= back)
            lo, hi = np.minimum(t[later], t[later - back]), np.maximum(t[later], t[later - back])
            combined.append(mix(mix(lo + _U(size_class)) + hi))
    return u[order[:rare]], np.concatenate(combined) if combined else np.empty(0, _U)


def _digests(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bitmap", pa.binary()), ("thin", pa.binary()), ("slot", pa.int32()), ("times", pa.int64())])

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n, d1, d2, maps, thin, at = [], [], [], [], [], []
            for u in shingle_sets(batch.column(1), width):
                n.append(len(u))
                d1.append(int(mix(u).sum(dtype=_U)) if len(u) else 0)
                d2.append(int(mix(u + _U(0x632BE59BD9B4E019)).sum(dtype=_U)) if len(u) else 0)
                maps.append(_bitmap(u, _bits(len(u))) if len(u) else b"")
                thin.append(_bitmap(u, _thin(len(u))) if len(u) else b"")
                at.append((u & _U(SLOTS - 1)).astype(np.int64))
            if at:
                counts += np.bincount(np.concatenate(at), minlength=SLOTS)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(d1, _U).view(np.int64)), pa.array(np.array(d2, _U).view(np.int64)), pa.array(maps, pa.binary()), pa.array(thin, pa.binary()), none.cast(pa.int32()), none], schema=schema)
        used = np.flatnonzero(counts)
        for a in range(0, len(used), 1 << 16):
            part = used[a : a + (1 << 16)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.binary()), pa.array(part.astype(np.int32)), pa.array(counts[part])], schema=schema)

    return run


def _postings(width: int, percent: int, table):
    """(sig, part, key, n): part is -1 for a single, else the salt of a combination."""
    schema = pa.schema([("sig", pa.int64()), ("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        counts, frequent = table.value
        seen: OrderedDict = OrderedDict()  # sets that this task has posted: copies post once a task, or more if many sets come between
        for batch in batches:
            sig, part, key, size, held = [], [], [], [], 0
            for u in shingle_sets(batch.column(0), width):
                if len(u) < _smallest(percent):
                    continue
                d = int(mix(u).sum(dtype=_U))
                if d in seen:
                    seen.move_to_end(d)
                    continue
                seen[d] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                one, two = signatures(u, counts, frequent, percent)
                sig += [one, two]
                # a slot's count bounds its shingles' own: large ones meet in parts first, as combinations do
                parts = counts[(one & _U(SLOTS - 1)).astype(np.int64)] // PART
                part += [np.where(parts > 0, (d & (1 << 40) - 1) % (parts + 1), -1).astype(np.int32), np.full(len(two), d % SALTS, np.int32)]
                m = len(one) + len(two)
                key.append(np.full(m, d, _U))
                size.append(np.full(m, len(u), np.int64))
                held += m
                if held >= 1 << 17:
                    yield _batch(schema, sig, part, key, size)
                    sig, part, key, size, held = [], [], [], [], 0
            if held:
                yield _batch(schema, sig, part, key, size)

    return run


def _batch(schema, sig, part, key, size):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(part)), pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(size))], schema=schema)


def _stars(count: int, seed: int, percent: int):
    """Rows (sig, part, parts, key, c, n) sorted by sig, part and n. kind 0: pairs of members with ``count`` of their
    part's members in another component, of a size that may link; kind 1: the members that any such partner may be there
    for (of a meeting in one part this is known, else all)."""
    schema = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("key", pa.int64()), ("other", pa.int64())])

    def flush(sig, part, parts, key, c, n):
        run_of = np.cumsum(np.append(False, (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])))
        at = run_of * (1 << 40) + n
        lo = np.searchsorted(at, run_of * (1 << 40) - (-percent * n // 100))
        hi = np.searchsorted(at, run_of * (1 << 40) + n * 100 // percent, side="right")
        change = np.append(np.flatnonzero((c[1:] != c[:-1]) | (run_of[1:] != run_of[:-1])) + 1, len(c))
        following = change[np.searchsorted(change, np.arange(len(c)), side="right")]
        keep = (c[lo] != c) | (following[lo] < hi) | (parts > 1)
        run_of, sig, key, c, n = run_of[keep], sig[keep], key[keep], c[keep], n[keep]
        yield out(1, sig, key, key)
        if not len(sig):
            return
        start = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
        length = np.diff(np.append(start, len(sig)))
        run_of = np.repeat(np.arange(len(start)), length)
        pairs = []
        for star in range(count):
            first = np.lexsort((mix(key.view(_U) + _U(seed + star)), run_of))[start]
            other, whose, size = (np.repeat(x[first], length) for x in (key, c, n))
            ok = (whose != c) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
            pairs.append(np.stack([np.minimum(key[ok], other[ok]), np.maximum(key[ok], other[ok])]))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield out(0, a, a, b)

    def out(kind, sig, key, other):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), kind, np.int32)), pa.array(sig), pa.array(key), pa.array(other)], schema=schema)

    def run(batches):
        held: list = []
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(6)]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) >= 1 << 17 else []
            if len(last):
                cut = int(last[-1]) + 1
                yield from flush(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield from flush(*held)

    return run


def _meet(final: bool):
    """From rows (sig, part, key, n) sorted by sig, part, key: kind 0 pairs (key, other) with each run's representatives,
    kind 1 the run's members, kind 2 (unless final) a representative to meet those of the signature's other parts."""
    schema = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("key", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def flush(sig, part, key, n):
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        again = np.zeros(len(sig), bool)
        again[1:] = ~new[1:] & (key[1:] == key[:-1])
        if not final:
            salted = start[part[start] >= 0]
            yield out(2, sig[salted], key[salted], key[salted], n[salted])
        sig, key, n, new = sig[~again], key[~again], n[~again], new[~again]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(sig)))
        run = np.repeat(np.arange(len(start)), length)
        many = length[run] > 1
        sig, key, n, run = sig[many], key[many], n[many], run[many]
        if not len(sig):
            return
        start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        length = np.diff(np.append(start, len(sig)))
        yield out(1, sig, key, key, n)
        for star in range(STARS):
            rank = mix(key.view(_U) + _U(star))
            first = np.lexsort((rank, run))[start]
            other, size = np.repeat(key[first], length), np.repeat(n[first], length)
            ok = other != key
            yield out(0, sig[ok], np.minimum(key[ok], other[ok]), np.maximum(key[ok], other[ok]), size[ok])

    def out(kind, sig, key, other, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), kind, np.int32)), pa.array(sig), pa.array(key), pa.array(other), pa.array(n)], schema=schema)

    def run(batches):
        held: list = []
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            if len(held[0]) < 1 << 16:
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(last):
                cut = int(last[-1]) + 1
                yield from flush(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield from flush(*held)

    return run


def _fold(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def _rest(percent: int, forest: bool):
    """From rows (sig, i, j, block, c, n, rep, key, bitmap, least) sorted by sig, i, j, n: pairs of different components,
    one from block i and one from block j, whose sizes and bitmaps allow a link. No other pair is ever made.

    least: the smallest signatures of a member, in order; pairs are left out that meet at a smaller one of both.
    forest: of these only so many as join, within the meeting, all components that they could join; least is not asked."""
    schema = pa.schema([(x, pa.int64()) for x in ("ra", "na", "ka", "rb", "nb", "kb")])

    def pairs(sig, block, c, n, bits, least):
        one_block = block[0] == block[-1] and (block == block[0]).all()
        edges = np.append(np.flatnonzero(np.append(True, np.diff([len(b) for b in bits]) != 0)), len(bits))
        classes = [(a, b, np.frombuffer(b"".join(bits[a:b]), np.uint64).reshape(b - a, -1)) for a, b in zip(edges, edges[1:])]
        folded = [None, *(_fold(m) if m.shape[1] == 2 * before.shape[1] else None for (_, _, before), (_, _, m) in zip(classes, classes[1:]))]
        last = np.searchsorted(n, n * 100 // percent, side="right")
        c = np.unique(c, return_inverse=True)[1]
        for k, (a, b, own) in enumerate(classes):
            for x in range(a, b):
                for lo, hi, maps in ((a, b, own), *([(classes[k + 1][0], classes[k + 1][1], folded[k + 1])] if k + 1 < len(classes) and folded[k + 1] is not None else [])):
                    u, v = max(lo, x + 1), min(hi, int(last[x]))
                    if u >= v:
                        continue
                    both = n[u:v] + n[x]
                    most = both - 2 * (-(-percent * both // (100 + percent)))
                    ok = (np.bitwise_count(maps[u - lo : v - lo] ^ own[x - a]).sum(1) <= most) & (c[u:v] != c[x])
                    if not one_block:
                        ok &= block[u:v] != block[x]
                    while len(near := np.flatnonzero(ok)):
                        if not forest:
                            theirs = least[near + u]
                            elsewhere = ((theirs[:, :, None] == least[x]).any(2) & (theirs < sig)).any(1)
                            yield from ((x, int(y) + u) for y in near[~elsewhere])
                            break
                        yield x, int(near[0]) + u
                        c[c == c[near[0] + u]] = c[x]
                        ok &= c[u:v] != c[x]

    def flush(t):
        sig, i, j, block, c, n, rep, key = (t.column(x).to_numpy() for x in range(8))
        bits = t.column(8).to_pylist()
        least = np.full((len(bits), LEAST), np.iinfo(np.int64).max)
        for k, own in enumerate(t.column(9).to_pylist() if not forest else ()):
            least[k, : len(own)] = own
        start = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        out = []
        for a, b in zip(start, np.append(start[1:], len(sig))):
            out += [(a + x, a + y) for x, y in pairs(sig[a], block[a:b], c[a:b], n[a:b], bits[a:b], least[a:b])]
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (rep[x], n[x], key[x], rep[y], n[y], key[y])], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            held = held.combine_chunks()
            at = [held.column(x).to_numpy() for x in range(3)]
            last = np.flatnonzero((at[0] != at[0][-1]) | (at[1] != at[1][-1]) | (at[2] != at[2][-1])) if len(held) else []
            if len(last) and len(held) >= 4 * BLOCK:
                cut = int(last[-1]) + 1
                yield flush(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield flush(held)

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]):
    """(first row, counts) by TILE sets of ``left``: how many items each has in common with each set of ``right``.

    Items that many of ``right`` have are counted by matrix products, the others posting by posting.
    """
    m = len(right)
    owner = np.repeat(np.arange(m), [len(u) for u in right])
    item = np.concatenate(right)
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    times = np.diff(np.append(start, len(item)))
    known = item[start]
    often = np.flatnonzero((times > FEW) & (times < m))
    place = np.full(len(known), -1)
    place[often] = np.arange(len(often))
    posting = place[np.repeat(np.arange(len(start)), times)]
    for a in range(0, len(left), TILE):
        some = left[a : a + TILE]
        row = np.repeat(np.arange(len(some)), [len(u) for u in some])
        mine = np.concatenate(some)
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        there = known[at] == mine
        row, at = row[there], at[there]
        same = np.bincount(row[times[at] == m], minlength=len(some)).astype(np.float32)[:, None] + np.zeros((1, m), np.float32)
        few = np.flatnonzero((times[at] <= FEW) & (times[at] < m))
        if len(few):
            n = times[at[few]]
            behind = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(row[few], n) * m + owner[np.repeat(start[at[few]], n) + behind]
            same += np.bincount(pair, minlength=len(some) * m).reshape(len(some), m)
        for k in range(0, len(often), 1024):
            width = min(1024, len(often) - k)
            own = np.flatnonzero((place[at] >= k) & (place[at] < k + width))
            if not len(own):
                continue
            x, y = np.zeros((len(some), width), np.float32), np.zeros((m, width), np.float32)
            x[row[own], place[at[own]] - k] = 1
            theirs = np.flatnonzero((posting >= k) & (posting < k + width))
            y[owner[theirs], posting[theirs] - k] = 1
            same += x @ y.T
        yield a, same


def _within(percent: int, counted: bool):
    """From rows (c, i, j, block, n, rep, key, items) sorted by c, i, j, block, n: every link of a component between one
    set of block i and one of block j; each pair of sets meets once. counted: for each set (rep, key, n) how many links it
    has in the meeting, else the links (a, b)."""

    def flush(t):
        c, i, j, block, n, rep, key = (t.column(x).to_numpy() for x in range(7))
        items = t.column(7)
        start = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        times, one, two = np.zeros(len(c), np.int64), [], []
        for a, b in zip(start, np.append(start[1:], len(c))):
            sets = [np.frombuffer(x, _U) for x in items.slice(a, b - a).to_pylist()]
            alone = i[a] == j[a]
            half = len(sets) if alone else int(np.searchsorted(block[a:b], block[a], side="right"))
            left, right, u = (sets, sets, a) if alone else (sets[:half], sets[half:], a + half)
            if not right or alone and len(sets) == 1:
                continue
            own = n[u:b]
            for x, same in _shared(left, right):
                rows = n[a + x : a + x + len(same), None]
                linked = 100 * same >= percent * (rows + own - same)
                if alone:
                    linked[np.arange(len(same)), np.arange(x, x + len(same))] = False
                times[a + x : a + x + len(same)] += linked.sum(1)
                if not alone:
                    times[u:b] += linked.sum(0)
                if not counted:
                    p, q = np.nonzero(linked)
                    once = p + x < q if alone else np.ones(len(p), bool)
                    one.append(rep[a + x + p[once]])
                    two.append(rep[u + q[once]])
        if counted:
            some = times > 0
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (rep, key, n, times)], names=["rep", "d1", "n", "n_links"])
        x, y = (np.concatenate([np.empty(0, np.int64), *z]) for z in (one, two))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            whole = tuple(held[0].column(x)[0].as_py() for x in range(3)) != tuple(batch.column(x)[batch.num_rows - 1].as_py() for x in range(3))
            if whole and size >= TILE:
                t = pa.Table.from_batches(held).combine_chunks()
                at = [t.column(x).to_numpy() for x in range(3)]
                cut = int(np.flatnonzero((at[0] != at[0][-1]) | (at[1] != at[1][-1]) | (at[2] != at[2][-1]))[-1]) + 1
                yield flush(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = len(t) - cut
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


_MET = "kind int, sig long, key long, other long, n long"


def _close(percent: int):
    """Keeps pairs whose sizes and bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            x = {name: batch.column(name) for name in batch.schema.names}
            na, nb = x["na"].to_numpy(), x["nb"].to_numpy()
            keep = np.zeros(len(na), bool)
            for i, (a, b) in enumerate(zip(x["ma"].to_pylist(), x["mb"].to_pylist())):
                both = int(na[i] + nb[i])
                most = both - 2 * (-(-percent * both // (100 + percent)))  # of the symmetric difference, in a link
                keep[i] = _differences(a, b) <= most
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([x["a"].filter(kept), x["b"].filter(kept)], names=["a", "b"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in shingle_sets(batch.column(1), width)], pa.binary())], names=["id", "items"])

    return run


def _keyed_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [u for u in shingle_sets(batch.column(1), width)]
            key = np.array([int(mix(u).sum(dtype=_U)) if len(u) else 0 for u in sets], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array([len(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], names=["rep", "d1", "n", "items"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): one row per row of ``docs``.

    component_id: the smallest doc_id that links reach. n_links: how many different sets of other rows the row's set
    links to (without ``links`` the column is left out, and only as many links are verified as make the components). A
    null or empty text, or one without words, has no shingles and only itself as its component. A null doc_id gives a
    null component. Rows that repeat a doc_id are kept, each with the component of its own set's class. Other columns
    of ``docs`` are not read.
    """
    ids, classes, found, within = _joined(spark, docs, width, percent, id_col, text_col)
    classes = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    names = ["d1", "d2", "n", F.coalesce("component", "rep").alias("c")]
    if links:
        degree = within(True, "rep long, d1 long, n long, n_links long").groupBy("rep", "d1", "n").agg(F.sum("n_links").alias("n_links"))
        classes = classes.join(degree, ["rep", "d1", "n"], "left")
        names.append("n_links")
    out = ids.join(classes.select(*names), ["d1", "d2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"), *(["n_links"] if links else []))
    return out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))) if links else out


def ngram_jaccard_links(spark: SparkSession, docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a <= b: every link between different sets, as the smallest doc_ids that have them.

    a = b where one doc_id has two linked sets. Equal sets are one: their rows are told by ``ngram_jaccard_join``.
    """
    return _joined(spark, docs, width, percent, id_col, text_col)[3](False, "a long, b long")


def _joined(spark: SparkSession, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str):
    """The rows' digests, the classes of equal sets, the components of their representatives, and what gives all links."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    shared_dir(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = written(spark, docs.mapInArrow(_digests(width), "doc_id long, n long, d1 long, d2 long, bitmap binary, thin binary, slot int, times long"), "digests")
    ids = both.where("slot is null").select("doc_id", "n", "d1", "d2", "bitmap", "thin")
    counts = np.zeros(SLOTS, np.int64)
    for slot, times in both.where("slot is not null").groupBy("slot").agg(F.sum("times")).toLocalIterator():  # SLOTS rows at most
        counts[slot] = times
    mean = float(counts.mean())
    frequent = int(mean + max(64.0, 8 * mean**0.5))
    table = spark.sparkContext.broadcast((counts, frequent))

    classes = written(spark, ids.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    posted = docs.where("doc_id is not null and text is not null").select("text").mapInArrow(_postings(width, percent, table), "sig long, part int, key long, n long")
    parts = posted.repartition("sig", "part").sortWithinPartitions("sig", "part", "key").mapInArrow(_meet(False), _MET)
    parts = written(spark, parts, "parts")
    heads = parts.where("kind = 2").select("sig", F.lit(-1).alias("part"), "key", "n")
    joined = written(spark, heads.repartition("sig").sortWithinPartitions("sig", "part", "key").mapInArrow(_meet(True), _MET), "heads")
    met = parts.where("kind < 2").union(joined)

    # classes by key; two classes of one key (a collision of 64 bits) both take part
    by_key = classes.where(F.col("n") >= _smallest(percent)).select(F.col("d1").alias("key"), "rep", "n")
    maps = ids.select(F.col("doc_id").alias("rep"), F.col("bitmap"), F.col("thin"), F.col("n").alias("m"), F.col("d1").alias("k"))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs: distinct (ra, na, rb, nb) of representatives."""
        fit = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ra") != F.col("rb"))
        pairs = pairs.where(fit)
        near = pairs.join(maps.select(F.col("rep").alias("ra"), F.col("bitmap").alias("ma"), F.col("m").alias("na"), F.col("k").alias("ka")), ["ra", "na", "ka"])
        near = near.join(maps.select(F.col("rep").alias("rb"), F.col("bitmap").alias("mb"), F.col("m").alias("nb"), F.col("k").alias("kb")), ["rb", "nb", "kb"])
        near = near.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb", "ma", "mb").mapInArrow(_close(percent), "a long, b long")
        near = written(spark, near.distinct(), "near")
        wanted = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
        # a doc_id that repeats with another text: the set of the class must be the one compared
        own = docs.join(fits(wanted), "doc_id", "left_semi").mapInArrow(_sets(width), "id long, items binary")
        sets = written(spark, own, "sets")
        whole = near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        links = written(spark, whole.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long").distinct(), "links")
        drop(spark, near, sets)
        return links

    def with_classes(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(by_key.select("key", F.col("rep").alias("ra"), F.col("n").alias("na")), "key").withColumnRenamed("key", "ka")
        return pairs.join(by_key.select(F.col("key").alias("other"), F.col("rep").alias("rb"), F.col("n").alias("nb")), "other").withColumnRenamed("other", "kb")

    links = verified(with_classes(met.where("kind = 0").select("key", "other").distinct()))
    members = written(spark, met.where("kind = 1").select("sig", "key").distinct().join(by_key, "key"), "members")
    drop(spark, parts, joined)

    def mixed() -> DataFrame:
        """(sig, key, rep, n, c) of the meetings that still have members of two components."""
        now = members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("sig", "key", "rep", "n", F.coalesce("component", "rep").alias("c"))
        apart = now.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        return now.join(apart.select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "sig")

    def compared(now: DataFrame, forest: bool) -> DataFrame:
        if forest:
            now = now.withColumn("least", F.array().cast("array<long>"))
        else:
            now = written(spark, now, "mixed")
            now = now.join(now.groupBy(F.col("rep").alias("r"), F.col("key").alias("k")).agg(F.slice(F.sort_array(F.collect_set("sig")), 1, LEAST).alias("least")), [F.col("rep") == F.col("r"), F.col("key") == F.col("k")]).drop("r", "k")
        # a meeting of many members is cut into blocks that meet two by two, so that no task has more than two blocks of it
        now = now.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        now = now.join(maps.select("rep", F.col("m").alias("n"), F.col("k").alias("key"), F.col("thin").alias("bitmap")), ["rep", "n", "key"])
        now = now.select("sig", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "c", "n", "rep", "key", "bitmap", "least")
        return now.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n").mapInArrow(_rest(percent, forest), "ra long, na long, ka long, rb long, nb long, kb long").distinct()

    def settled(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """The components so far; those known before come as stars, on which few rounds are left to do."""
        if before is not None:
            links = links.select("a", "b").union(before.where("id <> component").select("id", "component"))
        return written(spark, components(spark, links), "components")

    # more stars between components, then what could join components, then every pair that may still link
    found = settled(links)
    drop(spark, links)
    parts = F.ceil(F.col("blocks") * BLOCK / PART).cast("int")
    apart = mixed().withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    apart = apart.repartition("sig", "part").sortWithinPartitions("sig", "part", "n").select("sig", "part", "parts", "key", "c", "n")
    more = apart.mapInArrow(_stars(4, STARS, percent), "kind int, sig long, key long, other long")
    more = written(spark, more, "stars")
    all_members, members = members, written(spark, more.where("kind = 1").select("sig", "key").join(by_key, "key"), "members")
    drop(spark, all_members)
    links = verified(with_classes(more.where("kind = 0").select("key", "other").distinct()))
    drop(spark, more)
    for forest in (True, False):
        found = settled(links, found)
        drop(spark, links)
        links = verified(compared(mixed(), forest))
    found = settled(links, found)
    drop(spark, members, links)

    def within(counted: bool, schema: str) -> DataFrame:
        # all links are inside components: there every two sets of fitting size and bitmap are compared, each pair once
        own = classes.join(found.select(F.col("id").alias("rep"), F.col("component").alias("c")), "rep").select("rep", "d1", "n", "c")
        blocks = F.ceil(F.greatest(F.count("*") / WITHIN, F.sum("n") * 8 / HELD)).cast("int")
        own = written(spark, own.join(own.groupBy("c").agg(blocks.alias("blocks")), "c"), "joined")
        texts = docs.join(fits(own.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        sets = written(spark, texts.mapInArrow(_keyed_sets(width), "rep long, d1 long, n long, items binary"), "sets")
        # a doc_id that repeats with equal sets is there once
        sets = own.join(sets.groupBy("rep", "d1", "n").agg(F.first("items").alias("items")), ["rep", "d1", "n"])
        block = F.pmod(F.xxhash64("rep", "d1"), F.col("blocks")).cast("int")
        sets = sets.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sets = sets.select("c", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "n", "rep", F.col("d1").alias("key"), "items")
        return sets.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "block", "n").mapInArrow(_within(percent, counted), schema)

    return ids, classes, found, within
