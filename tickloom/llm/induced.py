"""Suffix sorting of one shard by external induced sorting, with common-prefix values.

A suffix is S-type if it is smaller than the one behind it, else L-type; LMS suffixes are
the S-type ones behind an L-type one. LMS substrings are sorted by induction and named,
the string of names is sorted, and L-type and then S-type suffixes are induced from that
order. Induction runs through priority queues, one for each first character: a
character's tuples (position, common prefix with the tuple before) arrive in their final
order, so a queue is a sequence of blocks. The common prefix of two induced suffixes is
one more than the least common prefix between their inducers; the minimum is carried
along for each queue.

The string of names has a large alphabet, over which induction can't go in blocks: its
ties are split by doubling instead, a run of ties at a time, and as only ``depth``
characters count a logarithm of ``depth`` rounds is enough.

Memory: text, types, orders, names, ranks and hashes are arrays of an ``Arena`` and the
queues are ``BlockQueues``; either holds at most ``memory`` bytes and keeps the rest in
unnamed scratch files of the task. All steps go over them ``CHUNK`` entries at a time
(a run of ties at once), sorted suffixes leave in blocks, and a shard's text is gathered
in a file, so that a shard may be far larger than the memory of its task.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from tickloom.llm import common

CHUNK = 1 << 22


class Arena:
    """Arrays of one shard: in memory up to a number of bytes, beyond that in unnamed scratch files."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0

    def empty(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if not n or self.held + size <= self.memory:
            self.held += size
            return np.empty(n, kind)
        with tempfile.TemporaryFile() as file:
            return np.memmap(file, kind, "w+", shape=(n,))


class BlockQueues:
    """A double-ended queue of array blocks for each key; when they outgrow ``memory``, the blocks go to a scratch file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.blocks, self.file = memory, 0, {}, None

    def put(self, key: int, *arrays: np.ndarray) -> None:
        self.blocks.setdefault(key, deque()).append(arrays)
        self.held += sum(x.nbytes for x in arrays)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in self.blocks.values():
            for i, x in enumerate(blocks):
                if isinstance(x, tuple):
                    blocks[i] = self.file.tell()
                    np.save(self.file, np.int64(len(x)))
                    for y in x:
                        np.save(self.file, y)
        self.held = 0

    def _read(self, x) -> tuple[np.ndarray, ...]:
        if isinstance(x, tuple):
            self.held -= sum(y.nbytes for y in x)
            return x
        self.file.seek(x)
        return tuple(np.load(self.file) for _ in range(int(np.load(self.file))))

    def take(self, key: int, most: int) -> tuple[np.ndarray, ...] | None:
        """The first blocks as one, of about ``most`` entries; None if there is none."""
        blocks = self.blocks.get(key)
        out, size = [], 0
        while blocks and size < most:
            out.append(self._read(blocks.popleft()))
            size += len(out[-1][0])
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None

    def take_last(self, key: int) -> tuple[np.ndarray, ...] | None:
        blocks = self.blocks.get(key)
        return self._read(blocks.pop()) if blocks else None

    def close(self) -> None:
        if self.file:
            self.file.close()


def chunks(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(a + size, n)


class Shard:
    """Text of one shard: characters 2 and up, 1 between strings, a final 0."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 256 << 20, chunk: int = CHUNK, arena: Arena | None = None):
        self.text, self.depth, self.memory, self.chunk, self.size = text, depth, memory, chunk, len(text)
        self.arena = arena or Arena(memory)
        self.place = np.int32 if self.size < 1 << 31 else np.int64
        self._types()
        starts = lambda a, b: np.flatnonzero(self.is_s[a:b] & ~np.append(a == 0 or self.is_s[a - 1], self.is_s[a : b - 1])) + a
        self.lms = self.arena.empty(sum(len(starts(a, b)) for a, b in chunks(self.size, chunk)), self.place)
        self.counts, done = np.zeros(258, np.int64), 0
        for a, b in chunks(self.size, chunk):
            found = starts(a, b)
            self.lms[done : done + len(found)] = found
            self.counts += np.bincount(text[a:b], minlength=258)
            done += len(found)
        self.chars = np.flatnonzero(self.counts).tolist()

    def _types(self) -> None:
        """S-types, and the last place of the run of equal characters that each place is in; from the end on."""
        self.is_s, self.run_end = self.arena.empty(self.size, bool), self.arena.empty(self.size, self.place)
        ahead, end, smaller = None, self.size - 1, True
        for a, b in reversed(list(chunks(self.size, self.chunk))):
            part = self.text[a:b].astype(np.int16)
            behind = np.append(part[1:], part[-1] if ahead is None else ahead)
            last = np.flatnonzero(part != behind)
            lengths = np.diff(np.concatenate([[-1], last, [b - a - 1]]))
            self.run_end[a:b] = np.repeat(np.append(last + a, end), lengths)
            self.is_s[a:b] = np.repeat(np.append(part[last] < behind[last], smaller), lengths)
            ahead, end, smaller = part[0], int(self.run_end[a]), bool(self.is_s[a])

    def _push(self, queues: BlockQueues, carry: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None, chosen: np.ndarray) -> np.ndarray:
        """Queue what the chosen members of a block induce; returns the characters that got tuples."""
        if not len(chosen):
            if lcp is not None and len(lcp):
                np.minimum(carry, lcp.min(), out=carry)
            return chosen
        ahead = pos[chosen] - 1
        chars = self.text[ahead]
        order = np.argsort(chars, kind="stable")
        ahead, chars, chosen = ahead[order], chars[order], chosen[order]
        first = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
        ends = np.append(first[1:], len(chars))
        if lcp is None:
            for a, b in zip(first, ends, strict=True):
                queues.put(int(chars[a]), ahead[a:b])
            return chars[first]
        kept = carry.copy()
        np.minimum(carry, lcp.min(), out=carry)
        for a, b in zip(first, ends, strict=True):
            p, at = int(chars[a]), chosen[a:b]
            least = np.minimum.reduceat(lcp, np.append(0, at[at + 1 < len(lcp)] + 1))
            new = least[: b - a].copy()
            new[0] = min(new[0], kept[p])
            queues.put(p, ahead[a:b], np.minimum(new + 1, self.depth).astype(np.int16))
            carry[p] = least[-1] if len(least) > b - a else self.depth
        return chars[first]

    def induce(self, seeds: dict[int, tuple[np.ndarray, np.ndarray | None]], with_lcp: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Sort all suffixes from the order of LMS ones (by first character): blocks from the largest suffix to the
        smallest, with common prefixes with the suffix just before."""
        text = self.text
        work, sorted_l = BlockQueues(self.memory), BlockQueues(self.memory)
        carry = np.full(258, -1, np.int16)
        run = lambda i: int(self.run_end[i]) - int(i) + 1
        for c in self.chars:
            final = None
            while (ready := work.take(c, self.chunk)) is not None:
                pos, lcp = ready if with_lcp else (ready[0], None)
                if with_lcp and final is None:
                    lcp[0] = 0
                sorted_l.put(c, *ready)
                ok = np.flatnonzero(pos > 0)
                ok = ok[text[pos[ok] - 1] >= c]
                self._push(work, carry, pos, lcp, ok)
                final = int(pos[-1])
            if c in seeds:
                for a, b in chunks(len(seeds[c][0]), self.chunk):
                    pos, lcp = np.array(seeds[c][0][a:b]), np.array(seeds[c][1][a:b]) if with_lcp else None
                    if with_lcp and a == 0:
                        lcp[0] = 0 if final is None else min(run(final), run(pos[0]), self.depth)
                    self._push(work, carry, pos, lcp, np.flatnonzero(pos > 0))
        carry = np.full(258, -1, np.int16)
        for c in self.chars[::-1]:
            final = None
            while (ready := work.take(c, self.chunk)) is not None:
                pos, lcp = ready if with_lcp else (ready[0], None)
                if with_lcp and final is None:
                    lcp[0] = 0
                yield pos, lcp
                ok = np.flatnonzero(pos > 0)
                ok = ok[text[pos[ok] - 1] <= c]
                self._push(work, carry, pos, lcp, ok)
                final = int(pos[-1])
            ahead = None  # common prefix of the last block's first with this block's last
            while (block := sorted_l.take_last(c)) is not None:
                pos, lcp = block[0][::-1], None
                if with_lcp:
                    up = block[1][::-1]
                    lcp = np.empty_like(up)
                    lcp[1:] = up[:-1]
                    lcp[0] = ahead if ahead is not None else 0 if final is None else min(run(final), run(pos[0]), self.depth)
                    ahead = up[-1]
                yield pos, lcp
                ok = np.flatnonzero(pos > 0)
                ok = ok[text[pos[ok] - 1] < c]
                self._push(work, carry, pos, lcp, ok)
        work.close()
        sorted_l.close()

    def _starts(self, pos: np.ndarray) -> dict[int, tuple[int, int]]:
        """Where the positions of each first character begin and end, once they are in order of it."""
        counts = np.zeros(258, np.int64)
        for a, b in chunks(len(pos), self.chunk):
            counts += np.bincount(self.text[pos[a:b]], minlength=258)
        ends = np.cumsum(counts)
        return {c: (int(ends[c] - counts[c]), int(ends[c])) for c in np.flatnonzero(counts).tolist()}

    def _substring_order(self) -> np.ndarray:
        """Numbers of the LMS suffixes in order of their LMS substrings, by induction from their first characters."""
        lms, m = self.lms, len(self.lms)
        number = self.arena.empty(self.size, self.place)
        for a, b in chunks(self.size, self.chunk):
            number[a:b] = -1
        at = self._starts(lms)
        dealt, free = self.arena.empty(m, self.place), {c: a for c, (a, _) in at.items()}
        for a, b in chunks(m, self.chunk):
            pos = np.array(lms[a:b])
            number[pos] = np.arange(a, b)
            chars = self.text[pos]
            order = np.argsort(chars, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(chars[order]) != 0))
            for x, y in zip(first, np.append(first[1:], b - a), strict=True):
                c = int(chars[order[x]])
                dealt[free[c] : free[c] + y - x] = pos[order[x:y]]
                free[c] += int(y - x)
        out, left = self.arena.empty(m, self.place), m
        for pos, _ in self.induce({c: (dealt[a:b], None) for c, (a, b) in at.items()}, False):
            found = number[pos]
            found = found[found >= 0]
            out[left - len(found) : left] = found[::-1]
            left -= len(found)
        if left:  # the final 0 isn't induced; it is the smallest
            out[0] = m - 1
        return out

    def sort_lms(self, prefix: np.ndarray) -> np.ndarray:
        """LMS suffixes in order of their first ``depth`` characters at least."""
        lms, m = self.lms, len(self.lms)
        order, rank = self._substring_order(), self.arena.empty(m, np.int64)
        before, first = None, 0
        for a, b in chunks(m, self.chunk):
            mine = np.array(order[a:b])
            start = lms[mine].astype(np.int64)
            stop = np.where(mine + 1 < m, lms[np.minimum(mine + 1, m - 1)], self.size - 1).astype(np.int64) + 1
            name = span_hash(prefix, start, stop)
            begins = np.append(before is None or name[0] != before, name[1:] != name[:-1])
            places = np.maximum.accumulate(np.where(begins, np.arange(a, b), first))
            rank[mine] = places
            before, first = name[-1], int(places[-1])
        # A rank is the place of its tie's first member. Doubling: ties are sorted by the rank ``step`` names on.
        active, many, step = order, m, 1
        tied = self.arena.empty(m, self.place)
        while step <= self.depth // 2 + 1:
            kept = 0
            for a, b in chunks(many, self.chunk):
                mine = np.array(active[a:b])
                r = rank[mine]
                left = np.append(a > 0 and rank[active[a - 1]] == r[0], r[1:] == r[:-1])
                right = np.append(r[1:] == r[:-1], b < many and rank[active[b]] == r[-1])
                mine = mine[left | right]
                tied[kept : kept + len(mine)] = mine
                kept += len(mine)
            active, many = tied, kept
            if not many:
                break
            a = 0
            while a < many:
                b = min(a + self.chunk, many)
                while b < many:  # whole ties
                    end = min(b + self.chunk, many)
                    other = np.flatnonzero(rank[active[b:end]] != rank[active[b - 1]])
                    b = b + int(other[0]) if len(other) else end
                    if len(other):
                        break
                mine = np.array(active[a:b])
                behind = mine.astype(np.int64) + step
                key = np.where(behind < m, rank[np.minimum(behind, m - 1)], -1)
                inner = np.lexsort((key, rank[mine]))
                mine, key = mine[inner], key[inner]
                group = rank[mine]
                begins = np.append(True, group[1:] != group[:-1])
                base = np.maximum.accumulate(np.where(begins, np.arange(len(mine)), 0))
                differs = begins | np.append(True, key[1:] != key[:-1])
                offset = np.maximum.accumulate(np.where(differs, np.arange(len(mine)), 0)) - base
                order[group + np.arange(len(mine)) - base] = mine
                rank[mine] = group + offset
                tied[a:b] = mine
                a = b
            step *= 2
        out = self.arena.empty(m, self.place)
        for a, b in chunks(m, self.chunk):
            out[a:b] = lms[order[a:b]]
        return out

    def common_prefix(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes a and b, at most ``depth``, by binary search over hashes."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        at_a, at_b, scale_a, scale_b = prefix[a], prefix[b], POWERS.down(a), POWERS.down(b)
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.depth, self.size - np.maximum(a, b))
        open_ = np.flatnonzero(high > 0)
        for turn in range(64):  # probes: all of it, then a few characters, then halves
            if not len(open_):
                break
            lo, hi = low[open_], high[open_]
            mid = hi if turn == 0 else np.minimum(np.maximum(lo + 1, 12), hi) if turn == 1 else (lo + hi + 1) // 2
            same = (prefix[a[open_] + mid] - at_a[open_]) * scale_a[open_] == (prefix[b[open_] + mid] - at_b[open_]) * scale_b[open_]
            low[open_], high[open_] = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            open_ = open_[low[open_] < high[open_]]
        return low.astype(np.int16)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks (positions, common prefixes with the suffix before) from the largest suffix down, as they are induced."""
        prefix = symbol_prefix(self.text, self.arena, self.chunk)
        lms = self.sort_lms(prefix)
        lcp = self.arena.empty(len(lms), np.int16)
        for a, b in chunks(len(lms), self.chunk):
            lcp[a] = self.common_prefix(prefix, lms[a - 1 : a], lms[a : a + 1])[0] if a else 0
            lcp[a + 1 : b] = self.common_prefix(prefix, lms[a : b - 1], lms[a + 1 : b])
        del prefix
        yield from self.induce({c: (lms[a:b], lcp[a:b]) for c, (a, b) in self._starts(lms).items()}, True)


class Powers:
    """Powers of the rolling-hash base and of its inverse, from tables of low and high digits that are small for any place."""

    def __init__(self, base: int = 0xD6E8FEB86659FD93):
        self.base, self.low, self.high = base, {}, {}
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            self.low[name] = self._steps(x, 1 << 16)
            self.high[name] = self._steps(pow(x, 1 << 16, 1 << 64), 1 << 16)

    @staticmethod
    def _steps(x: int, n: int) -> np.ndarray:
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def _at(self, name: str, i: np.ndarray) -> np.ndarray:
        return self.low[name][i & 0xFFFF] * self.high[name][i >> 16]

    def up(self, i: np.ndarray) -> np.ndarray:
        return self._at("up", i)

    def down(self, i: np.ndarray) -> np.ndarray:
        return self._at("down", i)


POWERS = Powers()
_SYMBOLS = common.mix64(np.arange(1, 259, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def symbol_prefix(text: np.ndarray, arena: Arena, chunk: int) -> np.ndarray:
    """S[i]: sum over j < i of the symbol of text[j] times base to the j, modulo 2**64."""
    out = arena.empty(len(text) + 1, np.uint64)
    out[0] = 0
    for a, b in chunks(len(text), chunk):
        out[a + 1 : b + 1] = out[a] + np.cumsum(_SYMBOLS[text[a:b]] * POWERS.up(np.arange(a, b)), dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return common.mix64((prefix[end] - prefix[start]) * POWERS.down(start) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Gathered:
    """The strings of one shard, one behind the other, in memory or in a scratch file beyond ``memory`` bytes."""

    def __init__(self, memory: int):
        self.file, self.sizes, self.size = tempfile.SpooledTemporaryFile(max_size=max(1, memory)), [], 0

    def add(self, text: bytes) -> None:
        self.file.write(text)
        self.sizes.append(len(text))
        self.size += len(text)

    def symbols(self, arena: Arena, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """The text that ``Shard`` takes, and where each string begins in it."""
        sizes = np.array(self.sizes, np.int64)
        at = np.append(0, np.cumsum(sizes + 1))
        text = arena.empty(int(at[-1]) + 1, np.uint16)
        self.file.seek(0)
        row = 0
        while row < len(sizes):
            end = max(row + 1, int(np.searchsorted(at, at[row] + chunk, side="right")) - 1)
            raw = np.frombuffer(self.file.read(int(sizes[row:end].sum())), np.uint8).astype(np.uint16) + 2
            text[at[row] : at[end]] = np.insert(raw, np.cumsum(sizes[row:end]), 1)
            row = end
        text[-1] = 0
        return text, at

    def close(self) -> None:
        self.file.close()


def repeated(texts: Gathered | list[bytes], depth: int, memory: int = 256 << 20, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """For each text in turn, whether the ``depth`` bytes from each position also start anywhere else in the texts."""
    if isinstance(texts, list):
        held = Gathered(memory)
        for x in texts:
            held.add(x)
        texts = held
    arena = Arena(memory)
    text, at = texts.symbols(arena, chunk)
    hit = arena.empty(len(text), bool)
    for a, b in chunks(len(text), chunk):
        hit[a:b] = False
    before = None
    for pos, lcp in Shard(text, depth, memory, chunk, arena).blocks():
        high = lcp >= depth
        hit[pos[high]] = True
        hit[pos[:-1][high[1:]]] = True
        if high[0] and before is not None:
            hit[before] = True
        before = pos[-1]
    for a, n in zip(at[:-1], texts.sizes, strict=True):
        out = np.array(hit[a : a + n])
        out[max(0, n - depth + 1) :] = False  # fewer than depth bytes are left
        yield out
    texts.close()
