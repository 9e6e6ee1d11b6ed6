"""Suffix order and common prefixes of a shard by external induced sorting.

A shard is a string of byte segments, each closed by a separator of its own. Suffixes whose character grows to the
right of a fall (S*) are sorted by recursion: their substrings are sorted by induction, named, and the string of
names is sorted the same way until all names differ. From the sorted S* suffixes two inductions sort all others:
a suffix taken from the queue in order puts the suffix one to its left into the bucket of its first character.
The bucket queues carry suffix positions and, at the level of bytes, the common prefix with the suffix before;
that of two suffixes put side by side into a bucket is one more than the least value between the two they came
from. Queues and strings beyond ``MEMORY_BYTES`` lie in files that the operating system pages in.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Arrays larger than this are kept in files of the task's temporary folder, gone when the task drops them.
MEMORY_BYTES = 64 << 20
#: Suffixes taken from the queue at once while no bucket among theirs still waits for suffixes.
BLOCK = 4096


def stored_array(size: int, dtype) -> np.ndarray:
    if size * np.dtype(dtype).itemsize <= MEMORY_BYTES:
        return np.zeros(size, dtype=dtype)
    with tempfile.TemporaryFile() as file:  # without a name; the mapping keeps it until the array goes
        file.truncate(size * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype=dtype, mode="r+", shape=(size,))


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable sorting order of small non-negative keys: key and place in one number sort faster than an argsort."""
    if keys.dtype.itemsize <= 2:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.int64) << 32) | np.arange(len(keys), dtype=np.int64)
    packed.sort()
    return packed & 0xFFFFFFFF


class BucketQueue:
    """A priority queue of suffixes: first by bucket, then by arrival. Sizes of all buckets are known before."""

    def __init__(self, sizes: np.ndarray, with_prefixes: bool):
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.head = self.start[:-1].copy()
        total = int(self.start[-1])
        self.suffix = stored_array(total, np.int64)
        self.prefix = stored_array(total, np.int32) if with_prefixes else None

    def push(self, bucket: np.ndarray, suffix: np.ndarray, prefix: np.ndarray | None = None) -> None:
        """Appends suffixes, given in bucket order and within a bucket in arrival order."""
        if not len(bucket):
            return
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        count = np.diff(np.concatenate([first, [len(bucket)]]))
        at = self.head[bucket] + np.arange(len(bucket)) - np.repeat(first, count)
        self.suffix[at] = suffix
        if prefix is not None:
            self.prefix[at] = prefix
        self.head[bucket[first]] += count

    def full(self, low: int, high: int) -> int:
        """End of the full buckets from ``low`` on, at most ``high``."""
        waiting = np.flatnonzero(self.head[low:high] != self.start[low + 1 : high + 1])
        return low + int(waiting[0]) if len(waiting) else high


def induce(chars: np.ndarray, target: np.ndarray, seeds: np.ndarray, alphabet: int) -> BucketQueue:
    """Sorts the ``target`` suffixes from sorted ``seeds``, lowest bucket first, targets before seeds in a bucket."""
    queue = BucketQueue(np.bincount(chars[target], minlength=alphabet), False)
    seed_start = np.concatenate([[0], np.cumsum(np.bincount(chars[seeds], minlength=alphabet))])
    entries = queue.start + seed_start

    turns = np.concatenate([[True], chars[1:] != chars[:-1]])
    run_start = np.maximum.accumulate(np.where(turns, np.arange(len(chars)), 0))

    def put(sources: np.ndarray, fed: int = -1) -> None:
        left = sources - 1
        left = left[left >= 0]
        left = left[target[left]]
        bucket = chars[left]
        if fed >= 0:  # done along the runs
            left, bucket = left[bucket != fed], bucket[bucket != fed]
        if len(left):
            order = stable_order(bucket)
            queue.push(bucket[order], left[order])

    low = 0
    while low < alphabet:
        high = max(low + 1, int(np.searchsorted(entries, entries[low] + BLOCK, "right")) - 1)
        high = queue.full(low, min(high, alphabet))
        if high > low:  # no bucket of the block waits for another of it
            mine = np.asarray(queue.suffix[queue.start[low] : queue.start[high]])
            given = seeds[seed_start[low] : seed_start[high]]
            both = np.concatenate([mine, given])
            key = chars[both].astype(np.int64) * 2
            key[len(mine) :] += 1
            put(both[stable_order(key)])
            low = high
            continue
        # the bucket feeds itself along runs of its character: from each suffix that came from elsewhere to the left,
        # first all one step away, then all two steps away, and so on
        came = np.array(queue.suffix[queue.start[low] : queue.head[low]])
        steps = came - run_start[came]
        suffix = np.repeat(came, steps)
        away = np.arange(1, len(suffix) + 1) - np.repeat(np.cumsum(steps) - steps, steps)
        order = stable_order(away)
        fed = (suffix - away)[order]
        queue.push(np.full(len(fed), low), fed)
        put(np.concatenate([came, fed]), low)
        put(seeds[seed_start[low] : seed_start[low + 1]], low)
        low += 1
    return queue


def induce_with_prefixes(
    chars: np.ndarray, target: np.ndarray, seeds: np.ndarray, seed_prefix: np.ndarray, alphabet: int, compare
) -> BucketQueue:
    """As ``induce``, bucket by bucket, with common prefixes; ``compare`` gives those of single pairs."""
    queue = BucketQueue(np.bincount(chars[target], minlength=alphabet), True)
    seed_start = np.concatenate([[0], np.cumsum(np.bincount(chars[seeds], minlength=alphabet))])
    # least common prefix among the sources since the last one that fed a bucket; -1: nothing fed it yet
    since = np.full(alphabet, -1, dtype=np.int64)

    def put(sources: np.ndarray, prefix: np.ndarray) -> None:
        left = sources - 1
        feeds = np.flatnonzero(left >= 0)
        feeds = feeds[target[left[feeds]]]
        fed = chars[left[feeds]]
        order = stable_order(fed)
        feeds, fed = feeds[order], fed[order]
        first = np.flatnonzero(np.concatenate([[True], fed[1:] != fed[:-1]])) if len(fed) else np.zeros(0, np.int64)
        bounds, made = np.append(first, len(fed)), np.zeros(len(fed), dtype=np.int64)
        whole, before = int(prefix.min()), since.copy()
        np.minimum(since, whole, out=since)
        for k, bucket in enumerate(fed[first].tolist()):
            at = feeds[bounds[k] : bounds[k + 1]]
            # minima over (previous feeder, feeder]; the stretch before the first feeder adds to what was open
            cuts = np.concatenate([[0], at[:-1] + 1])
            least = np.minimum.reduceat(prefix[: at[-1] + 1], cuts)
            if before[bucket] < 0:
                least[0] = -1  # the first of its bucket shares nothing with the suffix before it
            else:
                least[0] = min(least[0], before[bucket])
            made[bounds[k] : bounds[k + 1]] = least + 1
            rest = prefix[at[-1] + 1 :]
            since[bucket] = rest.min() if len(rest) else np.iinfo(np.int32).max
        if len(fed):
            queue.push(fed, left[feeds], made)

    for bucket in range(alphabet):
        taken, end = int(queue.start[bucket]), int(queue.start[bucket + 1])
        last = -1
        while taken < end:
            ready = int(queue.head[bucket])
            suffixes = np.array(queue.suffix[taken:ready])
            put(suffixes, np.array(queue.prefix[taken:ready]).astype(np.int64))
            taken, last = ready, int(suffixes[-1])
        given = seeds[seed_start[bucket] : seed_start[bucket + 1]]
        if len(given):
            prefix = seed_prefix[seed_start[bucket] : seed_start[bucket + 1]].astype(np.int64)
            prefix[0] = compare(np.array([last]), given[:1])[0] if last >= 0 else 0
            put(given, prefix)
    return queue


def falling(chars: np.ndarray) -> np.ndarray:
    """L suffixes: larger than the one to their right. The last suffix, with nothing to its right, is S."""
    size = len(chars)
    step = np.zeros(size, dtype=np.int8)
    step[:-1] = np.sign(chars[:-1].astype(np.int64) - chars[1:])
    step[-1] = -1
    place = np.where(step != 0, np.arange(size), size)
    # equal neighbours follow the next step to the right
    place = np.minimum.accumulate(place[::-1])[::-1]
    return step[place] > 0


def starred(fall: np.ndarray) -> np.ndarray:
    """Positions of S suffixes to the right of an L suffix."""
    return np.flatnonzero(~fall[1:] & fall[:-1]) + 1


def sort_starred(chars: np.ndarray, fall: np.ndarray, stars: np.ndarray, alphabet: int, apart: np.ndarray) -> np.ndarray:
    """The S* suffixes in order. ``apart`` marks separators: each differs from every other, ordered by place."""
    rough = stars[stable_order(chars[stars])]
    large = induce(chars, fall, rough, alphabet)
    descending = induce(alphabet - 1 - chars, ~fall & ~apart, np.asarray(large.suffix)[::-1], alphabet)
    order = np.asarray(descending.suffix)[::-1]
    is_star = np.zeros(len(chars), dtype=bool)
    is_star[stars] = True
    # separators sort first, by place
    order = np.concatenate([stars[apart[stars]], order[is_star[order]]])
    # names of the S* substrings, each from one S* to the next, both included
    index = np.zeros(len(chars), dtype=np.int64)
    index[stars] = np.arange(len(stars))
    length = np.diff(np.append(stars, len(chars) - 1)) + 1
    mine = length[index[order]]
    same = np.zeros(len(order), dtype=bool)
    open_ = np.flatnonzero(mine[1:] == mine[:-1]) + 1
    closed = apart[order + mine - 1] | apart[order]
    open_ = open_[~closed[open_] & ~closed[open_ - 1]]
    depth = 0
    while len(open_):
        a, b = order[open_ - 1] + depth, order[open_] + depth
        equal = chars[a] == chars[b]
        open_ = open_[equal]
        depth += 1
        done = mine[open_] == depth
        same[open_[done]] = True
        open_ = open_[~done]
    names = np.cumsum(~same) - 1
    reduced = np.zeros(len(stars), dtype=np.int64)
    reduced[index[order]] = names
    if names[-1] + 1 == len(stars):
        return order
    return stars[suffix_order(reduced, int(names[-1]) + 1)]


def suffix_order(names: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffixes of a string of names in order: the recursion."""
    chars = np.append(names + 1, 0)  # an end smaller than all names
    fall, apart, alphabet = falling(chars), chars == 0, alphabet + 1
    seeds = sort_starred(chars, fall, starred(fall), alphabet, apart)
    large = np.asarray(induce(chars, fall, seeds, alphabet).suffix)
    small = np.asarray(induce(alphabet - 1 - chars, ~fall & ~apart, large[::-1], alphabet).suffix)[::-1]
    every = np.concatenate([large, small])
    kind = np.repeat([0, 1], [len(large), len(small)])
    return every[stable_order(chars[every] * 2 + kind)]


def comparer(chars: np.ndarray, apart: np.ndarray, length: int):
    """Common prefixes of pairs of suffixes, followed up to ``length``, four characters at a time."""
    size = len(chars)
    words, clean = np.zeros(size, dtype=np.uint64), np.ones(size, dtype=bool)
    for lane in range(4):
        words[: size - lane] |= chars[lane:].astype(np.uint64) << np.uint64(16 * lane)
        clean[: size - lane] &= ~apart[lane:]
    clean[size - 3 :] = False

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, open_, rest = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), []
        for depth in range(0, length, 4):
            x, y = a[open_] + depth, b[open_] + depth
            equal = (words[x] == words[y]) & clean[x]
            rest.append(open_[~equal])
            open_ = open_[equal]
            if not len(open_):
                break
            found[open_] = depth + 4
        open_ = np.concatenate(rest) if rest else open_
        for _ in range(3):
            x, y = a[open_] + found[open_], b[open_] + found[open_]
            open_ = open_[(chars[x] == chars[y]) & ~apart[x]]
            found[open_] += 1
        return np.minimum(found, length)

    return compare


def long_repeats(segments: list[bytes], length: int) -> np.ndarray:
    """Flags over the joined segments (a separator after each): where a string of ``length`` bytes starts that
    also starts elsewhere. Common prefixes are followed up to ``length``."""
    size = sum(map(len, segments)) + len(segments)
    chars = stored_array(size, np.int16)
    at = 0
    for segment in segments:
        chars[at : at + len(segment)] = np.frombuffer(segment, dtype=np.uint8)
        chars[at : at + len(segment)] += 1
        at += len(segment) + 1
    apart = chars == 0
    fall, alphabet = falling(chars), 257
    stars = starred(fall)

    compare = comparer(chars, apart, length)
    seeds = sort_starred(chars, fall, stars, alphabet, apart)
    seed_prefix = np.concatenate([[0], compare(seeds[:-1], seeds[1:])])
    large = induce_with_prefixes(chars, fall, seeds, seed_prefix, alphabet, compare)
    # downwards, the value of a suffix is that with the suffix after it
    falls, prefix = np.asarray(large.suffix)[::-1], np.roll(np.asarray(large.prefix), -1)[::-1]
    flipped = alphabet - 1 - chars
    small = induce_with_prefixes(flipped, ~fall & ~apart, falls, prefix, alphabet, compare)
    flags = np.zeros(size, dtype=bool)
    for queue in (large, small):
        suffix, shared = np.asarray(queue.suffix), np.asarray(queue.prefix)
        hit = np.flatnonzero(shared >= length)
        flags[suffix[hit]] = flags[suffix[hit - 1]] = True
    # where the two kinds meet within a bucket
    last = np.flatnonzero(np.diff(large.start))
    first = np.flatnonzero(np.diff(small.start))
    ends = {int(c): int(large.suffix[large.start[c + 1] - 1]) for c in last}
    starts = {alphabet - 1 - int(c): int(small.suffix[small.start[c + 1] - 1]) for c in first}
    meet = sorted(ends.keys() & starts.keys())
    a, b = np.array([ends[c] for c in meet], dtype=np.int64), np.array([starts[c] for c in meet], dtype=np.int64)
    hit = compare(a, b) >= length
    flags[a[hit]] = flags[b[hit]] = True
    return flags
