"""Best-fit packing of token pieces into sequences by bin completion.

Only the counts of pieces by length matter for the packing, and there are at most
``capacity`` lengths, so the search runs on a histogram whose size does not grow with the
corpus.  Its result is a list of fillings with multiplicities; the pieces of a length are
numbered by a distributed ranking and find their sequence by their number.

Null and empty texts are one piece of the end id.  Very long texts are cut into pieces, and
very long words are encoded in stretches.  Repeated rows are packed each; ties among pieces of
one length are settled by a hash.  An empty table gives no rows; only the id and the text are
read, so other columns may have any names.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, save, slices, worker_cache

CAPACITY = 2048
#: Entries of a worker's new and of its old cache, and the longest word they keep in bytes: about 30 MB each with words of usual length.
CACHED_WORDS, CACHED_BYTES = 150_000, 48
#: Words beyond this many bytes are normalised, cut and merged stretch by stretch.
LONG_WORD, STRETCH = 1 << 16, 1 << 13
#: Kinds of bins closed by the whole search, and without a better packing; candidates tried for one bin, and steps to enumerate them;
#: bins closed between best-fit solutions of what is left.
NODES, PATIENCE, BRANCH, STEPS, REFIT = 40_000, 10_000, 6, 3_000, 256
#: Latin letters without a decomposition to come, then ASCII punctuation other than the apostrophe: always two pre-tokens.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of white-space separated words as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never merges across it, so a text's ids are those
    of its words in turn.  A word of plain letters and closing punctuation goes to the
    vocabulary's merges in these two parts, past the normaliser and the pattern, which would
    only lower its case and part it there; any other word is encoded in full, and one of
    more than ``LONG_WORD`` bytes stretch by stretch (``_long``).  When the cache is full it
    becomes the old one, from which words still in use move to the new one; words beyond
    ``CACHED_BYTES`` are never kept.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.normalise, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.old: dict[bytes, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def part(self, part: str) -> bytes:
        """Ids of a pre-token."""
        raw = self.raw
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(LETTERS)
        return b"".join([raw[t.id] for t in self.merge(letters)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha() and word.islower() and len(word) <= CACHED_BYTES:  # of bytes: ASCII letters only
                raw = self.raw
                ids = b"".join([raw[t.id] for t in self.merge(word.decode())])
            else:
                ids = self._parted(word)
            if len(word) > CACHED_BYTES:
                return ids
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _parted(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if len(word) <= CACHED_BYTES and (m := SIMPLE.fullmatch(text)):
            letters, closing = m.groups()
            low = letters.lower()
            first = low.encode()
            return (self.part(low) if first == word else self[first]) + (self.part(closing) if closing else b"")
        if len(word) <= LONG_WORD:
            return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = bytearray()
        for ids in self._long(text):
            out += ids
        return bytes(out)

    def text(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))

    # ---- long words

    def _long(self, text: str) -> Iterator[bytes]:
        """Ids of a long word, in memory of a few bytes a character.

        Special strings stand apart; the rest is normalised in stretches that begin with a
        letter or an ASCII character, which never combine with what is before them; the
        pattern's pre-tokens are told by the class that it gives each character.
        """
        for i, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                yield self.raw[self.special[part]]
                continue
            stretches, at = [], 0
            while at < len(part):
                end = min(at + STRETCH, len(part))
                while end < len(part) and not (part[end].isascii() or (part[end].isalpha() and not "\u1100" <= part[end] <= "\u11ff")):
                    end += 1
                stretches.append(self.normalise(part[at:end]))
                at = end
            yield from self._pretokens("".join(stretches))

    def _pretokens(self, text: str) -> Iterator[bytes]:
        if not text:
            return
        kind = np.empty(len(text), np.uint8)
        for o in range(0, len(text), 1 << 18):
            known, which = np.unique(np.frombuffer(text[o : o + (1 << 18)].encode("utf-32-le", "replace"), "<u4"), return_inverse=True)
            kind[o : o + (1 << 18)] = np.array([self._kind(chr(c)) for c in known], np.uint8)[which]
        new = np.empty(len(kind), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == 2  # each numeral is a pre-token of its own
        starts = np.append(np.flatnonzero(new).astype(np.uint32), np.uint32(len(text)))
        done = 0
        for n in range(len(starts) - 1):
            at, end = max(done, int(starts[n])), int(starts[n + 1])
            if at >= end or kind[at] == 3:
                continue
            if end == at + 1 and text[at] == "'" and (m := CONTRACTION.match(text, at)):
                end = m.end()
            done = end
            yield self.part(text[at:end]) if end - at <= CACHED_BYTES else b"".join(self._run(text[at:end]))

    def _kind(self, c: str) -> int:
        """How the pattern takes a character: 0 with letters, 1 with signs, 2 alone, 3 not at all."""
        if len(self.cut("a" + c)) == 1 and len(self.cut(c)):
            return 0
        return 3 if not self.cut(c) else 1 if len(self.cut("!" + c)) == 1 else 2

    def _run(self, run: str) -> Iterator[bytes]:
        """Ids of one long pre-token, merged stretch by stretch.

        A sequence of tokens is what the merges make of their text if that holds for each two
        that meet; so a stretch may follow another wherever the last token of the one and the
        first of the other stay apart when merged with what comes after.
        """
        s = run.encode().decode("latin-1").translate(LETTERS)
        at, width = 0, STRETCH
        while at + width < len(s):
            tokens = self.merge(s[at : at + width])
            ends = np.cumsum([len(t.value) for t in tokens])
            for k in range(len(tokens) * 3 // 4, 1, -1):
                q = at + int(ends[k - 1])
                there = self.merge(s[at + int(ends[k - 2]) : q + 256])
                if there[0].id == tokens[k - 1].id and len(there) > 2 and there[1].id == self.merge(s[q : q + width])[0].id:
                    yield b"".join([self.raw[t.id] for t in tokens[:k]])
                    at, width = q, STRETCH
                    break
            else:
                width *= 2
        yield b"".join([self.raw[t.id] for t in self.merge(s[at:])])


def word_ids(tokenizer_path: str) -> WordIds:
    """The worker's cache for a vocabulary file."""
    kept = worker_cache("packing")
    if tokenizer_path not in kept:
        kept[tokenizer_path] = WordIds(tokenizer_path)
    return kept[tokenizer_path]


def pieces(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Rows (id, piece, start, length, crc[, ids]): each document's ids and an end id, cut only beyond ``capacity``.

    Null and empty texts are one piece that holds the end id.  ``crc`` is the unsigned CRC-32
    of the ids as little-endian unsigned 32-bit numbers.
    """
    end = np.array([end_id], "<u4").tobytes()
    at_once = 4096

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        names = ["id", "piece", "start", "length", "crc"] + ["ids"] * with_ids

        def out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            at, piece, start, length, crc, data = zip(*rows)
            cols = [ids.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in data], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names)

        for b in slices(batches, "packing"):
            rows: list[tuple] = []
            for at, text in enumerate(b.column(1).cast(pa.large_binary())):
                raw = words.text(text.as_py()) + end
                for piece, o in enumerate(range(0, len(raw), 4 * capacity)):
                    x = raw[o : o + 4 * capacity]
                    rows.append((at, piece, o // 4, len(x) // 4, zlib.crc32(x), x if with_ids else None))
                    if len(rows) == at_once:
                        yield out(b.column(0), rows)
                        rows = []
            if rows:
                yield out(b.column(0), rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, crc long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the search

Filling = tuple[int, ...]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: fillings with their numbers of bins."""
    open_bins: dict[int, list[list]] = {}  # room -> [[filling, number], ...]
    rooms: list[int] = []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                full, rest = divmod(left, per)
                new = [[(size,) * per, full]] * bool(full) + [[(size,) * rest, 1]] * bool(rest)
                left = 0
            else:
                room = rooms[i]
                filling, number = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
                per = room // size
                full = min(number, left // per)
                new = [[filling + (size,) * per, full]] if full else [[filling + (size,) * left, 1]]
                rest = number - (full or 1)
                left -= full * per if full else left
                new += [[filling, rest]] * bool(rest)
            for filling, number in new:
                room = capacity - sum(filling)
                if room not in open_bins:
                    open_bins[room] = []
                    bisect.insort(rooms, room)
                open_bins[room].append([filling, number])
    return [(f, n) for x in open_bins.values() for f, n in x]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes], np.int64)
    best = -(-int((sizes * n).sum()) // capacity) if len(sizes) else 0
    for k in [0, *sizes[sizes <= capacity // 2]]:
        alone = int(n[sizes > capacity - k].sum())
        half = (sizes <= capacity - k) & (2 * sizes > capacity)
        small = (sizes >= max(k, 1)) & (2 * sizes <= capacity)
        room = int((n[half] * (capacity - sizes[half])).sum())
        over = int((sizes[small] * n[small]).sum()) - room
        best = max(best, alone + int(n[half].sum()) + max(0, -(-over // capacity)))
    return best


def fillings(have: list[int], counts: dict[int, int], room: int) -> list[Filling]:
    """Undominated ways to fill ``room``, least waste first, at most ``BRANCH`` of them.

    ``have`` lists the lengths in stock, ascending.  A filling is dominated if a length in
    stock could replace one of its pieces, or two of them together, and still fit: then some
    best packing does without it.  A single exact piece dominates all others.  One step adds
    all pieces of one length, from as many as fit down to one, so the depth is the number of
    different lengths in a filling; the list ends at the first filling without waste or after
    ``STEPS`` steps.
    """
    if not have or have[0] > room:
        return [()]
    if counts.get(room):
        return [(room,)]
    found: dict[Filling, int] = {}
    worst = -1

    def dominated(f: Filling, waste: int) -> bool:
        if not waste:
            return False
        used = {x: f.count(x) for x in set(f)}
        parts = {*used, *(a + b for a in used for b in used if a < b), *(2 * a for a, n in used.items() if n > 1)}
        for x in parts:
            i = bisect.bisect_right(have, x)
            while i < len(have) and have[i] <= x + waste:
                if counts[have[i]] > used.get(have[i], 0):
                    return True
                i += 1
        return False

    # each level: the length to try, the number of its pieces taken (0: none yet), the room and the filling before it
    steps, left = STEPS, room
    levels: list[list] = [[bisect.bisect_right(have, left) - 1, 0, left, ()]]
    while levels and steps > 0:
        level = levels[-1]
        i, taken, before, held = level
        if i < 0:
            levels.pop()
            continue
        size = have[i]
        taken = level[1] = taken - 1 if taken else min(counts[size], before // size)
        if not taken:  # fewer than one: on to the next length
            level[0] -= 1
            continue
        steps -= 1
        left = before - taken * size
        f = held + (size,) * taken
        if left and left < size and counts.get(left):
            found[(*f, left)] = 0
            break
        at = bisect.bisect_right(have, left if left < size else size - 1) - 1
        if at >= 0:
            levels.append([at, 0, left, f])
        elif (left < size or taken == counts[size]) and (len(found) < 4 * BRANCH or left < worst):
            if not any(counts[h] > f.count(h) for h in have[: bisect.bisect_right(have, left)]):
                found[f] = left
                worst = max(worst, left)
                if not left:
                    break
    ranked = sorted(found.items(), key=lambda x: (x[1], len(x[0])))
    good = [f for f, waste in ranked if not dominated(f, waste)][:BRANCH]
    return good or [f for f, _ in ranked[:1]] or [_greedy(have, counts, room)]


def _greedy(have: list[int], counts: dict[int, int], room: int) -> Filling:
    """The filling that takes the longest pieces that fit."""
    f: Filling = ()
    for size in reversed(have):
        n = min(counts[size], room // size)
        f += (size,) * n
        room -= n * size
    return f


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, patience: int = PATIENCE) -> list[tuple[Filling, int]]:
    """Pack a histogram of lengths into few bins: (filling, number of bins) pairs.

    Branch and bound: around the largest piece left, each undominated filling is tried, least
    waste first, for as many bins at once as the stock allows.  A branch is cut when its waste
    so far already needs as many bins as the incumbent.  Incumbents are best-fit decreasing
    packings: of everything at first, later of what the bins closed so far leave, every
    ``REFIT`` bins.  The search ends at the lower bound, or with the best packing so far
    after closing ``nodes`` kinds of bins, or ``patience`` of them (beside one for
    each length) without a better packing; the packing is always whole.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    best = best_fit_decreasing(counts, capacity)
    best_bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    stock, have = dict(counts), sorted(counts)

    def take(filling: Filling, times: int) -> None:
        for s in filling:
            stock[s] -= times
            if not stock[s]:
                have.pop(bisect.bisect_left(have, s))

    def give(filling: Filling, times: int) -> None:
        for s in filling:
            if not stock[s]:
                bisect.insort(have, s)
            stock[s] += times

    def options() -> list[Filling]:
        top = have[-1]
        take((top,), 1)
        out = [(top, *f) for f in fillings(have, stock, capacity - top)]
        give((top,), 1)
        return out[::-1]

    path: list[tuple[Filling, int]] = []
    bins = waste = 0
    last = nodes
    stack = [options()] if best_bins > bound else []
    while stack and best_bins > bound and nodes > 0 and last - nodes < patience + len(counts):
        if not stack[-1]:
            stack.pop()
            if path:
                filling, times = path.pop()
                give(filling, times)
                bins -= times
                waste -= times * (capacity - sum(filling))
            continue
        filling = stack[-1].pop()
        need = {s: filling.count(s) for s in set(filling)}
        times = min(stock[s] // n for s, n in need.items())
        lost = times * (capacity - sum(filling))
        if -(-(total + waste + lost) // capacity) >= best_bins:
            continue
        nodes -= 1
        take(filling, times)
        path.append((filling, times))
        bins += times
        waste += lost
        if not have:
            if bins < best_bins:
                best, best_bins, last = list(path), bins, nodes
            stack.append([])
            continue
        if nodes % REFIT == 0:
            rest = best_fit_decreasing({s: stock[s] for s in have}, capacity)
            if bins + sum(n for _, n in rest) < best_bins:
                best, best_bins, last = path + rest, bins + sum(n for _, n in rest), nodes
        stack.append(options())
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds (sequence_id, offset) to rows (id, piece, start, length, crc, ...).

    The columns named here decide only which of the pieces of equal length goes where; every
    row gets a place, repeated rows one each.  An empty table stays empty.
    """
    cut = save(cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    base, used = 0, dict.fromkeys(counts, 0)
    for filling, times in bin_completion(counts, capacity):
        offset = 0
        for size in sorted(set(filling), reverse=True):
            k = filling.count(size)
            runs.setdefault(size, []).append((used[size], base, k, offset))
            used[size] += k * times
            offset += k * size
        base += times
    tables = {size: np.array(x, np.int64).T for size, x in runs.items()}

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, start, k, offset = tables[int(s)]
                i = np.searchsorted(first, rank[at], "right") - 1
                q = rank[at] - first[i]
                seq[at] = start[i] + q // k[i]
                off[at] = offset[i] + q % k[i] * s
            keep = [i for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(seq), pa.array(off)], [*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    ranked = positions(cut, "length", ["id", "piece", "crc", "start"], "_rank", sum(counts.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, doc_ids) from pieces packed with their ids; a row has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.id").alias("doc_ids"))
