"""Token counts of sections by offset-mapped attribution.

Each whole document is encoded once; the spans of its tokens are then joined with the spans
of its sections, so a token that crosses a boundary is neither lost nor counted twice.

Null and empty texts are one section without tokens.  Very long texts are encoded piece by
piece, cut at spaces between letters, where the vocabulary always cuts; a text of megabytes
without one is encoded in one go.  Repeated rows have a row per section each; an empty table
gives no rows; only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, worker_cache

Sections = Callable[[str], list[tuple[str, int, int]]]
RULES = ("first", "last", "largest")
#: Texts longer than this many characters are encoded piece by piece, cut where the vocabulary's pattern always cuts.
PIECE = 1 << 20
CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def lines(text: str) -> list[tuple[str, int, int]]:
    """One section per line, its line feed included."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append(("line", at, end))
        at = end
    return out


class _Encoder:
    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("cairnql", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        at, out = 0, []
        while len(text) - at > PIECE and (m := CUT.search(text, at + PIECE)):
            out.append(self.encoding.encode_to_numpy(text[at : m.start()], disallowed_special=()))
            at = m.start()
        out.append(self.encoding.encode_to_numpy(text[at:] if at else text, disallowed_special=()))
        return np.concatenate(out).astype(np.int64)


def encoder(path: str) -> _Encoder:
    """The worker's encoder for a vocabulary file."""
    kept = worker_cache("token counts")
    if path not in kept:
        kept[path] = _Encoder(path)
    return kept[path]


def byte_starts(text: str, raw: bytes) -> np.ndarray | None:
    """Byte offset of each character and of the end; None if they are the characters' own."""
    if len(raw) == len(text):
        return None
    b = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``ends`` are the tokens' ends, ``sections`` rows (start, end), all in bytes.

    Sections ascend and do not overlap; gaps are allowed and their tokens are nobody's.  A
    token that touches several sections goes to the one that holds its first byte in any
    section ("first"), its last ("last"), or most of its bytes ("largest", the earlier if
    equal).
    """
    out = np.zeros(len(sections), np.int64)
    if not len(sections) or not len(ends):
        return out
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(sections[:, 1], starts, "right")  # first section that ends beyond the token's start
    last = np.searchsorted(sections[:, 0], ends, "left") - 1  # last section that begins before the token's end
    held = first <= last
    owner = first if rule != "last" else last
    if rule == "largest":
        owner = first.copy()
        for t in np.flatnonzero(held & (first < last)):
            part = sections[first[t] : last[t] + 1]
            owner[t] += int(np.argmax(np.minimum(part[:, 1], ends[t]) - np.maximum(part[:, 0], starts[t])))
    return np.bincount(owner[held], minlength=len(sections)).astype(np.int64)


def token_counts(
    docs: DataFrame, vocabulary_path: str, *, sections: Sections = lines, rule: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, section, name, start, end, tokens, total): one per section of each document.

    ``start`` and ``end`` are in characters, ``total`` is the document's number of tokens.
    A null or empty text is one section (name "empty", no tokens) so that every row of the
    input shows.  Special strings in a text are ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for b in slices(batches, "token counts", 256):
            at, number, name, start, end, tokens, total = ([] for _ in range(7))
            for i, text in enumerate(b.column(1).to_pylist()):
                found = sections(text) if text else []
                spans = np.array([(s, e) for _, s, e in found] or [(0, 0)], np.int64).reshape(-1, 2)
                counts, n = np.zeros(len(spans), np.int64), 0
                if text:
                    ids = enc.ids(text)
                    n = len(ids)
                    where = byte_starts(text, text.encode("utf-8", "replace"))
                    if found:
                        counts = attribute(enc.sizes[ids].cumsum(), spans if where is None else where[spans], rule)
                at.append(np.full(len(spans), i))
                number.append(np.arange(len(spans), dtype=np.int32))
                name += [x for x, _, _ in found] or ["empty"]
                start.append(spans[:, 0])
                end.append(spans[:, 1])
                tokens.append(counts)
                total.append(np.full(len(spans), n))
            if at:
                cat = lambda x: pa.array(np.concatenate(x))
                yield pa.RecordBatch.from_arrays([b.column(0).take(cat(at)), cat(number), pa.array(name), cat(start), cat(end), cat(tokens), cat(total)], ["id", "section", "name", "start", "end", "tokens", "total"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, section int, name string, start long, end long, tokens long, total long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
