"""Token ids of whole texts with a public byte-level BPE tokenizer, with a bounded cache of frequent chunks.

The tokenizer cuts a text into chunks before it merges bytes. Between two characters that aren't white space, a
single space starts a new chunk and a single line feed is a token of its own, whatever stands around it. So a text
in which white space comes singly is encoded part by part; parts that a task has met are taken from a cache. Texts
with any other white space are encoded whole. Both give the ids of `Tokenizer.encode(text)`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

VOCABULARY = "byte_bpe_50k.json"
#: Parts that a worker process knows at a time, about 60 bytes each; beyond it only those of the last texts stay.
CACHE_WORDS = 1_200_000
#: Parts that are encoded at a time.
LEARN_WORDS = 30_000
#: Characters that are split at a time.
BATCH_CHARS = 5_000_000


@cache
def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes. A part is a line feed and the first word of a line, or another word of a line."""

    def __init__(self, name: str = VOCABULARY):
        import numpy as np
        import pyarrow as pa

        self.np, self.tok = np, tokenizer(name)
        self.feed = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.specials = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        # start and length say where the ids of known parts are in pool; a part that can't be encoded apart has none
        self.known = pa.array([], pa.string())
        self.pool = self.np.zeros(0, "<u4")
        self.start = self.length = self.np.zeros(0, self.np.int64)

    def _keep(self, rows) -> None:
        """Forgets all other parts."""
        at = rows.to_numpy()
        self.known, length = self.known.take(rows), self.length[at]
        ends = self.np.cumsum(length)
        self.pool = self._gather(self.start[at], length, ends)
        self.start, self.length = ends - length, length

    def _gather(self, start, length, ends):
        """The ids of rows, one after another."""
        np = self.np
        return self.pool[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def whole(self, text: str) -> bytes:
        return self.np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _apart(self, part: str) -> bool:
        word = part.removeprefix("\n")
        return bool(word) and not word[0].isspace() and not word[-1].isspace() and not any(s in word for s in self.specials)

    def _learn(self, new) -> None:
        """Takes an array of parts in."""
        import pyarrow as pa

        np, parts = self.np, new.to_pylist()
        apart = np.fromiter(map(self._apart, parts), bool, len(parts))
        usable = [p for p, a in zip(parts, apart) if a]
        start, length = np.zeros((2, len(parts)), np.int64)
        if usable:
            ids, start[apart], length[apart] = self._ids(usable)
            start += len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
        self.known = pa.concat_arrays([self.known, new])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])

    def _ids(self, usable: list[str]):
        """Ids of all, and where each part's begin and how many they are."""
        np = self.np
        # other parts stand behind a space; each is followed by a line feed, and a part's own line feed is the one before it
        lines = [p[1:] if p[0] == "\n" else " " + p for p in usable]
        ids = np.asarray(self.tok.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, dtype="<u4")
        ids = np.concatenate([[self.feed], ids]).astype("<u4")
        first = np.flatnonzero(ids == self.feed)
        if len(first) != len(usable):  # a word holds a line feed of its own
            rows = [np.frombuffer(self.whole(x), "<u4") for x in lines]
            ids = np.concatenate([np.concatenate([[self.feed], r]) for r in rows]).astype("<u4")
            first = np.cumsum([0, *(len(r) + 1 for r in rows[:-1])])
        own = np.fromiter((p[0] == "\n" for p in usable), bool, len(usable))
        begin = first + ~own
        return ids, begin, np.append(first[1:], len(ids)) - begin

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        start = 0
        while start < len(texts):
            end, n = start, 0
            while end < len(texts) and (n == 0 or n + len(texts[end]) <= BATCH_CHARS):
                n += len(texts[end])
                end += 1
            yield from self._some(texts[start:end])
            start = end

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        np = self.np
        lines = pc.replace_substring(pa.array(texts, pa.string()), pattern="\n", replacement=" \n")
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")
        coded = parts.values.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        unknown = pc.is_null(at)
        new, unknown = coded.dictionary.filter(unknown), unknown.to_numpy(zero_copy_only=False)
        places = at.fill_null(0).to_numpy().astype(np.int64)
        if len(self.known) + len(new) > CACHE_WORDS:
            self._keep(at.drop_null())
            places[~unknown] = np.arange(len(self.known))
        places[unknown] = np.arange(len(new)) + len(self.known)
        for k in range(0, len(new), LEARN_WORDS):
            self._learn(new.slice(k, LEARN_WORDS))
        rows = places[coded.indices.to_numpy()]
        length = self.length[rows]
        ends = np.cumsum(length)
        ids = self._gather(self.start[rows], length, ends)
        edges = parts.offsets.to_numpy()
        place = np.concatenate([[0], ends])[edges]
        odd = np.add.reduceat(length == 0, edges[:-1])
        for k, text in enumerate(texts):
            # the line feed before the text isn't its own
            yield b"" if not text else self.whole(text) if odd[k] else ids[place[k] + 1 : place[k + 1]].tobytes()


@cache
def encoder(name: str = VOCABULARY) -> Encoder:
    """One for each worker process, so that tasks share its cache."""
    return Encoder(name)


def text_batches(batches, columns: list[str]):
    """Arrow batches as (columns, texts); null texts are empty."""
    for b in batches:
        yield [b.column(c) for c in columns], [t or "" for t in b.column("text").to_pylist()]
