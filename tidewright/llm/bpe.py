r"""BPE encoding and decoding by speculation and verification.

A pre-token (word) is first cut by greedy longest match, which is cheap.  A cut
is the BPE result exactly if every token is what BPE makes of its own letters and
every adjacent pair stays apart.  Whether a pair stays apart is seen by undoing
merges on both sides of the seam, the latest first: it does unless two tokens
that face each other at some time have a merge of their own that comes before
either is merged elsewhere.  All adjacent pairs of all new words of a batch are
undone together, as arrays with one table look-up a step; only words with a
failing pair go through exact merging.  Words' ids are remembered within a task
up to a fixed number.  Decoding takes the ids alone.

Defined results: a null text is an empty text; an empty text or one of white
space only has no tokens (digest of the empty string); special-token strings
in a text become their ids, as in the library's default; a very long text is
one text, its words handled like others; repeated rows are encoded alike; an
empty table gives no rows; other columns are not read, and kept if asked for.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidewright.llm.textkernel import chunks

#: White space of the tokenizer's regular expressions.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: The tokenizer's pre-token pattern.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Remembered words in a task: half of them newer ones, half older ones, which are dropped unless they come again.
REMEMBERED = 500_000
_NEVER = np.int64(1 << 60)
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class SpeculativeBpe:
    """A word-end BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level letters: printable bytes stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.chunk: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.names = pa.array([self.name.get(i, "") for i in range(max(self.name, default=-1) + 1)], pa.string())
        self._tables()

    def _tables(self) -> None:
        """Merges as arrays: each token's latest merge and its halves, and the rank of every pair that has a merge."""
        n = len(self.names)
        self.made, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        pairs = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in self.rank], np.int64).reshape(-1, 3)
        ranks = np.array(list(self.rank.values()), np.int64)
        whole, first = np.unique(pairs[:, 2], return_index=True)  # of several merges that make one token, the earliest
        self.made[whole], self.left[whole], self.right[whole] = ranks[first], pairs[first, 0], pairs[first, 1]
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = np.append(key[order], -1), np.append(ranks[order], _NEVER)
        # undoing by rank is undoing in time only if no merge comes before those of its halves
        in_time = bool((ranks > self.made[pairs[:, :2]].max(axis=1, initial=-1)).all())
        self.sound = np.zeros(n, bool)  # tokens that BPE makes of their own letters, by their earliest merge
        if in_time:
            for t, i in self.vocab.items():
                self.sound[i] = self.made[i] < 0 and len(self._units(t)) == 1
            apart = self.apart(self.left[whole], self.right[whole], ranks[first])
            for k in np.argsort(ranks[first]).tolist():
                t = whole[k]
                self.sound[t] = apart[k] and self.sound[self.left[t]] and self.sound[self.right[t]]

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = _NEVER) -> np.ndarray:
        """Which pairs (a, b) of sound tokens BPE keeps apart, regarding merges before the rank `until`."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        u, v = a.copy(), b.copy()
        u_gone, v_gone = (np.full(len(a), until, np.int64) for _ in range(2))  # rank of the merge that takes each away
        while len(at):
            place = np.searchsorted(self.pair_key[:-1], u << 32 | v)
            rank = np.where(self.pair_key[place] == (u << 32 | v), self.pair_rank[place], _NEVER)
            meet = (rank < u_gone) & (rank <= v_gone)  # equal ranks: the leftmost pair goes first
            out[at[meet]] = False
            more = ~meet & ((self.made[u] >= 0) | (self.made[v] >= 0))
            at, u, v, u_gone, v_gone = at[more], u[more], v[more], u_gone[more], v_gone[more]
            left = self.made[u] > self.made[v]  # the later one is undone; of equal ones the right one was made later
            u_gone, v_gone = np.where(left, self.made[u], u_gone), np.where(left, v_gone, self.made[v])
            u, v = np.where(left, self.right[u], u), np.where(left, v, self.left[v])
        return out

    # -- exact merging -------------------------------------------------
    def merged(self, symbols: list[str]) -> list[str]:
        """Apply the lowest-ranked merge, leftmost first, until none is left."""
        symbols, rank, never = list(symbols), self.rank.get, 1 << 60
        ranks = [rank(p, never) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            symbols[at] += symbols.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), never)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), never)
        return symbols

    def symbols(self, text: str, last: bool) -> list[str]:
        """Single letters; the word end clings to the last one."""
        out = list(text)
        if last and self.end:
            out[-1] += self.end
        return out

    def _units(self, token: str) -> list[str]:
        last = bool(self.end) and token.endswith(self.end)
        return self.symbols(token.removesuffix(self.end) if last else token, last)

    # -- speculation ---------------------------------------------------
    def greedy(self, word: str) -> list[int]:
        vocab, end, n, i, out = self.vocab, self.end, len(word), 0, []
        while i < n:
            stop = min(n, i + self.longest)
            found = vocab.get(word[i:] + end) if stop == n else None
            if found is not None:
                out.append(found)
                return out
            if stop == n:
                stop = n - 1
            while stop > i:
                found = vocab.get(word[i:stop])
                if found is not None:
                    break
                stop -= 1
            if found is None:
                return []
            out.append(found)
            i = stop
        return out

    def words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each word (byte-level letters): propose, check all pairs at once, merge only what fails."""
        cuts = [self.greedy(w) for w in words]
        sizes = np.array([len(c) for c in cuts], np.int64)
        ids = np.fromiter((i for c in cuts for i in c), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(cuts)), sizes)
        ok = sizes > 0
        ok[of[~self.sound[ids]]] = False
        inner = np.flatnonzero(of[1:] == of[:-1]) if len(ids) else np.zeros(0, np.int64)
        inner = inner[ok[of[inner]]]
        keys, back = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        ok[of[inner[~self.apart(keys >> 32, keys & 0xFFFFFFFF)[back]]]] = False
        return {w: c if fine else [self.vocab[s] for s in self.merged(self.symbols(w, True))] for w, c, fine in zip(words, cuts, ok.tolist())}

    # -- texts -----------------------------------------------------------
    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, text) in order."""
        at = 0
        if self._special is not None and "<" in text:
            for m in self._special.finditer(text):
                yield False, text[at : m.start()]
                yield True, m[0]
                at = m.end()
        yield False, text[at:]

    def pieces(self, text: str) -> list[str]:
        """The normalised text cut at white space, or at pre-tokens where str.split() would differ."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # letter by letter, a final sigma is no exception
        text = text.lower()
        return _PIECES.findall(text) if _ODD_SPACE.search(text) else text.split()

    def learn(self, new: set[str]) -> None:
        """Encode chunks that have not been seen."""
        letter = self.letter.__getitem__
        cut = {c: [p if p.isascii() and p.isprintable() else "".join(map(letter, p.encode())) for p in _PIECES.findall(c)] for c in new}
        ids = self.words(list({w for ws in cut.values() for w in ws}))
        for c, ws in cut.items():
            got = [i for w in ws for i in ids[w]]
            self.chunk[c] = " ".join(map(str, got))

    def remember(self, words: set[str]) -> None:
        """See that `chunk` has all the words of a batch: from the older ones, or learnt anew."""
        if len(self.chunk) + len(words.difference(self.chunk)) > REMEMBERED // 2:
            self.older, self.chunk = self.chunk, {}
        new = words.difference(self.chunk)
        again = new.intersection(self.older)
        self.chunk.update((c, self.older[c]) for c in again)
        if new := new - again:
            self.learn(new)

    def forget(self) -> None:
        """At the end of a task: workers live on, and other stages need the memory."""
        self.chunk, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[tuple[int, str]]:
        """(number of tokens, ids joined by spaces) of each text."""
        cut = [[(s, [t] if s else self.pieces(t)) for s, t in self.segments(x)] for x in texts]
        self.remember({c for parts in cut for s, cs in parts for c in cs if not s})
        for s, i in self.special.items():
            self.chunk[s] = str(i)
        out = []
        for parts in cut:
            chunks_ = parts[0][1] if len(parts) == 1 else [c for _, cs in parts for c in cs]
            ids = " ".join(filter(None, map(self.chunk.__getitem__, chunks_)))  # a chunk without tokens must not leave a blank
            out.append((ids.count(" ") + 1 if ids else 0, ids))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(i) for i in self.encode([text])[0][1].split()]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Text of each list of ids: tokens joined by spaces, as a tokenizer file without a decoder has it; ids outside the vocabulary give nothing."""
        flat_ids = ids.flatten()
        known = pc.is_in(flat_ids, pa.array(sorted(self.name), flat_ids.type))
        if pc.all(known, min_count=0).as_py():
            return pc.binary_join(pa.ListArray.from_arrays(_offsets(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()), self.names.take(flat_ids)), " ")
        return self.decode(pa.array([[i for i in x or [] if i in self.name] for x in ids.to_pylist()], ids.type))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


_loaded: dict[str, SpeculativeBpe] = {}


def _model(path: str) -> SpeculativeBpe:
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, ids_column: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of every text: count, digests of ids and decoded text, the ids themselves under `ids_column` if asked for, and the columns `keep` of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        try:
            yield from encoded(model, batches)
        finally:
            model.forget()

    def encoded(model: SpeculativeBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            got = model.encode([x or "" for x in batch.column(1).to_pylist()])
            counts = np.array([n for n, _ in got], np.int64)
            ids = np.fromstring(" ".join(x for _, x in got if x), np.int32, sep=" ")
            lists = pa.ListArray.from_arrays(_offsets(counts), pa.array(ids))
            cols = [
                batch.column(0),
                pa.array(counts),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for _, x in got], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in model.decode(lists).to_pylist()], pa.string()),
                *([lists] if ids_column else []),
                *batch.columns[2:],
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    more = [f.simpleString().split(":", 1) for f in (docs.schema[c] for c in keep)]
    schema = ", ".join([SCHEMA, *([f"`{ids_column}` array<int>"] if ids_column else []), *(f"`{name}` {kind}" for name, kind in more)])
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *([ids_column] if ids_column else []), *keep]
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"], *(docs[c] for c in keep)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """The decoded text of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), model.decode(batch.column(1))], ["doc_id", "text"])

    return encoded.select("doc_id", ids_column).mapInArrow(run, "doc_id bigint, text string")
