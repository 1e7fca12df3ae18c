"""BPE encoding and decoding: a streaming transducer with bounded lookahead.

A word's symbols (its bytes; the last one marked as the word's end) are read one by one. For each prefix the last token of the prefix's
encoding is kept: it is the one token whose pair with the last token of the rest is stable, which means that no merge across their
border comes before the merges that made them. An encoding is read off backwards from the end. What later symbols can still change
reaches back over a chain of merges of growing rank, each of which takes a suffix from the token on its left. The longest chain that
the merge list allows, times the longest token, is the sufficient lookahead: tokens further back are emitted and forgotten, so memory
doesn't grow with the word. Mostly they are certain much sooner: a later token starts within the last symbols, as many as the longest
token has, so what the encodings up to all these places share is final. Words met before come from a bounded cache.

Decoding is incremental too: a state machine takes token after token; it holds at most an unfinished UTF-8 character.

Cases: null and empty texts have no tokens and decode to the empty text; special tokens written out in a text become their ids, as the
library does by default; repeated rows encode alike; an empty table gives an empty result; other columns are ignored by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space of the vocabulary's normaliser (Unicode White_Space), written out as the pattern libraries differ over it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
END = "</w>"
CACHE_WORDS, CACHE_LENGTH = 250_000, 40
#: Words whose ids and text are held at once where only digests are wanted.
STREAM_WORDS = 4096


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Merges:
    """A vocabulary with its merge list; tokens are numbers in order of birth: symbols first, then by rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        made = {a + b for a, b in merges}
        names = [t for t in vocabulary if t not in made and t not in specials]
        self.first_rank = len(names)
        self.number = {t: i for i, t in enumerate(names)}
        self.parts: list[tuple[int, int] | None] = [None] * len(names)
        self.wide = len(names) + len(merges)  # a pair (a, b) is the number a * wide + b
        self.pair: dict[int, int] = {}
        for a, b in merges:
            if a + b in self.number or a not in self.number or b not in self.number:
                raise ValueError(f"the merges aren't proper: {a} {b}")
            pair = self.number[a], self.number[b]
            self.pair[pair[0] * self.wide + pair[1]] = self.number[a + b] = len(self.parts)
            self.parts.append(pair)
        self.names = list(self.number)
        self.ids = [vocabulary[t] for t in self.names]
        self.lengths = [1 if p is None else 0 for p in self.parts]
        for i, p in enumerate(self.parts):
            if p:
                self.lengths[i] = self.lengths[p[0]] + self.lengths[p[1]]
        self.longest = max(self.lengths, default=1)
        #: every string that some token ends with
        self.ending = {t[k:] for t in self.names for k in range(len(t))}
        self.specials = specials
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._stable: dict[int, bool] = {}
        #: tokens that their own symbols encode to; only these can come out
        self.usable: dict[str, int] = {}
        whole = []
        for i, p in enumerate(self.parts):
            whole.append(p is None or whole[p[0]] and whole[p[1]] and not self._crosses(p[0], p[1], i))
            if whole[-1]:
                self.usable[self.names[i]] = i
        self._right.clear()
        self._left.clear()

    def _edge(self, token: int, side: int, kept: dict) -> list[tuple[int, float]]:
        """The tokens that stood at a token's border while it grew, with the rank of the merge that ended each."""
        spine, ends = [], float("inf")
        at: int | None = token
        while at is not None:
            spine.append((at, ends))
            ends = at
            at = self.parts[at][side] if self.parts[at] else None
        kept[token] = spine
        return spine

    def _crosses(self, a: int, b: int, before: float) -> bool:
        """Whether a merge over the border of a and b comes before those that made a and b, and before ``before``."""
        get, wide = self.pair.get, self.wide
        left = self._left.get(b) or self._edge(b, 0, self._left)
        for x, x_ends in self._right.get(a) or self._edge(a, 1, self._right):
            row = x * wide
            for y, y_ends in left:
                m = get(row + y)
                # of equal merges the left one is first
                if m is not None and m < x_ends and m <= y_ends and m < before:
                    return True
        return False

    def stable(self, a: int, b: int) -> bool:
        pair = a * self.wide + b
        found = self._stable.get(pair)
        if found is None:
            if len(self._stable) > 200_000:
                self._stable.clear()
            found = self._stable[pair] = not self._crosses(a, b, float("inf"))
        return found

    @lru_cache(maxsize=1)  # noqa: B019
    def lookahead(self) -> int:
        """Symbols after which a token can't change any more.

        A merge (a, b) takes a from a token x that ends in a and is made later; what x leaves behind begins with some token d, which
        a still later merge (c, d) can join to the token on its left, and so on. The longest such chain is found from the last merge
        to the first; ``after[a]`` is the longest chain that may follow a merge whose left part is a.
        """
        begins = defaultdict(list)
        text, number = self.names, self.number
        fronts = lambda x: [d for k in range(1, len(text[x])) if (d := number.get(text[x][:k])) is not None]
        backs = [[d for k in range(1, len(x)) if (d := number.get(x[k:])) is not None] for x in text]
        joins, after = defaultdict(int), defaultdict(int)
        best = 0
        for m in range(len(text) - 1, self.first_rank - 1, -1):
            a, d = self.parts[m]
            length = 1 + after[a]
            best = max(best, length)
            begun = fronts(m)
            top = max((joins[p] for p in begun), default=0)
            for s in backs[m]:
                after[s] = max(after[s], top)
            for p in begun:
                begins[p].append(m)
            if length > joins[d]:
                joins[d] = length
                for x in begins[d]:
                    for s in backs[x]:
                        if after[s] < length:
                            after[s] = length
        return (best + 1) * self.longest


class Transducer:
    """Symbols in, tokens out; ``held`` is the number of symbols not yet encoded for good."""

    def __init__(self, merges: Merges, lookahead: int):
        self.m, self.look, self.every = merges, lookahead, 8 * merges.longest
        self.restart()

    def restart(self) -> None:
        self.text: list[str] = []
        self.last: list[int] = []
        self.before: int | None = None  # the last token emitted

    @property
    def held(self) -> int:
        return len(self.text)

    def push(self, symbol: str) -> list[int]:
        """Takes a symbol; returns the tokens that have become certain."""
        self.text.append(symbol)
        m, n = self.m, len(self.text)
        number, last, stable = m.usable, self.last, m.stable
        name = ""
        for k in range(1, min(m.longest, n) + 1):
            name = self.text[n - k] + name
            token = number.get(name)
            if token is None:
                continue
            prior = last[n - k - 1] if n > k else self.before
            if prior is None or stable(prior, token):
                last.append(token)
                break
        else:
            raise ValueError(f"{symbol!r} isn't in the vocabulary")
        if n % self.every:
            return []
        return self._emit(max(self._certain(), n - self.look))

    def _certain(self) -> int:
        """The last place at which all encodings that can go on have a border."""
        shared: set[int] | None = None
        for at in range(len(self.text), max(0, len(self.text) - self.m.longest), -1):
            ends = set()
            while at > 0:
                ends.add(at)
                at -= self.m.lengths[self.last[at - 1]]
            shared = ends if shared is None else shared & ends
        return max(shared or (0,))

    def run(self, letters: str) -> list[int]:
        """The tokens of a short word at once; ``letters`` are its symbols without the mark of the end."""
        m, last, n = self.m, [], len(letters)
        number, known, wide, ending = m.usable.get, m._stable.get, m.wide, m.ending
        for i in range(1, n + 1):
            mark = END if i == n else ""
            for j in range(i - 1, -1, -1):
                name = letters[j:i] + mark
                token = number(name)
                if token is not None:
                    if j == 0:
                        last.append(token)
                        break
                    fits = known(last[j - 1] * wide + token)
                    if fits or fits is None and m.stable(last[j - 1], token):
                        last.append(token)
                        break
                elif name not in ending:
                    break
            if len(last) < i:
                raise ValueError(f"{letters[i - 1]!r} isn't in the vocabulary")
        out = []
        while n:
            out.append(last[n - 1])
            n -= m.lengths[last[n - 1]]
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._emit(len(self.text))
        self.restart()
        return out

    def _emit(self, upto: int) -> list[int]:
        """The tokens, on the way to the present end, that end at ``upto`` or before."""
        at, ends = len(self.text), []
        while at > 0:
            ends.append(at)
            at -= self.m.lengths[self.last[at - 1]]
        ends = [e for e in reversed(ends) if e <= upto]
        out = [self.last[e - 1] for e in ends]
        if ends:
            self.before = out[-1]
            del self.text[: ends[-1]], self.last[: ends[-1]]
        return out


class Codec:
    """Texts to ids and back, by a vocabulary file of the kind with word ends."""

    def __init__(self, path: str, lookahead: int | None = None):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        specials = {t["content"]: t["id"] for t in config["added_tokens"]}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = Merges(model["vocab"], merges, specials)
        self.symbols = byte_symbols()
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.names = {i: t for t, i in (model["vocab"] | specials).items()}
        self.transducer = Transducer(self.merges, lookahead or self.merges.lookahead())
        self.cache: dict[str, bytes] = {}

    def _stream(self, word: str) -> list[int]:
        data = word.encode()
        if len(data) <= 64:
            return self.transducer.run("".join([self.symbols[b] for b in data]))
        out = []
        for b in data[:-1]:
            out += self.transducer.push(self.symbols[b])
        return out + self.transducer.push(self.symbols[data[-1]] + END) + self.transducer.finish()

    def word(self, word: str) -> bytes:
        """A word's ids as bytes."""
        found = self.cache.get(word)
        if found is None:
            ids = self.merges.ids
            found = array("I", [ids[t] for t in self._stream(word)]).tobytes()
            if len(word) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of each word or special token."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        for part in parts:
            if part in self.merges.specials:
                yield array("I", [self.merges.specials[part]]).tobytes()
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            # letter by letter, so a final sigma is no special case
            get, word = self.cache.get, self.word
            for w in _TOKEN.findall(part.replace("Σ", "σ").lower()):
                yield get(w) or word(w)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return b"".join(self.pieces(text or ""))

    def both(self, text: str | None) -> tuple[bytes, str]:
        """Ids, and the text that they decode to."""
        ids = self.encode(text)
        machine = Decoder(self)
        return ids, machine.feed(array("I", ids)) + machine.finish()

    def stream(self, text: str | None) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text, bit by bit: of some thousand words each time, or of one very long word."""
        machine, some = Decoder(self), []
        for piece in self.pieces(text or ""):
            some.append(piece)
            if len(some) == STREAM_WORDS:
                ids = b"".join(some)
                yield ids, machine.feed(array("I", ids))
                some.clear()
        ids = b"".join(some)
        yield ids, machine.feed(array("I", ids)) + machine.finish()


class Decoder:
    """Ids in, text out, one at a time.

    As the library decodes a vocabulary without a decoder of its own: the tokens' names with spaces between. With ``words=True`` names
    become bytes and word ends spaces; bytes of an unfinished character wait in the state, and wrong ones become U+FFFD.
    """

    def __init__(self, codec: Codec, words: bool = False):
        import codecs

        self.names, self.specials, self.words, self.started = codec.names, codec.merges.specials, words, False
        self.bytes = {c: i for i, c in enumerate(codec.symbols)}
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: array) -> str:
        """What these further ids add to the text."""
        if self.words:
            return "".join(map(self.push, ids))
        out = " ".join(map(self.names.__getitem__, ids))
        if self.started and ids:
            out = " " + out
        self.started = self.started or len(ids) > 0
        return out

    def push(self, token_id: int) -> str:
        if not self.words:
            return self.feed(array("I", [token_id]))
        name = self.names[token_id]
        if name in self.specials:
            return self.state.decode(b"", True) + name
        ended = name.endswith(END)
        data = bytes(self.bytes[c] for c in (name[: -len(END)] if ended else name))
        return self.state.decode(data, ended) + (" " if ended else "")

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.words else ""


_CODECS: dict[str, Codec] = {}


def codec(path: str, lookahead: int | None = None) -> Codec:
    """The codec of a file, kept as long as the worker lives; the lookahead is computed unless given."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, lookahead)
    return _CODECS[path]


def decode(c: Codec, ids: Iterable[int], words: bool = False) -> str:
    machine = Decoder(c, words)
    return "".join([*map(machine.push, ids), machine.finish()])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded for each row of ``docs`` (doc_id, text)."""

    lookahead = codec(path).transducer.look

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lookahead)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [c.both(x.as_py()) for x in part.column("text")]
                ids = pa.ListArray.from_arrays(pa.array([0, *_running(len(a) // 4 for a, _ in found)], pa.int32()), pa.Array.from_buffers(pa.int32(), sum(len(a) for a, _ in found) // 4, [None, pa.py_buffer(b"".join([a for a, _ in found]))]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(a) // 4 for a, _ in found], pa.int64()), ids, pa.array([b for _, b in found], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def _running(lengths: Iterable[int]) -> Iterator[int]:
    total = 0
    for n in lengths:
        total += n
        yield total


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what ``encode`` gives, digested as the encoder and the decoder's state machine give it,
    so neither ids nor decoded text of a document are held whole."""

    lookahead = codec(path).transducer.look

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, lookahead)
        for batch in batches:
            rows = []
            for x in batch.column("text"):
                n_bytes, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for ids, decoded in c.stream(x.as_py()):
                    n_bytes += len(ids)
                    of_ids.update(ids)
                    of_text.update(decoded.encode())
                rows.append((n_bytes // 4, of_ids.hexdigest(), of_text.hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
