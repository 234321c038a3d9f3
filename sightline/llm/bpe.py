"""BPE encoding and decoding as streaming transducers."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm.common import fields_of, sliced

#: White space as the tokenizer's normalizer and splitter see it.
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_FIRST_BLANK, _LAST_BLANK = regex.compile(f"[{BLANK}]"), regex.compile(f"(?r)[{BLANK}]")
#: Encoded pieces that a worker keeps, of 64 characters at most; beyond, the older half goes. About 200 bytes each.
CACHE = 200_000
#: Ids that are decoded at once.
RUN = 4096
#: A piece that begins so near to what has been read may be another one once more is read, unless it is a run: longer than any fixed piece.
UNSURE = 16
#: Bits of a symbol's number in a packed pair, and a place in the merge list that is behind all.
SHIFT = 20
MASK, NEVER = (1 << SHIFT) - 1, 1 << 60
#: Windows of so many symbols are searched for the next merge from end to end; longer ones keep a heap.
SHORT = 64


class Recent(dict):
    """A cache of bounded size: when a generation is full, the one before it is dropped. Long keys are made anew each time."""

    def __init__(self, make, entries: int = CACHE, longest: int = 64):
        self.make, self.half, self.longest, self.old = make, entries // 2, longest, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    shown = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255]
    free = iter(range(256, 512))
    return [chr(i) if i in set(shown) else chr(next(free)) for i in range(256)]


class Tokenizer:
    """What a tokenizer file says: vocabulary, merges, word end, pre-tokenization and added tokens.

    Symbols and tokens are numbers: those of the vocabulary by their ids, others after them. pairs: two symbols, packed, to the merge's place in
    the list and the number of the token that it makes, packed.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        merges: dict[tuple[str, str], tuple[int, str]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            merges[a, b] = (rank, a + b)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", BLANK))
        #: The alternatives of the pattern that are runs of any length.
        self.runs = [regex.compile(r.replace(r"\s", BLANK)) for r in regex.findall(r"\[(?:\\.|[^\]\\])*\]\+", pattern)]
        self.letters = byte_letters()
        self.lookahead = lookahead(merges, self.end)
        parts = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, parts))) if parts else None
        number = dict(self.vocab)
        self.known = max(number.values(), default=-1) + 1
        of = lambda token: number.setdefault(token, self.known + len(number))
        self.inside, self.last = [of(c) for c in self.letters], [of(c + self.end) for c in self.letters]
        self.pairs = {of(a) << SHIFT | of(b): rank << SHIFT | of(both) for (a, b), (rank, both) in merges.items()}
        self.size = {i: symbols_of(t, self.end) for t, i in number.items()}


def symbols_of(token: str, end: str) -> int:
    """Base symbols in a token; the word end belongs to the last one."""
    return len(token.removesuffix(end)) if end else len(token)


def lookahead(merges: dict[tuple[str, str], tuple[int, str]], end: str) -> int:
    """Symbols that must be known beyond a token for it to be final, from the merge list alone.

    Compare a run that sees only what has been read with one that sees the whole word. To the left of some place their tokens agree; the place
    starts where reading stopped. It moves left only when a merge (a, b) happens in one run alone, b beginning at the place; then by the length
    of a. Afterwards the token that begins at the place is ab in one run and a in the other, and only later merges can follow. So, from the last
    merge to the first: far[b] = max(|a| + max(far[ab], far[a])), and, as b can have grown, far[a] = max(far[a], far[ab]).
    """
    far: dict[str, int] = {}
    for (a, b), (_, both) in sorted(merges.items(), key=lambda m: -m[1][0]):
        onward = max(far.get(both, 0), far.get(a, 0))
        grown = far.get(both, 0)
        far[b] = max(far.get(b, 0), symbols_of(a, end) + onward)
        far[a] = max(far.get(a, 0), grown)
    base = {s for a, b in merges for s in (a, b) if symbols_of(s, end) == 1}
    return max((far.get(s, 0) for s in base), default=0) + 1


def merge_window(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the symbols of a window: always the pair that is earliest in the list, the leftmost of equals."""
    get, before = pairs.get, symbols[0]
    found = [get(before << SHIFT | (before := b), NEVER) for b in symbols[1:]]
    if len(symbols) <= SHORT:
        while found and (best := min(found)) != NEVER:
            i, both = found.index(best), best & MASK
            symbols[i] = both
            del symbols[i + 1], found[i]
            if i:
                found[i - 1] = get(symbols[i - 1] << SHIFT | both, NEVER)
            if i < len(found):
                found[i] = get(both << SHIFT | symbols[i + 1], NEVER)
        return symbols
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(m, i) for i, m in enumerate(found) if m != NEVER]
    heapq.heapify(heap)
    while heap:
        best, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= n or pairs.get(symbols[i] << SHIFT | symbols[j]) != best:
            continue
        both = best & MASK
        symbols[i], symbols[j], after[i] = both, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
            if m := pairs.get(both << SHIFT | symbols[after[j]]):
                heapq.heappush(heap, (m, i))
        if before[i] >= 0 and (m := pairs.get(symbols[before[i]] << SHIFT | both)):
            heapq.heappush(heap, (m, before[i]))
    return [s for s in symbols if s >= 0]


class Encoder:
    """A transducer from text to ids. Blocks of text come in, and ids leave as soon as nothing that follows can change them; what it holds is a
    window of one piece, a block, and a bounded cache of what the transducer gave for short pieces. Runs of ids are little-endian 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer, window: int | None = None, block: int = 1 << 16, cache: int = CACHE):
        self.t, self.block = tokenizer, block
        self.window = max(window or 4 * tokenizer.lookahead, tokenizer.lookahead + 64)
        self.pieces = Recent(self.piece, cache)

    def stream(self, blocks: Iterable[bytes]) -> Iterator[bytes]:
        """Runs of ids of one piece, whose UTF-8 bytes come in blocks. A token is final if it ends `lookahead` symbols before the last one read, or
        if the piece has ended; what follows final tokens is encoded as if the piece began there."""
        blocks = filter(None, blocks)
        held, block, at = b"", next(blocks, b""), 0
        while block or held:
            while block and len(held) < self.window:
                part = block[at : at + self.window - len(held)]
                held, at = held + part, at + len(part)
                if at == len(block):
                    block, at = next(blocks, b""), 0
            ids, done = self.step(held, not block)
            yield ids
            held = held[done:]

    def step(self, held: bytes, ended: bool) -> tuple[bytes, int]:
        """The transducer's step: the ids that are final given what is held, and how much of it they stand for."""
        t, done = self.t, len(held)
        symbols = [*map(t.inside.__getitem__, held)]
        if ended:
            symbols[-1] = t.last[held[-1]]
        tokens = merge_window(symbols, t.pairs)
        if not ended:
            done, limit = 0, done - t.lookahead
            for k, token in enumerate(tokens):  # noqa: B007
                if done + t.size[token] > limit:
                    break
                done += t.size[token]
            tokens = tokens[:k]
        if tokens and max(tokens) >= t.known:
            tokens = [x for x in tokens if x < t.known]
        return array("I", tokens).tobytes(), done

    def piece(self, piece: str) -> bytes:
        """A piece within the window is one step; others are many."""
        data = piece.encode()
        return self.step(data, True)[0] if len(data) <= self.window else b"".join(self.stream((data,)))

    def normal(self, text: str) -> str:
        """Composed, and in lower case character by character: only a capital sigma's lower case depends on what stands around it."""
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])

    def parts(self, text: str, at: int, end: int) -> Iterator[str]:
        """Normal forms of text[at:end], by parts of about a block that compose as the whole does: no part begins with a character that could
        join what stands before it."""
        while at < end:
            stop = min(at + self.block, end)
            while stop < end and not text[stop].isascii() and (unicodedata.category(text[stop])[0] == "M" or "\u1100" <= text[stop] <= "\u11ff"):
                stop += 1
            yield self.normal(text[at:stop])
            at = stop

    def long_chunk(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of text[at:end], of any length and without a blank. A piece that reaches the end of a part goes on in the next one."""
        parts = self.parts(text, at, end)
        kept, following = next(parts), next(parts, "")
        while kept:
            stop, rest = len(kept), ""
            for m in self.t.pieces.finditer(kept):
                if following and len(kept) - m.start() < UNSURE:
                    stop = m.start()
                    break
                if following and m.end() == len(kept):
                    run, left = next(r for r in self.t.runs if r.fullmatch(m[0])), []
                    yield from self.stream(self.run(run, m[0], itertools.chain([following], parts), left))
                    rest, following = "".join(left), ""
                    break
                yield self.pieces[m[0]]
            kept = kept[stop:] + rest + following
            following = next(parts, "")

    def run(self, run, begun: str, parts: Iterable[str], left: list[str]) -> Iterator[bytes]:
        """The bytes of a run that goes on for as long as the parts match; what follows it in its last part is put into `left`."""
        yield begun.encode()
        for part in parts:
            m = run.match(part)
            size = m.end() if m else 0
            yield part[:size].encode()
            if size < len(part):
                left.append(part[size:])
                return

    def between(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Runs of ids of text[at:end], which holds no added token; by blocks that end at a blank, which no piece crosses."""
        while at < end:
            stop = min(at + self.block, end)
            if stop < end:
                blank = _LAST_BLANK.search(text, at, stop)
                if blank is None:
                    following = _FIRST_BLANK.search(text, stop, end)
                    stop = following.start() if following else end
                    yield from self.long_chunk(text, at, stop)
                    at = stop
                    continue
                stop = blank.end()
            yield b"".join(map(self.pieces.__getitem__, self.t.pieces.findall(self.normal(text[at:stop]))))
            at = stop

    def encode(self, text: str) -> Iterator[bytes]:
        """Runs of ids of a whole text. Added tokens in it count as themselves."""
        at = 0
        if self.t.special is not None and "<|" in text:
            for m in self.t.special.finditer(text):
                yield from self.between(text, at, m.start())
                yield struct.pack("<I", self.t.added[m[0]])
                at = m.end()
        yield from self.between(text, at, len(text))


class Decoder:
    """A state machine from ids to text. Each id stands for some bytes; a character leaves once its last byte has come, so the state is the bytes of
    one character and whether a token has come. Bytes that are not UTF-8 become U+FFFD.

    The tokenizer file names no decoder, so its library joins the tokens' names with blanks: `joined`, the rule by default. With `joined` false,
    letters are read as bytes again and a word end as a blank.
    """

    def __init__(self, tokenizer: Tokenizer, joined: bool = True):
        byte = {c: i for i, c in enumerate(tokenizer.letters)}
        self.joined, end, self.spoken = joined, tokenizer.end, {}
        for i, name in tokenizer.names.items():
            if joined or name in tokenizer.added:
                self.spoken[i] = b" " * joined + name.encode()
            else:
                ends = bool(end) and name.endswith(end)
                self.spoken[i] = bytes(byte[c] for c in (name.removesuffix(end) if ends else name)) + b" " * ends

    def decode(self, runs: Iterable[bytes]) -> Iterator[str]:
        """Text as ids come, in runs of any length."""
        state, begun = codecs.getincrementaldecoder("utf-8")("replace"), False
        for run in runs:
            for at in range(0, len(run), 4 * RUN):
                got = b"".join(map(self.spoken.__getitem__, np.frombuffer(run[at : at + 4 * RUN], "<u4").tolist()))
                yield state.decode(got if begun or not self.joined else got[1:])
                begun = True
        yield state.decode(b"", True)

    def text(self, ids: bytes) -> str:
        return "".join(self.decode((ids,)))

    def digest(self, ids: bytes) -> str:
        """sha256 of the text in UTF-8, of which one run's is held at a time."""
        state = hashlib.sha256()
        for part in self.decode((ids,)):
            state.update(part.encode())
        return state.hexdigest()


_HELD: dict[tuple[str, int], tuple[Encoder, Decoder]] = {}


def tools(path: str, cache: int = CACHE) -> tuple[Encoder, Decoder]:
    """A worker's own, kept from task to task."""
    if (path, cache) not in _HELD:
        tokenizer = Tokenizer(path)
        _HELD[path, cache] = Encoder(tokenizer, cache=cache), Decoder(tokenizer)
    return _HELD[path, cache]


def encode_documents(docs: DataFrame, path: str, decode: str = "decoded", cache: int = CACHE) -> DataFrame:
    """Encode every whole text and decode its ids: all columns, then `n_tokens`, `ids` (little-endian 32-bit integers) and the column that
    `decode` names: `decoded`, or `decoded_sha256` of its UTF-8 bytes.

    path: a tokenizer file that each worker can read; cache: pieces that it keeps. Null and empty texts have no ids and decode to the empty text. Repeated rows get equal
    results. Input columns of these names are replaced.
    """
    added = ["n_tokens", "ids", decode]
    keep = [c for c in docs.columns if c not in added]
    chosen = docs.select(*keep)

    def encoded(batches):
        encoder, decoder = tools(path, cache)
        told = {"decoded": decoder.text, "decoded_sha256": decoder.digest}[decode]
        for batch in sliced(batches):
            ids = [b"".join(encoder.encode(t or "")) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(told, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*keep, *added])

    return chosen.mapInArrow(encoded, f"{fields_of(chosen.schema)}, n_tokens bigint, ids binary, {decode} string")
