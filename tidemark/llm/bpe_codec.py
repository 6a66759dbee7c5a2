"""BPE encoding and decoding (operator 7): a bounded-lookahead transducer and a state machine.

Encoding. Merges never cross the border between two final tokens, so a border that no text further
right can undo splits the work. ``sufficient_lookahead`` computes from the merge list how many bytes
right of a token's end decide about it: a rule (s, w) over the border needs an s that the token may end
in and a whole w, and w can only be spoilt by a rule of lower rank that starts inside w's right spine
and needs bytes of its own, and so on down the ranks. Every piece goes through the transducer a few
bytes (``STRIDE``) at a time; a token leaves as soon as what has come after it is its lookahead, so the
transducer holds the greatest lookahead (144 bytes for this vocabulary), a longest token and a stride at
most, however long a piece is; words that are shorter are decided by their end.
Long texts are cut into chunks, inside a piece if need be: the transducer goes on with the next chunk.

Decoding. ``Decoder`` takes the ids as they are emitted and keeps only its state between them: by
default it gives the text that the library gives, in which bytes appear as the vocabulary's symbols and
tokens stand apart; with ``readable`` it turns symbols back to bytes and feeds an incremental UTF-8
machine, where the bytes of an unfinished character wait for the next id.

Defined results: a null or empty text has no ids and decodes to the empty text; special strings in a
text become their ids; unknown ids in ``Decoder`` raise ``KeyError``; repeated rows are each encoded.
No row is shuffled. What a task remembers of pieces is bounded in bytes and ends with the task.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm import bpe_vocab, common

VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's own pattern for the pieces of a normalised text (a fixed value), with the classes to fill in.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
#: Bytes that enter the transducer at a time.
STRIDE = 16
#: A text is normalised and cut to pieces in chunks of about this many characters.
CHUNK, SEEK = 1 << 18, 1 << 12


@lru_cache(maxsize=1)
def newer_characters() -> tuple[str, dict[int, str]]:
    """Where the regex module, the interpreter and the tokenizers library know different Unicode versions.

    Returns the letters and numbers of the regex module that the library doesn't know yet, and lower
    case forms of the library that the interpreter doesn't know yet.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    known = tokenizers.pre_tokenizers.Split(tokenizers.Regex(r"[^\p{L}\p{N}]"), "removed").pre_tokenize_str("".join(newer))
    known = set("".join(piece for piece, _ in known))
    lower = tokenizers.normalizers.Lowercase().normalize_str
    return "".join(c for c in newer if c not in known), {ord(c): small for c in newer if (small := lower(c)) != c}


@lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    return frozenset(map(chr, newer_characters()[1]))


def cutter():
    """A function from a normalised text to its pieces."""
    plain = lambda name: rf"\p{{{name}}}"
    later = newer_characters()[0]
    known = regex.compile(PIECES.replace("{L}", plain("L")).replace("{N}", plain("N"))).findall
    if not later:
        return known
    less = lambda name: rf"[{plain(name)}--[{later}]]"
    exact = regex.compile(PIECES.replace("{L}", less("L")).replace("{N}", less("N")), regex.V1).findall
    alien = frozenset(later).isdisjoint

    def pieces(text: str) -> list[str]:
        # set differences are slow in the regex module; only texts with such characters need them
        return known(text) if text.isascii() or alien(text) else exact(text)

    return pieces


def sufficient_lookahead(vocabulary: bpe_vocab.Vocabulary) -> dict[int, int]:
    """For each token, the bytes right of its end that decide whether it ends there for good."""
    width, id_mask, end = bpe_vocab.WIDTH, bpe_vocab.ID_MASK, vocabulary.word_end
    size = {i: max(1, len(name.removesuffix(end) if end else name)) for i, name in vocabulary.names.items()}
    made: dict[int, list[tuple[int, int]]] = defaultdict(list)
    #: For each left symbol, the ranks of its rules so far and the most that any up to there needs.
    ranks: dict[int, list[int]] = defaultdict(list)
    needs: dict[int, list[int]] = defaultdict(list)

    def needed(last: int, before: int) -> int:
        """By rules of a rank below ``before`` over a border that ``last`` ends at, or a part of it earlier on."""
        most, spine, seen = 0, [(last, before)], set()
        while spine:
            symbol, before = spine.pop()
            if (symbol, before) in seen:
                continue
            seen.add((symbol, before))
            if k := bisect_left(ranks[symbol], before):
                most = max(most, needs[symbol][k - 1])
            spine += [(part, own) for own, part in made[symbol] if own < before]
        return most

    for pair, value in sorted(vocabulary.pairs.items(), key=lambda x: x[1]):
        left, right, rank = pair >> width, pair & id_mask, value >> width
        need = size[right] + needed(right, rank)
        needs[left].append(max(need, needs[left][-1] if needs[left] else 0))
        ranks[left].append(rank)
        made[value & id_mask].append((rank, right))
    return {token: needed(token, len(vocabulary.pairs) + 1) for token in vocabulary.ids.values()}


#: Greater than any rule's value.
NO_RULE = 1 << 62


def merged(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """The tokens of one stretch of symbols."""
    n = len(symbols)
    width, id_mask, get = bpe_vocab.WIDTH, bpe_vocab.ID_MASK, pairs.get
    if n <= 48:
        # few symbols: a list of the pairs' ranks is quicker than a heap
        found = [get(a << width | b, NO_RULE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while found and (best := min(found)) < NO_RULE:
            at = found.index(best)
            symbols[at : at + 2] = [merged_symbol := best & id_mask]
            del found[at]
            if at:
                found[at - 1] = get(symbols[at - 1] << width | merged_symbol, NO_RULE)
            if at < len(found):
                found[at] = get(merged_symbol << width | symbols[at + 1], NO_RULE)
        return symbols
    heap = [found << 32 | k for k in range(n - 1) if (found := get(symbols[k] << width | symbols[k + 1])) is not None]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heapq.heappop(heap)
        at, found = entry & 0xFFFFFFFF, entry >> 32
        follows = after[at]
        if symbols[at] < 0 or follows >= n or get(symbols[at] << width | symbols[follows]) != found:
            continue
        symbols[at], symbols[follows] = found & id_mask, -1
        after[at] = beyond = after[follows]
        if beyond < n:
            before[beyond] = at
            if (found := get(symbols[at] << width | symbols[beyond])) is not None:
                heapq.heappush(heap, found << 32 | at)
        if (back := before[at]) >= 0 and (found := get(symbols[back] << width | symbols[at])) is not None:
            heapq.heappush(heap, found << 32 | back)
    return [s for s in symbols if s >= 0]


class Transducer:
    """Encodes the bytes of one piece as they come and emits every token once it is stable."""

    def __init__(self, vocabulary: bpe_vocab.Vocabulary, lookahead: dict[int, int], stride: int = STRIDE) -> None:
        self.vocabulary, self.lookahead, self.stride = vocabulary, lookahead, stride
        end = vocabulary.word_end
        self.sizes = {i: len(n.removesuffix(end) if end else n) for n, i in vocabulary.ids.items()}
        self.held = bytearray()

    def push(self, raw: bytes) -> list[int]:
        """Takes the piece's next bytes; gives the tokens that are stable by now."""
        out: list[int] = []
        for at in range(0, len(raw), self.stride):
            if self.held:
                # more has come: none of the held bytes is the piece's last
                out += self.settle()
            self.held += raw[at : at + self.stride]
        return out

    def settle(self) -> list[int]:
        first, taken, out = self.vocabulary.first, 0, []
        for token in merged([first[b] for b in self.held], self.vocabulary.pairs):
            ends = taken + self.sizes[token]
            if len(self.held) - ends < self.lookahead[token]:
                break
            taken = ends
            out.append(token)
        del self.held[:taken]
        return out

    def finish(self) -> list[int]:
        """The tokens of what is left at the end of the piece; ready for another piece."""
        if not self.held:
            return []
        symbols = [self.vocabulary.first[b] for b in self.held]
        symbols[-1] = self.vocabulary.last[self.held[-1]]
        self.held.clear()
        return merged(symbols, self.vocabulary.pairs)


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter; white space only separates pieces."""
    if text.isascii():
        return text.lower()
    # str.lower() knows a final sigma, the letterwise rule does not
    text, newer = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower(), newer_characters()[1]
    return text if newer_letters().isdisjoint(text) else text.translate(newer)


def pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Texts to packed ids; the ids of pieces are remembered within a bound of bytes."""

    def __init__(self, vocabulary: bpe_vocab.Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.transducer = Transducer(vocabulary, sufficient_lookahead(vocabulary))
        self.pieces = cutter()
        strings = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.known = common.Memory(self.piece)

    def piece(self, piece: str) -> bytes:
        return pack(self.transducer.push(piece.encode()) + self.transducer.finish())

    def encoded(self, text: str | None) -> Iterator[bytes]:
        """Packed ids, a chunk of the text at a time."""
        if not text:
            return
        special = self.vocabulary.special
        parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        for part in parts:
            if part in special:
                yield pack([special[part]])
            else:
                yield from self.stretch(part)

    def stretch(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text without special strings; pieces that go on over a cut stay in the transducer."""
        within = False
        for chunk, goes_on in chunked(text):
            pieces, out = self.pieces(normalised(chunk)), []
            if within:
                out.append(pack(self.transducer.push(pieces[0].encode())))
                if goes_on and len(pieces) == 1:
                    yield out[0]
                    continue
                out.append(pack(self.transducer.finish()))
                del pieces[0]
            last = pieces.pop() if goes_on else None
            out.extend(map(self.known.__getitem__, pieces))
            if last is not None:
                out.append(pack(self.transducer.push(last.encode())))
            within = goes_on
            yield b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encoded(text)), "<u4")


#: Places inside a piece or before a number, where no composed character, contraction or other piece is cut:
#: between two ASCII letters without an apostrophe before them, two ideographs, two equal signs, before a digit.
CUTS = regex.compile(r"(?<=(?<!'..|'.|')[A-Za-z])(?=[A-Za-z])|(?<=[\u4E00-\u9FFF])(?=[\u4E00-\u9FFF])|(?<=([!-&(-/:-@\[-`{-~]))(?=\1)|(?<=[ -~])(?=[0-9])")


def chunked(text: str, size: int = CHUNK, seek: int = SEEK) -> Iterator[tuple[str, bool]]:
    """Chunks of a text, and whether a chunk's last piece goes on in the next one.

    Cuts at white space, which no piece and no composed character spans, if some is near; otherwise at
    the first safe place.
    """
    at = 0
    while len(text) - at > size:
        cut = next((k for k in range(at + size, min(len(text), at + size + seek)) if text[k] in " \t\n\r"), None)
        if cut is None:
            found = CUTS.search(text, at + size)
            if found is None:
                break
            cut = found.start()
        yield text[at:cut], text[cut] not in " \t\n\r0123456789"
        at = cut
    yield text[at:], False


class Decoder:
    """Ids to text as they come; nothing but the state between two ids is held."""

    def __init__(self, vocabulary: bpe_vocab.Vocabulary, readable: bool = False) -> None:
        self.names, self.special, self.end = vocabulary.names, set(vocabulary.special.values()), vocabulary.word_end
        self.readable, self.begun = readable, False
        self.byte = {s: b for b, s in enumerate(bpe_vocab.byte_symbols())}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids add."""
        if self.readable:
            return "".join(map(self.whole_characters, ids))
        shown = " ".join(map(self.names.__getitem__, ids))
        gap = " " if self.begun and shown else ""
        self.begun |= bool(shown)
        return gap + shown

    def whole_characters(self, token: int) -> str:
        name = self.names[token]
        if token in self.special:
            return self.machine.decode(b"", True) + name
        ends = bool(self.end) and name.endswith(self.end)
        raw = bytes(self.byte[c] for c in (name[: -len(self.end)] if ends else name))
        return self.machine.decode(raw) + (self.machine.decode(b"", True) + " " if ends else "")

    def close(self) -> str:
        """What an unfinished character leaves."""
        return self.machine.decode(b"", True)


def decode(vocabulary: bpe_vocab.Vocabulary, ids: Iterable[int], readable: bool = False) -> str:
    machine = Decoder(vocabulary, readable)
    return machine.feed(map(int, ids)) + machine.close()


def with_ids(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Appends ``token_ids`` and ``decoded``, the readable text of the ids."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe_vocab.read(path or public_tokenizers.path(VOCABULARY)))

    def make():
        own = Encoder(bpe_vocab.parse(sent.value))

        def run(texts: list) -> list[list]:
            ids = [own.ids(t).tolist() for t in texts]
            return [ids, [decode(own.vocabulary, x, readable=True) for x in ids]]

        return run

    return common.map_text(docs, make, [common.field("token_ids", T.ArrayType(T.LongType())), common.field("decoded", T.StringType())], text)


def with_digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Appends the number of ids and the digests of the ids and of the text that the decoder makes of them.

    Both go on a chunk at a time, so neither ids nor decoded text of a long document are held.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bpe_vocab.read(path or public_tokenizers.path(VOCABULARY)))

    def make():
        own = Encoder(bpe_vocab.parse(sent.value))

        def digests(text: str | None) -> tuple[int, str, str]:
            n, ids_hash, text_hash, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(own.vocabulary)
            for packed in own.encoded(text):
                ids = np.frombuffer(packed, "<u4").tolist()
                n += len(ids)
                ids_hash.update(packed)
                text_hash.update(machine.feed(ids).encode())
            text_hash.update(machine.close().encode())
            return n, ids_hash.hexdigest(), text_hash.hexdigest()

        return lambda texts: list(zip(*map(digests, texts), strict=True)) or [(), (), ()]

    return common.map_text(docs, make, [common.field("n_tokens", T.LongType()), common.field("ids_sha256", T.StringType()), common.field("decoded_sha256", T.StringType())], text)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(common.documents(spark, sf_dir)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_bpe_codec": op7_bpe_codec}
ORACLE_SQL: dict[str, str] = {}
