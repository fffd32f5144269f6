"""BPE by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Where the vocabulary is; a parameter of every function that reads it.
TOKENIZER = os.environ.get("TIDEMARK_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")
#: Pieces of text, and pair verdicts, in one generation of what a Python worker remembers; it keeps two.
REMEMBERED, PAIRS = 120_000, 200_000
#: Stands for the word end within token texts while they are matched; no byte maps to it.
_END = "\n"


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _unassigned() -> str:
    """Code points that the regex module counts as letters or numbers but Python's Unicode tables, like the
    library's, don't know yet: as the inside of a character class."""
    newer = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn"))
    runs: list[list[int]] = []
    for c in map(ord, newer):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def tables(path: str) -> dict:
    """What encoding and decoding need of a ``tokenizers`` BPE file, as plain data for a broadcast (bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if newer := _unassigned():
        split = split.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[[\p{{L}}\p{{N}}]--[{newer}]]]")
        split = split.replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{newer}]]")
    return {
        "name": hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest(),
        "vocab": model["vocab"],
        "merges": merges,
        "suffix": model["end_of_word_suffix"] or "",
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "split": split,
    }


class Memory(dict):
    """A bounded memory: once it holds ``most`` entries they become the older generation, and return when they are asked for."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def again(self, key):
        """An entry of the older generation, now in this one too; None if there is none."""
        found = self.older.get(key)
        if found is not None:
            self[key] = found
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Encoder:
    """Encodes one text at a time; made once in each Python worker."""

    def __init__(self, spec: dict):
        suffix = spec["suffix"]

        def inner(token: str) -> str:
            return token[: -len(suffix)] + _END if suffix and token.endswith(suffix) else token

        self.ids = {inner(t): i for t, i in spec["vocab"].items()}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.lengths = {i: len(t) for t, i in self.ids.items()}
        # How a token comes about: its rank, and the tokens it is merged from.
        self.rank, self.parts, self.merged = {}, {}, {}
        for rank, (left, right) in enumerate(spec["merges"]):
            a, b = spec["vocab"][left], spec["vocab"][right]
            c = spec["vocab"][left + right]
            self.merged.setdefault((a, b), (rank, c))
            if c not in self.parts:
                self.rank[c], self.parts[c] = rank, (a, b)
        self.shorter = {i: self._prefix(t) for t, i in self.ids.items()}
        self.letters = {b: letter for b, letter in enumerate(_byte_letters())}
        self.special = spec["special"]
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.split = regex.compile(spec["split"], regex.V1)
        self.spaces = regex.compile(r"\s+")
        self.edges: tuple[dict, dict] = {}, {}
        self.words, self.known, self.pairs = Memory(REMEMBERED), Memory(REMEMBERED), Memory(PAIRS)

    def _prefix(self, text: str) -> int | None:
        """The longest token that is a proper prefix of a token."""
        return next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), None)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge while ``token`` forms, outermost first, each with the rank of the merge that uses it up."""
        out = self.edges[side].get(token)
        if out is None:
            first, out, until = token, [], float("inf")
            while True:
                out.append((token, until))
                if token not in self.parts:
                    break
                until = self.rank[token]
                token = self.parts[token][side]
            self.edges[side][first] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps two neighbouring tokens apart.

        Along the seam, the right edge of the left token and the left edge of the right one grow by merges of rising rank.
        They stay apart unless a pair of edge tokens that exist at one time has a merge across the seam whose turn comes
        before either is used up; at equal rank the leftmost goes first.
        """
        key = left << 32 | right
        known = self.pairs.again(key)
        if known is None:
            a, b = self._edge(left, 1), self._edge(right, 0)
            i, j, known = len(a) - 1, len(b) - 1, True
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                across = self.merged.get((x, y))
                if across and across[0] < x_until and across[0] <= y_until:
                    known = False
                    break
                if not i and not j:
                    break
                if j == 0 or (i and x_until <= y_until):
                    i -= 1
                else:
                    j -= 1
            self.pairs.keep(key, known)
        return known

    def piece(self, text: str) -> list[int]:
        """The ids of one word piece, given as byte letters closed by the word end."""
        n = len(text)
        longest: list[int | None] = [None] * n
        for end, (token, length) in self.automaton.iter(text):
            longest[end - length + 1] = token  # later ends are longer matches
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], None
        while at < n:
            while token is not None:
                end = at + lengths[token]
                if not dead[end]:
                    if last is None:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                last, at = token, end
                token = longest[at] if at < n else None
            elif out:
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else None
                at -= lengths[token]
            else:
                raise ValueError(f"no tokens for {text!r}")
        return out

    def _word(self, word: str) -> list[int]:
        found = self.words.get(word) or self.words.again(word)
        if found is None:
            found = self.piece(word.encode().decode("latin-1").translate(self.letters) + _END)
            if len(word) < 64:
                self.words.keep(word, found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        """The ids, as 32-bit integers, of a text without special tokens and without a blank at a place that counts."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            ids = self._word(text)
        elif text[:-1].isalpha() and text[-1:] in ".,;:!?":
            ids = self._word(text[:-1]) + self._word(text[-1])
        else:
            ids = [i for word in self.split.findall(self.spaces.sub(" ", text)) for i in self._word(word)]
        return array("i", ids).tobytes()

    def plain(self, text: str, out: list[bytes]) -> None:
        """Append the ids of a text without special tokens. Word pieces never cross a blank, so what stands between blanks
        is encoded by itself, and remembered."""
        known = self.known
        chunks = text.replace("\n", " ").split(" ")
        found = list(map(known.get, chunks))
        for i, ids in enumerate(found):
            if ids is None:
                chunk = chunks[i]
                ids = known.get(chunk)
                if ids is None:
                    ids = known.again(chunk)
                if ids is None:
                    ids = self._chunk(chunk)
                    if len(chunk) < 64:
                        known.keep(chunk, ids)
                found[i] = ids
        out += found

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        if any(t in text for t in self.special):
            at = 0
            for match in self.special_pattern.finditer(text):
                self.plain(text[at : match.start()], out)
                out.append(array("i", [self.special[match[0]]]).tobytes())
                at = match.end()
            text = text[at:]
        self.plain(text, out)
        return np.frombuffer(b"".join(out), np.int32)


class Slices:
    """Texts in one byte string, with the offset at which each begins; numbers copy their slices out of it."""

    def __init__(self, texts: list[str]):
        parts = [f"{t} ".encode() for t in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in parts])])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        """The texts of some numbers joined by one space, in UTF-8; part by part, for very long lists."""
        out = []
        for at in range(0, len(numbers), 65536):
            some = numbers[at : at + 65536].astype(np.int64)
            starts, sizes = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)].tobytes())
        return b"".join(out)[:-1]


class Decoder:
    """Token texts, and the ids in decimal, in offset tables."""

    def __init__(self, spec: dict):
        tokens = {i: t for t, i in spec["vocab"].items()} | {i: t for t, i in spec["special"].items()}
        self.texts = Slices([tokens.get(i, "") for i in range(max(tokens) + 1)])
        self.decimals = Slices([str(i) for i in range(max(tokens) + 1)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.texts.joined(ids)

    def digest(self, ids: np.ndarray) -> str:
        """The SHA-256 of the ids in decimal, joined by one space."""
        return hashlib.sha256(self.decimals.joined(ids)).hexdigest()


#: The encoder and decoder of a file, by its hash, kept between the tasks of one Python worker.
_MADE: dict[str, tuple[Encoder, Decoder]] = {}


def _made(spec: dict) -> tuple[Encoder, Decoder]:
    if spec["name"] not in _MADE:
        _MADE.clear()
        _MADE[spec["name"]] = Encoder(spec), Decoder(spec)
    return _MADE[spec["name"]]


def encode(docs: DataFrame, path: str = TOKENIZER, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the column ``to``: the token ids (array of int) of each whole text.

    As the tokenizers library encodes with the file at ``path``, without adding special tokens: special
    token strings in the text are special tokens. Null and empty texts give an empty array. The file is
    read on the driver and broadcast; rows stay where they are, in their order, with all their columns; a column ``to``
    that is there already is replaced.
    """
    docs = docs.drop(to)
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches):
        encoder, _ = _made(shared.value)
        for batch in batches:
            found = [encoder.encode(x.as_py() or "") for x in batch.column(text)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, to])

    schema = docs.select("*", F.lit(None).cast("array<int>").alias(to)).schema
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str = TOKENIZER, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the column ``to``: the text of the token ids, as the library's decode gives it with special tokens kept.

    Null and empty arrays give an empty text; a column ``to`` that is there already is replaced.
    """
    docs = docs.drop(to)
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches):
        _, decoder = _made(shared.value)
        for batch in batches:
            column = batch.column(ids)
            found = [decoder.decode(x.values.to_numpy()) if x.is_valid and len(x) else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()).cast(pa.string())], [*batch.schema.names, to])

    schema = docs.select("*", F.lit("").alias(to)).schema
    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str = TOKENIZER, chunk: int = 512) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode every text, keeping digests only.

    The same encoder and decoder as ``encode`` and ``decode`` in one pass over Arrow batches of bounded row count, so
    neither ids nor decoded texts travel.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches):
        encoder, decoder = _made(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                counts, ids_hash, text_hash = [], [], []
                for x in batch.column(1):
                    ids = encoder.encode(x.as_py() or "")
                    counts.append(len(ids))
                    ids_hash.append(decoder.digest(ids))
                    text_hash.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, keep: list[str], path: str = TOKENIZER, chunk: int = 512) -> DataFrame:
    """The columns ``keep`` of ``docs``, and n_tokens, ids (array of int) and decoded_sha256 of each whole text.

    One pass over Arrow batches in chunks of bounded row count; null and empty texts have no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))

    def run(batches):
        encoder, decoder = _made(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                found = [encoder.encode(x.as_py() or "") for x in batch.column("text")]
                hashes = [hashlib.sha256(decoder.decode(x)).hexdigest() for x in found]
                sizes = np.array([len(x) for x in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(sizes), ids, pa.array(hashes)], [*keep, "n_tokens", "ids", "decoded_sha256"]
                )

    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("array<int>").alias("ids"), F.lit("").alias("decoded_sha256")).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
