"""SentencePiece BPE encoding by backtracking, and decoding.

A sequence of pieces is the BPE encoding of a text if each two neighbours are the encoding of their own concatenation.
So the encoder needs no merge queue.  An Aho-Corasick automaton gives the longest piece that starts at each position.
From left to right the longest piece is taken that is compatible with its predecessor, which is checked by merging the
two anew; when no prefix of it is, the position is marked as failed in a bitfield and the last piece is taken back.
Every position fails at most once, so the work is linear in the length of the text.

White space is a mark at the start of pieces only, and no piece has a line feed, so a text falls into chunks (marks,
then other characters) that no merge crosses; encodings of short chunks are remembered, up to a bound.

Models: merge type, identity normalisation, a dummy prefix, white space kept, byte fallback.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.words import release, slices

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Chunks of up to so many characters are remembered, twice so many of them at most: about 100 MB in each worker.
SHORT, REMEMBERED = 48, 200_000
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: So many verdicts on pairs of pieces are remembered.
PAIRS = 1 << 18


class Codec:
    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.id_of: dict[str, int] = {}
        self.bytes_of: dict[int, int] = {}
        self.control: set[int] = set()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.bytes_of[i] = int(p[3:5], 16)
            elif sp.is_control(i):
                self.control.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                self.id_of[p] = i
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id_of) or sp.encode_as_pieces("ﬁ  A ") != sp.encode_as_pieces("ﬁ") + sp.encode_as_pieces(" A "):
            raise ValueError("the model's normalisation is not supported")
        self.beside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}  # pairs of characters that stand in a piece
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.parts: dict[str, tuple[str, str]] = {}  # what a piece was merged of
        whole = {p for p in self.id_of if len(p) == 1 or self.merged(p, self.parts) == [p]}  # others are no text's encoding
        # a merge never comes after one that scores less, if no piece scores more than its parts
        self.ordered = all(self.score[p] <= min(self.score.get(x, 0.0) if len(x) > 1 else 0.0 for x in ab) for p, ab in self.parts.items())
        self.shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            if len(p) > 1:
                self.automaton.add_word(p, (len(p) - 1, p))
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in whole), p[:1])
        self.automaton.make_automaton()
        self.verdicts: dict[str, dict[str, bool]] = {}
        self.n_verdicts = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.digits = [str(i) for i in range(n)]
        # text of each id as it stands in decoded texts; bytes from 0x80 on and special ids are not plain
        self.plain = [p.replace(MARK, " ") for p in self.piece]
        for i, b in self.bytes_of.items():
            self.plain[i] = chr(b)
        self.special = {i for i, b in self.bytes_of.items() if b >= 0x80} | self.control | {self.unk}

    def merged(self, text: str, parts: dict | None = None) -> list[str]:
        """The merges of BPE on a short text, best score first, the leftmost of equals.  parts: gets the last merge of a
        text that becomes one piece."""
        s, score, last = list(text), self.score, None
        while len(s) > 1:
            best, at = None, 0
            for k in range(len(s) - 1):
                x = score.get(s[k] + s[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                break
            last = (s[at], s[at + 1])
            s[at : at + 2] = [s[at] + s[at + 1]]
        if parts is not None and len(s) == 1 and last:
            parts[text] = last
        return s

    def compatible(self, left: str, right: str) -> bool:
        """Is left, right the encoding of the two together?  Re-merges what meets at the border, from the last merge
        back: a merge across it that scores more than the one undone would have come first."""
        if not self.ordered:
            return self.merged(left + right) == [left, right]
        score, parts, a, b, limit = self.score, self.parts, left, right, float("-inf")
        while True:
            across = score.get(a + b)
            if across is not None and across > limit:
                return False
            if across is not None and across == limit:  # the leftmost of equals comes first: merge all anew
                return self.merged(left + right) == [left, right]
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and score[a] < score[b]):
                limit, a = score[a], x[1]
            elif x is not None and score[a] == score[b]:
                return self.merged(left + right) == [left, right]
            else:
                limit, b = score[b], y[0]

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text; a character without a piece stands for itself."""
        n = len(text)
        longest = list(text)
        for end, (before, p) in self.automaton.iter(text):  # of those that start at a place the longest comes last
            longest[end - before] = p
        out: list[str] = []
        if not n:
            return out
        verdicts, shorter = self.verdicts, self.shorter
        failed: bytearray | None = None  # a bit for each position, from the first failure on
        pos, token = 0, longest[0]
        after: dict[str, bool] | None = None  # verdicts on what may follow the last piece; None: anything
        while True:
            end = pos + len(token)
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                if after is None:
                    fits = True
                else:
                    fits = after.get(token)
                    if fits is None:
                        fits = self.check(out[-1], token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    after = verdicts.get(token)
                    if after is None:
                        after = verdicts[token] = {}
                    pos, token = end, longest[end]
                    continue
            if len(token) > 1:
                token = shorter[token]
                continue
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[pos >> 3] |= 1 << (pos & 7)  # no encoding of the text so far ends here
            token = out.pop()
            pos -= len(token)
            after = verdicts.setdefault(out[-1], {}) if out else None

    def check(self, left: str, right: str) -> bool:
        """The remembered verdict on a pair."""
        if self.n_verdicts >= PAIRS:
            self.verdicts.clear()
            self.n_verdicts = 0
        self.n_verdicts += 1
        fits = self.verdicts.setdefault(left, {})[right] = self.compatible(left, right)
        return fits

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        pieces = self.backtrack(chunk)
        try:
            return tuple(map(self.id_of.__getitem__, pieces))
        except KeyError:  # characters without a piece
            out: list[int] = []
            for p in pieces:
                if p in self.id_of:
                    out.append(self.id_of[p])
                else:
                    out += [self.byte_id[b] for b in p.encode()] if self.byte_id else [self.unk]
            return tuple(out)

    def _learn(self, chunk: str) -> tuple[int, ...]:
        """The ids of a chunk that is not known.  The remembered ones are in two generations, of which the older goes.

        Where no piece has two neighbouring characters side by side no merge crosses, so symbols behind a word are
        mostly encoded by themselves, and the word is a chunk that is likelier to be known."""
        ids = self.older.get(chunk)
        if ids is None:
            stem = chunk.rstrip(SIGNS)
            k = len(stem)
            if 0 < k < len(chunk) and chunk[k - 1 : k + 1] not in self.beside:
                return (self.known.get(stem) or self._learn(stem)) + (self.known.get(chunk[k:]) or self._learn(chunk[k:]))
            ids = self.chunk_ids(chunk)
        if len(chunk) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts: list[tuple[int, ...]] = []
        lines = text.split("\n")
        for k, line in enumerate(lines):
            line = line if k else MARK + line  # the dummy prefix
            if "  " in line or line[-1:] == " " or MARK in line[1:]:
                chunks = CHUNKS.findall(line.replace(" ", MARK))
            elif line:
                chunks = line.replace(" ", " " + MARK).split(" ")
                if not chunks[0]:
                    del chunks[0]
                if chunks[0] == MARK and len(chunks) > 1:  # the dummy prefix and a space
                    chunks[:2] = [MARK + chunks[1]]
            else:
                chunks = []
            if k:
                chunks.insert(0, "\n")
            ids = list(map(self.known.get, chunks))
            if None in ids:
                ids = [self._learn(c) if x is None else x for c, x in zip(chunks, ids)]
            parts += ids
        return list(chain.from_iterable(parts))

    def joined(self, ids: list[int]) -> str:
        """The decimal ids, joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the dummy prefix goes, byte ids are read as UTF-8 (a wrong byte is U+FFFD), control ids are
        empty and the unknown id is a double question mark."""
        if not ids:
            return ""
        if ids[0] not in self.bytes_of and self.special.isdisjoint(ids):
            text = "".join([self.plain[i] for i in ids])
            return text[1:] if self.piece[ids[0]].startswith(MARK) else text
        out: list[str] = []
        raw = bytearray()
        start = True
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                raw.clear()
            start = start and not any(out)
            if i in self.control:
                continue
            if i == self.unk:
                out.append(" ⁇ ")
                continue
            text = self.plain[i]
            if start and self.piece[i].startswith(MARK):
                text, start = text[1:], False
            out.append(text)
        out.append(utf8(bytes(raw)))
        return "".join(out)


def utf8(raw: bytes) -> str:
    """``raw`` as text; of a wrong sequence each byte is one U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        try:
            out.append(raw[k:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[k : k + e.start].decode() + "�")
            k += e.start + 1
    return "".join(out)


@lru_cache(4)
def codec(model_file: str) -> Codec:
    """The codec of a model file, made once for each Python worker."""
    return Codec(model_file)


def _mapped(df: DataFrame, col: str, kind: str, out: str, schema: T.DataType, make) -> DataFrame:
    """``df`` with the column ``out`` (in place of one of that name) made of ``col``, a batch at a time."""
    keep = [c for c in df.columns if c != out]
    src = df.select(*(df[c] for c in keep), df[col].cast(kind).alias("__in"))

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], make(b.column(len(keep)).to_pylist())], [*keep, out])
        release()

    return src.mapInArrow(run, T.StructType([*df.select(*keep).schema.fields, T.StructField(out, schema)]))


def encode(df: DataFrame, model_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text, as the sentencepiece library gives them without begin or end ids.
    Null and empty texts have no ids.  A column named ``out`` is replaced."""

    def make(texts):
        c = codec(model_file)
        return pa.array([c.encode(t or "") for t in texts], pa.list_(pa.int32()))

    return _mapped(df, text, "string", out, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of ids; null ids decode to the empty text."""

    def make(arrays):
        c = codec(model_file)
        return pa.array([c.decode(x or []) for x in arrays], pa.string())

    return _mapped(df, ids, "array<int>", out, T.StringType(), make)


def round_trip(df: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 for each row of ``df``; a null
    text counts as empty, a repeated row gives repeated rows, an empty table none.

    Texts are encoded and their ids decoded in one task, a few hundred at a time; only digests go back.
    """
    src = df.select(df[id_col].alias("doc_id"), df[text].cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256"))])

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        c = codec(model_file)
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(sha(c.joined(ids)))
                text_sha.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema.names)
        release()

    return src.mapInArrow(run, schema)
