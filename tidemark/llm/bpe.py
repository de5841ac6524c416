"""Byte-level BPE encoding and decoding with a transducer lexicon.

Frequent words of the corpus are compiled into a minimal acyclic transducer: equal suffixes share states, every arc
carries the number of words that sort before it, and the sum along a path is the word's place in the id table.  The
flat file is sent to executors by Spark, memory-mapped there and walked once per distinct word; a word that the
lexicon does not know is merged by rank, exactly as the tokenizer would.

Cases: a null text counts as empty and has no ids; texts of any length are cut into words by one pass; strings of
added tokens in a text become those tokens; repeated rows are encoded each on its own; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import held, send, ship_package, table

#: Words of a byte-level tokenizer (fixed value); White_Space is spelled out because Python's \s holds more.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: The same words for texts of Latin characters only, in the faster standard module.
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
LATIN = re.compile("[\0-ʯ]*")
LATIN_WORDS = re.compile(f" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")

#: Most words in the lexicon, and how often a task must have met a word to put it forward.
LEXICON_WORDS = 65536
TASK_MINIMUM = 4
MEMO_WORDS = 250_000
LONG_TEXT = 4_000_000
ROWS_OUT = 256


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


class Merges:
    """Ids and merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without prefix space or normalizer is needed")
        vocab, shown = model["vocab"], byte_characters()
        self.of_byte = [vocab[c] for c in shown]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        back = {c: b for b, c in enumerate(shown)}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in added}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked pair is merged first, the leftmost of equals."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank_of, made = self.ranks.get, self.made
        none = len(made)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            new = ids[k] = made[best]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of((new, ids[k + 1]), none)
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], new), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(ranks[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, k, pair = heapq.heappop(heap)
            right = after[k]
            if right < 0 or ids[k] < 0 or (ids[k], ids[right]) != pair:
                continue
            ids[k], ids[right] = self.made[rank], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left, here in ((before[k], k), (k, after[k])):
                if left >= 0 and here >= 0 and (p := (ids[left], ids[here])) in ranks:
                    heapq.heappush(heap, (ranks[p], left, p))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer over ``words`` as one flat int32 file.

    Sorted words are added one by one and finished branches are folded into equal ones already held, so suffixes
    are shared.  Layout: sizes; per state its base and whether a word ends there; per slot its owner, the target and
    the output; the id table's offsets and ids.
    """
    ordered = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_states: list[list] = [[False, []]]

    def fold(down_to: int) -> None:
        while len(open_states) > down_to:
            final, arcs = open_states.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(finished)
                finished.append(key)
            if open_states:
                label = open_states[-1][1][-1][0]
                open_states[-1][1][-1] = (label, register[key])

    last = b""
    for w in ordered:
        common = len(os.path.commonprefix([last, w]))
        fold(common + 1)
        for b in w[common:]:
            open_states[-1][1].append((b, -1))
            open_states.append([False, []])
        open_states[-1][0] = True
        last = w
    fold(0)
    accepted = []
    for final, arcs in finished:
        accepted.append(final + sum(accepted[t] for _, t in arcs))
    # Arcs are laid out by row displacement: the arc of state s for byte b lies at base[s] + b and names s as its owner.
    base, ends = [0] * len(finished), [int(final) for final, _ in finished]
    owner, target, output, lowest, dense = [-1] * 256, [0] * 256, [0] * 256, 256, 256
    for state in sorted(range(len(finished)), key=lambda s: -len(finished[s][1])):
        arcs = finished[state][1]
        if not arcs:
            continue
        while lowest < len(owner) and owner[lowest] >= 0:
            lowest += 1
        at = tried = max(lowest, dense if len(arcs) > 1 else 0) - arcs[0][0]
        while any(at + b < len(owner) and owner[at + b] >= 0 for b, _ in arcs):
            at += 1
        if at - tried > 32:  # crowded up to here: states with several arcs go on from this place
            dense = at + arcs[0][0] if len(arcs) > 1 else dense
        grown = at + 256 - len(owner)
        owner += [-1] * grown
        target += [0] * grown
        output += [0] * grown
        base[state], before = at, ends[state]
        for b, t in arcs:
            owner[at + b], target[at + b], output[at + b] = state, t, before
            before += accepted[t]
    offsets = np.cumsum([0, *(len(words[w]) for w in ordered)])
    ids = [i for w in ordered for i in words[w]]
    sizes = [len(finished), len(owner), len(ordered), len(ids)]
    return np.concatenate([np.asarray(x, dtype=np.int32) for x in (sizes, base, ends, owner, target, output, offsets, ids)]).tobytes()


class Lexicon:
    """A compiled lexicon, read in place from its memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            held = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("i")
        states, slots, words, ids = held[:4]
        at = 4
        parts = []
        for n in (states, states, slots, slots, slots, words + 1, ids):
            parts.append(held[at : at + n])
            at += n
        self.base, self.ends, self.owner, self.target, self.output, self.offsets, self.ids = parts
        self.root = states - 1

    def get(self, word: bytes) -> list[int] | None:
        state, place = self.root, 0
        base, owner, target, output = self.base, self.owner, self.target, self.output
        for b in word:
            at = base[state] + b
            if owner[at] != state:
                return None
            place += output[at]
            state = target[at]
        if not self.ends[state]:
            return None
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()


class Encoder:
    """Encodes whole texts; keeps the ids of recent words, at most MEMO_WORDS of them."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        import regex

        self.merges, self.lexicon = merges, lexicon
        self.words = regex.compile(WORDS)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(merges.added, key=len, reverse=True)) + ")") if merges.added else None
        self.memo: dict[str, bytes] = {}

    def find(self, text: str) -> list[str]:
        return (LATIN_WORDS if LATIN.fullmatch(text) else self.words).findall(text)

    def _packed(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon else None
        packed = array("i", self.merges.merge(raw) if ids is None else ids).tobytes()
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) < 64:
            self.memo[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if len(text) < LONG_TEXT:
            found = self.find(text)
            get, packed = self.memo.get, self._packed
            return b"".join([get(w) or packed(w) for w in found])
        out = bytearray()
        for m in self.words.finditer(text):
            w = m.group()
            out += self.memo.get(w) or self._packed(w)
        return bytes(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.split is None or not any(t in text for t in self.merges.added):
            return np.frombuffer(self._plain(text), dtype=np.int32)
        parts = [np.asarray([self.merges.added[p]], dtype=np.int32).tobytes() if p in self.merges.added else self._plain(p) for p in self.split.split(text) if p]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids) -> str:
        of = self.merges.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", errors="replace")


def _encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    def made() -> Encoder:
        return Encoder(Merges(Path(SparkFiles.get(tokenizer)).read_text()), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)

    return held(("bpe", tokenizer, lexicon), made)


def frequent_words(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The corpus's most frequent words, at most ``limit``; each task puts forward the words it met often."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, None)
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if n >= TASK_MINIMUM and len(w) < 64]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                if (value := t.as_py()) and len(value) < LONG_TEXT:
                    seen.update(encoder.find(value))
                elif value:
                    seen.update(m.group() for m in encoder.words.finditer(value))
                if len(seen) > 4 * MEMO_WORDS:
                    yield flush()
        yield flush()

    counts = docs.select(text).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(limit).collect()]


def prepare(docs: DataFrame, tokenizer_path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> tuple[str, str | None]:
    """Send the tokenizer and the corpus's compiled lexicon to the executors; their names there."""
    spark = docs.sparkSession
    ship_package(spark)
    content = Path(tokenizer_path).read_bytes()
    tokenizer = send(spark, content, "tokenizer")
    words = frequent_words(docs, tokenizer, text, lexicon_words)
    merges = Merges(content.decode())
    lexicon = compile_lexicon({w.encode(): merges.merge(w.encode()) for w in words})
    return tokenizer, send(spark, lexicon, "lexicon") if words else None


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>) and, if ``decoded`` is named, the text that these ids decode to.

    Columns of ``docs`` that already have these names are replaced.
    """
    tokenizer, lexicon = prepare(docs, tokenizer_path, text, lexicon_words)
    docs = docs.drop(*[c for c in (ids, decoded) if c and c != text])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, lexicon)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                found = [encoder.encode(t.as_py()) for t in batch.column(at)]
                offsets = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
                values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)]
                if decoded:
                    columns.append(pa.array([encoder.decode(x.tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(encoded, schema)


def decode_documents(tokens: DataFrame, tokenizer_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the column ``ids``; a null list decodes to the empty text."""
    spark = tokens.sparkSession
    ship_package(spark)
    tokenizer = send(spark, Path(tokenizer_path).read_bytes(), "tokenizer")
    tokens = tokens.drop(text)
    at = tokens.columns.index(ids)
    schema = T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())])

    def decoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, None)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                texts = pa.array([encoder.decode(x.as_py() or ()) for x in batch.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return tokens.mapInArrow(decoding, schema)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> list:
    """The columns that sum up encoded documents: counts and digests of ids and decoded text."""
    return [
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, tokenizer_file(), decoded="decoded")
    return encoded.select("doc_id", *digests(encoded))
