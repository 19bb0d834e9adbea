"""Operator 6: BPE encoding and decoding with tree concatenation of long unsplit text.

Text is cut where the tokenizer itself cuts it (white space, then its split pattern). A piece without a cut that is longer
than a leaf is halved until leaves remain; leaves are encoded on their own and joined pairwise up the tree. At each join a
window of tokens on both sides is encoded again and grows until its first token agrees with the left side and its last
with the right side: then every adjacent pair of tokens is one that the merges leave alone, so the whole is the encoding.

Texts of at least ``piece_chars`` that hold an unsplit stretch of that length go through a second path, where the leaves of one
text are rows that different tasks encode, and the joins run once they are together again.

A null text counts as empty: no ids, empty decoded text. Repeated rows give repeated results; an empty table gives an empty
result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.common import map_texts, small_batches, table

#: Symbols of a leaf of the tree.
LEAF = 256
#: Tokens on each side of a join that are encoded again at first.
WINDOW = 4
#: Entries of the caches of white-space-free chunks and of words. A full cache stays as it is until eight times as many chunks were missed, and is then emptied.
CACHE = 250_000

#: The tokenizer's white space where Python's differs: without \x1c-\x1f.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_OWN_SPACE = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBPE:
    """A byte-level BPE with word ends, from a tokenizers file. encode() and decode() equal the library's."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = self._shape(spec)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.window = leaf, window
        self.end = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        self.vocab = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes = byte_symbols()
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._split = None
        self._cache: dict[str, tuple[bytes, str]] = {}
        self._words: dict[str, tuple[bytes, str]] = {}
        self._missed = 0

    @staticmethod
    def _shape(spec: dict) -> str:
        """The split pattern of a file whose other settings are those that this class follows; any other file is an error."""
        norm, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
        good = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        good = good and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and (cuts[0].get("behavior"), cuts[0].get("invert")) == ("Removed", True) and "Regex" in cuts[0]["pattern"]
        good = good and not cuts[1].get("add_prefix_space") and cuts[1].get("use_regex") is False
        good = good and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        good = good and not spec.get("post_processor") and not spec.get("decoder") and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        if not good or any(t["content"][:2] != "<|" for t in spec["added_tokens"]):
            raise ValueError("not a lower-casing byte-level BPE file whose pattern removes what it doesn't match")
        return cuts[0]["pattern"]["Regex"]

    # one stretch of symbols

    def merge(self, ids: list[int]) -> list[int]:
        """The merges applied to a sequence of initial symbols, lowest rank first, leftmost among equals."""
        n = len(ids)
        if n < 2:
            return list(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((new, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def symbols(self, word: str) -> list[int]:
        """Ids of the initial symbols of a whole word, the last one with the word end."""
        mapped = [self.bytes[b] for b in word.encode()]
        mapped[-1] += self.end
        return [self.vocab[s] for s in mapped]

    def unmerge(self, ids: list[int]) -> list[int]:
        """Ids of the initial symbols that tokens stand for."""
        out = []
        for i in ids:
            name = self.names[i]
            if self.end and name.endswith(self.end) and len(name) > len(self.end):
                body = name[: -len(self.end)]
                out += [self.vocab[c] for c in body[:-1]]
                out.append(self.vocab[body[-1] + self.end])
            else:
                out += [self.vocab[c] for c in name]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded stretches put together."""
        if not left or not right:
            return left + right
        a = b = self.window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            mid = self.merge(self.unmerge(left[-a:] + right[:b]))
            left_agrees = a == len(left) or mid[0] == left[-a]
            right_agrees = b == len(right) or mid[-1] == right[b - 1]
            if left_agrees and right_agrees:
                return left[:-a] + mid + right[b:]
            a, b = (a if left_agrees else 2 * a), (b if right_agrees else 2 * b)

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Encoded neighbours joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode_word(self, word: str) -> list[int]:
        symbols = self.symbols(word)
        n = len(symbols)
        if n <= self.leaf:
            return self.merge(symbols)
        return self.join_all([self.merge(symbols[i : i + self.leaf]) for i in range(0, n, self.leaf)])

    # chunks and texts

    def words(self, chunk: str) -> list[str]:
        """The tokenizer's words of a chunk without white space, normalized."""
        if not chunk or max(chunk) < "ɐ" and not _OWN_SPACE.search(chunk):
            if self._split is None:
                import regex

                self._split = regex.compile(self.pattern)
            return self._split.findall(unicodedata.normalize("NFC", chunk).lower())
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))
        back = {c: b for b, c in enumerate(self.bytes)}
        return [bytes(back[c] for c in p).decode() for p, _ in pieces]

    def word(self, word: str) -> tuple[bytes, str]:
        got = self._words.get(word)
        if got is None:
            if len(word) <= self.leaf // 4:  # a leaf of its own
                ids = [t.id for t in self.tok.model.tokenize("".join([self.bytes[b] for b in word.encode()]))]
            else:
                ids = self.encode_word(word)
            got = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])
            if len(self._words) < CACHE and len(word) <= 64:
                self._words[word] = got
        return got

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as little-endian uint32 and the token strings with blanks between, of a chunk without white space."""
        got = self._cache.get(chunk)
        if got is None:
            if (low := chunk.lower()).isalpha() and max(low) < "ɐ":
                got = self.word(low)  # letters of Latin blocks are composed already
            else:
                parts = [self.word(w) for w in self.words(chunk)]
                got = b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
            if len(self._cache) < CACHE:
                if len(chunk) <= 64:
                    self._cache[chunk] = got
            else:
                self._missed += 1
                if self._missed > 8 * CACHE:
                    self._cache, self._words, self._missed = {}, {}, 0
        return got

    def chunks(self, text: str) -> Iterator[tuple[bytes, str]]:
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield struct.pack("<I", self.special[part]), part
                continue
            cut = _SPACE.split(part) if _OWN_SPACE.search(part) else part.split()
            yield from map(self.chunk, filter(None, cut))

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian uint32, and the decoded text."""
        got = list(self.chunks(text))
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_packed(text)[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's decode() of a file without a decoder: token strings with blanks between."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """One tokenizer per worker."""
    return WordBPE(path)


OUT = "ids binary, decoded string"


def _short(docs: DataFrame, id_col: str, text_col: str, path: str, digest: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(x: dict) -> dict:
        bpe = load(path)
        got = [bpe.encode_packed(t or "") for t in x["text"]]
        if digest:
            return {"doc_id": x["doc_id"], "n_tokens": [len(a) // 4 for a, _ in got], "ids_sha256": [sha256(a).hexdigest() for a, _ in got], "decoded_sha256": [sha256(d.encode()).hexdigest() for _, d in got]}
        return {"doc_id": x["doc_id"], "ids": [a for a, _ in got], "decoded": [d for _, d in got]}

    return map_texts(docs, {"doc_id": id_col, "text": text_col}, f"doc_id {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else OUT), rows)


def _leaves(path: str, piece_chars: int):
    """Rows (text_key, seq, word, text, last) of long texts: chunks, and pieces of unsplit words with their place."""

    def run(batches):
        for b in batches:
            bpe = load(path)
            for key, text in zip(b["text_key"].to_pylist(), b["text"].to_pylist()):
                out: dict[str, list] = {"text_key": [], "seq": [], "symbols": [], "ready": []}
                small: list[bytes] = []

                def put(symbols: bytes, ready: bool) -> None:
                    for name, v in (("text_key", key), ("seq", len(out["seq"])), ("symbols", symbols), ("ready", ready)):
                        out[name].append(v)

                parts = bpe._special.split(text) if "<|" in text else [text]
                for k, part in enumerate(parts):
                    if k % 2:
                        small.append(struct.pack("<I", bpe.special[part]))
                        continue
                    for chunk in filter(None, _SPACE.split(part)):
                        if len(chunk) < piece_chars:
                            small.append(bpe.chunk(chunk)[0])
                            continue
                        for word in bpe.words(chunk):
                            symbols = bpe.symbols(word)
                            if len(symbols) < piece_chars:
                                small.append(struct.pack(f"<{len(w)}I", *w) if (w := bpe.encode_word(word)) else b"")
                                continue
                            put(b"".join(small), True)
                            small.clear()
                            for i in range(0, len(symbols), piece_chars // 4):
                                s = symbols[i : i + piece_chars // 4]
                                put(struct.pack(f"<{len(s)}I", *s), False)
                            put(b"", True)  # a word end
                put(b"".join(small), True)
                yield pa.RecordBatch.from_pydict(out, schema=_LEAF)

    return run


_LEAF = pa.schema([("text_key", pa.binary()), ("seq", pa.int64()), ("symbols", pa.binary()), ("ready", pa.bool_())])


def _long(docs: DataFrame, id_col: str, text_col: str, path: str, piece_chars: int) -> DataFrame:
    """The second path: leaves of a text are encoded by many tasks, each distinct text once."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.sha2(text_col, 256)).alias("text_key"))
    pieces = keyed.groupBy("text_key").agg(F.first("text").alias("text")).mapInArrow(_leaves(path, piece_chars), "text_key binary, seq bigint, symbols binary, ready boolean")

    def encode(batches):
        for b in batches:
            bpe = load(path)
            got = []
            for s, ready in zip(b["symbols"].to_pylist(), b["ready"].to_pylist()):
                if not ready:
                    ids = array("I", s).tolist()
                    ids = bpe.join_all([bpe.merge(ids[i : i + bpe.leaf]) for i in range(0, len(ids), bpe.leaf)])
                    s = struct.pack(f"<{len(ids)}I", *ids)
                got.append(s)
            yield pa.RecordBatch.from_arrays([b["text_key"], b["seq"], pa.array(got, pa.binary()), b["ready"]], schema=_LEAF)

    encoded = pieces.repartition("text_key", "seq").mapInArrow(encode, "text_key binary, seq bigint, symbols binary, ready boolean")

    def join(t: pa.Table) -> pa.Table:
        bpe, out, word = load(path), [], []
        for s, ready in zip(t["symbols"].to_pylist(), t["ready"].to_pylist()) if t.num_rows < 2 else zip(*[(u := t.sort_by("seq"))[c].to_pylist() for c in ("symbols", "ready")]):
            if ready:
                out += bpe.join_all(word)
                word = []
                out += array("I", s).tolist()
            else:
                word.append(array("I", s).tolist())
        return pa.table({"text_key": [t["text_key"][0].as_py()], "ids": [struct.pack(f"<{len(out)}I", *out)], "decoded": [bpe.decode(out)]}, schema=pa.schema([("text_key", pa.binary()), ("ids", pa.binary()), ("decoded", pa.string())]))

    joined = encoded.groupBy("text_key").applyInArrow(join, "text_key binary, ids binary, decoded string")
    return keyed.drop("text").join(joined, "text_key").select("doc_id", "ids", "decoded")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, piece_chars: int = 32_768, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian uint32) and decoded; with digest their counts and hashes instead.

    piece_chars: a stretch without white space of this length sends its text over the second path. Only such texts are shuffled.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    unsplit = F.coalesce((F.length(text) >= piece_chars) & text.rlike(f"\\S{{{piece_chars}}}"), F.lit(False))
    short = _short(docs.filter(~unsplit), id_col, text_col, path, digest)
    long = _long(docs.filter(unsplit), id_col, text_col, path, piece_chars)
    if digest:
        long = long.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return short.unionByName(long)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True)
