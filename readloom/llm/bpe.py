"""BPE encoding and decoding (operator 3) with a public vocabulary file, whose path is a parameter.

A text is cut at the vocabulary's special tokens and at white space. A chunk between is normalised and split into pieces as the
file says; which characters are letters, digits and marks, and how marks compose, is taken from the tokenizers library's own
normaliser and splitter for chunks beyond ASCII, so that results do not depend on the Unicode tables of the Python that runs.
A piece's symbols are its bytes, the last one marked as the end of a word. They form a doubly linked list; a priority queue holds
(rank, position) of every neighbouring pair that has a merge. The least entry is applied if it is not stale, that is, if both symbols
still stand and their pair still has that rank; then the pairs with the two new neighbours are queued. Decoding looks
the ids up and joins the vocabulary's strings, with a space between as the file names no decoder.

Results that the cases have: null and empty texts have no tokens and decode to the empty string; rows that repeat are
encoded alike; null ids stay; extra columns are ignored; an empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, process_cache, text_of

#: Bytes of chunks and ids that a worker remembers in a generation, what Python needs to hold them included, and of pieces beyond ASCII.
REMEMBERED, PIECES = 64 << 20, 16 << 20
#: Bytes that Python needs for an entry besides the characters and ids: two objects and a place in the table.
ENTRY = 190
#: Bytes of ids and decoded text that an Arrow batch of the result aims at.
EMITTED = 4 << 20


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Remembered(dict):
    """What `make` gives for a key, kept in two generations: when the younger holds `most` bytes it becomes the older, whose unused entries go."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.held += len(key) * (1 if key.isascii() else 4) + len(value) + ENTRY
        if self.held > self.most:
            self.older, self.held = dict(self), len(key) * 4 + len(value) + ENTRY
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder. With `library`, the tokenizers library merges the symbols of a piece, to the same ids."""

    def __init__(self, path: str, library: bool = False):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path}: not a plain BPE vocabulary")
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"}:
            raise ValueError(f"{path}: other normalisation than is implemented")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"], spec["decoder"]) != ("Removed", True, False, False, None):
            raise ValueError(f"{path}: other splitting than is implemented")
        pattern = split["pattern"]["Regex"]
        self.ascii_piece = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.parts = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        spaces = [c for c in map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]) if c.isspace()]
        odd = [c for c in spaces if self.parts.pre_tokenize_str(c)]
        # what Python takes for white space and the library does not must not cut a chunk
        self.odd = re.compile(f"[{re.escape(''.join(odd))}]") if odd else None
        self.space = re.compile(f"[{re.escape(''.join(c for c in spaces if c not in odd))}]+")
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        if max(self.vocab.values()) >= 1 << 20:
            raise ValueError(f"{path}: ids of more than 20 bits")
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.news = [self.vocab[a + b] for a, b in model["merges"]]
        self.strings = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for s, i in [*self.vocab.items(), *special.items()]:
            self.strings[i] = s
        symbols = self.symbols = byte_symbols()
        self.model = Tokenizer.from_file(path).model if library else None
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.pieces, self.chunks = Remembered(self.piece_ids, PIECES), Remembered(self.chunk_ids, REMEMBERED)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece, by the queue of merges over the linked list. A queue entry is rank * 2^32 + position."""
        inner, ranks, news = self.inner, self.ranks, self.news
        symbols = [inner[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        n = len(symbols)
        queue = [r << 32 | k for k in range(n - 1) if (r := ranks.get(symbols[k] << 20 | symbols[k + 1])) is not None]
        if not queue:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, k = entry >> 32, entry & 0xFFFFFFFF
            right = after[k]
            if symbols[k] < 0 or right >= n or ranks.get(symbols[k] << 20 | symbols[right]) != rank:
                continue  # stale: one of the two has been merged with another
            symbols[k] = new = news[rank]
            symbols[right] = -1
            after[k] = far = after[right]
            if far < n:
                before[far] = k
                if (r := ranks.get(new << 20 | symbols[far])) is not None:
                    heapq.heappush(queue, r << 32 | k)
            if (near := before[k]) >= 0 and (r := ranks.get(symbols[near] << 20 | new)) is not None:
                heapq.heappush(queue, r << 32 | near)
        return [s for s in symbols if s >= 0]

    def piece_ids(self, piece: str) -> bytes:
        if self.model:
            ids = [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode())))]
        else:
            ids = self.merged(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of what stands between white space, as little-endian bytes."""
        if chunk.isascii():
            parts = self.ascii_piece.findall(chunk.lower())
            return self.piece_ids(chunk) if parts == [chunk] else b"".join([self.chunks[p] for p in parts])
        return b"".join([self.pieces[p] for p, _ in self.parts.pre_tokenize_str(self.normal.normalize_str(chunk))])

    def encoded(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            parts = self.cut.split(text)
            return b"".join([self.special[p].to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(parts)])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if text.isascii():
            text = text.lower()
        chunks = [c for c in self.space.split(text) if c] if self.odd and self.odd.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def codec(path: str, library: bool = False) -> Codec:
    return process_cache(f"codec {library} {path}", lambda: Codec(path, library))


def coder(path: str, digests: bool, decode: bool):
    """Arrow batches of `_text` to ids and decoded text, or their digests; a batch of the result ends once it holds EMITTED bytes."""
    schema = pa.schema([("n", pa.int64()), ("i", pa.string() if digests else pa.list_(pa.int32())), *([("d", pa.string())] if decode else [])])

    def emitted(ids: pa.Array, columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=False))], ["_id", *schema.names])

    def run(batches):
        c = codec(path)
        for batch in batches:
            begun, size, n, ids, decoded = 0, 0, [], [], []
            for k, text in enumerate(batch["_text"]):
                blob = c.encoded(text.as_py())
                n.append(len(blob) // 4)
                ids.append(hashlib.sha256(blob).hexdigest() if digests else np.frombuffer(blob, "<u4").astype(np.int32))
                size += len(ids[-1]) if digests else len(blob)
                if decode:
                    whole = c.decode(np.frombuffer(blob, "<u4").tolist())
                    decoded.append(hashlib.sha256(whole.encode()).hexdigest() if digests else whole)
                    size += len(decoded[-1])
                if size >= EMITTED:
                    yield emitted(batch["_id"].slice(begun, k + 1 - begun), [n, ids, decoded])
                    begun, size, n, ids, decoded = k + 1, 0, [], [], []
            if n:
                yield emitted(batch["_id"].slice(begun), [n, ids, decoded])

    return run


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, keep: tuple[str, ...] = (), decode: bool = True) -> DataFrame:
    """One row a document: (id_col, n_tokens, ids, decoded), or SHA-256 digests of the two (ids_sha256, decoded_sha256).

    Columns named in keep follow the id. Without decode nothing is decoded and that column is absent. No shuffle: a row depends on its text
    alone. path names the vocabulary file, which every executor can read.
    """
    rows = docs.select(F.struct(col(id_col).alias("id"), *(col(c).alias(f"c{k}") for k, c in enumerate(keep))).alias("_id"), text_of(docs, text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = dict(zip("id" if decode else "i", ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"), strict=False))
    out = rows.mapInArrow(coder(path, digests, decode), f"_id {kind}, n bigint, i {'string' if digests else 'array<int>'}" + ", d string" * decode)
    return out.select(F.col("_id.id").alias(id_col), *(F.col(f"_id.c{k}").alias(c) for k, c in enumerate(keep)), F.col("n").alias("n_tokens"), *(F.col(k).alias(n) for k, n in names.items()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), digests=True)
