"""Byte-level BPE by dynamic programming over prefixes.

For a fixed list of merge ranks every byte string has one encoding, and so every prefix of it has one valid last
token: the token t that ends there, such that the token before it (the last token of the prefix without t) and t
stay apart under the merge rules. Storing that token for each prefix gives three things: appending bytes only adds
prefixes, words with a common beginning share their work, and after an edit only the pieces near it are encoded
again.

Null texts count as empty; an empty text has no ids. Rows are handled one by one, so repeated rows, null doc_ids and
extra columns make no difference: the output has one row for each input row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_of

ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class PrefixTable:
    """The valid last token of each byte prefix seen so far.

    ranks must hold all single bytes. For beginnings of up to SHARED bytes the last tokens are kept from one piece to the
    next, max_prefixes of them at most (then the table starts anew); longer prefixes belong to one piece. So memory is
    bounded whatever the texts are.
    """

    SHARED = 6

    def __init__(self, ranks: dict[bytes, int], max_prefixes: int = 60_000, max_pairs: int = 100_000):
        self.ranks = ranks
        self.token = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.max_prefixes, self.max_pairs = max_prefixes, max_pairs
        self._last: dict[bytes, list[int]] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.token[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    raise ValueError(f"no merges lead to token {token}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of left's bytes followed by right's bytes is just these two tokens.

        Undo the merges on both sides of the seam, latest first. The tokens stay apart unless, at some moment, the
        two pieces then at the seam could merge earlier than the merge that was undone last.
        """
        known = self._apart.get(left << 32 | right)
        if known is None:
            if len(self._apart) >= self.max_pairs:
                self._apart.clear()
            known = self._apart[left << 32 | right] = self.seam_holds(left, right)
        return known

    def seam_holds(self, a: int, b: int) -> bool:
        before = 1 << 40
        while True:
            joined = self.ranks.get(self.token[a] + self.token[b])
            if joined is not None and joined < before:
                return False
            undo_left, undo_right = self.halves(a), self.halves(b)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and a > b):
                before, a = a, undo_left[1]
            else:  # of two equal merges the left one comes first, so a merge of the same rank at the seam wins over it
                before, b = b + 1, undo_right[0]

    def _go_on(self, data: bytes, lasts: list[int]) -> None:
        """Append to lasts, the last tokens of data's first prefixes, those of all longer ones.

        Exactly one token is valid, so the order of trial is free: first the last token of the prefix before, longer
        by this byte, then shorter ones, then longer ones.
        """
        rank_of, apart_of, size, stay_apart = self.ranks.get, self._apart.get, self.size, self.stay_apart
        n = len(lasts)
        first = n - size[lasts[-1]] if n else 0
        for end in range(n + 1, len(data) + 1):
            for start in range(first, end):
                token = rank_of(data[start:end])
                if token is not None:
                    if not start:
                        break
                    left = lasts[start - 1]
                    apart = apart_of(left << 32 | token)
                    if apart or (apart is None and stay_apart(left, token)):
                        break
            else:
                for start in range(first - 1, max(-1, end - 1 - self.longest), -1):
                    token = rank_of(data[start:end])
                    if token is not None and (not start or stay_apart(lasts[start - 1], token)):
                        break
                else:
                    raise ValueError("the ranks lack a single byte")
            lasts.append(token)
            first = start

    def _ids(self, lasts: list[int]) -> list[int]:
        """The ids of the piece whose prefixes have these last tokens."""
        ids, n, size = [], len(lasts), self.size
        while n:
            token = lasts[n - 1]
            ids.append(token)
            n -= size[token]
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece (a match of the splitting pattern)."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        beginning = piece[: self.SHARED]
        known = self._last.get(beginning)
        if known is None:
            known = list(self._last.get(beginning[:-2], ()))
            self._go_on(beginning, known)
            if len(self._last) >= self.max_prefixes:
                self._last.clear()
            self._last[beginning] = known
        lasts = known.copy()
        self._go_on(piece, lasts)
        return self._ids(lasts)

    def extend(self, lasts: list[int], old: bytes, more: bytes) -> tuple[list[int], list[int]]:
        """Append bytes to one piece: from the last tokens of all prefixes of old, those of old + more, and its ids."""
        lasts = list(lasts)
        self._go_on(old + more, lasts)
        return lasts, self._ids(lasts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen runs of flat, one after another, and their sizes; run i is flat[starts[i] : starts[i] + sizes[i]]."""
    n = sizes[chosen]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[chosen] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


class PrefixArrays:
    """The same for many pieces at a time: last tokens of all prefixes of all pieces, found length by length."""

    #: Bytes that are worked on at a time; longer pieces than LONG are encoded one by one.
    BYTES, LONG = 100_000, 64

    def __init__(self, prefixes: PrefixTable):
        self.prefixes = prefixes
        nodes: dict[bytes, int] = {b"": 0}
        for token in prefixes.ranks:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        edges = sorted((nodes[path[:-1]] * 256 + path[-1], node) for path, node in nodes.items() if path)
        self._edge, self._node = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self._rank = np.full(len(nodes), -1, np.int64)
        self._rank[[nodes[t] for t in prefixes.ranks]] = list(prefixes.ranks.values())
        self._size = np.zeros(max(prefixes.token) + 1, np.int64)
        self._size[list(prefixes.size)] = list(prefixes.size.values())
        self._second = np.full(65536, -1, np.int64)  # nodes of two bytes
        deep = [(path[0] << 8 | path[1], node) for path, node in nodes.items() if len(path) == 2]
        self._second[[x[0] for x in deep]] = [x[1] for x in deep]
        self._first = np.array([nodes[bytes([b])] for b in range(256)])
        # Pairs of tokens by a hash of theirs, the last one of each place; what isn't there is found anew.
        self._pairs, self._apart = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _tokens(self, data: np.ndarray, last: np.ndarray) -> np.ndarray:
        """[k, i]: the token of the k + 1 bytes from i on, -1 where there is none; last[i] is the last byte of i's piece."""
        at, node, out = np.arange(len(data)), self._first[data], []
        while len(at):
            out.append(np.full(len(data), -1, np.int32))
            out[-1][at] = self._rank[node]
            going = last[at] >= at + len(out)
            at, node = at[going], node[going]
            following = data[at + len(out)]
            if len(out) == 1:
                node = self._second[data[at] << 8 | following]
                on = node >= 0
            else:
                place = np.searchsorted(self._edge, key := node * 256 + following)
                place[place == len(self._edge)] = 0
                on, node = self._edge[place] == key, self._node[place]
            at, node = at[on], node[on]
        return np.stack(out)

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        place = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        apart, unknown = self._apart[place], np.flatnonzero(self._pairs[place] != key)
        if len(unknown):
            new, of = np.unique(key[unknown], return_inverse=True)
            found = np.array([self.prefixes.seam_holds(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
            apart[unknown] = found[of]
            self._pairs[place[unknown]], self._apart[place[unknown]] = key[unknown], found[of]
        return apart

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for pieces in descending order of their lengths."""
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        base = np.cumsum(sizes) - sizes
        tokens = self._tokens(data, np.repeat(base + sizes - 1, sizes))
        lasts = np.zeros(len(data), np.int64)
        length = np.zeros(len(pieces), np.int64)  # of the last token
        for end in range(1, sizes[0] + 1):
            n = np.count_nonzero(sizes >= end)
            open_rows, tried = np.arange(n), length[:n] + 1  # longer by this byte, then shorter, then longer ones
            most, step = tried, -1
            while len(open_rows):
                at = base[open_rows] + end - tried
                token = np.where((tried <= len(tokens)) & (tried <= end), tokens[np.minimum(tried, len(tokens)) - 1, at], -1).astype(np.int64)
                fits = np.flatnonzero(token >= 0)
                inner = fits[tried[fits] < end]
                valid = token >= 0
                valid[inner] = self._stay_apart(lasts[at[inner] - 1], token[inner])
                done = open_rows[valid]
                lasts[base[done] + end - 1], length[done] = token[valid], tried[valid]
                open_rows, tried, most = open_rows[~valid], tried[~valid] + step, most[~valid]
                if step < 0 and len(tried) and tried.max() < 1:
                    tried, step = most + 1, 1
                elif step < 0 and len(tried) and tried.min() < 1:
                    tried = np.where(tried < 1, 1, tried)  # tried again, until all rows have come to the longer ones
                elif step > 0 and len(tried) and tried.min() > end:
                    raise ValueError("the ranks lack a single byte")
        ends, ids, rows = sizes.copy(), [], []
        going = np.arange(len(pieces))
        while len(going):  # back from the whole piece, one token a step
            token = lasts[base[going] + ends[going] - 1]
            ids.append(token)
            rows.append(going)
            ends[going] -= self._size[token]
            going = going[ends[going] > 0]
        rows, ids = np.concatenate(rows), np.concatenate(ids)
        order = np.argsort(rows, kind="stable")[::-1]
        return ids[order], np.bincount(rows, minlength=len(pieces))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece's begin and how many they are."""
        ids, sizes = [np.zeros(0, np.int64)], np.ones(len(pieces), np.int64)
        starts, at = np.zeros(len(pieces), np.int64), 0
        rank_of = self.prefixes.ranks.get
        whole = np.fromiter((rank_of(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        ids.append(whole[known])
        starts[known], at = np.arange(len(known)), len(known)
        parts, size = [], 0
        by_length = sorted(np.flatnonzero(whole < 0).tolist(), key=lambda i: -len(pieces[i]))
        for i in by_length:
            if len(pieces[i]) > self.LONG:
                found = self.prefixes.encode(pieces[i])
                ids.append(np.array(found, np.int64))
                starts[i], sizes[i], at = at, len(found), at + len(found)
                continue
            if not parts or size > self.BYTES:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += len(pieces[i])
        for part in parts:
            found, n = self._encode([pieces[i] for i in part])
            ids.append(found)
            sizes[part], starts[part] = n, at + len(found) - np.cumsum(n)
            at += len(found)
        return np.concatenate(ids), starts, sizes


class TextEncoder:
    """Encodes whole texts piece by piece, equal pieces of a batch once."""

    #: A space between white space and white space (or the end) belongs to a longer run, so chunks may not start there.
    MERGING_SPACE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.prefixes = PrefixTable(ranks)
        self.arrays = PrefixArrays(self.prefixes)
        self.pattern = regex.compile(pattern)
        self.pieces = self.pattern.findall

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has.

        A piece never goes on past a space that follows a visible character, so texts are cut there and equal chunks are
        split into pieces once. Texts with runs of white space are split as they are; their pieces count as chunks.
        """
        chunks, per_text, whole = [], [], []
        for text in texts:
            whole.append(self.MERGING_SPACE.search(text) is not None)
            if whole[-1]:
                found = self.pieces(text)
            else:
                first, *rest = text.split(" ")
                found = [first, *map(" ".__add__, rest)]
            chunks += found
            per_text.append(len(found))
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        per_text = np.array(per_text)
        is_piece = np.repeat(np.array(whole), per_text)
        codes, distinct = pd.factorize(np.array(chunks, dtype=object))
        split = np.zeros(len(distinct), bool)
        split[codes[~is_piece]] = True
        split_pieces = [self.pieces(c) if s else () for c, s in zip(distinct, split.tolist(), strict=True)]
        pieces = [p for found in split_pieces for p in found]
        n = np.fromiter(map(len, split_pieces), np.int64, len(distinct))
        runs, run_sizes, run_starts = np.arange(len(pieces)), n, np.cumsum(n) - n
        # Pieces of texts with runs of white space are runs of one piece each.
        alone = np.flatnonzero(np.bincount(codes[is_piece], minlength=len(distinct)))
        own = np.zeros(len(distinct), np.int64)
        own[alone] = len(distinct) + np.arange(len(alone))
        runs = np.append(runs, len(pieces) + np.arange(len(alone)))
        run_starts = np.append(run_starts, len(pieces) + np.arange(len(alone)))
        run_sizes = np.append(run_sizes, np.ones(len(alone), np.int64))
        pieces += [distinct[i] for i in alone.tolist()]
        codes = np.where(is_piece, own[codes], codes)
        piece_codes, distinct_pieces = pd.factorize(np.array(pieces, dtype=object))
        ids, starts, sizes = self.arrays.encode([p.encode("utf-8", "surrogatepass") for p in distinct_pieces])
        # From pieces to chunks, and from chunks to texts.
        ids, per_piece = _gathered(ids, starts, sizes, piece_codes[runs])
        before = np.append(0, np.cumsum(per_piece))
        chunk_starts = before[run_starts]
        chunk_sizes = before[run_starts + run_sizes] - chunk_starts
        ids, per_chunk = _gathered(ids, chunk_starts, chunk_sizes, codes)
        before = np.append(0, np.cumsum(per_chunk))
        ends = np.cumsum(per_text)
        return ids, before[ends] - before[ends - per_text]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def reencode(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text with [start, end) replaced by new, and its ids, from the ids of the old text.

        Only pieces from just before the edit to the first old piece boundary met again behind it are encoded; all
        other ids are kept.
        """
        edited = text[:start] + new + text[end:]
        old = [m.span() for m in self.pattern.finditer(text)]
        shift = len(new) - (end - start)
        lengths, at, bounds = [], 0, {0: 0}
        for a, b in old:  # ids of each old piece
            size = len(text[a:b].encode("utf-8", "surrogatepass"))
            k = 0
            while size:
                size -= self.prefixes.size[ids[at + k]]
                k += 1
            lengths.append(k)
            at += k
            bounds[b] = at
        keep = 0
        for a, b in old:  # a piece depends on at most the run of white space behind it
            if b >= start or (text[b : b + 1].isspace() and not text[b:start].strip()):
                break
            keep = b
        out, tail = ids[: bounds[keep]], len(edited)
        for m in self.pattern.finditer(edited, keep):
            if m.start() >= start + len(new) and m.start() - shift in bounds and m.start() - shift >= end:
                tail = m.start()
                break
            out = out + self.prefixes.encode(m[0].encode("utf-8", "surrogatepass"))
        return edited, out + (ids[bounds[tail - shift] :] if tail < len(edited) else [])


#: Characters of texts that are encoded at a time.
BATCH_CHARS = 2_000_000

_encoder: dict[bytes, TextEncoder] = {}


def _encoder_of(ranks: dict[bytes, int], pattern: str) -> TextEncoder:
    """The worker's encoder. It holds one vocabulary at a time, named by a digest of all of it."""
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).digest()
    if key not in _encoder:
        _encoder.clear()
        _encoder[key] = TextEncoder(ranks, pattern)
    return _encoder[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (packed), and hashes of the ids and of the bytes decoded from them, for each row of docs.

    The columns in keep are carried along; a partition's rows stay in their order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_ranks(rank_path), pattern))  # one vocabulary, whatever the corpus

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder_of(*shared.value)
        token = encoder.prefixes.token
        for batch in batches:
            part = np.cumsum(batch["text"].str.len().to_numpy(np.int64)) // BATCH_CHARS
            for _, rows in batch.groupby(part, sort=False):
                ids, sizes = encoder.encode_batch(rows["text"].tolist())
                ends = np.cumsum(sizes)
                found = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                decoded = [b"".join(map(token.__getitem__, ids[a:b].tolist())) for a, b in zip(ends - sizes, ends, strict=True)]
                yield pd.DataFrame(
                    {
                        "doc_id": rows["doc_id"],
                        "n_tokens": sizes,
                        "ids_sha256": [hashlib.sha256(p).hexdigest() for p in found],
                        "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
                        "ids": found,
                    }
                    | {c: rows[f"keep_{c}"] for c in keep}
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    return rows.mapInPandas(encode, T.StructType([*ENCODED, *(docs.schema[c] for c in keep)]))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the byte_bpe_50k ranks."""
    import public_tokenizers

    encoded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.drop("ids")
