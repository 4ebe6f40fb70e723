"""Best-fit packing with swap-based local search (operator 3).

Documents become pieces of at most ``CAPACITY`` tokens. The pieces (ids,
lengths and check sums, never texts or tokens) are dealt at random into groups
of a fixed expected size; each group is packed by best-fit decreasing and then
improved by a local search over underfull bins: moving a piece, exchanging one
for one, or two for one, whenever that raises the sum of squared fills. Bins
that the search empties disappear.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import ship_package, stored, table
from filtra.llm.scan import TEXTS, released

CAPACITY = 2048
GROUP_PIECES = 8192  # expected pieces per packing group
MEMO_WORDS = 600_000  # words, and pieces of words, whose token ids a worker keeps
PASSES = 12  # sweeps of the local search; it ends earlier when nothing improves
PAIR_ITEMS = 12  # largest pieces of a bin that may leave it as a pair
END_ID = 0

# Fixed values of the vocabulary's pre-tokenizer, used below U+0250 only, where
# letters and numbers are the same in every Unicode version.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN_END = "\u0250"
_TAIL = ".,;:!?#$%&*|()"  # single-run punctuation that often ends a word
_LATIN = regex.compile("[\x21-\x7e\xa1-\u024f]+")

_worker: dict = {}


def _encoder(path: str) -> dict:
    """The tokenizer of this Python worker with its memos of words and pieces."""
    if _worker.get("path") != path:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        ends = np.zeros(tok.get_vocab_size(), dtype=bool)
        for token, i in tok.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith("</w>")
        _worker.update(path=path, tok=tok, ends=ends, words={}, pieces={})
    return _worker


def _encode_pieces(w: dict, new: list[str]) -> dict[str, bytes]:
    """Ids of word pieces, many to a call: a piece's last token, and no other, ends a word."""
    out = {}
    for at in range(0, len(new), 2048):
        part = new[at:at + 2048]
        ids = np.array(w["tok"].encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
        stops = np.nonzero(w["ends"][ids])[0] + 1
        if len(stops) == len(part) and stops[-1] == len(ids):
            raw, begin = ids.tobytes(), 0
            for piece, stop in zip(part, (stops * 4).tolist()):
                out[piece] = raw[begin:stop]
                begin = stop
        else:
            for piece in part:
                out[piece] = np.array(w["tok"].encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
    return out


def _pieces_of(word: bytes):
    """The pre-tokenizer's pieces of a Latin word; None for any other word."""
    text = word.decode()
    low = text.lower()
    stem = low.rstrip(_TAIL)
    if stem.isalpha() and (stem.isascii() or max(stem) < _LATIN_END):
        return (stem,) if len(stem) == len(low) else (stem, low[len(stem):])
    if _LATIN.fullmatch(low) and "<|" not in text:
        return _SPLIT.findall(low)
    return None


def _encode_words(w: dict, missing: list[bytes]) -> dict[bytes, bytes]:
    """Ids of words. Latin words are taken apart by the vocabulary's own split
    rule and their pieces encoded once; any other word goes to the tokenizer whole."""
    parts, out, seen = {}, {}, w["pieces"]
    for word in missing:
        parts[word] = _pieces_of(word)
    new = {p for ps in parts.values() if ps for p in ps if p not in seen}
    fresh = _encode_pieces(w, list(new)) if new else {}
    if len(seen) + len(fresh) <= MEMO_WORDS:
        seen.update(fresh)
        fresh = {}
    for word, ps in parts.items():
        if ps is None:
            ids = w["tok"].encode(word.decode(), add_special_tokens=False).ids
            out[word] = np.array(ids, dtype="<u4").tobytes()
        else:
            out[word] = b"".join([seen[p] if p in seen else fresh[p] for p in ps])
    return out


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """Token ids of whole texts, without special tokens added.

    The vocabulary drops white space and never joins across it, and lowers case
    (its marked tokens ``<|...|>`` apart), so a text's ids are those of its
    white-space separated words in a row; each word is encoded once and remembered.
    """
    w = _encoder(path)
    split = [raw.split() if b"<|" in raw else raw.lower().split() for raw in [t.encode() for t in texts]]
    memo = w["words"]
    missing: set = set()
    for words in split:
        missing.update([x for x in words if x not in memo])
    fresh = _encode_words(w, list(missing)) if missing else {}
    if len(memo) + len(fresh) <= MEMO_WORDS:
        memo.update(fresh)
        fresh = {}
    if fresh:  # the memo is full: it keeps the words met first, the frequent ones
        return [np.frombuffer(b"".join([memo[x] if x in memo else fresh[x] for x in words]), dtype="<u4")
                for words in split]
    return [np.frombuffer(b"".join([memo[x] for x in words]), dtype="<u4") for words in split]


def forget() -> None:
    """Drop the words and pieces that this worker knows."""
    for memo in ("words", "pieces"):
        _worker.get(memo, {}).clear()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, remember: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document tokenised, ended
    by id 0, and cut into runs of ``capacity`` tokens. Null text counts as empty
    (one token, the end). With ``remember`` a worker knows its words from task to
    task, which saves time and holds their memory while it waits for other stages."""
    ship_package(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], dtype="<u4")

    def cut_batches(batches):
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = batch.column("text")
            row, piece, start, length, crc = [], [], [], [], []
            for at in range(0, len(texts), TEXTS):
                for i, ids in enumerate(encode_texts(texts.slice(at, TEXTS).to_pylist(), tokenizer), at):
                    ids = np.concatenate([ids, end])
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s:s + capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                schema=out)
        if not remember:
            forget()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return src.mapInArrow(released(cut_batches), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when a bin with room r exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - need
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


class _Search:
    """Local search over the underfull bins of one group."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.size = [int(x) for x in lengths]
        self.bins = bins
        self.cap = capacity
        self.fill = [sum(self.size[i] for i in b) for b in bins]
        self.holders: list[dict] = [{} for _ in range(capacity + 1)]  # unit length -> bin -> its pieces
        self.present = 0  # bit L is set when some bin offers a unit of length L
        for b in range(len(bins)):
            self._offer(b)

    def _units(self, b: int):
        if not 0 < self.fill[b] < self.cap:
            return
        items = sorted(self.bins[b], key=self.size.__getitem__, reverse=True)
        for i in items:
            yield self.size[i], (i,)
        items = items[:PAIR_ITEMS]
        for x in range(len(items)):
            for y in range(x + 1, len(items)):
                yield self.size[items[x]] + self.size[items[y]], (items[x], items[y])

    def _offer(self, b: int) -> None:
        for length, unit in self._units(b):
            self.holders[length].setdefault(b, unit)
            self.present |= 1 << length

    def _withdraw(self, b: int) -> None:
        for length, _ in self._units(b):
            if self.holders[length].pop(b, None) is not None and not self.holders[length]:
                self.present &= ~(1 << length)

    def _partner(self, b: int, gives: int):
        """A unit (bin, pieces) whose exchange for ``gives`` tokens of bin ``b``
        fills b the most, taken from a bin that ends emptier than b."""
        room = self.cap - self.fill[b]
        want = gives + room
        masked = self.present & ((1 << (want + 1)) - 1)
        while masked:
            length = masked.bit_length() - 1
            gain = length - gives
            if gain <= 0:
                return None
            for a, unit in self.holders[length].items():
                # raises the squared fills; only then is the loop sure to end
                if a != b and self.fill[a] < self.fill[b] + gain:
                    return a, unit, gain
            masked ^= 1 << length
        return None

    def run(self) -> list[list[int]]:
        for _ in range(PASSES):
            moved = False
            order = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.cap),
                           key=lambda b: -self.fill[b])
            for b in order:
                while 0 < self.fill[b] < self.cap:
                    best = None
                    for out in [None, *{self.size[i]: i for i in self.bins[b]}.values()]:
                        found = self._partner(b, 0 if out is None else self.size[out])
                        if found and (best is None or found[2] > best[0][2]):
                            best = (found, out)
                            if found[2] == self.cap - self.fill[b]:
                                break
                    if best is None:
                        break
                    (a, unit, gain), out = best
                    self._withdraw(a)
                    self._withdraw(b)
                    for i in unit:
                        self.bins[a].remove(i)
                        self.bins[b].append(i)
                    if out is not None:
                        self.bins[b].remove(out)
                        self.bins[a].append(out)
                    self.fill[a] -= gain
                    self.fill[b] += gain
                    self._offer(a)
                    self._offer(b)
                    moved = True
            if not moved:
                break
        return [b for b in self.bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of positions) for the given lengths, each in 1..capacity."""
    return _Search(lengths, best_fit(lengths, capacity), capacity).run()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
         group_pieces: int = GROUP_PIECES, remember: bool = True) -> DataFrame:
    """Place every piece of every document into sequences of at most ``capacity``.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are one end token; repeated rows and null ids are packed like
    others; an empty table gives no rows. Only ``doc_id`` and ``text`` are read. ``remember``: see
    :func:`pieces`.
    """
    cut_up = stored(pieces(docs, tokenizer, capacity, remember), "pieces")
    n = cut_up.count()
    groups = max(1, -(-n // group_pieces))
    # dealt by position in the stored table: even for any ids, the same on a retry
    dealt = cut_up.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        seq = np.zeros(len(pdf), dtype=np.int64)
        offset = np.zeros(len(pdf), dtype=np.int64)
        base = int(pdf["_group"].iloc[0]) << 32
        for s, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], offset[i] = base + s, at
                at += int(lengths[i])
        pdf["sequence_id"], pdf["offset"] = seq, offset
        return pdf.drop(columns="_group")

    schema = ("doc_id string, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")
    # ids travel as text: pandas has no null in its integers
    packed = (dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
              .select("doc_id", "piece", "start", "length", "ids_crc32", "_group")
              .groupBy("_group").applyInPandas(pack_group, schema))
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
