"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts up to `order`, pretrained on the training rows of the whole
corpus. A symbol is predicted in the longest context that training has seen; a symbol new to it
costs an escape, estimated from the number of distinct symbols seen there (as in method D, a fixed
part of each symbol's count), and is then looked for one byte shorter, where the symbols already
ruled out are excluded from the counts.
Below order 0 the symbols never seen are equally likely. The byte 0xFF, which UTF-8 never holds,
stands before the text and ends it, so a text's probability includes its end.

Beside it each text gets a unigram word score. Words are counted over all training rows by hash,
and the counts meet each block of texts again through a join on the word.

Memory: the trie's n-grams are counted by Spark. They reach the scoring tasks in broadcast pieces
of at most `max_grams` entries; a trie beyond that is cut by the newest bytes of the context, and
each block of texts is scored against one piece after the other with the same result.

Defined results: null texts count as empty and score the probability of the end alone; null ids
train; repeated rows each count and each return; an empty table gives an empty result; with no
training rows every byte is equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecrest.llm.common import release, settle

END = b"\xff"
#: Words' end token in the unigram counts; no word equals it, as words are UTF-8.
END_WORD = xxhash.xxh64_intdigest(END) - (1 << 63)
LOW = 2  # contexts up to this order are in every piece of the trie: 256**3 grams at most
STEP = 1 << 18


def lay_out(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts joined with their padding, and the codes' positions that are padding."""
    pad = END * order
    buf = np.frombuffer(b"".join([x for t in texts for x in (pad, t, END)]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + order + 1
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(texts) else np.zeros(0, np.int64)
    return buf, starts


def codes_of(buf: np.ndarray, order: int) -> np.ndarray:
    """Code of each byte with the `order` bytes before it; the newest byte is lowest."""
    n = len(buf) - order
    codes = np.zeros(max(n, 0), np.int64)
    for j in range(order + 1):
        codes <<= 8
        codes |= buf[j : n + j]
    return codes


def real(starts: np.ndarray, n: int, order: int) -> np.ndarray:
    """Positions in codes that end in a byte of a text or its end."""
    keep = np.ones(n, bool)
    pads = (starts[1:, None] - order + np.arange(order)).ravel()
    keep[pads] = False
    return keep


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    at = np.argsort(k, kind="stable")
    k, c = k[at], c[at]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return (k[first], np.add.reduceat(c, first)) if len(k) else (k, c)


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def take(texts: list[bytes]) -> None:
        buf, starts = lay_out(texts, order)
        codes = codes_of(buf, order)
        k, c = np.unique(codes[real(starts, len(codes), order)], return_counts=True)
        keys.append(k)
        counts.append(c.astype(np.int64))

    def out() -> pa.RecordBatch:
        k, c = _summed(keys, counts)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["gram", "n"])

    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for t in batch.column(0).slice(at, 256).to_pylist():
                texts.append((t or b"").lower())
                size += len(texts[-1]) + order + 1
            if size > 1 << 20:
                take(texts)
                texts, size = [], 0
                if sum(map(len, keys)) > 1_500_000:
                    k, c = _summed(keys, counts)
                    keys, counts = [k], [c]
                    if len(k) > 1_000_000:
                        yield out()
                        keys, counts = [], []
    if texts:
        take(texts)
    if keys:
        yield out()
    del keys, counts
    release()


class Trie:
    """Log probabilities from gram counts. high: grams of the full order; low: of order LOW, or of the
    full order if that is less. Below the full order a symbol counts once for each longer context
    that it was seen in (update exclusion), and `discount` of each symbol's count goes to the escape."""

    def __init__(self, order: int, high: tuple[np.ndarray, np.ndarray], low: tuple[np.ndarray, np.ndarray], discount: float = 0.3):
        self.order = order
        top = [None] * (order + 1)
        for j in range(order, -1, -1):
            if j == order or j == LOW:
                keys, n = low if j == min(LOW, order) else high
            else:
                keys, n = top[j + 1][0] & ((1 << 8 * (j + 1)) - 1), np.ones(len(top[j + 1][0]), np.int64)
            top[j] = _summed([keys], [n])
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # keys, log10 of counts
        self.contexts: list[tuple[np.ndarray, ...]] = []  # keys, own total, own escape, the parent's total and escape when excluded
        totals: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for j, (keys, n) in enumerate(top):
                ctx, first, kinds = np.unique(keys >> 8, return_index=True, return_counts=True)
                total = np.add.reduceat(n, first) if len(keys) else n
                totals.append((ctx, total, kinds))
                self.grams.append((keys, np.log10(n - discount)))
                own = np.log10(total), np.log10(discount * kinds / total)
                if not j or not len(keys):
                    self.contexts.append((ctx, *own, np.zeros(len(ctx)), np.zeros(len(ctx))))
                    continue
                up_keys, up_n = top[j - 1]
                ruled_out = np.add.reduceat(up_n[np.searchsorted(up_keys, keys & ((1 << 8 * j) - 1))], first)
                up_ctx, up_total, up_kinds = totals[j - 1]
                at = np.searchsorted(up_ctx, ctx & ((1 << 8 * (j - 1)) - 1))
                left, new = up_total[at] - ruled_out, up_kinds[at] - kinds
                self.contexts.append((ctx, *own, np.where(new > 0, np.log10(left), 0.0), np.where(new > 0, np.log10(discount * new / left), 0.0)))
        zero = self.contexts[0]
        self.unseen = -np.log10(max(1, 256 - (int(totals[0][2][0]) if len(zero[0]) else 0)))
        keys, logs = self.grams[order]
        own = self.contexts[order]
        self._table(keys, logs - own[1][np.searchsorted(own[0], keys >> 8)] if len(keys) else logs)
        self.grams[order] = keys[:0], logs[:0]  # the table has them

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open-addressing table of the full-order grams, filled and read a whole array at a time."""
        self.bits = max(4, int(1.3 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.slots[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code's newest byte after the bytes before it."""
        slot = self._slot(codes)
        got = self.slots[slot]
        out = self.values[slot]
        miss = np.flatnonzero(got != codes)
        lost = []
        while len(miss):
            at = slot[miss]
            lost.append(miss[got[miss] < 0])
            miss = miss[got[miss] >= 0]
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            got[miss] = self.slots[slot[miss]]
            hit = got[miss] == codes[miss]
            out[miss[hit]] = self.values[slot[miss[hit]]]
            miss = miss[~hit]
        if lost and len(rest := np.concatenate(lost)):
            out[rest] = self._escaped(codes[rest])
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """Codes that the longest context has not seen: down the orders, excluding what was ruled out."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        entered = np.zeros(len(codes), bool)
        total = np.zeros(len(codes))  # of the context at hand, with exclusions
        escape = np.zeros(len(codes))
        for j in range(self.order, -1, -1):
            c = codes[left]
            ctx_keys, own_total, own_escape, up_total, up_escape = self.contexts[j]
            ctx = (c >> 8) & ((1 << 8 * j) - 1)
            at = np.minimum(np.searchsorted(ctx_keys, ctx), max(0, len(ctx_keys) - 1))
            known = ctx_keys[at] == ctx if len(ctx_keys) else np.zeros(len(c), bool)
            start = known & ~entered[left]
            total[left[start]] = own_total[at[start]]
            escape[left[start]] = own_escape[at[start]]
            entered[left[start]] = True
            keys, logs = self.grams[j]
            gram = c & ((1 << 8 * (j + 1)) - 1)
            g = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
            found = keys[g] == gram if len(keys) else np.zeros(len(c), bool)
            out[left[found]] += logs[g[found]] - total[left[found]]
            stay = ~found
            out[left[stay]] += np.where(entered[left[stay]], escape[left[stay]], 0.0)
            left, at, known = left[stay], at[stay], known[stay]
            if known.any():
                total[left[known]] = up_total[at[known]]
                escape[left[known]] = up_escape[at[known]]
        out[left] += self.unseen
        return out


def piece_of(codes: np.ndarray, pieces: int) -> np.ndarray:
    """Which piece of the trie holds a code: by the newest LOW + 1 bytes of its context."""
    return ((codes >> 8) & ((1 << 8 * (LOW + 1)) - 1)) * 40503 % 65521 % pieces


def train(docs: DataFrame, text: str, order: int) -> DataFrame:
    """(gram, n): how often each run of order + 1 bytes ends at a byte of a training text."""
    grams = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(lambda it: _count(it, order), "gram long, n long")
    return settle(grams.groupBy("gram").agg(F.sum("n").alias("n")))


def broadcast_pieces(grams: DataFrame, order: int, max_grams: int) -> list:
    """The trie in broadcasts of at most about max_grams grams of the full order each."""
    sc = grams.sparkSession.sparkContext
    arrays = lambda df: tuple(c.to_numpy() for c in df.toArrow().select(["gram", "n"]).columns)
    if order <= LOW:
        low = arrays(grams)
    else:
        longer = grams.select(F.col("gram").bitwiseAND((1 << 8 * (LOW + 2)) - 1).alias("gram")).distinct()
        low = arrays(longer.groupBy(F.col("gram").bitwiseAND((1 << 8 * (LOW + 1)) - 1).alias("gram")).agg(F.count("*").alias("n")))
    pieces = max(1, -(-grams.count() // max_grams))
    if pieces == 1:
        return [sc.broadcast(Trie(order, arrays(grams), low))]
    newest = F.shiftright("gram", 8).bitwiseAND((1 << 8 * (LOW + 1)) - 1)
    return [sc.broadcast(Trie(order, arrays(grams.where((newest * 40503) % 65521 % pieces == p)), low)) for p in range(pieces)]


def _score(batches: Iterator[pa.RecordBatch], pieces: list, order: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of texts: per text id, held out, tokens, score and the indices of its
    words in the block's vocabulary, as compressed byte planes; of the vocabulary the hashes and counts in training texts."""
    names = ["block", "doc_id", "held_out", "n_words", "score", "word", "vocab", "train_n"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    part, seq = TaskContext.get().partitionId(), 0

    def scores(texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        for p, held in enumerate(pieces):
            trie: Trie = held.value
            at = 0
            while at < len(texts):  # some texts at a time; a long one alone
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < STEP):
                    size += len(texts[to]) + order + 1
                    to += 1
                buf, starts = lay_out(texts[at:to], order)
                keep = real(starts, len(buf) - order, order)
                ends = np.cumsum(keep)[starts]  # codes of texts before, plus one
                codes = codes_of(buf, order)[keep]
                if len(pieces) > 1:
                    mine = np.flatnonzero(piece_of(codes, len(pieces)) == p)
                    logs = np.zeros(len(codes))
                    logs[mine] = trie.log10(codes[mine])
                else:
                    logs = np.concatenate([trie.log10(codes[k : k + STEP]) for k in range(0, len(codes), STEP)])
                total[at:to] += np.add.reduceat(logs, ends - 1)
                at = to
            if len(pieces) > 1:
                del trie
                vars(held).pop("_value", None)  # one piece at a time in memory
        return total

    def block(ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        nonlocal seq
        index: dict[bytes, int] = {}
        at = index.setdefault
        found = []
        for t in texts:
            found.append(np.fromiter((at(w, len(index)) for w in t.split()), np.int32))
        learned = [np.zeros(0, np.int32), *(w for h, w in zip(held, found) if not h)]
        train_n = np.bincount(np.concatenate(learned), minlength=len(index)).astype(np.int64)
        vocab = np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64)
        row = [
            [part << 32 | seq], [ids], [held], [list(map(len, found))], [scores(texts)],
            [zstandard.compress(np.concatenate([*found, np.zeros(0, np.int32)]).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)],
            [np.r_[(vocab ^ np.uint64(1 << 63)).view(np.int64), END_WORD]], [np.r_[train_n, held.count(False)]],
        ]
        seq += 1
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    ids: list = []
    held: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for i, h, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                ids.append(i)
                held.append(h)
                texts.append((t or b"").lower())
                size += len(texts[-1]) + 64
                if size >= block_bytes:
                    yield block(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
                    release()
    if ids:
        yield block(ids, held, texts)
        del ids, held, texts
    release()


def _base(blocks: pa.Table, counts: pa.Table, tokens: int, distinct: int) -> pa.Table:
    """Rows of one block, its words' counts beside it."""
    row = blocks.to_pylist()[0]
    at, c = (counts.column(k).to_numpy() for k in ("pos", "c"))
    log = np.full(row["vocab_size"], np.log10(0.5 / (tokens + 0.5 * (distinct + 1))))
    known = np.zeros(row["vocab_size"], np.int64)
    log[at] = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
    known[at] = c > 0
    word = np.ascontiguousarray(np.frombuffer(zstandard.decompress(row["word"]), np.uint8).reshape(4, -1).T).view("<i4").ravel()
    n = np.array(row["n_words"], np.int64)
    cut = np.r_[0, np.cumsum(n)]
    run_known = np.r_[0, np.cumsum(known[word])]
    base = np.array([log[word[a:b]].sum() for a, b in zip(cut[:-1], cut[1:])]) + log[-1]
    return pa.table({
        "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": n + 1,
        "n_known": run_known[cut[1:]] - run_known[cut[:-1]] + known[-1], "train_tokens": np.full(len(n), tokens), "base_score": base, "score": pa.array(row["score"], pa.float64()),
    })


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 5, max_grams: int = 4_000_000, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out marks the rows that the model must not learn from. max_grams bounds what is broadcast
    at once, block_bytes the texts that a task holds.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    pieces = broadcast_pieces(train(rows.where("not held_out"), "text", order), order, max_grams)
    schema = "block long, doc_id array<long>, held_out array<boolean>, n_words array<long>, score array<double>, word binary, vocab array<long>, train_n array<long>"
    blocks = settle(rows.select("doc_id", "held_out", F.col("text").cast("binary")).mapInArrow(lambda it: _score(it, pieces, order, block_bytes), schema))
    words = blocks.select("block", F.posexplode(F.arrays_zip("vocab", "train_n")).alias("pos", "w")).select("block", "pos", F.col("w.vocab").alias("h"), F.col("w.train_n").alias("n"))
    counts = settle(words.where("n > 0").groupBy("h").agg(F.sum("n").alias("c")))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # Words that training has not seen need not come back.
    found = words.select("block", "pos", "h").join(counts, "h").select("block", "pos", "c")
    heads = blocks.select(F.col("block").alias("held_block"), "doc_id", "held_out", "n_words", "score", "word", F.size("vocab").alias("vocab_size"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return heads.groupBy("held_block").cogroup(found.groupBy("block")).applyInArrow(lambda a, b: _base(a, b, tokens, distinct), out)
