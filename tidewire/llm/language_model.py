"""A bigram model of the corpus, held in tries by shard, and the score of every document under it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, buffer_of, discard, lowered, materialise, mixed, slices, text_of, words_of
from .elias_fano import KEY_BITS, Trie

_MASK = np.uint64((1 << 62) - 1)
#: Words, and pairs, that are split at most: their tables, 16 bytes each, are sent to the executors.
#: What is split decides where pairs are counted, not what comes out.
MOST_HOT = 1 << 20
#: Keys of the end of a text (a token) and of its beginning (a context only).
END, BEGIN = np.uint64(1), np.uint64(2)


def _keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """62-bit keys of the tokens, each row's closed by END, and the tokens before each row."""
    low = lowered(data)
    starts, ends, bounds = words_of(low, offsets)
    n = len(bounds) - 1
    at = bounds + np.arange(n + 1)
    keys = np.full(len(starts) + n, END, np.uint64)
    keys[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(bounds))] = (Spans(low)(starts, ends) & _MASK) | np.uint64(4)
    return keys, at


def _blocks(batches, most_tokens: int, step: int = 1 << 21):
    """Ids, folds, token keys and row bounds of runs of documents of about ``most_tokens``."""
    held: list[tuple] = []
    size = 0

    def joined():
        ids = pa.concat_arrays([x[0] for x in held])
        folds = np.concatenate([x[1] for x in held])
        keys = np.concatenate([x[2] for x in held])
        lengths = np.concatenate([np.diff(x[3]) for x in held])
        return ids, folds, keys, np.concatenate([[0], np.cumsum(lengths)])

    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        folds = batch.column(2).to_numpy(zero_copy_only=False)
        for i, j in slices(offsets, step):
            keys, at = _keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            held.append((batch.column(0).slice(i, j - i), folds[i:j], keys, at))
            size += len(keys)
            if size >= most_tokens or sum(len(x[0]) for x in held) > 40_000:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _contexts(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """40 bits of the token before each token."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[at[:-1]] = BEGIN
    return np.where(before == BEGIN, BEGIN, mixed(before)) & np.uint64((1 << KEY_BITS) - 1)


def _pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mixed(words ^ mixed(contexts + np.uint64(1)))


def _among(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in an ascending table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


# ---------------------------------------------------------------- counts of words and of hot words' pairs

_COUNTS_SQL = "shard int, keys binary, counts binary, train binary, texts long"


def _count_messages(shards: int, most_tokens: int, hot=None):
    """Each block's counts by key, of training texts and of the others, one row a shard.

    Keys are the words, or the pairs of the ``hot`` words alone.
    """

    def run(batches):
        for _, held_out, keys, at in _blocks(batches, most_tokens):
            train = np.repeat(~held_out, np.diff(at))
            if hot is not None:
                some = np.flatnonzero(_among(keys, hot.value)[0])
                keys, train = _pair_keys(keys[some], _contexts(keys, at)[some]), train[some]
            parts = [np.unique(keys[part], return_counts=True) for part in (train, ~train)]
            taught = np.repeat(np.array([1, 0], np.uint8), [len(x[0]) for x in parts])
            key, count = (np.concatenate(x) for x in zip(*parts))
            shard = (mixed(key) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts))
            key, count, taught = key[order], count[order].astype(np.uint32), taught[order]
            cut = lambda x: pa.array([_binary(x[cuts[s] : cuts[s + 1]]) for s in some], pa.binary())
            texts = np.where(np.arange(len(some)) == 0, int((~held_out).sum()), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cut(key), cut(count), cut(taught), pa.array(texts)], ["shard", "keys", "counts", "train", "texts"])

    return run


_TOTALS_SQL = "tokens long, distinct long, texts long, hot binary, hot_counts binary, hot_totals binary"


def _totals(hot: int):
    """A shard's sums, and its keys that occur ``hot`` times or more in all texts: in training texts, in all."""

    def run(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        keys, place = np.unique(joined("keys", np.uint64), return_inverse=True)
        every = joined("counts", np.uint32)
        total = np.bincount(place, every, len(keys)).astype(np.int64)
        count = np.bincount(place, every * joined("train", np.uint8), len(keys)).astype(np.int64)
        often = total >= hot
        binary = lambda x: pa.array([_binary(x[often])], pa.binary())
        whole = lambda x: pa.array([int(x)], pa.int64())
        return pa.table({"tokens": whole(count.sum()), "distinct": whole((count > 0).sum()), "texts": whole(np.sum(table.column("texts").to_numpy())), "hot": binary(keys), "hot_counts": binary(count), "hot_totals": binary(total)})

    return run


def _hottest(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and training counts of the hottest keys."""
    often = totals.where(F.octet_length("hot") > 0).select("hot", "hot_counts", "hot_totals").collect()
    keys, counts, every = (np.frombuffer(b"".join(bytes(r[k]) for r in often), kind) for k, kind in enumerate((np.uint64, np.int64, np.int64)))
    hottest = np.argsort(-every, kind="stable")[:MOST_HOT]
    order = hottest[np.argsort(keys[hottest])]
    return keys[order], counts[order]


# ---------------------------------------------------------------- pairs


def _pair_messages(shards: int, handle, most_tokens: int):
    """One row for each block and shard with its word-context-document counts, one with the ids."""

    def run(batches):
        from pyspark import TaskContext

        hot, hot_pairs, part, number = handle.value[0], handle.value[2], TaskContext.get().partitionId(), 0
        for ids, held_out, keys, at in _blocks(batches, most_tokens):
            block = part << 32 | number
            number += 1
            words, word = np.unique(keys, return_inverse=True)
            context = _contexts(keys, at)
            doc = np.repeat(np.arange(len(ids)), np.diff(at))
            # a hot word's pairs are dealt by word and context, hot pairs by the block too, any other's by the word
            shard = (mixed(words) % np.uint64(shards)).astype(np.int64)[word]
            apart = np.flatnonzero(_among(words, hot)[0][word])
            pair = _pair_keys(keys[apart], context[apart])
            often = _among(pair, hot_pairs)[0]
            pair[often] = mixed(pair[often] + np.uint64(block))
            shard[apart] = (pair % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((doc, context, word, shard))
            shard, word, context, doc = shard[order], word[order], context[order], doc[order]
            new = np.ones(len(order), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(order)))
            shard, word, context, doc = shard[head], word[head], context[head], doc[head]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts))
            rows = []
            for s in some.tolist():
                a, b = cuts[s], cuts[s + 1]
                first = np.flatnonzero(np.concatenate([[True], word[a + 1 : b] != word[a : b - 1]]))
                rows.append((s, block, _binary(words[word[a:b][first]]), _binary(np.diff(np.append(first, b - a)).astype(np.uint32)), _binary((context[a:b] >> np.uint64(32)).astype(np.uint8)), _binary(context[a:b].astype(np.uint32)), _binary(doc[a:b].astype(np.uint16)), _binary(np.minimum(count[a:b], 255).astype(np.uint8)), _binary(np.stack([np.flatnonzero(count[a:b] > 254), count[a:b][count[a:b] > 254]])), np.packbits(held_out).tobytes(), None, None, None))
            rows.append((block % shards, block, *[None] * 8, ids.to_pylist(), held_out.tolist(), np.diff(at).tolist()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _MESSAGE)], schema=_MESSAGE)

    return run


_META = [("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64()))]
_MESSAGE = pa.schema([("shard", pa.int32()), ("block", pa.int64()), *((k, pa.binary()) for k in ("words", "runs", "high", "low", "docs", "counts", "many", "held_bits")), *_META])
_MESSAGE_SQL = "shard int, block long, words binary, runs binary, high binary, low binary, docs binary, counts binary, many binary, held_bits binary, doc_ids array<long>, held array<boolean>, lengths array<long>"
_REPLY = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((k, pa.binary()) for k in ("docs", "known", "base", "score")), *_META])
_REPLY_SQL = "block long, shard int, docs binary, known binary, base binary, score binary, doc_ids array<long>, held array<boolean>, lengths array<long>"


def _shard_scores(handle, prior: float):
    """Builds a shard's trie from its training pairs and looks up every pair of the shard in it.

    With c(u w) the count of a pair and p(w) the word's own chance, the model is
    p(w | u) = (c(u w) + prior p(w)) / (c(u) + prior). A pair's numerator is known where pairs
    of w are; its denominator where u is a word: so each document gets one partial sum a shard.
    """

    def run(table: pa.Table) -> pa.Table:
        hot, hot_counts, hot_pairs, pair_counts, tokens, distinct = handle.value
        total = tokens + 0.5 * (distinct + 1)
        meta = table.filter(pa.compute.is_valid(table.column("doc_ids")))
        rows = table.filter(pa.compute.is_valid(table.column("words"))).to_pylist()
        out = [(r["block"], r["shard"], None, None, None, None, r["doc_ids"], r["held"], r["lengths"]) for r in meta.select(["block", "shard", "doc_ids", "held", "lengths"]).to_pylist()]
        if rows:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for k, r in enumerate(rows):
                docs = np.frombuffer(r["docs"], np.uint16)
                count = np.frombuffer(r["counts"], np.uint8).astype(np.int64)
                at, n = np.frombuffer(r["many"], np.int64).reshape(2, -1)
                count[at] = n
                held = np.unpackbits(np.frombuffer(r["held_bits"], np.uint8)).astype(bool)
                parts[0].append(np.repeat(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["runs"], np.uint32)))
                parts[1].append((np.frombuffer(r["high"], np.uint8).astype(np.uint64) << np.uint64(32)) | np.frombuffer(r["low"], np.uint32))
                parts[2].append(docs.astype(np.int32))
                parts[3].append(count)
                parts[4].append(~held[docs])
                parts[5].append(np.full(len(docs), k, np.int32))
                r.clear()
            word, context, doc, count, train, source = (np.concatenate(x) for x in parts)
            del parts, rows[:]
            words, number = np.unique(word, return_inverse=True)
            del word
            c = np.bincount(number, count * train, len(words))
            split, at = _among(words, hot)
            c[split] = hot_counts[at[split]]
            own = np.log10(prior * (c + 0.5) / total)
            # distinct pairs; those of the training texts make the trie
            order = np.lexsort((context, number))
            new = np.ones(len(order), bool)
            new[1:] = (number[order][1:] != number[order][:-1]) | (context[order][1:] != context[order][:-1])
            pair = np.empty(len(order), np.int64)
            pair[order] = np.cumsum(new) - 1
            head = order[new]
            seen = np.bincount(pair, count * train, len(head))
            owner, under = number[head], context[head]
            split, at = _among(_pair_keys(words[owner], under), hot_pairs)
            seen[split] = pair_counts[at[split]]
            kept = seen > 0
            trie = Trie(words, own, owner[kept], under[kept], np.log10(seen[kept] + prior * (c[owner[kept]] + 0.5) / total))
            value = np.concatenate([trie.find(words[owner[i : i + (1 << 19)]], under[i : i + (1 << 19)]) for i in range(0, len(head), 1 << 19)])
            given = np.where(words == END, 0.0, np.log10(c + prior))
            score = count * (value[pair] - given[number])
            base = count * np.log10(c + 0.5)[number]
            known = count * (c > 0)[number]
            place = source.astype(np.int64) << 16 | doc
            place, back = np.unique(place, return_inverse=True)
            sums = [np.bincount(back, x, len(place)) for x in (known, base, score)]
            cuts = np.searchsorted(place >> 16, np.arange(int(source[-1]) + 2))
            shard = int(table.column("shard")[0].as_py())
            blocks = table.filter(pa.compute.is_valid(table.column("words"))).column("block").to_pylist()
            for k, block in enumerate(blocks):
                a, b = cuts[k], cuts[k + 1]
                out.append((block, shard, _binary((place[a:b] & 0xFFFF).astype(np.uint16)), _binary(sums[0][a:b].astype(np.uint32)), _binary(sums[1][a:b]), _binary(sums[2][a:b].astype(np.float32)), None, None, None))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _REPLY)], schema=_REPLY)

    return run


def _block_sums(table: pa.Table) -> pa.Table:
    """A block's documents with the sums of what the shards say of them, in the shards' order."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["docs"] is not None, r["shard"]))
    meta = rows[0]
    n = len(meta["doc_ids"])
    known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    for r in rows[1:]:
        docs = np.frombuffer(r["docs"], np.uint16)
        known[docs] += np.frombuffer(r["known"], np.uint32)
        base[docs] += np.frombuffer(r["base"], np.float64)
        score[docs] += np.frombuffer(r["score"], np.float32)
    return pa.table({"doc_id": pa.array(meta["doc_ids"], pa.int64()), "held_out": pa.array(meta["held"], pa.bool_()), "n_tokens": pa.array(meta["lengths"], pa.int64()), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score)})


def score(docs: DataFrame, held_out: Column, *, prior: float = 200.0, block_tokens: int = 1 << 20, shard_tokens: int = 3 << 19, hot: int = 1000) -> DataFrame:
    """Scores every whole text under the model of those that are not ``held_out``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens are
    words in lower case (A-Z) and an end. The corpus is read for the words' counts, for those of
    the hot words' pairs, and for all pairs, which blocks of documents send in packed columns to
    shards, dealt by the predicted word. A word whose pairs would fill over a quarter of a shard is
    hot and dealt by word and context instead; a pair that would is hot too and dealt by the block
    of its documents as well. Both are told by all texts, held out or not, and their counts are
    known before. Each shard counts the other training pairs, builds its part of the trie, looks up
    all its pairs and returns one sum for each document. Nothing but the tables of hot words and
    pairs (at most four a shard each, and the ``MOST_HOT`` hottest are kept) reaches the driver.

    Words are told apart by 62-bit hashes, contexts under a word by 40 bits: a shard has at most
    some 1.5 million contexts of one word, so about one pair of them may merge with another.

    Null or empty text: the end alone. No training text: known is 0 and the chances are even.
    Repeated and null ids keep a row each, and equal texts score alike; further columns are
    ignored; an empty table gives no rows. A very long text is a block of its own.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), held_out.alias("held_out"))
    size = text.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    tokens_about = (size[0] or 0) // 5 + size[1]
    shards = max(8, -(-tokens_about // shard_tokens))
    often = max(hot, shard_tokens // 4)

    def counted(name: str, words=None) -> DataFrame:
        messages = text.mapInArrow(_count_messages(shards, block_tokens, words), _COUNTS_SQL)
        return materialise(messages.groupBy("shard").applyInArrow(_totals(often), _TOTALS_SQL), name)

    words = counted("word-counts")
    tokens, distinct, texts = (x or 0 for x in words.agg(F.sum("tokens"), F.sum("distinct"), F.sum("texts")).first())
    keys, counts = _hottest(words)
    discard(words)
    pair_keys, pair_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys):
        sent = spark.sparkContext.broadcast(keys)
        pairs = counted("pair-counts", sent)
        pair_keys, pair_counts = _hottest(pairs)
        discard(pairs)
        sent.destroy()
    handle = spark.sparkContext.broadcast((keys, counts, pair_keys, pair_counts, tokens, distinct))
    replies = text.mapInArrow(_pair_messages(shards, handle, block_tokens), _MESSAGE_SQL).groupBy("shard").applyInArrow(_shard_scores(handle, prior), _REPLY_SQL)
    sums = replies.groupBy("block").applyInArrow(_block_sums, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (distinct + 1))))).alias("base_score"), (F.col("score") - F.lit(float(np.log10(texts + prior)))).alias("score"))
