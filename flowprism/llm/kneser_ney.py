"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and mapped into memory by the workers.

Fitting:

1. Words of the training texts are counted and numbered by falling count. The vocabulary is stored as sorted arrays of
   word hashes with number and count.
2. Tasks map the vocabulary, turn texts into numbers and send sorted, combined runs of n-grams of the highest order to
   *shards*, dealt by the hash of the context. A shard merges its runs, counts each n-gram, writes the contexts as a
   sorted hash array with the following words and their counts, and sends the distinct n-grams without their
   first word to the shards of the next lower order. There an n-gram's count is the number of different words seen
   before it, as Kneser-Ney asks. One order follows another in one job.
3. How many n-grams of an order occur once, twice, three and four times gives its three discounts.

A context whose words are frequent (more than ``rows`` occurrences each) is dealt by the following word as well, so no
shard grows with a hot word; the totals of such contexts are added up by Spark and stored as arrays of their own.

Scoring: a task maps the files it needs and looks up the n-grams of a chunk in the order of their hashes, so each
file is read forwards. Nothing is broadcast but a few numbers; mapped pages are shared by all workers of a machine.

Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end. A text is preceded by one begin, which
only serves as context; n-grams that start with it keep their plain counts. The probability of a word is
``max(c - D(c), 0) / total + (D1 n1 + D2 n2 + D3 n3) / total * lower``, down to ``1 / (V + 1)``: the share of an unknown
word. A context never seen hands on to the lower order. Where an order has no n-grams with one of the four counts, or a
discount leaves its range, its discounts are 0.5, 1 and 1.5.

Word hashes have 64 bits: two words of a vocabulary of 10^8 share one with probability 0.0003.

Null and empty texts have one token, the end. Rows whose training condition is null do not train. Without training
texts every token has probability one. Repeated rows count as often as they occur and score alike. Other columns pass
through; columns named ``n_tokens``, ``n_known``, ``base_score`` or ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowprism.llm import files
from flowprism.llm import texts as T
from flowprism.llm.columns import fresh, schema_of
from flowprism.operators.numbering import rank_rows
from flowprism.session import scratch_path, stored

ORDER = 3
#: n-grams (with repeats) a shard is made for, words of a vocabulary file, bytes of text worked on at a time.
SHARD_ROWS, WORDS, CHUNK = 1 << 21, 1 << 22, 8 << 20
U = np.uint64
UNKNOWN, BEGIN = 2**32 - 2, 2**32 - 1
_END = T.hash_bytes(pa.array([b" "], pa.large_binary()))  # no word holds a space
NEXT, COUNTS, HOT = 0, 1, 2
ROW = "kind int, level int, shard int, key bigint, n array<bigint>, body binary"
_NAMES = ["kind", "level", "shard", "key", "n", "body"]
FALLBACK = (0.5, 1.0, 1.5)
RESULT = ("n_tokens", "n_known", "base_score", "score")


@dataclass
class Layout:
    """What tasks need to find a place in the files of a model."""

    path: str
    order: int
    rows: int
    bits: int
    word_bits: int
    hot: int  # words with more than ``rows`` occurrences are numbered below this
    texts: int
    tokens: int = 0
    words: int = 0

    def file(self, name: str, shard: int) -> str:
        return f"{self.path}/{name}/{shard:08d}"

    def words_by_hash(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (``UNKNOWN`` without one) and count of each word."""
        number, count = np.full(len(hashes), UNKNOWN, np.uint32), np.zeros(len(hashes), np.int64)
        for shard, at in _by_shard(hashes, self.word_bits):
            if found := files.arrays(self.file("words", shard)):
                place = np.minimum(np.searchsorted(found[0], hashes[at]), len(found[0]) - 1)
                hit = found[0][place] == hashes[at]
                number[at[hit]], count[at[hit]] = found[1][place[hit]], found[2][place[hit]]
        return number, count

    def salts(self, context: list[np.ndarray]) -> np.ndarray:
        """In how many parts a context is dealt; each holds about ``rows`` occurrences or fewer."""
        out = None
        frequent = files.arrays(f"{self.path}/frequent")[0] if self.hot else np.zeros(0, np.int64)
        for ids in context:
            n = np.ones(len(ids), np.int64)
            mine = ids < self.hot
            n[mine] = frequent[ids[mine]]
            n[ids == BEGIN] = self.texts
            out = n if out is None else np.minimum(out, n)
        return -(-out // self.rows)

    def keys(self, context: list[np.ndarray], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the context, that of its part that holds ``word``, and whether there are several parts."""
        whole = np.full(len(word), len(context), U)
        for k in range(0, len(context), 2):
            pair = context[k].astype(U) << U(32)
            pair = pair | context[k + 1].astype(U) if k + 1 < len(context) else pair
            whole = T.mix(pair) if not k else T.mix(T.mix(whole) + pair)
        salts = self.salts(context)
        several = salts > 1
        salt = np.where(several, T.mix(word.astype(U)) % np.maximum(salts, 1).astype(U), U(0))
        return whole, T.mix(whole + salt), several


def _by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard and the places of its keys, in the order of the keys."""
    order = np.argsort(keys, kind="stable")
    shard = (keys[order] >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    heads = np.flatnonzero(np.diff(shard, prepend=-1))
    for at in np.split(order, heads[1:]) if len(order) else []:
        yield int(keys[at[0]] >> U(64 - bits)) if bits else 0, at


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 2**32 else np.uint64)


def pack(columns: list[np.ndarray]) -> bytes:
    """Whole-number columns, sorted by the first, as bytes of their planes."""
    parts = [np.array([len(columns), len(columns[0])], np.int64).tobytes()]
    for k, column in enumerate(columns):
        column = np.diff(column.astype(np.int64), prepend=0) if not k else column
        column = _narrow(column)
        body = np.ascontiguousarray(column.view(np.uint8).reshape(-1, column.itemsize).T).tobytes()
        parts += [np.array([column.itemsize], np.int64).tobytes(), body]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    width, n = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for k in range(width):
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n * size, at + 8).reshape(size, n)
        column = np.ascontiguousarray(planes.T).view(f"u{size}").ravel().astype(np.int64)
        out.append(np.cumsum(column) if not k else column)
        at += 8 + n * size
    return out


def _rows(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(zip(_NAMES, types, strict=True))})


def _combined(columns: list[np.ndarray], count: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal rows made one and their counts added, sorted by ``first`` (equal for equal rows), then the columns."""
    order = np.lexsort((*reversed(columns), first))
    columns, count, first = [c[order] for c in columns], count[order], first[order]
    new = np.zeros(len(count), bool)
    new[:1] = True
    for c in (first, *columns):
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.add.reduceat(count, heads) if len(heads) else count[:0], first[heads]


def _sent(layout: Layout, level: int, columns: list[np.ndarray], count: np.ndarray) -> list[tuple]:
    """Runs of n-grams for the shards of their order."""
    if not len(count):
        return []
    if level == 1:
        shard = columns[0].astype(np.int64) // WORDS
    else:
        key = layout.keys(columns[:-1], columns[-1])[1]
        shard = (key >> U(64 - layout.bits)).astype(np.int64) if layout.bits else np.zeros(len(key), np.int64)
    columns, count, shard = _combined(columns, count, shard)
    heads = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(heads[1:], len(shard))
    return [(NEXT, level, int(shard[a]), None, None, pack([*(c[a:b] for c in columns), count[a:b]])) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]


@dataclass
class Tokens:
    """Numbers of the tokens of a chunk, each text preceded by a begin; ``at``: places of the tokens, ``depth``: tokens before."""

    ids: np.ndarray
    at: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def grams(self, n: int, depth: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of the n-grams that fit, and which tokens they end in."""
        fit = np.flatnonzero(self.depth >= n - 2 if depth is None else depth)
        ends = self.at[fit]
        return [self.ids[ends - n + 1 + k] for k in range(n)], fit


def _words(chunk: T.Chunk) -> tuple[T.Words, np.ndarray, np.ndarray]:
    words = T.split(chunk)
    at, distinct = T.codes(chunk, words, T.LOWER[chunk.data])
    return words, at, T.hash_bytes(distinct)


def tokens_of(chunk: T.Chunk, layout: Layout) -> Tokens:
    words, code, hashes = _words(chunk)
    number, count = layout.words_by_hash(np.append(hashes, _END))
    texts = np.arange(chunk.n + 1)
    first = words.first + texts
    ids = np.full(int(words.first[-1]) + 2 * chunk.n, BEGIN, np.uint32)
    total = np.full(int(first[-1]), count[-1], np.int64)
    document = words.documents()
    place = np.arange(len(words)) + document
    total[place] = count[code]
    ids[place + document + 1] = number[code]
    last = first[1:] - 1
    ids[last + texts[:-1] + 1] = number[-1]
    own = np.repeat(texts[:-1], np.diff(first))
    return Tokens(ids, np.arange(first[-1]) + own + 1, np.arange(first[-1]) - first[:-1][own], first, total)


def _word_batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for chunk in T.chunks(batch.column(0), CHUNK):
            _, code, hashes = _words(chunk)
            count = np.bincount(code, minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([T.signed(np.append(hashes, _END)), pa.array(np.append(count, chunk.n), pa.int64())], names=["hash", "n"])


def _gram_batches(layout: Layout):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for chunk in T.chunks(batch.column(0), CHUNK):
                tokens = tokens_of(chunk, layout)
                rows = []
                for n in range(2, layout.order + 1):
                    # Below the highest order only n-grams that start with a begin are counted as they are.
                    columns, fit = tokens.grams(n, None if n == layout.order else tokens.depth == n - 2)
                    rows += _sent(layout, n, columns, np.ones(len(fit), np.int64))
                yield from _rows(rows).to_batches()

    return run


def _tally(count: np.ndarray) -> list[int]:
    """n-grams that occur once, twice, three and four times, three times and more, and all occurrences."""
    return [*(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count > 2).sum()), int(count.sum())]


def _level(layout: Layout, level: int):
    """Merge the runs of an order's shard, write its file and send the next lower order on."""

    def run(table: pa.Table) -> pa.Table:
        mine = pa.compute.and_(pa.compute.equal(table["kind"], NEXT), pa.compute.equal(table["level"], level))
        other = table.filter(pa.compute.invert(mine))
        bodies = table.filter(mine)["body"].to_pylist()
        if not bodies:
            return other
        shard = table["shard"][0].as_py()
        *columns, count = (np.concatenate(c) for c in zip(*map(unpack, bodies), strict=True))
        columns = [c.astype(np.uint32) for c in columns]
        rows = []
        if level == 1:
            number = columns[0].astype(np.int64) - shard * WORDS
            before = np.bincount(number, count).astype(np.int64)
            files.put(layout.file("1", shard), [_narrow(before)])
            rows.append((COUNTS, 1, shard, None, _tally(before[before > 0]), None))
            return pa.concat_tables([other, _rows(rows).cast(other.schema)])
        whole, key, _ = layout.keys(columns[:-1], columns[-1])
        columns, count, key = _combined(columns, count, key)
        heads = np.flatnonzero(np.diff(key, prepend=key[0] ^ U(1)))
        size = np.diff(np.append(heads, len(key)))
        stats = np.stack([np.add.reduceat(x.astype(np.int64), heads) for x in (count, count == 1, count == 2, count > 2)], axis=1)
        # A context with one word seen once needs no totals.
        lone = (size == 1) & (stats[:, 0] == 1)
        alone = np.repeat(lone, size)
        starts = np.concatenate([[0], np.cumsum(size[~lone])])
        files.put(
            layout.file(str(level), shard),
            [key[heads][~lone], key[heads][lone], _narrow(starts), columns[-1][~alone], columns[-1][alone], _narrow(stats[~lone].ravel()), _narrow(count[~alone])],
        )
        rows.append((COUNTS, level, shard, None, _tally(count), None))
        whole, _, several = layout.keys([c[heads] for c in columns[:-1]], columns[-1][heads])
        for at in np.flatnonzero(several).tolist():
            rows.append((HOT, level, shard, int(whole[at].view(np.int64)), stats[at].tolist(), None))
        rows += _sent(layout, level - 1, columns[1:], np.ones(len(count), np.int64))
        return pa.concat_tables([other, _rows(rows).cast(other.schema)])

    return run


def _write(path: str, name: str, shards: int):
    """Writer of one sorted array file: a hash and whole-number columns."""

    def run(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        columns = [table[c].to_numpy()[order] for c in table.column_names if c not in ("key", "shard")]
        files.put(f"{path}/{name}/{table['shard'][0].as_py():08d}", [key[order], *map(_narrow, columns)])
        return pa.table({"shard": table["shard"].slice(0, 1)})

    return run


def _put(rows: DataFrame, path: str, name: str, bits: int) -> None:
    """``rows(key, ...)`` as sorted array files, dealt by the first bits of the key."""
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    dealt = rows.withColumn("shard", shard).groupBy("shard").applyInArrow(_write(path, name, 1 << bits), "shard int")
    dealt.agg(F.count(F.lit(1))).collect()


def _bits(rows: int, size: int) -> int:
    return max(0, (-(-rows // size) - 1).bit_length())


def discounts(tally: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = tally[:4]
    if min(n1, n2, n3, n4) < 1:
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 <= d <= k for k, d in enumerate(found, 1)) else FALLBACK


@dataclass
class Model:
    layout: Layout
    tallies: dict[int, list[int]]
    hot_bits: int = 0

    @property
    def discounts(self) -> dict[int, tuple[float, float, float]]:
        return {n: discounts(t) for n, t in self.tallies.items()}


def fit(docs: DataFrame, train: Column, *, order: int = ORDER, text: str = "text", rows: int = SHARD_ROWS) -> Model:
    """Count the texts for which ``train`` holds."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    path = scratch_path(spark, "kneser-ney")
    given = docs.where(train).select(F.col(f"`{text}`").cast("string").alias("text"))
    words = given.mapInArrow(_word_batches, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    ranked, total = rank_rows(words.withColumn("down", -F.col("n")), ["down", "hash"], "number")
    if total >= UNKNOWN:
        raise ValueError(f"{total} different words; numbers have 32 bits")
    end = int(_END.view(np.int64)[0])
    sums = ranked.agg(F.sum("n"), F.count_if(F.col("n") > rows), F.sum(F.when(F.col("hash") == end, F.col("n")))).first()
    tokens, hot, texts = (int(v or 0) for v in sums)
    layout = Layout(path, order, rows, _bits(tokens, rows), _bits(total, WORDS), hot, texts, tokens, total)
    if not total:
        return Model(layout, {n: [0] * 6 for n in range(1, order + 1)})
    _put(ranked.select(F.col("hash").alias("key"), "number", "n"), path, "words", layout.word_bits)
    if hot:
        # At most one word for each ``rows`` tokens.
        found = ranked.where(F.col("n") > rows).select("number", "n").orderBy("number").collect()
        files.put(f"{path}/frequent", [np.array([r["n"] for r in found], np.int64)])
    grams = given.mapInArrow(_gram_batches(layout), ROW)
    for level in range(order, 0, -1):
        grams = grams.groupBy("shard").applyInArrow(_level(layout, level), ROW)
    found = stored(grams.select("kind", "level", "key", "n"), "tallies")
    each = [F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(6)]
    tallies = {r["level"]: [int(r[f"n{k}"]) for k in range(6)] for r in found.where(F.col("kind") == COUNTS).groupBy("level").agg(*each).collect()}
    model = Model(layout, {n: tallies.get(n, [0] * 6) for n in range(1, order + 1)})
    if hot or texts > rows:
        totals = stored(found.where(F.col("kind") == HOT).groupBy("level", "key").agg(*each[:4]), "hot")
        model.hot_bits = _bits(totals.count(), WORDS)
        for level in range(2, order + 1):
            _put(totals.where(F.col("level") == level).drop("level"), path, f"hot-{level}", model.hot_bits)
    return model


def _find(file: list[np.ndarray], key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of the word after the context, and the totals of the context, from one shard."""
    keys, lone_keys, starts, words, lone_words, stats, counts = file
    count, totals = np.zeros(len(key), np.int64), np.zeros((len(key), 4), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == key)
        at = at[hit]
        totals[hit] = stats.reshape(-1, 4)[at]
        low, high, wanted = starts[at].astype(np.int64), starts[at + 1].astype(np.int64), word[hit]
        end = high.copy()
        # The words of a context are sorted: halve all ranges at once, those that are open.
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            less = words[middle] < wanted[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        inside = low < end
        found = np.flatnonzero(inside)
        found = found[words[low[found]] == wanted[found]]
        count[hit[found]] = counts[low[found]]
    if len(lone_keys):
        at = np.minimum(np.searchsorted(lone_keys, key), len(lone_keys) - 1)
        hit = np.flatnonzero(lone_keys[at] == key)
        totals[hit] = (1, 1, 0, 0)
        count[hit] = lone_words[at[hit]] == word[hit]
    return count, totals


def _lookup(model: Model, level: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    layout = model.layout
    whole, key, several = layout.keys(columns[:-1], columns[-1])
    count, totals = np.zeros(len(key), np.int64), np.zeros((len(key), 4), np.int64)
    for shard, at in _by_shard(key, layout.bits):
        if file := files.arrays(layout.file(str(level), shard)):
            count[at], totals[at] = _find(file, key[at], columns[-1][at])
    spread = np.flatnonzero(several)
    for shard, at in _by_shard(whole[spread], model.hot_bits):
        at = spread[at]
        if file := files.arrays(layout.file(f"hot-{level}", shard)):
            place = np.minimum(np.searchsorted(file[0], whole[at]), len(file[0]) - 1)
            hit = file[0][place] == whole[at]
            totals[at[hit]] = np.stack([c[place[hit]] for c in file[1:]], axis=1)
    return count, totals


def _discounted(count: np.ndarray, totals: np.ndarray, lower: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    total = np.maximum(totals[:, 0], 1)
    own = (count - np.array([0.0, *d])[np.minimum(count, 3)]) / total
    return np.where(totals[:, 0] > 0, np.maximum(own, 0) + (totals[:, 1:] @ np.array(d)) / total * lower, lower)


def probabilities(model: Model, tokens: Tokens) -> np.ndarray:
    """Probability of each token after its text so far."""
    layout, found = model.layout, model.discounts
    ids = tokens.ids[tokens.at]
    before = np.zeros(len(ids), np.int64)
    known = np.flatnonzero(ids < UNKNOWN)
    shard = ids[known] // np.uint32(WORDS)
    for k in np.unique(shard).tolist():
        at = known[shard == k]
        before[at] = files.arrays(layout.file("1", k))[0][ids[at] - np.uint32(k * WORDS)]
    tally = model.tallies[1]
    totals = np.broadcast_to(np.array([tally[5], tally[0], tally[1], tally[4]], np.int64), (len(ids), 4))
    p = _discounted(before, totals, np.full(len(ids), 1 / (layout.words + 1)), found[1])
    for n in range(2, layout.order + 1) if layout.words else []:
        columns, fit = tokens.grams(n)
        seen = np.ones(len(fit), bool)
        for c in columns[:-1]:
            seen &= c != UNKNOWN
        fit, columns = fit[seen], [c[seen] for c in columns]
        count, totals = _lookup(model, n, columns)
        p[fit] = _discounted(count, totals, p[fit], found[n])
    return p


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``base_score`` and ``score``."""
    kept = [c for c in docs.columns if c not in RESULT]
    (given,) = fresh([*kept, *RESULT], "text")
    schema = ", ".join([schema_of(docs, kept), "n_tokens bigint, n_known bigint, base_score double, score double"])
    layout = model.layout

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for chunk in T.chunks(batch.column(len(kept)), CHUNK):
                tokens = tokens_of(chunk, layout)
                heads = tokens.first[:-1]
                logs = np.log10(probabilities(model, tokens))
                base = np.log10((tokens.count + 1) / (layout.tokens + layout.words + 1))
                sums = [np.diff(tokens.first), *(np.add.reduceat(x, heads) for x in ((tokens.count > 0).astype(np.int64), base, logs))]
                rows = batch.slice(chunk.at, chunk.n)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *map(pa.array, sums)], names=[*kept, *RESULT])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(given)).mapInArrow(run, schema)


def held_out(row_id: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves 2 modulo 7; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit(""))) % 7 == 2


def score_documents(docs: DataFrame, *, order: int = ORDER, rows: int = SHARD_ROWS) -> DataFrame:
    """Fit on the rows that are not held out and score all: one row for each document."""
    model = fit(docs, ~held_out(), order=order, rows=rows)
    out = score(docs.select("doc_id", "text"), model)
    tokens = F.lit(model.layout.tokens).cast("bigint").alias("train_tokens")
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")
