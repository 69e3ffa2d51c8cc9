"""Byte-level BPE by recursive DuckDB queries inside each Spark task.

Texts are cut by the pre-token pattern; each distinct pre-token is encoded once. A token-position table
``(word, pos, token)`` joins the merge table; every round contracts each word's leftmost pair of minimum
rank, and words without a mergeable pair leave the recursion. In words over ``SHORT_BYTES`` long, all
occurrences of the pair are contracted in one round where no later merge can rank below it (a property of
the vocabulary, computed once), which gives the same result in fewer rounds. Decoding joins ids with the
vocabulary and aggregates the bytes in token order.

Rounds work on at most ``WORDS_PER_QUERY`` words; encoded words are kept per Python worker, up to
``CACHED_WORDS``, under their bytes. Decoded bytes are compared with the text. No shuffle takes place. Null and empty texts have no tokens; repeated rows are encoded like any other; other
columns pass through, and columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowprism.llm import texts as T

WORDS_PER_QUERY = 20_000
SHORT_BYTES = 64
CACHED_WORDS = 1_500_000
MOST_TOKENS = 2_000_000
LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3

#: The pre-token pattern whose cuts ``cut`` computes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Short words: the leftmost pair of minimum rank, by joins on the position of the next token.
ENCODE = """
with recursive rows(word, pos, token, next, live) as (
    select word, pos, token, next, true from start
  union all
    (with paired as (
        select r.word, r.pos, r.token, r.next, n.next as after, m.merged, m.merged::bigint * 4294967296 + r.pos as key
        from rows r left join rows n on n.pos = r.next left join merges m on m.first = r.token and m.second = n.token
        where r.live),
    best as (
        select word, min(key) as key, min(key) % 4294967296 as place, arg_min(next, key) as gone
        from paired where key is not null group by word)
    select p.word, p.pos, case when p.pos = b.place then merged else token end,
        case when p.pos = b.place then after else next end, b.word is not null
    from paired p left join best b on b.word = p.word where p.pos is distinct from b.gone)
)
select word, token from rows where not live order by word, pos
"""

#: Long words: every occurrence of the minimum-rank pair where that is safe, else the leftmost.
ENCODE_LONG = """
with recursive rows(word, pos, token, live) as (
    select word, pos, token, true from start
  union all
    (with paired as (
        select word, pos, token, lead(token) over (partition by word order by pos) as following,
            row_number() over (partition by word order by pos) as place
        from rows where live),
    ranked as (
        select p.word, p.pos, p.token, p.place, m.merged, m.safe, min(m.merged) over (partition by p.word) as best
        from paired p left join merges m on m.first = p.token and m.second = p.following),
    hits as (
        select *, coalesce(merged = best, false) as hit,
            place - coalesce(max(case when merged = best then null else place end)
                over (partition by word order by place rows between unbounded preceding and current row), 0) as run,
            sum(case when merged = best then 1 else 0 end)
                over (partition by word order by place rows between unbounded preceding and current row) as nth
        from ranked),
    taken as (select *, hit and run % 2 = 1 and (safe or nth = 1) as take from hits),
    shadowed as (select *, coalesce(lag(take) over (partition by word order by place), false) as gone from taken)
    select word, pos, case when take then merged else token end, best is not null from shadowed where not gone)
)
select word, token from rows where not live order by word, pos
"""

#: One thread aggregates rows in the order in which the sort hands them on; an order inside the aggregate sorts
#: every document apart and takes three times as long. The result is compared with the text.
DECODE = """
select document, string_agg(bytes, '') as bytes
from (select t.document, v.bytes from tokens t join vocabulary v on v.token = t.token order by t.pos)
group by document
"""


def read_ranks(path: str, most: int = MOST_TOKENS) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file on the driver; ``most`` bounds what is sent to the executors."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > most:
        raise ValueError(f"{len(ranks)} tokens; at most {most} are broadcast")
    return ranks


class Vocabulary:
    """Merge table, bytes of tokens and character classes, as arrays that are broadcast once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        lowest = dict.fromkeys(ranks.values(), len(ranks) + 1)
        merges = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                head, tail = ranks.get(token[:i]), ranks.get(token[i:])
                if head is not None and tail is not None:
                    merges.append((head, tail, rank))
                for part in (head, tail):
                    if part is not None:
                        lowest[part] = min(lowest[part], rank)
        self.merges = np.array(merges, np.int32).reshape(-1, 3)
        # After a merge, each new pair begins or ends with the new token: none may rank below it.
        self.safe = np.array([lowest[c] > c for c in self.merges[:, 2]], bool)
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.bytes = np.array(single, np.int32)
        codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, codes))
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, text):
                self.classes[codes[m.start()] : codes[m.end() - 1] + 1] = kind


def cut(chunk: T.Chunk, classes: np.ndarray) -> T.Words:
    """The matches of PATTERN in each document, as byte spans; together they cover every byte."""
    text = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(text)
    lead = np.append(np.flatnonzero((chunk.data & 0xC0) != 0x80), len(chunk.data))
    if not n:
        none = np.zeros(0, np.int64)
        return T.Words(none, none, np.zeros(chunk.n + 1, np.int64))
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, chunk.offsets)] = True
    kind = classes[text]
    begin = edge[:n].copy()
    begin[0] = True
    begin[1:] |= kind[1:] != kind[:-1]
    ends = np.append(begin[1:], True)
    white = kind == WHITE
    start = begin.copy()
    # The last white character before a visible one stands alone, or joins it if it is a plain space.
    last = white & ends & ~edge[1:]
    start |= last
    joined = np.flatnonzero(last & (text == 32)) + 1
    start[joined] = False
    # A lone apostrophe that no space precedes takes a short ending from the letters after it.
    alone = np.flatnonzero((text == 39) & begin & ends & start & ~edge[1:])
    if len(alone):
        at = lambda i: np.where(i < n, text[np.minimum(i, n - 1)], 0)
        one, two = at(alone + 1), np.where(edge[np.minimum(alone + 2, n)], 0, at(alone + 2))
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            length = np.where((one == ord(a)) & (two == ord(b)), 2, length)
        alone, length = alone[length > 0], length[length > 0]
        start[alone + 1] = False
        after = alone + 1 + length
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    places = lead[starts]
    return T.Words(places, np.append(places[1:], len(chunk.data)), np.searchsorted(places, chunk.offsets))


class Coder:
    """Encodes and decodes in one process, with a private in-memory DuckDB."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb

        self.vocabulary = vocabulary
        self.con = duckdb.connect()
        self.con.execute("set threads = 1")
        self.con.execute("set memory_limit = '400MB'")
        m = vocabulary.merges
        self._put("merges", {"first": pa.array(m[:, 0]), "second": pa.array(m[:, 1]), "merged": pa.array(m[:, 2]), "safe": pa.array(vocabulary.safe)})
        tokens = list(vocabulary.ranks.items())
        # Latin-1 text stands for bytes: one character per byte, so string_agg can join them.
        self._put("vocabulary", {"token": pa.array([r for _, r in tokens], pa.int32()), "bytes": pa.array([b.decode("latin-1") for b, _ in tokens])})
        self.forget()

    def _put(self, name: str, columns: dict) -> None:
        self.con.register("_new", pa.table(columns))
        self.con.execute(f"create or replace temp table {name} as select * from _new")
        self.con.unregister("_new")

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        out: list = [None] * len(words)
        short, long = [], []
        for i, word in enumerate(words):
            whole = self.vocabulary.ranks.get(word)
            if whole is None:
                (short if len(word) <= SHORT_BYTES else long).append(i)
            else:
                out[i] = np.array([whole], np.int32)
        for left, sql in ((short, ENCODE), (long, ENCODE_LONG)):
            for a in range(0, len(left), WORDS_PER_QUERY):
                part = left[a : a + WORDS_PER_QUERY]
                for i, ids in zip(part, self._contract([words[i] for i in part], sql), strict=True):
                    out[i] = ids
        return out

    def _contract(self, words: list[bytes], sql: str) -> list[np.ndarray]:
        """Run the recursion over the byte positions of some words."""
        sizes = np.array([len(word) for word in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        following = np.arange(1, len(data) + 1, dtype=np.int64)
        following[np.cumsum(sizes) - 1] = -1
        start = {
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": np.arange(len(data), dtype=np.int64),
            "token": self.vocabulary.bytes[data],
            "next": following,
        }
        self._put("start", {name: pa.array(column) for name, column in start.items()})
        found = self.con.execute(sql).fetchnumpy()
        bounds = np.searchsorted(found["word"], np.arange(len(words) + 1))
        tokens = np.asarray(found["token"], np.int32)
        return [tokens[bounds[k] : bounds[k + 1]] for k in range(len(words))]

    def encode(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all documents of a chunk, and for each document where its ids begin."""
        words = cut(chunk, self.vocabulary.classes)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(chunk.n + 1, np.int64)
        codes, distinct = T.codes(chunk, words)
        distinct = distinct.to_pylist()
        new = [word for word in distinct if word not in self.known]
        if new:
            self._remember(new, self.encode_words(new))
        place = np.array([self.known[word] for word in distinct], np.int64)
        at, size = self.at[place], self.size[place]
        each = size[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(at[codes] - total[:-1], each) + np.arange(total[-1])]
        return ids, total[words.first]

    def _remember(self, words: list[bytes], found: list[np.ndarray]) -> None:
        size = np.array([len(f) for f in found], np.int64)
        at = len(self.flat) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.known.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, *found])
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Bytes of each document from its ids."""
        n = len(starts) - 1
        out = [b""] * n
        document = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
        self.con.register("tokens", pa.table({"document": pa.array(document), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "token": pa.array(ids)}))
        found = self.con.execute(DECODE).fetchall()
        self.con.unregister("tokens")
        for i, text in found:
            out[i] = text.encode("latin-1")
        return out

    def round_trip(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        if len(self.known) > CACHED_WORDS:
            self.forget()
        ids, starts = self.encode(chunk)
        decoded = self.decode(ids, starts)
        if b"".join(decoded) != chunk.data.tobytes():
            raise RuntimeError("decoded bytes differ from the text")
        return ids, starts, decoded


_CODERS: dict[str, Coder] = {}


def _coder(name: str, vocabulary) -> Coder:
    """One coder per Python worker and vocabulary."""
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(vocabulary.value)
    return _CODERS[name]


def shared_vocabulary(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (binary), through the rank file at ``path``."""
    spark = docs.sparkSession
    vocabulary = shared_vocabulary(spark, path)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "ids array<int>", "decoded binary"])
    text = kept.index("text")

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for chunk in T.chunks(batch.column(text)):
                ids, starts, decoded = _coder(path, vocabulary).round_trip(chunk)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                rows = batch.slice(chunk.at, chunk.n)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(decoded, pa.binary())], names=[*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs, path).drop("decoded")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of the ids in the column ``ids``."""
    vocabulary = shared_vocabulary(tokens.sparkSession, path)
    kept = [c for c in tokens.columns if c != "decoded"]
    schema = ", ".join([*(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept), "decoded binary"])
    at = kept.index("ids")

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids = batch.column(at)
            sizes = np.array([0 if i is None else len(i) for i in ids], np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            decoded = _coder(path, vocabulary).decode(flat, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*kept, "decoded"])

    return tokens.select(*kept).mapInArrow(batches, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of a round trip of every document."""
    coded = round_trip(docs.select("doc_id", F.col("text").cast("string").alias("text")), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
