"""Passages of held-out items inside a corpus, found with a generalised suffix automaton.

The items are normalised to words and put into one suffix automaton; a document's words are streamed
through it, which gives at each word the length of the longest passage that ends there and occurs in an
item. A set of items larger than one automaton should be is taken in blocks: every block is streamed
against all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycast.llm.words import WORD, words
from quarrycast.runtime import ship

MIN_WORDS = 12  #: shortest shared passage
BLOCK_MB = 16  #: MB of item texts in one automaton; a worker needs about 40 times that


class Automaton:
    """Suffix automaton of the word sequences of (id, words) items."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.least = min_words
        owners: dict[int, set[int]] = defaultdict(set)
        for item, tokens in items:
            last = 0
            for w in tokens:
                last = self._extend(last, w)
                owners[last].add(item)
        # a state holds the items of all states whose link it is
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if owners.get(v) and self.len[self.link[v]] >= min_words:
                owners[self.link[v]] |= owners[v]
        # of each state of at least min_words: the shortest such suffix, which has the most items
        self.top = list(range(len(self.len)))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if self.len[self.link[v]] >= min_words:
                self.top[v] = self.top[self.link[v]]
        self.items = {v: frozenset(owners[v]) for v in {*self.top} if self.len[v] >= min_words}

    def _clone(self, p: int, q: int, w: str) -> int:
        """A copy of state q for the passages that reach it from p by w."""
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:  # a passage that an earlier item has
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return cur

    def matches(self, tokens: Iterable[str]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(position, length, items) wherever the longest passage that ends there has min_words or more."""
        nxt, link, length, top, least = self.next, self.link, self.len, self.top, self.least
        v = n = 0
        for i, w in enumerate(tokens):
            u = nxt[v].get(w)
            while u is None and v:
                v = link[v]
                n = length[v]
                u = nxt[v].get(w)
            if u is None:
                n = 0
                continue
            v = u
            n += 1
            if n >= least:
                yield i, n, self.items[top[v]]


_held: tuple[object, Automaton] | None = None


def _automaton(items, least: int) -> Automaton:
    """The automaton of broadcast items, built once in each worker."""
    global _held
    key = (items.value, least)
    if _held is None or _held[0] != key:
        _held = key, Automaton(((i, t.split(" ")) for i, t in items.value), least)
    return _held[1]


def _blocks(items: DataFrame, item_id: str, text: str, block_mb: float) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of about block_mb; only one block at a time is on the driver."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and length(trim(t)) > 0")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // int(block_mb * 1e6)))
    for b in range(n if size else 0):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) if n > 1 else rows
        yield sorted({(r.i, " ".join(words(r.t))) for r in part.toLocalIterator()})


def _scan(df: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str, block_mb: float, least: int, run, schema: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    out = None
    for block in _blocks(items, item_id, item_text, block_mb):
        shared = spark.sparkContext.broadcast(block)

        def each(batches, shared=shared):
            auto = _automaton(shared, least)
            for batch in batches:
                yield from run(auto, batch.column("k"), batch.column("t").to_pylist())

        part = rows.mapInArrow(each, f"k {rows.schema['k'].dataType.simpleString()}, {schema}")
        out = part if out is None else out.unionByName(part)
    empty = spark.createDataFrame([], f"k {rows.schema['k'].dataType.simpleString()}, {schema}")
    return (empty if out is None else out).withColumnRenamed("k", key)


def find(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_mb: float = BLOCK_MB) -> DataFrame:
    """(key, item_id) of every document and item that share at least min_words consecutive words.

    One map over the documents for each block of items, no shuffle. A pair comes once for each row of df, so
    repeated rows with one key give repeated pairs. Null and wordless texts share nothing; items shorter than
    min_words can't leak. No documents or no items: no rows.
    """

    def run(auto, keys, texts):
        at, found = [], []
        for i, t in enumerate(texts):
            hit: set[int] = set()
            for _, _, own in auto.matches(WORD.findall(t.lower())):
                hit |= own
            at += [i] * len(hit)
            found += sorted(hit)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(found, pa.int64())], ["k", "item_id"])

    return _scan(df, key, text, items, item_id, item_text, block_mb, min_words, run, "item_id bigint").withColumnRenamed("item_id", item_id)


def spans(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_mb: float = BLOCK_MB) -> DataFrame:
    """(key, begin, until, n_words): the merged character spans of df's texts that items share.

    begin counts code points from 0, until is exclusive. Documents without a shared passage have no row.
    """

    def run(auto, keys, texts):
        cols: list[list[int]] = [[], [], [], []]
        for i, t in enumerate(texts):
            low = t.lower()
            if len(low) != len(t):  # characters that grow when lowered: keep positions by lowering each alone
                low = "".join(x if len(x := c.lower()) == 1 else c for c in t)
            at = [m.span() for m in WORD.finditer(low)]
            merged: list[list[int]] = []
            for p, n, _ in auto.matches(low[a:b] for a, b in at):
                if merged and p - n + 1 <= merged[-1][1] + 1:
                    merged[-1] = [min(merged[-1][0], p - n + 1), p]
                else:
                    merged.append([p - n + 1, p])
            for a, b in merged:
                for c, x in zip(cols, (i, at[a][0], at[b][1], b - a + 1)):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int32())), *(pa.array(c, pa.int32()) for c in cols[1:])], ["k", "begin", "until", "n_words"])

    return _scan(df, key, text, items, item_id, item_text, block_mb, min_words, run, "begin int, until int, n_words int")


def without_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", max_coverage: float = 0.5, **kw) -> DataFrame:
    """(key, text, leaked_share) with all shared spans cut out of the texts; a document of which they cover
    more than max_coverage has the empty text. Null texts stay null. key must be unique in df."""
    cuts = spans(df, items, key, text, **kw).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("begin", "until"))).alias("cuts"))
    rows = df.select(key, text).join(cuts, key, "left")
    size = F.greatest(F.char_length(text), F.lit(1))
    # spans of different blocks can overlap: each cut begins where the earlier ones end
    kept = F.aggregate(
        "cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("gone")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c["begin"] > s["at"], F.substring(F.col(text), s["at"] + 1, c["begin"] - s["at"])).otherwise("")).alias("out"),
            F.greatest(s["at"], c["until"]).alias("at"),
            (s["gone"] + F.greatest(c["until"] - F.greatest(c["begin"], s["at"]), F.lit(0))).alias("gone"),
        ),
        lambda s: F.struct(F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.char_length(text))).alias("out"), (s["gone"] / size).alias("share")),
    )
    rows = rows.withColumn("kept", kept)
    share = F.coalesce(F.col("kept.share"), F.lit(0.0))
    return rows.select(key, F.when(share > max_coverage, F.lit("")).otherwise(F.coalesce(F.col("kept.out"), F.col(text))).alias(text), share.alias("leaked_share"))
