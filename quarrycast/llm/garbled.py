"""Texts decoded with a wrong encoding, restored by minimum description length.

Every segment of a text gets candidate decodings: chains of steps that take characters back to the bytes of
the encoding they were read with and read those as UTF-8 (once or repeatedly), or as another legacy encoding.
The description length of a candidate is that of its characters, each after the one before it, under the counts of
pairs of characters of the language that gives the least (interpolated by Witten and Bell with the counts of
characters), with the language's share and the cost of its chain. The shortest wins; without a gain the segment stays
unchanged. A replacement character says that a part is lost.

The counts are those of all clean texts of all languages; their number is bounded by the pairs of characters that
languages use, not by the texts. What a pattern can't tell from clean text is kept out by a second pass over all
texts: those that a chain makes shorter under the pairs of characters of the other texts. All segments of all texts
with characters beyond ASCII are then examined.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycast.runtime import ship

STEP_COST = 1.0  #: bytes that each step of a chain costs
LEGACY_COST = 4.0  #: more bytes for a step to a legacy encoding, which nearly any character allows
DEPTH = 3  #: most steps of a chain
SEGMENT = 600  #: characters after which a segment is cut at the next space, or else after
LONGEST = 6_000  #: characters, where there is no space
AROUND = 64  #: characters before LONGEST among which a cut that splits no garbled character is sought

PLAIN_BITS = 6.0  #: that a pair of ASCII characters costs in the second pass over the sample
UNSEEN = 2.0**-17  #: share of each character among those that a language lacks
PAIRS_KEPT = 200_000  #: counts of pairs that a worker gathers before it sends them on
SEGMENTS_KEPT = 20_000  #: segments that a worker remembers as unchanged

LOST = "\N{REPLACEMENT CHARACTER}"
# --- fixed values: encodings --------------------------------------------------------------------------------
READ_AS = ["cp1252", "cp1251", "cp437", "mac_roman", "cp850", "cp1250"]  #: what UTF-8 is taken for
#: (taken for, real) of other confusions; cp1252 stands for Latin-1 too.
LEGACY = [("cp1252", e) for e in ("cp1251", "koi8_r", "cp866", "iso8859_5", "gb18030", "big5", "cp932", "euc_jp", "euc_kr", "cp1250", "iso8859_2", "mac_roman", "cp437", "cp850")]
LEGACY += [("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"), ("iso8859_5", "koi8_r"), ("cp1250", "cp1252"), ("iso8859_2", "cp1250")]
# -------------------------------------------------------------------------------------------------------------


def _bytes_of(encoding: str) -> dict[str, int]:
    """The byte of each character of an encoding; C1 controls stand for bytes that it leaves undefined or, in
    Latin-1 fashion, for themselves."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    return out


_MAPS = {e: _bytes_of(e) for e in [*READ_AS, *(a for a, _ in LEGACY)]}


#: Translations to the character whose code is the byte, so that Latin-1 gives the bytes.
_LATIN = {e: {ord(c): b for c, b in t.items()} for e, t in _MAPS.items()}


def _classes(table: dict[str, int]) -> tuple[str, str, str, str]:
    pick = lambda a, b: "[" + "".join(re.escape(c) for c, x in table.items() if a <= x <= b) + "]"
    return pick(0xC2, 0xDF), pick(0xE0, 0xEF), pick(0xF0, 0xF4), pick(0x80, 0xBF)


_SEQUENCE = {}
for _e in READ_AS:
    _two, _three, _four, _cont = _classes(_MAPS[_e])
    _SEQUENCE[_e] = re.compile(f"(?:{_four}{_cont}{{3}}|{_three}{_cont}{{2}}|{_two}{_cont})")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_TWO = re.compile(r"[^\x00-\x7f]{2}")  #: what every sequence of bytes in UTF-8 was read as has
_AROUND = re.compile(r"[\x00-\x7f]?(?:[^\x00-\x7f]+[\x00-\x7f]?)+", re.S)  #: all pairs with a character beyond ASCII lie in one of these, and hardly any others
_any = lambda t: "".join(re.escape(c) for c in t)
_HIGH = {a: re.compile(f"[{_any(_MAPS[a])}]") for a, _ in LEGACY}
_RUN = {a: re.compile(f"[\\x00-\\x7f{_any(_MAPS[a])}]+") for a, _ in LEGACY}
#: Legacy encodings of one byte a character: what each character read as one of them is in the other, or LOST.
_ONE = {(a, e): {ord(c): bytes([b]).decode(e, "replace") for c, b in _MAPS[a].items()} for a, e in LEGACY if e not in ("gb18030", "big5", "cp932", "euc_jp", "euc_kr")}
_SPLIT = re.compile(r"((?<=[.!?。！？।])\s+|\n+)")
#: What clean texts must not have, as a Java pattern: likely sequences, controls, symbols glued to letters.
UNCLEAN = r"[\x{0080}-\x{009F}\x{FFFD}\x{F8FF}]|[ÂÃ][\x{00A0}-\x{00BF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|â[€‚„]|[ÄÅ][\x{00A0}-\x{00BF}‚„…†‡ˆ‰Š‹ŒŽ™š›œžŸ]|[├┼┬─ΓÔ╨╤╪┘]|√[\P{L}\p{L}]|‚Ä|¬[øø°]|[ГРС][\x{00A0}-\x{00BF}ЂЃѓ‚„…†‡€‰Љ‹ЊЌЋЏђљњќћџЎўЈҐЁЄЇІіґєјЅѕї№]|вЂ|\p{L}[¡-©«-´¶-¹»-¿]\p{L}|\p{L}[¹³¿œŸ]\s|[\x{00C0}-\x{00FF}]{4}|[\x{00A1}-\x{00BF}]{2}|ï[¼½]|à[¤¥]"


def decode_once(text: str, encoding: str) -> str:
    """text with every valid UTF-8 sequence that was read as encoding decoded."""
    table = _LATIN[encoding]

    def back(m: re.Match) -> str:
        try:
            return m[0].translate(table).encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _SEQUENCE[encoding].sub(back, text)


def decode_legacy(text: str, taken: str, real: str) -> str | None:
    """text with each run of characters of the encoding that it was taken for read as the real one; None where
    that is impossible."""
    one = _ONE.get((taken, real))
    if one:
        new = _FOREIGN.sub(lambda m: m[0].translate(one), text)
        return None if new == text or new.count(LOST) > text.count(LOST) else new
    table = _LATIN[taken]
    out, at = [], 0
    for m in _RUN[taken].finditer(text):
        if not _HIGH[taken].search(m[0]):
            continue
        try:
            new = m[0].translate(table).encode("latin-1").decode(real)
        except UnicodeDecodeError:
            return None
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join([*out, text[at:]]) if out else None


#: ASCII, punctuation and currencies, which all languages share: texts that lack one say nothing about it.
_NEUTRAL = np.array([*range(0x20, 0x7F), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C1), *range(0xA3, 0xA6)])
_BITS = 21  #: of a character in the code of a pair


def candidates(segment: str) -> dict[str, float]:
    """Each decoding of segment with the cost of its chain, segment itself among them."""
    found, edge = {segment: 0.0}, [segment]
    for depth in range(DEPTH):
        new = []
        for s in edge:
            options = [(decode_once(s, e), STEP_COST) for e in READ_AS] if _TWO.search(s) else []
            if depth == 0:
                options += [(x, STEP_COST + LEGACY_COST) for a, e in LEGACY if (x := decode_legacy(s, a, e)) is not None]
            for t, cost in options:
                if t not in found:
                    found[t] = found[s] + cost
                    new.append(t)
        edge = new
    return found


def _apart(head: str, tail: str, depth: int = DEPTH) -> bool:
    """Whether no chain of decodings as UTF-8 joins the end of head with the start of tail."""
    for e in READ_AS:
        h, t, both = decode_once(head, e), decode_once(tail, e), decode_once(head + tail, e)
        if h + t != both or (depth > 1 and both != head + tail and not _apart(h, t, depth - 1)):
            return False
    return True


def _cut(p: str) -> int:
    """The place near LONGEST where a text without spaces is cut: between garbled characters, not inside one."""
    places = [c for c in range(LONGEST, LONGEST - AROUND, -1) if _apart(p[c - AROUND : c], p[c : c + AROUND])]
    # half a character of a legacy encoding at the end makes the decoding impossible
    return max(places, key=lambda c: sum(decode_legacy(p[:c], a, e) is not None for a, e in LEGACY), default=LONGEST)


def _characters(text: str) -> np.ndarray:
    """The codes of the characters of text, all digits of ASCII as one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((c >= 48) & (c <= 57), 48, c)


def _pairs(text: str) -> np.ndarray:
    c = _characters(text)
    return c[:-1] << _BITS | c[1:]


def _found(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value, the length of sorted_ where it is missing."""
    at = np.searchsorted(sorted_, wanted)
    return np.where(np.append(sorted_, -1)[at] == wanted, at, len(sorted_))


class Counts:
    """The pairs of characters of texts: sorted codes, how often each comes, and the number of texts as its length."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, texts: int):
        self.codes, self.n, self.texts = codes, n, texts

    def __len__(self) -> int:
        return self.texts

    @classmethod
    def of(cls, texts: list[str]) -> Counts:
        return cls(*np.unique(np.concatenate([_pairs(t) for t in texts] or [np.zeros(0, np.int64)]), return_counts=True), len(texts))


class Others:
    """Description lengths of parts of a text under the pairs of characters of all other texts; counts holds in how
    many texts each pair is, only pairs with a character beyond ASCII."""

    def __init__(self, counts: Counts):
        self.codes, self.seen = counts.codes, np.append(counts.n, 0)
        self.total = int(counts.n.sum()) + 1

    def lengths(self, texts: list[str], own: np.ndarray) -> np.ndarray:
        """Bytes of each text; own are the pairs of the text that it is part of, of which one is not another's."""
        parts = [_pairs(t) for t in texts]
        pairs, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        far = _is_foreign(pairs)
        others = self.seen[_found(self.codes, pairs[far])] - (_found(own, pairs[far]) < len(own))
        bits = np.bincount(of[far], np.log2(self.total / (np.maximum(others, 0) + 0.5)), len(parts))
        return (bits + PLAIN_BITS * np.bincount(of[~far], minlength=len(parts))) / 8

    def garbled(self, text: str) -> bool:
        """Whether a chain makes a segment of text, one of those counted, shorter."""
        own = None
        for p in _segments(text):
            if p.isascii() or p.isspace():
                continue
            found = candidates(p)
            if len(found) == 1:
                continue
            own = _foreign_pairs(text) if own is None else own
            lengths = self.lengths([*found], own) + [*found.values()]  # the first is p itself
            if lengths[1:].min() < lengths[0]:
                return True
        return False


def _is_foreign(pairs: np.ndarray) -> np.ndarray:
    """Which have a character beyond ASCII."""
    return (pairs >> _BITS > 127) | (pairs & 2**_BITS - 1 > 127)


def _foreign_pairs(text: str) -> np.ndarray:
    """The pairs of characters of text, each once, with a character beyond ASCII."""
    pairs = _pairs(text)
    return np.unique(pairs[_is_foreign(pairs)])


def _segments(text: str) -> Iterator[str]:
    """The parts that text is examined in; joined they are text."""
    for p in _SPLIT.split(text):
        while len(p) > SEGMENT:
            cut = p.find(" ", SEGMENT, LONGEST)
            if cut < 0 and len(p) <= LONGEST:
                break
            cut = cut if cut > 0 else _cut(p)
            yield p[:cut]
            p = p[cut:]
        yield p


class Model:
    """Description lengths under the pairs of characters of each language, given as Counts or as texts."""

    def __init__(self, languages: dict[str, Counts | list[str]]):
        held = [c if isinstance(c, Counts) else Counts.of(c) for c in languages.values()]
        held = [c for c in held if len(c.codes)]
        self.same: set[str] = set()  # segments found unchanged
        self.chars = np.unique(np.concatenate([_NEUTRAL, *[x for c in held for x in (c.codes >> _BITS, c.codes & 2**_BITS - 1)]]))
        self.size = len(held)
        v = len(self.chars) + 1  # the last for characters that no language has
        neutral = np.append(np.isin(self.chars, _NEUTRAL), False)
        total = sum(int(c.n.sum()) for c in held)
        # bits of a character as such, of leaving what follows a character for that, and what a known pair saves of both
        self.alone, self.leaving, self.share = np.zeros((v, self.size), np.float32), np.zeros((v, self.size), np.float32), np.zeros(self.size)
        codes, lang, saved = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for k, c in enumerate(held):
            a, b = np.searchsorted(self.chars, c.codes >> _BITS), np.searchsorted(self.chars, c.codes & 2**_BITS - 1)
            after, kinds, n = np.bincount(a, c.n, v), np.bincount(a, minlength=v), np.bincount(b, c.n, v)
            distinct = (n > 0).sum()
            share = (n + neutral + distinct * UNSEEN) / (n.sum() + neutral.sum() + distinct)
            new = np.where(after > 0, kinds / np.maximum(after + kinds, 1), 1.0)
            self.alone[:, k], self.leaving[:, k], self.share[k] = -np.log2(share), -np.log2(new), np.log2(total / c.n.sum())
            codes.append(c.codes)
            lang.append(np.full(len(a), k, np.int32))
            saved.append((np.log2((c.n + kinds[a] * share[b]) / (after[a] + kinds[a])) - np.log2(new[a] * share[b])).astype(np.float32))
        order = np.argsort(np.concatenate(codes), kind="stable")
        self.pairs, self.first = np.unique(np.concatenate(codes)[order], return_index=True)
        self.first = np.append(self.first, [len(order)] * 2)
        self.lang, self.saved = np.concatenate(lang)[order], np.concatenate(saved)[order]
        self.both = self.alone + self.leaving

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bytes of each text, none of them empty, under the language that gives the least."""
        parts = [_characters(t) for t in texts]
        if not self.size:
            return np.array([len(t.encode("utf-8", "replace")) for t in texts], float)
        starts = np.cumsum([0, *map(len, parts)])
        every = np.concatenate(parts)
        at = _found(self.chars, every)
        bits = np.add.reduceat(self.both[at], starts[:-1], axis=0, dtype=np.float64) - self.leaving[at[starts[1:] - 1]]
        inner = np.ones(len(every), bool)
        inner[starts[1:] - 1] = False  # the last of a text is followed by nothing
        inner = np.flatnonzero(inner)
        pair = _found(self.pairs, every[inner] << _BITS | every[inner + 1] if len(inner) else inner)
        n = self.first[pair + 1] - self.first[pair]
        entry = np.repeat(self.first[pair] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(starts))[inner], n)
        bits -= np.bincount(text * self.size + self.lang[entry], self.saved[entry], len(texts) * self.size).reshape(bits.shape)
        return (bits + self.share).min(axis=1) / 8

    def best(self, segment: str) -> str:
        """The candidate decoding of least description length, the segment itself among them."""
        found = candidates(segment)
        if len(found) == 1:
            return segment
        rated = sorted(zip(self.lengths([*found]) + [*found.values()], found.values(), found))
        return rated[0][2]

    def restore(self, text: str) -> str:
        """text with each garbled segment restored."""
        if text.isascii():
            return text
        return "".join(map(self._piece, _segments(text)))

    def _piece(self, p: str) -> str:
        if p.isascii() or p.isspace() or p in self.same:
            return p
        new = self.best(p)
        if new == p:
            if len(self.same) >= SEGMENTS_KEPT:
                self.same.clear()
            self.same.add(p)
        return new


def _summed(rows: DataFrame) -> dict[str, Counts]:
    """(l, code, n) of all workers as Counts; code -1 has the number of texts."""
    t = rows.groupBy("l", "code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = t["code"].to_numpy(), t["n"].to_numpy()
    names = t["l"].combine_chunks().dictionary_encode() if t.num_rows else None
    out = {}
    for k, name in enumerate(names.dictionary.to_pylist() if names is not None else []):
        here = np.flatnonzero(names.indices.to_numpy() == k)
        here = here[np.argsort(codes[here])]
        texts = codes[here] < 0
        out[name] = Counts(codes[here][~texts], n[here][~texts], int(n[here][texts].sum()))
    return dict(sorted(out.items()))


def _counted(gathered: dict[str, list[np.ndarray]], texts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for name, parts in gathered.items():
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        codes, n = np.append(codes, -1), np.append(n, texts[name])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["l", "code", "n"])
    gathered.clear()
    texts.clear()


def _gather(rows: Iterable[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(l, code, n) of the pairs of each (l, pairs), summed over some texts at a time."""
    gathered, texts, size = defaultdict(list), defaultdict(int), 0
    for name, pairs in rows:
        gathered[name].append(pairs)
        texts[name] += 1
        size += len(pairs)
        if size > PAIRS_KEPT:
            yield from _counted(gathered, texts)
            size = 0
    yield from _counted(gathered, texts)


def fit(df: DataFrame, text: str, lang: str) -> dict[str, Counts]:
    """The pairs of characters of all clean texts of each language code, without texts that the others show to be
    garbled."""
    ship(df.sparkSession)
    code: Column = F.lower(F.regexp_extract(F.coalesce(F.col(lang), F.lit("und")), r"^([A-Za-z]{2,3})", 1))
    rows = df.where(F.col(text).isNotNull()).select(code.alias("l"), F.col(text).cast("string").alias("t")).where(~F.col("t").rlike(UNCLEAN))
    schema = "l string, code bigint, n bigint"

    def in_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gather(("", _foreign_pairs(t)) for b in batches for t in b.column("t").to_pylist() if not t.isascii())

    pooled = _summed(rows.select("t").mapInArrow(in_texts, schema)).get("", Counts.of([]))
    shared = df.sparkSession.sparkContext.broadcast(Others(pooled))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = shared.value
        each = ((name, t) for b in batches for name, t in zip(b.column("l").to_pylist(), b.column("t").to_pylist()))
        yield from _gather((name, _pairs(t)) for name, t in each if t.isascii() or not others.garbled(t))

    return _summed(rows.mapInArrow(clean, schema))


sample = fit  #: its former name, when it took some texts of each language


def restore(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, restored, lost) of each row whose text is garbled.

    restored is the original text, or null where lost: a part can't be had again. Null, blank and clean texts
    have no row; repeated rows come as often as they do. An empty table gives no rows.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Model(fit(df, text, lang)))
    rows = df.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            at, new, lost = [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                gone = LOST in t
                r = None if gone else model.restore(t)
                if gone or r != t:
                    at.append(i)
                    new.append(r)
                    lost.append(gone)
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int32())), pa.array(new, pa.string()), pa.array(lost, pa.bool_())], ["k", "restored", "lost"])

    return rows.mapInArrow(run, f"k {kind}, restored string, lost boolean").withColumnRenamed("k", key)


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()
