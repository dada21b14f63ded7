"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of typed tokens: a number is <num>, the word after a number that is a unit
is <unit>, a capitalised word is <name>, any other word is itself in lower case without outer
punctuation. A capitalised word that opens a sentence can be either, so it is read both ways. Every
window of ``window`` tokens is hashed, once for each reading of the words in it, with the values of its
slots beside it. An item with fewer tokens is one window of its own length; documents then have windows
of that length too.

Windows of documents are hash-joined with the windows of benchmark items. On each diagonal of matches
(document position less item position) an item's slot value stands for the document value that most
windows give it (then an equal one, then the larger hash). A window counts if all its slots keep to
that, or if all its slot values are equal. An item is found in a document if the windows that count
are at least ``coverage`` of its own. It is ``verbatim`` if all of these have equal slot values, else
``reparameterised``.

The benchmark's windows, if at most ``max_broadcast`` of them, go to the executors as sorted arrays and
are joined in the document's task, which passes on only items that have ``coverage`` of their windows in
the document whatever the slots say; so a template that many items share makes no rows for those of
them that aren't there. A larger benchmark is joined by shuffle from all windows. Rows leave a task by
document, so a passage in a third of all documents only makes one row for each of its windows in each.

Nulls: a null or empty text has no windows, is clean, and as an item is never found. A null doc_id
is a document of its own. Repeated items are found each under their own id. Rows of one doc_id are
looked at each, and what is found in one counts for the doc_id; so do the null ones together. Items
without id count as one. Windows made only of slots are not used. An empty table on either side leaves every document clean. Texts of any
length are read whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm._bytes import U64, mix, signed, slices
from strata.llm._shared import cached, lean, staged, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
# Number words and units in English, German, French and Spanish.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil".split())
UNITS = frozenset("mm cm m km meter meters metre metres mile miles inch inches foot feet yard yards g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees c f k v w kw watt watts volt volts hz khz mhz mph kph newton newtons joule joules stunde stunden minuten sekunde sekunden tag tage tagen woche wochen monat monate jahr jahre jahren kilo kilogramm gramm liter meile meilen heure heures seconde secondes jour jours semaine semaines mois an ans année années litre litres gramme grammes kilogramme kilogrammes mètre mètres kilomètre kilomètres hora horas minuto minutos segundo segundos día días semana semanas mes meses año años litro litros gramo gramos kilogramo kilogramos metro metros kilómetro kilómetros peso pesos".split())
PLAIN_, NUM, UNIT, CAPITAL = 0, 1, 2, 3
STOP = ".!?:"
NO_ID = -(2**63)


class Tokens(dict):
    """word -> (kind, ends a sentence, hash of the stripped lower-case word) packed into one int."""

    MOST = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        core = word if word.isalpha() else OUTER.sub("", word)
        low = core.lower()
        if not core:
            kind = -1
        elif NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper() and (len(core) == 1 or not core.isupper()):
            kind = CAPITAL
        else:
            kind = PLAIN_
        h = int.from_bytes(hashlib.blake2b(low.encode(), digest_size=7).digest(), "little")
        got = (h << 4) | ((kind + 1) << 1) | (word.rstrip("\"')]}»”’")[-1:] in STOP)
        if len(word) <= 64:
            self[word] = got
        return got


SLOT = mix(np.arange(1, 5, dtype=np.uint64))


def templates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each canonical token, its slot value: 0 for a word, its value as a name if it is a word that can be one, else 0; index of each text's first token, n + 1)."""
    words: list[str] = []
    ends = [0]
    for text in texts:
        words += WORD.findall(text)
        ends.append(len(words))
    codes = np.fromiter(map(cached(Tokens, Tokens).__getitem__, words), np.uint64, len(words))
    edges = np.array(ends)
    stop = np.zeros(len(codes) + 1, bool)
    stop[1:] = codes & U64(1) != 0
    stop[edges] = True
    keep = codes & U64(14) != 0
    first = stop[:-1][keep]
    edges = np.concatenate(([0], np.cumsum(keep)))[edges]
    codes = codes[keep]
    kind = ((codes >> U64(1)) & U64(7)).astype(np.int8) - 1
    value = codes >> U64(4)
    after_number = np.zeros(len(kind) + 1, bool)
    after_number[1:] = kind == NUM
    after_number[edges] = False
    slot = np.where(kind == NUM, NUM, np.where((kind == UNIT) & after_number[:-1], UNIT, np.where((kind == CAPITAL) & ~first, CAPITAL, 0)))
    token = np.where(slot > 0, SLOT[slot], mix(value + U64(1)))
    return token, np.where(slot > 0, value, U64(0)), np.where((kind == CAPITAL) & first, value, U64(0)), edges


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return templates([text])[:3]


def _folded(token: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(place), U64(n))
    for i in range(n):
        h = mix(h * U64(31) + token[place + i])
    return h


def window_hashes(token: np.ndarray, values: np.ndarray, names: np.ndarray, window: int, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(first token, hash, whether it has a word and which tokens are read as names, of each window and reading; the windows' length).

    ``edges``: tokens of several texts, whose shorter ones have no window; else of one, which is a window if it is shorter.
    """
    n = min(window, len(token)) if edges is None else window
    k = len(token) - n + 1
    if n == 0 or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros((0, n), bool), n
    at = np.arange(k)
    if edges is not None:
        whole = np.ones(k, bool)
        for i in range(1, n):
            inner = edges[1:-1] - i
            whole[inner[(inner >= 0) & (inner < k)]] = False
        at = at[whole]
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    plain, seen = sums(values == 0), sums(names != 0)
    h = _folded(token, at, n)
    word = plain[at + n] > plain[at]
    choices = seen[at + n] - seen[at]
    read = np.zeros((len(at), n), bool)
    one, more = at[choices == 1], at[choices > 1]
    parts = [(at, h, word, read)]
    if len(one):
        # One choice: the other reading is that of the names.
        mask = names[one[:, None] + np.arange(n)] != 0
        parts.append((one, _folded(np.where(names != 0, SLOT[CAPITAL], token), one, n), plain[one + n] - plain[one] > 1, mask))
    if len(more):
        # Several: a row splits in two at each token that can be read both ways.
        place, g, has, mask = more, np.full(len(more), U64(n)), np.zeros(len(more), bool), np.zeros((len(more), n), bool)
        for i in range(n):
            two = np.flatnonzero(names[place + i] != 0)
            old = len(place)
            place, g, has, mask = (np.concatenate((x, x[two])) for x in (place, g, has, mask))
            mask[old:, i] = True
            g = mix(g * U64(31) + np.where(mask[:, i], SLOT[CAPITAL], token[place + i]))
            has |= (values[place + i] == 0) & ~mask[:, i]
        new = mask.any(1)
        parts.append((place[new], g[new], has[new], mask[new]))
    at, h, word, read = (np.concatenate([p[c] for p in parts]) for c in range(4))
    return at, h, word, read, n


WINDOWS = "id long, row long, pos int, h long, slots array<long>"
PAIRS = "doc long, row long, item long, diagonal int, pos int, item_slots array<long>, doc_slots array<long>"


def _slots(values: np.ndarray, names: np.ndarray, place: np.ndarray, read: np.ndarray, n: int, width: int) -> np.ndarray:
    """Slot values of windows, one row of ``width`` each: 0 for a word and beyond the window."""
    out = np.zeros((len(place), width), np.int64)
    if n and len(place):
        here = place[:, None] + np.arange(n)
        out[:, :n] = signed(np.where(read, names[here], values[here]))
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1]), pa.array(rows.ravel()))


def _items(window: int):
    """Windows of benchmark items."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    token, values, names = template(text or "")
                    place, h, word, read, n = window_hashes(token, values, names, window)
                    on = np.flatnonzero(word)
                    slots = _slots(values, names, place[on], read[on], n, window)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(on), pa.int64()), pa.array(np.full(len(on), n)), pa.array(place[on].astype(np.int32)), pa.array(signed(h[on])), _lists(slots)], ["id", "row", "pos", "h", "slots"]
                    )

    return find


def _documents(window: int, lengths: list[int]):
    """(rows, ids, row hashes, place in the text, hash, slots) of all windows of documents, a slice at a time; ``keep`` sieves the hashes."""

    def windows(batches: Iterator[pa.RecordBatch], keep) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                token, values, names, edges = templates(texts)
                for length in lengths:
                    place, h, word, read, n = window_hashes(token, values, names, length, edges)
                    hit = np.flatnonzero(keep(h, word))
                    if len(hit):
                        at = place[hit]
                        doc = np.searchsorted(edges, at, "right") - 1
                        hashes = {k: xxhash.xxh3_64_intdigest(texts[k]) for k in np.unique(doc).tolist()}
                        row = signed(np.array([hashes[k] for k in doc.tolist()], np.uint64))
                        yield part.column(0), doc, row, (at - edges[doc]).astype(np.int32), h[hit], _slots(values, names, at, read[hit], n, window)

    return windows


def _all_windows(window: int, lengths: list[int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, doc, row, pos, h, slots in _documents(window, lengths)(batches, lambda h, word: word):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(row), pa.array(pos), pa.array(signed(h)), _lists(slots)], ["id", "row", "pos", "h", "slots"])

    return find


class Index:
    """The benchmark's windows by hash: items, positions and slots, and how many windows an item needs."""

    def __init__(self, rows: list, totals: dict, coverage: float):
        rows.sort(key=lambda r: (r["h"] % 2**64, r["id"], r["pos"]))
        h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
        self.hashes, first = np.unique(h, return_index=True)
        self.first = np.append(first, len(h))
        self.items = np.array(sorted(totals), np.int64)
        self.item = np.searchsorted(self.items, np.array([r["id"] for r in rows], np.int64))
        self.pos = np.array([r["pos"] for r in rows], np.int64)
        self.slots = np.array([r["slots"] for r in rows], np.int64)
        # a hair less, so that no rounding loses what the exact share keeps
        self.need = np.array([totals[i] * coverage for i in self.items.tolist()]) - 1e-9
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> U64(44)).astype(np.int64)] = True

    def keep(self, h: np.ndarray, word: np.ndarray) -> np.ndarray:
        on = word & self.sieve[(h >> U64(44)).astype(np.int64)]
        near = np.flatnonzero(on)
        on[near] = self.hashes[np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)] == h[near]
        return on


#: Pairs of a document's window and an item's that a task holds at once, beyond those of one document.
HELD = 1 << 21


def _matched(window: int, lengths: list[int], index: Index):
    """Pairs of windows of each document with those items that have enough windows in it."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(_documents(window, lengths)(iter([part]), index.keep))
                if found:
                    doc, row, pos, h = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3, 4))
                    slots = np.concatenate([f[5] for f in found])
                    order = np.argsort(doc, kind="stable")
                    doc, row, pos, h, slots = doc[order], row[order], pos[order], h[order], slots[order]
                    at = np.searchsorted(index.hashes, h)
                    size = index.first[at + 1] - index.first[at]
                    done = np.concatenate(([0], np.cumsum(size)))
                    a = 0
                    while a < len(doc):
                        # whole documents, with at most HELD pairs or one document
                        b = int(np.searchsorted(done, done[a] + HELD, "right")) - 1
                        b = int(np.searchsorted(doc, doc[b])) if b < len(doc) else b
                        b = b if b > a else int(np.searchsorted(doc, doc[a], "right"))
                        left = np.repeat(np.arange(a, b), size[a:b])
                        right = np.arange(len(left)) - np.repeat(done[a:b] - done[a], size[a:b]) + index.first[at[left]]
                        # the item's places that the document has, each once
                        of = doc[left] * len(index.items) + index.item[right]
                        key = np.unique(np.stack((of, index.pos[right]), 1), axis=0)[:, 0] if len(of) else of
                        pair, n = np.unique(key, return_counts=True)
                        good = pair[n >= index.need[pair % max(1, len(index.items))]]
                        on = np.isin(of, good)
                        left, right = left[on], right[on]
                        if len(left):
                            yield pa.RecordBatch.from_arrays(
                                [part.column(0).take(pa.array(doc[left])), pa.array(row[left]), pa.array(index.items[index.item[right]]), pa.array((pos[left] - index.pos[right]).astype(np.int32)), pa.array(index.pos[right].astype(np.int32)), _lists(index.slots[right]), _lists(slots[left])],
                                ["doc", "row", "item", "diagonal", "pos", "item_slots", "doc_slots"],
                            )
                        a = b

    return pairs


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, max_broadcast: int = 2_000_000) -> DataFrame:
    """(doc, item, coverage, kind): the items found in each document."""
    spark = docs.sparkSession
    tune(spark)
    # ``row`` of an item's window is its length
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("long"), F.lit(NO_ID)).alias("id"), benchmark["text"].alias("text"))
    items = staged(items.mapInArrow(lean(_items(window)), WINDOWS).distinct(), "items")
    total = items.groupBy("id").agg(F.countDistinct("pos").alias("total"))
    lengths = sorted(r[0] for r in items.select("row").distinct().collect())  # at most ``window`` of them
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"))
    if not lengths:
        pairs = spark.createDataFrame([], PAIRS)
    elif items.count() <= max_broadcast:
        index = Index(items.collect(), {r["id"]: r["total"] for r in total.collect()}, coverage)
        pairs = texts.mapInArrow(lean(_matched(window, lengths, index)), PAIRS)
    else:
        d, i = texts.mapInArrow(lean(_all_windows(window, lengths)), WINDOWS).alias("d"), items.alias("i")
        pairs = d.join(i, F.expr("d.h = i.h")).select(
            F.col("d.id").alias("doc"), "d.row", F.col("i.id").alias("item"), (F.col("d.pos") - F.col("i.pos")).alias("diagonal"), F.col("i.pos").alias("pos"), F.col("i.slots").alias("item_slots"), F.col("d.slots").alias("doc_slots")
        )
    # On a diagonal an item value stands for the document value that most windows give it; windows that say otherwise go, unless all their values are equal.
    key = ["doc", "row", "item", "diagonal"]
    pairs = staged(pairs.distinct().withColumn("equal", F.expr("item_slots = doc_slots")), "pairs")
    changed = pairs.filter("NOT equal").select(*key).distinct().alias("x")
    p = pairs.alias("p")
    on = " AND ".join(f"p.{k} <=> {{0}}.{k}" for k in key)
    slots = p.join(changed, F.expr(on.format("x")), "left_semi").select(*key, "pos", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("z")).select(*key, "pos", F.col("z.item_slots").alias("a"), F.col("z.doc_slots").alias("b")).filter("a <> 0")
    votes = slots.groupBy(*key, "a", "b").agg(F.countDistinct("pos").alias("n"))
    chosen = votes.groupBy(*key, "a").agg(F.max_by("b", F.struct("n", F.col("a") == F.col("b"), "b")).alias("b"))
    good = p.filter("equal").select("doc", "row", "item", "pos", "equal")
    agreed = p.filter("NOT equal").withColumn("z", F.explode(F.arrays_zip("item_slots", "doc_slots"))).filter("z.item_slots <> 0").alias("q")
    c = chosen.alias("c")
    agreed = agreed.join(c, F.expr(" AND ".join(f"q.{k} <=> c.{k}" for k in key) + " AND q.z.item_slots = c.a")).groupBy(*[F.col(f"q.{k}").alias(k) for k in key], F.col("q.pos").alias("pos"), F.col("q.item_slots").alias("item_slots"), F.col("q.doc_slots").alias("doc_slots")).agg(F.bool_and(F.col("q.z.doc_slots") == F.col("c.b")).alias("fits")).filter("fits")
    good = good.unionByName(agreed.select("doc", "row", "item", "pos", F.lit(False).alias("equal")))
    counted = good.groupBy("doc", "row", "item", "pos").agg(F.bool_or("equal").alias("equal")).groupBy("doc", "row", "item").agg(F.count("*").alias("n"), F.bool_and("equal").alias("equal")).alias("g")
    share = F.col("n") / F.col("total")
    found = counted.join(total.alias("t"), F.expr("g.item = t.id")).filter(share >= coverage).select("doc", "item", share.alias("coverage"), F.when(F.col("equal"), "verbatim").otherwise("reparameterised").alias("kind"))
    best = found.groupBy("doc", "item").agg(F.max(F.struct("coverage", "kind")).alias("best"))
    return best.select("doc", F.when(F.col("item") != NO_ID, F.col("item")).alias("item"), "best.coverage", "best.kind")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, max_broadcast: int = 2_000_000) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, item_id (the best covered), coverage, kind."""
    found = matches(docs, benchmark, window, coverage, max_broadcast)
    best = found.groupBy("doc").agg(F.count("*").alias("n_items"), F.max_by(F.struct("item", "coverage", "kind"), F.struct("coverage", F.bitwise_not("item"))).alias("best"))
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    return ids.join(best, F.expr("doc_id <=> doc"), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("best.item").alias("item_id"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), F.col("best.kind").alias("kind")
    )
