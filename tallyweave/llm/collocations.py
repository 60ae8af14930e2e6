"""Phrase collocation mining by SETM: set-oriented relations of occurrences.

The occurrence relation of length k holds, sorted by piece and position, the places where a
frequent phrase of k words begins. It is persisted. One block of it is a row: an array of
word codes whose index is the position, 0 standing where a piece ends and where the phrase
is not frequent. So each k neighbours between two zeros are a frequent phrase, and merging
the relation with itself at the next position gives the phrases of k + 1 words whose both
parts of k words are frequent. These are counted per group by a shuffle, and the relation
is semi-joined with the frequent groups before the next length.

A word is coded by a 64-bit hash of its language and itself. The dictionary shows whether
two words share a code; then all is done again with another seed, so that counts are exact.
The semi-join runs in the tasks with a bit filter of bounded size. A group that passes it
by chance is counted like any other and falls at the minimum count, which is exact.

Texts are cut into slices, counts are combined per task before they are shuffled, and no
text, language or phrase is gathered in one task. A language's ranking goes through salted
lists of its first rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.llm.common import LOWER, long_array, utf8
from tallyweave.sources.scratch import materialise

MIN_COUNT = 10
MAX_WORDS = 3
#: A longer candidate with this many hundredths of a phrase's occurrences covers it.
COVER = 50
#: Language of rows without one.
UNKNOWN = "und"
#: Bits of a semi-join filter, at most (16 MB).
FILTER_BITS = 1 << 27
#: Piece ends become commas, blanks and tabs blanks; every other byte belongs to words.
_BYTES = bytes(0x2C if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b in b" \t" else LOWER[b] for b in range(256))
_SLICE = 1 << 20  # bytes of text that are cut into words at once
_ROW = 128  # words in a row of a persisted relation, up to the next zero: Arrow batches hold thousands of rows
_WORDS = 1 << 19  # words that a task's dictionary holds before it is emptied
_COUNTED = 1 << 21  # positions that are counted together
_SALTS = 64


class _Numbers(dict):
    """Words to numbers in order of appearance; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b",": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slices(texts: list[bytes]) -> Iterator[bytes]:
    """Texts joined by piece ends, some megabytes or one long text at once."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _SLICE:
            yield b",".join(held)
            held, size = [], 0
    if held:
        yield b",".join(held)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words and piece ends of joined texts, a bounded number at once."""
    at = 0
    while at < len(data):
        end = at + 2 * _SLICE
        if end < len(data):
            blank, comma = data.rfind(b" ", at, end), data.rfind(b",", at, end)
            cut = max(blank, comma)
            if cut <= at:  # one word of more than a slice
                after = [x for x in (data.find(b" ", end), data.find(b",", end)) if x >= 0]
                cut = min(after, default=len(data))
            end = cut
        yield data[at:end].replace(b",", b" , ").split()
        at = end


def _numbers(data: bytes, numbers: _Numbers) -> np.ndarray:
    """Numbers of the words and piece ends, in order."""
    parts = []
    for words in _words(data):
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        out.setdefault(lang, []).append(utf8(text).translate(_BYTES))
    return out


def _code(lang: str, word: bytes, seed: int) -> int:
    """Code of a word, never 0. A word holds no blank, so the joined bytes tell language and word apart."""
    return (xxhash.xxh64_intdigest(utf8(lang) + b" " + word, seed) - (1 << 63)) or 1


def _counter(seed: int):
    """(lang, text) to (lang, word, code, f): words counted per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        counts: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, own in numbers.items():
                words = list(own)[1:]
                f = counts[lang][1:]
                codes = [_code(lang, w, seed) for w in words]
                texts = [w.decode("utf-8", "replace") for w in words]
                arrays = [pa.array([lang] * len(words), pa.string()), pa.array(texts, pa.string()), pa.array(codes, pa.int64()), pa.array(f)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "code", "f"])
            numbers.clear()
            counts.clear()

        for batch in batches:
            for lang, texts in _by_language(batch).items():
                for data in _slices(texts):
                    own = numbers.setdefault(lang, _Numbers())
                    found = np.bincount(_numbers(data, own), minlength=len(own))
                    if lang in counts:
                        found[: len(counts[lang])] += counts[lang]
                    counts[lang] = found
                    if sum(map(len, numbers.values())) > _WORDS:
                        yield from emptied()
        yield from emptied()

    return run


def _rows(relation: np.ndarray) -> pa.RecordBatch:
    """A relation as rows of about ``_ROW`` words, cut after zeros."""
    ends = np.flatnonzero(relation == 0) + 1
    wanted = np.searchsorted(ends, np.arange(_ROW, len(relation), _ROW))
    cuts = np.unique(np.r_[0, ends[wanted[wanted < len(ends)]], len(relation)])
    arrays = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(relation))]
    return pa.RecordBatch.from_arrays(arrays, names=["words"])


def _passes(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the filter holds hashes of groups; its length is a power of two."""
    at = codes.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of the words of each group; only the filter depends on it."""
    mixed = columns[0].view(np.uint64)
    for column in columns[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + column.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _first_relation(seed: int, bits):
    """(lang, text) to the occurrence relation of single frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        codes: dict[str, np.ndarray] = {}
        held = bits.value
        for batch in batches:
            for lang, texts in _by_language(batch).items():
                if sum(map(len, numbers.values())) > _WORDS:
                    numbers.clear()
                    codes.clear()
                own = numbers.setdefault(lang, _Numbers())
                known = codes.get(lang, np.zeros(1, np.int64))
                for data in _slices(texts):
                    found = _numbers(data, own)
                    if len(own) > len(known):
                        words = list(own)[len(known) :]
                        new = np.array([_code(lang, w, seed) for w in words], np.int64)
                        known = np.r_[known, np.where(_passes(_mixed([new]), held), new, 0)]
                    yield _rows(np.r_[known[found], 0])
                codes[lang] = known

    return run


def window_starts(relation: np.ndarray, k: int) -> np.ndarray:
    """Positions at which ``k`` words follow each other without a zero."""
    ok = relation != 0
    whole = ok[: len(ok) - k + 1].copy()
    for j in range(1, k):
        whole &= ok[j : len(ok) - k + 1 + j]
    return np.flatnonzero(whole)


def count_windows(relation: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases of ``k`` words, as columns of codes, and how often each occurs."""
    starts = window_starts(relation, k)
    vocabulary, ids = np.unique(relation, return_inverse=True)
    key = ids[starts]
    size = len(vocabulary)
    for j in range(1, k):
        if size >= (1 << 62) // len(vocabulary):
            distinct, key = np.unique(key, return_inverse=True)
            size = len(distinct)
        key = key * len(vocabulary) + ids[starts + j]
        size *= len(vocabulary)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [relation[starts[first] + j] for j in range(k)], counts


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of a relation joined again, many at once; each row ends with a zero."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(long_array(batch.column("words").flatten()))
        size += len(held[-1])
        if size >= _COUNTED:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _names(k: int) -> list[str]:
    return [f"w{j}" for j in range(1, k + 1)]


def _group_counter(k: int):
    """A relation of length k - 1 merged with itself at the next position: phrases of k words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for relation in _relations(batches):
            columns, counts = count_windows(relation, k)
            if len(counts):
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts.astype(np.int64))], names=[*_names(k), "f"])

    return run


def extended(relation: np.ndarray, k: int, bits: np.ndarray) -> np.ndarray:
    """The relation of length k: of the windows of k words those that pass the filter, in runs that end with a zero."""
    starts = window_starts(relation, k)
    starts = starts[_passes(_mixed([relation[starts + j] for j in range(k)]), bits)]
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, np.diff(starts) != 1])
    sizes = np.diff(np.r_[new, len(starts)]) + k  # the run's words and a zero
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[new], sizes)
    out = relation[np.minimum(at, len(relation) - 1)]
    out[ends - 1] = 0
    return out


def _semi_join(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for relation in _relations(batches):
            found = extended(relation, k, held)
            if len(found):
                yield _rows(found)

    return run


def _filter(groups: DataFrame, names: list[str]):
    """A broadcast bit filter that holds every group; at most ``FILTER_BITS`` bits."""
    n = groups.count()
    size = min(FILTER_BITS, 1 << max(16, (32 * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _mixed([long_array(batch.column(c)) for c in names]).view(np.uint64) & np.uint64(size - 1)
            bit = np.uint64(1) << (at & np.uint64(63))
            arrays = [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["slot", "bits"])

    slots = groups.select(*names).mapInArrow(run, "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    found = slots.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[long_array(found.column("slot").combine_chunks())] = long_array(found.column("bits").combine_chunks()).view(np.uint64)
    return groups.sparkSession.sparkContext.broadcast(bits)


def _persist(relation: DataFrame, k: int) -> DataFrame:
    return materialise(relation, f"occurrences-{k}")


def _dictionary(docs: DataFrame, seeds: int = 4) -> tuple[DataFrame, int]:
    """Words with their codes and counts, and the seed with which no two words share a code."""
    for seed in range(seeds):
        counted = docs.mapInArrow(_counter(seed), "lang string, word string, code bigint, f bigint")
        words = materialise(counted.groupBy("lang", "word", "code").agg(F.sum("f").alias("f")), "words")
        if words.groupBy("code").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def _scored(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each candidate; equal scores go to the first cut."""
    cuts = candidates.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut")).selectExpr(
        "words", "a", "cut", "slice(words, 1, cut) as left", "slice(words, cut + 1, size(words) - cut) as right"
    )
    sides = cuts.join(groups.select(F.col("words").alias("left"), F.col("f").alias("l")), "left").join(
        groups.select(F.col("words").alias("right"), F.col("f").alias("r")), "right"
    )
    # Products may pass 64 bits: decimals of 38 digits hold them exactly for counts up to 10^16.
    whole = "cast(({}) as decimal(38,0))".format
    share = f"{whole('cast(a as decimal(19,0)) * cast(a as decimal(19,0))')}"
    scaled = f"{whole(share + ' * cast(1000000 as decimal(7,0))')}"
    exact = sides.withColumn("top", F.expr(scaled)).withColumn("low", F.expr(whole("cast(l as decimal(19,0)) * cast(r as decimal(19,0))")))
    scored = exact.withColumn("score", F.expr("cast(top div low as bigint)"))
    best = scored.groupBy("words").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("best"))
    return best.select("words", "best.a", "best.l", "best.r", "best.score")


def _uncovered(candidates: DataFrame, cover: int) -> DataFrame:
    """Candidates that no longer candidate covers."""
    inner = "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))"
    longer = candidates.where("size(words) > 2").select(F.explode(F.expr(inner)).alias("words"), F.col("a").alias("longer"))
    most = longer.groupBy("words").agg(F.max("longer").alias("longer"))
    return candidates.join(most, "words", "left").where(f"longer is null or 100 * longer < {int(cover)} * a").drop("longer")


def phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    cover: int = COVER,
) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of every candidate that no longer one covers.

    A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into
    words at blanks and tabs. A candidate has 2 to ``max_words`` words that follow each other
    in a piece at least ``min_count`` times. ``score`` is floor(10^6 a^2 / (l r)) for the cut
    that makes it least, ``l`` and ``r`` being the counts of both parts, ``n`` the words of the
    language. A null text is empty, a null language is ``und``; repeated rows count each time.
    An empty table, or one without frequent phrases, gives no rows. Other columns, whatever
    their names, are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    dictionary, seed = _dictionary(rows)
    frequent = dictionary.where(F.col("f") >= min_count)
    singles = frequent.select(F.col("code").alias("w1"), "f")
    groups = [singles.select(F.array("w1").alias("words"), "f")]
    relation = _persist(rows.mapInArrow(_first_relation(seed, _filter(singles, ["w1"])), "words array<bigint>"), 1)
    for k in range(2, max_words + 1):
        names = _names(k)
        counted = relation.mapInArrow(_group_counter(k), ", ".join(f"{c} bigint" for c in (*names, "f")))
        found = materialise(counted.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), f"groups-{k}")
        groups.append(found.select(F.array(*names).alias("words"), "f"))
        if k < max_words:
            relation = _persist(relation.mapInArrow(_semi_join(k, _filter(found, names)), "words array<bigint>"), k)
    everything = groups[0]
    for more in groups[1:]:
        everything = everything.unionAll(more)
    everything = materialise(everything, "groups")
    candidates = everything.where("size(words) > 1").withColumnRenamed("f", "a")
    kept = _scored(everything, _uncovered(candidates, cover))
    texts = kept.select("words", F.posexplode("words").alias("at", "code")).join(frequent.select("code", "lang", "word"), "code")
    spelt = texts.groupBy("words").agg(
        F.first("lang").alias("lang"), F.expr("array_join(transform(array_sort(collect_list(struct(at, word))), x -> x.word), ' ')").alias("phrase")
    )
    sizes = dictionary.groupBy("lang").agg(F.sum("f").alias("n"))
    return kept.join(spelt, "words").join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def first_phrases(found: DataFrame, first: int) -> DataFrame:
    """Each language's first rows, with ``rank``: by score and a, highest first, then by phrase."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    salted = found.withColumn("salt", F.expr(f"pmod(xxhash64(phrase), {_SALTS})"))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
