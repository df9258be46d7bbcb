"""Phrases whose words occur together more often than by chance, per language, by sorting suffixes.

Method. Every word of a text is the start of a suffix, which ends with its piece or after ``longest`` words. Tasks cut texts
into blocks, count equal suffixes of a block and route them by their leading words: splitters, found in a sample, part the
sorted order of all suffixes into ranges, so that the suffixes of a common word, or of a common phrase, fill as many ranges
as they need. Within a range pointers to the suffixes are sorted by a multikey three-way quicksort, all partitions of a
round at once: the size of an equal partition is the count of the phrase of its leading words; it is sorted on by the next
word, up to the greatest depth, and a partition of fewer than ``least`` suffixes is abandoned, as no phrase in it can be
frequent. Only a partition that holds a range's first or last suffix may go on in the next range: it is never abandoned, and
such parts are summed up.

Counts are exact and cover all texts; the sample only balances the ranges. A candidate's parts are as frequent as itself, so
their counts are found by a join with the frequent phrases. The few phrases that make up more than one in ``1 / HOT`` of all
words are broadcast in that join (at most ``1 / HOT`` of each length), so no key of the other join is common.

Scores are exact for counts below 10**16; beyond, an error is raised. A null text is empty, a null language is ``und``, and
rows that are equal count as often as they are there. Texts longer than a block are cut at the end of a piece. Ties of score
and count are put in order of the phrase's bytes. Only the two named columns are read, so others may have any names. An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dosewise.llm.common import documents, packed, raw_texts, unpacked
from dosewise.llm.pool import Numbers
from dosewise.session import broadcast_rows, materialize

LONGEST, LEAST, TOP, COVERED = 3, 10, 2000, 50
#: Bytes of text in a block of a map task, and in a range of suffixes.
BLOCK_BYTES = RANGE_BYTES = 8 << 20
#: Greatest number of ranges, and sampled suffixes for each range.
RANGES, SAMPLED = 1 << 18, 16
#: Share of all words from which on a phrase is broadcast.
HOT = 1 / 4096
#: Parts into which each language's candidates are dealt before the best are taken.
DEALT = 256
UNKNOWN = "und"

_END = b"\xff"  # stands at the end of a piece; no UTF-8 text holds it
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _SEPARATORS + b"\t", _LOWER + _END * len(_SEPARATORS) + b" ")

Suffixes = tuple[list[bytes], list[bytes], np.ndarray]


def _parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Blocks of ``(language, text)`` of about ``limit`` bytes; longer texts are cut where a piece ends."""
    held, size = [], 0
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lang, text in zip(langs, raw_texts(batch, "text")):
            if not text:
                continue
            text, start = text.translate(_TABLE), 0
            while start < len(text):
                end = start + limit
                end = len(text) if end >= len(text) else text.find(_END, end)
                end = len(text) if end < 0 else end
                held.append((lang.encode(), text[start:end]))
                size += end - start
                start = end
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def suffixes(block: list[tuple[bytes, bytes]], longest: int) -> Suffixes:
    """Sorted languages and words of a block, and one column per suffix: the numbers of its language and its words.

    Languages are numbered from 0. Words are numbered from 1 in the order of their bytes; 0 stands behind the last word.
    """
    words: list[bytes] = []
    counts = []
    for _, text in block:
        found = text.replace(_END, b" \xff ").split()
        words += found
        words.append(_END)
        counts.append(len(found) + 1)
    numbers = Numbers()
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    del words
    names = sorted(w for w in numbers if w != _END)
    place = np.zeros(len(numbers), np.int32)
    place[np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))] = np.arange(1, len(names) + 1)
    langs = sorted({lang for lang, _ in block})
    index = {lang: i for i, lang in enumerate(langs)}
    keys = np.zeros((longest + 1, len(at)), np.int32)
    keys[0] = np.repeat(np.fromiter((index[lang] for lang, _ in block), np.int32, len(block)), counts)
    keys[1] = place[at]
    for k in range(2, longest + 1):
        following = np.zeros(len(at), np.int32)
        following[: 1 - k] = keys[1, k - 1 :]
        keys[k] = np.where(keys[k - 1] > 0, following, 0)
    return langs, names, keys[:, keys[1] > 0]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns in order, and how often each occurs."""
    keys = keys[:, np.lexsort(keys[::-1])]
    first = np.ones(keys.shape[1], bool)
    first[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    starts = np.flatnonzero(first)
    return keys[:, starts], np.diff(np.append(starts, keys.shape[1]))


def cuts(langs: list[bytes], names: list[bytes], keys: np.ndarray, splitters: list[tuple[bytes, ...]]) -> list[int]:
    """For each splitter the number of sorted columns that come before it."""
    found = []
    for splitter in splitters:
        low, high = 0, keys.shape[1]
        for k, word in enumerate(splitter):
            known = names if k else langs
            number = bisect_left(known, word) if not k or word else -1
            there = number < 0 or (number < len(known) and known[number] == word)
            number += 1 if k else 0
            row = keys[k, low:high]
            next_low = low + int(np.searchsorted(row, number, "left"))
            high = low + int(np.searchsorted(row, number, "right")) if there else next_low
            low = next_low
            if low == high:
                break
        found.append(low)
    return found


def _routed(
    batches: Iterator[pa.RecordBatch], longest: int, splitters: list[tuple[bytes, ...]], block_bytes: int
) -> Iterator[pa.RecordBatch]:
    """The distinct suffixes of each block, packed by range."""
    for block in _parts(batches, block_bytes):
        langs, names, keys = suffixes(block, longest)
        keys, n = counted(keys)
        edges = [0, *cuts(langs, names, keys, splitters), keys.shape[1]]
        rows = []
        for number, (start, end) in enumerate(zip(edges, edges[1:])):
            if start == end:
                continue
            part = keys[:, start:end]
            used, own = np.unique(part[1:], return_inverse=True)
            own = own.reshape(part[1:].shape)
            if used[0]:
                own = own + 1  # 0 stays for the end
            words = b" ".join([names[i - 1] for i in used.tolist() if i])
            columns = [packed(np.diff(part[0], prepend=0)), packed(np.diff(own[0], prepend=0)), *map(packed, own[1:]), packed(n[start:end])]
            rows.append({"range": number, "langs": _END.join(langs), "words": words, "columns": columns})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CHUNK)


_CHUNK = pa.schema([("range", pa.int32()), ("langs", pa.binary()), ("words", pa.binary()), ("columns", pa.list_(pa.binary()))])


def _united(lists: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """All distinct items in order, and the numbers of each list's items among them."""
    together = sorted(set().union(*lists))
    index = {item: i for i, item in enumerate(together)}
    return together, [np.fromiter(map(index.__getitem__, items), np.int32, len(items)) for items in lists]


def equal_partitions(keys: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(depth, pointer, count)`` of the leading words that suffixes share, by a multikey three-way quicksort.

    ``keys`` has a column per suffix, with key 0 for the language and 0 in the others for the end; ``n`` says how often each
    suffix is there. ``depth`` is the number of shared keys less one; ``pointer`` is one of the suffixes. Partitions of fewer
    than ``least`` are abandoned, but for those that hold the first or the last suffix of all.
    """
    depth_end, size = keys.shape
    edge = np.zeros(size, bool)
    for least_or_most in (np.min, np.max):
        left = np.arange(size)
        for row in keys:
            left = left[row[left] == least_or_most(row[left])]
        edge[left[0]] = True
    order = np.arange(size)
    starts, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    draw = np.random.default_rng(size)
    while len(order):
        sizes = np.diff(np.append(starts, len(order)))
        key = keys[np.repeat(depth, sizes), order]
        pivot = key[starts + (draw.random(len(starts)) * sizes).astype(np.int64)]
        side = np.sign(key - np.repeat(pivot, sizes)) + 1
        # Every partition in place: smaller keys, equal keys, greater keys.
        wide = np.repeat(np.arange(len(starts)) * 3, sizes) + side
        split = np.bincount(wide, minlength=3 * len(starts))
        into = np.cumsum(split) - split
        moved = np.empty(len(order), np.int64)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            parts = split[s::3]
            first = np.cumsum(parts) - parts
            moved[np.repeat(into[s::3] - first, parts) + np.arange(len(mine))] = order[mine]
        order = moved
        filled = np.flatnonzero(split)
        starts, sizes, kind = into[filled], split[filled], filled % 3
        depth = np.repeat(depth, 3)[filled]
        weight = np.add.reduceat(n[order], starts)
        at_edge = np.logical_or.reduceat(edge[order], starts)
        alive = (weight >= least) | at_edge
        equal = kind == 1
        heads = order[starts]
        ended = equal & (depth > 0) & (keys[depth, heads] == 0)
        shared = equal & ~ended & (alive | (depth == 0))
        for d in np.unique(depth[shared]).tolist():
            here = shared & (depth == d)
            yield d, heads[here], weight[here]
        depth = depth + equal
        alive &= ~ended & (depth < depth_end)
        keep = np.repeat(alive, sizes)
        order, depth, sizes = order[keep], depth[alive], sizes[alive]
        starts = np.cumsum(sizes) - sizes


def _sorted_range(chunks: pa.Table, least: int) -> pa.Table:
    """Frequent leading words of the suffixes of one range, and those at its edges."""
    rows = chunks.to_pylist()
    langs, lang_numbers = _united([r["langs"].split(_END) for r in rows])
    words, word_numbers = _united([r["words"].split() for r in rows])
    columns, n = [], []
    for row, lang, word in zip(rows, lang_numbers, word_numbers):
        first, second, *others, count = map(unpacked, row["columns"])
        word = np.concatenate([np.zeros(1, np.int32), word + 1])
        columns.append(np.stack([lang[np.cumsum(first)], word[np.cumsum(second)], *[word[o] for o in others]]))
        n.append(count)
    keys, n = np.concatenate(columns, axis=1), np.concatenate(n)
    found = {"lang": [], "size": [], "phrase": [], "n": []}
    for depth, pointer, count in equal_partitions(keys, n, least):
        found["lang"] += [langs[i].decode() for i in keys[0, pointer].tolist()]
        found["size"] += [depth] * len(pointer)
        spelled = [[words[i - 1] for i in keys[k, pointer].tolist()] for k in range(1, depth + 1)]
        found["phrase"] += [b" ".join(p).decode() for p in zip(*spelled)] if depth else [""] * len(pointer)
        found["n"] += count.tolist()
    return pa.Table.from_pydict(found, pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())]))


def _sampled(batches: Iterator[pa.RecordBatch], longest: int, share: float, block_bytes: int) -> Iterator[pa.RecordBatch]:
    for block in _parts(batches, block_bytes):
        langs, names, keys = suffixes(block, longest)
        draw = np.random.default_rng(len(names))
        chosen = keys[:, draw.random(keys.shape[1]) < share]
        spelled = [[langs[i] for i in chosen[0].tolist()]] + [[names[i - 1] if i else b"" for i in row] for row in chosen[1:].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in zip(*spelled)], pa.list_(pa.binary()))], names=["suffix"])


def splitters(docs: DataFrame, longest: int, ranges: int, size: int, rows: int) -> list[tuple[bytes, ...]]:
    """Suffixes that part the sorted order of all into about equal ranges, from a bounded sample; they only balance work."""
    if ranges < 2:
        return []
    wanted = SAMPLED * ranges
    of_docs = min(1.0, 4 * wanted / max(1, rows))
    of_words = min(1.0, wanted / (of_docs * size / 6))  # a word has about six bytes with its space
    some = docs.filter(F.rand(11) < of_docs).mapInArrow(partial(_sampled, longest=longest, share=of_words, block_bytes=BLOCK_BYTES), "suffix array<binary>")
    sample = sorted(tuple(map(bytes, r["suffix"])) for r in some.orderBy(F.rand(13)).limit(2 * wanted).collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, size, phrase, n)`` of all phrases of up to ``longest`` words with at least ``least`` occurrences.

    Size 0, with an empty phrase, has the number of all words of the language.
    """
    docs = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = min(RANGES, 1 + size // RANGE_BYTES)
    split = splitters(docs, longest, ranges, size, rows)
    chunks = docs.mapInArrow(
        partial(_routed, longest=longest, splitters=split, block_bytes=BLOCK_BYTES),
        "range int, langs binary, words binary, columns array<binary>",
    )

    def in_range(of_range: pa.Table) -> pa.Table:
        return _sorted_range(of_range, least)

    found = chunks.groupBy("range").applyInArrow(in_range, "lang string, size int, phrase string, n long")
    whole = found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return materialize(whole.filter((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def _subphrase(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _part_counts(parts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``parts`` with ``f``, the count of the phrase ``(lang, part)``; the few common ones are joined by a broadcast."""
    known = phrases.filter("size > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("f"))
    total = phrases.filter("size = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("f") >= total * HOT
    same = (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_phrase"))
    hot = parts.join(F.broadcast(known.filter(common)), same)
    rest = parts.join(F.broadcast(known.filter(common).drop("f")), same, "left_anti").join(known.filter(~common), same)
    return hot.unionByName(rest).drop("_lang", "_phrase")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``a`` is a phrase's count, ``l`` and ``r`` those of the parts left and right of the cut with the lowest score
    ``floor(1000000 a a / (l r))``; of equal cuts the first counts. Phrases that a longer one with at least ``covered``
    percent of their count holds are left out.
    """
    phrases = phrase_counts(docs, longest, least, text, lang)
    candidates = phrases.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    longer = candidates.filter("size > 2").select(
        "lang",
        F.col("a").alias("_longer"),
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(2), F.col("size") - 1),
                        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _subphrase(words, i, m)),
                    )
                )
            )
        ).alias("phrase"),
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    covers = F.coalesce(100 * F.col("_longer") >= covered * F.col("a"), F.lit(False))
    free = candidates.join(most, ["lang", "phrase"], "left").filter(~covers).drop("_longer")
    free = materialize(free, "phrases-free")

    sides = F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("left"), _subphrase(words, F.lit(1), k).alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("left"), _subphrase(words, k + 1, F.col("size") - k).alias("part")),
        ),
    )
    parts = free.select("lang", "phrase", "a", F.inline(F.flatten(sides)))
    whole = F.expr(
        "cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))"
        " div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    )
    by_cut = _part_counts(parts, phrases).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    scored = by_cut.withColumn("score", whole).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", "_deal").orderBy(*best)
    ranked = Window.partitionBy("lang").orderBy(*best)
    some = scored.withColumn("_deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).withColumn("_rank", F.row_number().over(dealt))
    final = some.filter(F.col("_rank") <= top).withColumn("rank", F.row_number().over(ranked).cast("long"))
    totals = broadcast_rows(phrases.filter("size = 0").select("lang", "n"))
    return final.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_suffix_collocations(spark, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language of all documents."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = """
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS p FROM f WHERE size >= 2 AND n >= 10),
longer AS (SELECT lang, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase, a FROM c WHERE size = 3),
most AS (SELECT lang, phrase, max(a) AS a FROM longer GROUP BY ALL),
free AS (SELECT c.* FROM c LEFT JOIN most m ON m.lang = c.lang AND m.phrase = c.phrase WHERE m.a IS NULL OR 100 * m.a < 50 * c.a),
cut AS (
  SELECT lang, phrase, a, 1 AS k, p[1] AS lp, array_to_string(p[2:], ' ') AS rp FROM free
  UNION ALL SELECT lang, phrase, a, 2, p[1] || ' ' || p[2], p[3] FROM free WHERE size = 3),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000
"""
