"""License notices by diagonal voting over word k-grams.

Rolling k-gram hashes of every text meet the positions of the same grams in the notice templates. A gram at word ``p`` of the
text and word ``t`` of a template votes for the diagonal ``p - t``; votes are counted per diagonal, diagonals a few words
apart (a word left out or put in) are merged. A phrase is found where all its grams vote for one diagonal. A notice's merged
diagonals are only a candidate span, from one vote on: the words of the text around it are held against the template one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm import bytewords as bw
from rankloom.llm.tables import pick, row_key, store

# The phrases whose places are reported, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Opening words of public license notices, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
}

# Names and versions that tell notices apart.
NAMES = ("apache", "mozilla", "lesser", "nc", "sa")
VERSIONS = ("2", "3", "4")

KEY = ["doc_id", "key_a", "key_b"]
FILTER_BITS = 1 << 20


@dataclass(frozen=True)
class LicenseScan:
    """Parameters: words of a gram for phrases and for notices, the largest step between diagonals that are merged, the votes
    that make a candidate span of a notice, and the share that its found words must have of the notice's words and those put in
    between. A phrase must be covered whole on one diagonal."""

    phrase_gram: int = 2
    notice_gram: int = 4
    drift: int = 3
    least_votes: int = 1
    least_words: float = 0.75


def template_grams(how: LicenseScan) -> list[tuple[int, str, bool, int, int, str]]:
    """(k, label, is_base, grams of the template, position, gram) for every gram of every template."""
    out = []
    for texts, base, k in ((BASE_PHRASES, True, how.phrase_gram), (NOTICES, False, how.notice_gram)):
        for text, label in texts.items():
            words = text.split()
            n = len(words) - k + 1
            out += [(k, label, base, n, t, " ".join(words[t : t + k])) for t in range(n)]
    return out


def template_words() -> list[tuple[str, int, int, int | None, str, bool]]:
    """(label, its words, its telling words, place, word, is it telling) for every word of a notice, and one row without a place
    for every name of a rival, a notice with the same first word, that the notice itself does not have."""
    out = []
    for text, label in NOTICES.items():
        words = text.split()
        marks = sum(w in NAMES + VERSIONS for w in words)
        out += [(label, len(words), marks, t, w, w in NAMES + VERSIONS) for t, w in enumerate(words)]
        rivals = {w for other in NOTICES if other.split()[0] == words[0] for w in other.split()}
        out += [(label, len(words), marks, None, w, False) for w in NAMES if w in rivals and w not in words]
    return out


def _hash_of(gram: str) -> int:
    data = np.frombuffer(gram.encode(), dtype=np.uint8)
    words = bw.find_words(bw.TextBlock(0, data, np.array([0, data.size])), bw.ALNUM)
    hashes, _ = bw.gram_hashes(bw.word_hashes(words), words.row, words.starts.size)
    return int(hashes.view(np.int64)[0])


def rolling_grams(docs: DataFrame, how: LicenseScan) -> DataFrame:
    """For every text one row with its number of words (``pos`` null), one for each gram that may be in a template, and one for
    each word (``k`` = 0) that may be in a notice and stands near a gram of one.

    Every k-gram of the text is hashed. Those whose hash is not in a bitmap of the template hashes (fixed size, made of the
    templates alone) can match nothing and stay in the task; the others leave it with their words.
    """
    grams = template_grams(how)
    may = {}
    for k in sorted({g[0] for g in grams}):
        may[k] = np.zeros(FILTER_BITS, dtype=bool)
        may[k][[_hash_of(g[5]) % FILTER_BITS for g in grams if g[0] == k]] = True
    notice_hashes = np.array([_hash_of(g[5]) for g in grams if not g[2]], dtype=np.int64).view(np.uint64)
    notice_words = template_words()
    word_may = np.zeros(FILTER_BITS, dtype=bool)
    word_may[[_hash_of(w[4]) % FILTER_BITS for w in notice_words]] = True
    # No word of a span is further than this from one of its grams.
    reach = max(w[1] for w in notice_words) + 2 * how.drift + how.notice_gram

    def near_words(words: bw.Words, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and numbers of the words near the grams ``at`` that may be in a notice."""
        edge, first = np.zeros(hashes.size + 1, dtype=np.int64), words.first_of_row
        np.add.at(edge, np.maximum(at - reach, first[words.row[at]]), 1)
        np.add.at(edge, np.minimum(at + reach, first[words.row[at] + 1]), -1)
        near = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        h = bw.gram_hashes(hashes[near], np.zeros(near.size, dtype=np.int64), 1)[0]
        passes = word_may[(h % np.uint64(FILTER_BITS)).astype(np.int64)]
        return h[passes], near[passes]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch.column("text")):
                words = bw.find_words(block, bw.ALNUM)
                hashes, first = bw.word_hashes(words), words.first_of_row
                rows, pos, code, said = [np.arange(block.rows)], [np.full(block.rows, -1)], [np.zeros(block.rows, np.int64)], [""] * block.rows
                size = [np.full(block.rows, -1)]

                def add(k: int, h: np.ndarray, at: np.ndarray) -> None:
                    rows.append(words.row[at])
                    pos.append(at - first[words.row[at]])
                    size.append(np.full(at.size, k))
                    code.append(h.view(np.int64))
                    for i in at.tolist():
                        ends = zip(words.starts[i : i + max(k, 1)], words.ends[i : i + max(k, 1)])
                        said.append(b" ".join(words.codes[s:e].tobytes() for s, e in ends).decode("utf-8", "replace"))

                for k, passes in may.items():
                    h, at = bw.gram_hashes(hashes, words.row, k)
                    hit = passes[(h % np.uint64(FILTER_BITS)).astype(np.int64)]
                    add(k, h[hit], at[hit])
                    if k == how.notice_gram:
                        add(0, *near_words(words, hashes, at[hit][np.isin(h[hit], notice_hashes)]))
                rows, pos, size = np.concatenate(rows), np.concatenate(pos), np.concatenate(size)
                here = batch.slice(block.first, block.rows).select(KEY).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *here.columns,
                        pa.array(words.counts[rows].astype(np.int64)),
                        pa.array(size.astype(np.int32), mask=size < 0),
                        pa.array(pos.astype(np.int64), mask=pos < 0),
                        pa.array(np.concatenate(code)),
                        pa.array(said, pa.string()),
                    ],
                    names=[*KEY, "n_words", "k", "pos", "h", "gram"],
                )

    return docs.mapInArrow(per_batch, "doc_id long, key_a long, key_b long, n_words long, k int, pos long, h long, gram string")


def _templates(spark: SparkSession, how: LicenseScan) -> DataFrame:
    rows = [(k, _hash_of(g), g, label, base, n, t, None, False) for k, label, base, n, t, g in template_grams(how)]
    rows += [(0, _hash_of(w), w, label, False, n, t, marks, told) for label, n, marks, t, w, told in template_words()]
    kind = "t_k int, t_h long, t_gram string, label string, is_base boolean, n int, t long, n_marks int, is_mark boolean"
    return spark.createDataFrame(rows, kind)


def _bands(hits: DataFrame, how: LicenseScan) -> DataFrame:
    """(key, label, is_base, band, low, high, covered, n): merged neighbouring diagonals; every diagonal of a phrase is its own."""
    what = [*KEY, "label", "is_base"]
    votes = hits.groupBy(*what, "diagonal").agg(F.collect_set("t").alias("seen"), F.max("n").alias("n"))
    along = Window.partitionBy(*what).orderBy("diagonal")
    far = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(along) > how.drift)
    votes = votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("band", F.sum("new").over(along))
    return votes.groupBy(*what, "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"),
        F.max("n").alias("n"),
        F.min("diagonal").alias("low"),
        F.max("diagonal").alias("high"),
    )


def _verified(bands: DataFrame, words: DataFrame, how: LicenseScan) -> DataFrame:
    """(key, label, start, cover) of the candidate spans of notices that stand word by word.

    A word of the notice is found where the text has it within ``drift`` of the span's diagonals. A span must have
    ``least_words`` of the notice's words, counted with those put in between, all its telling ones, and no name of a rival inside. Spans and words meet by
    stretches of the text, so a text that repeats a notice is no quadratic join.
    """
    strip = max(w[1] for w in template_words())
    longest = F.col("high") + F.lit(strip + how.drift)
    strips = F.sequence(F.floor((F.col("low") - how.drift) / strip), F.floor(longest / strip))
    spans = bands.select(*(F.col(c).alias(f"s_{c}") for c in (*KEY, "label", "band")), "low", "high", F.explode(strips).alias("s_strip"))
    words = words.withColumn("place", F.col("pos") - F.coalesce("t", F.lit(0)))
    words = words.select(*KEY, "label", "place", "t", "n", "n_marks", "is_mark", F.floor(F.col("place") / strip).alias("strip"))
    same = F.col("doc_id").eqNullSafe(F.col("s_doc_id"))
    for c in ("key_a", "key_b", "label", "strip"):
        same &= F.col(c) == F.col(f"s_{c}")
    aligned = F.col("t").isNotNull() & F.col("place").between(F.col("low") - how.drift, F.col("high") + how.drift)
    rival = F.col("t").isNull() & F.col("place").between(F.col("low"), F.col("high") + F.col("n") - 1)
    met = words.join(spans, same).filter(aligned | rival)
    held = met.groupBy(*KEY, "label", F.col("s_band").alias("band")).agg(
        F.min("low").alias("start"),
        F.max(F.col("high") - F.col("low")).alias("extra"),
        F.size(F.collect_set("t")).alias("found"),
        F.size(F.collect_set(F.when(F.col("is_mark"), F.col("t")))).alias("marks"),
        F.count_if(F.col("t").isNull()).alias("rivals"),
        F.max("n").alias("n"),
        F.max("n_marks").alias("n_marks"),
    )
    held = held.filter("marks = n_marks and rivals = 0").withColumn("cover", F.col("found") / (F.col("n") + F.col("extra")))
    return held.filter(F.col("cover") >= how.least_words).select(*KEY, "label", "start", "cover")


def spans(documents: DataFrame, how: LicenseScan = LicenseScan()) -> DataFrame:
    """Every finding: the key of its text, label, is_base, ``start`` (word number, from 0), ``cover`` (0 to 1), n_words.

    ``cover`` of a notice is its found words by its words and those put in between; a span that begins inside a notice has a start before its
    first word, down to below 0. Every text has one more row, the only one with n_words, whose label is null.
    """
    docs = pick(documents, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    grams = rolling_grams(docs.select("doc_id", *row_key(F.col("text")), "text"), how)
    # The templates are constants of this module: a few hundred rows whatever the data.
    templates = F.broadcast(_templates(documents.sparkSession, how))
    same = (F.col("k") == F.col("t_k")) & (F.col("h") == F.col("t_h")) & (F.col("gram") == F.col("t_gram"))
    hits = grams.join(templates, same, "left").filter("pos is null or t_k is not null").drop("t_k", "t_h", "t_gram", "h", "gram")
    hits = store(hits)
    bands = _bands(hits.filter("k > 0").withColumn("diagonal", F.col("pos") - F.col("t")), how)
    phrases = bands.filter("is_base and covered = n").select(*KEY, "label", "is_base", F.col("low").alias("start"), F.lit(1.0).alias("cover"))
    notices = _verified(bands.filter(~F.col("is_base") & (F.col("covered") >= how.least_votes)), hits.filter("k = 0"), how)
    notices = notices.withColumn("is_base", F.lit(False))
    texts = hits.filter("pos is null").select(*KEY, "n_words")
    return texts.unionByName(phrases.unionByName(notices), allowMissingColumns=True)


def license_scan(documents: DataFrame, how: LicenseScan = LicenseScan()) -> DataFrame:
    """One row per (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the base phrases; first_word and last_word are the smallest and largest of their starts
    (null without any). ``labels`` has the notices' labels too; both lists are distinct, sorted and joined by commas, and
    empty without findings. ``score`` is the best cover of a finding, 0 without any. A null text is
    empty; rows that repeat a doc_id and its text count as one; an empty table gives no rows; further columns are ignored.
    """
    found = spans(documents, how)
    base = F.col("is_base") & F.col("label").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        found.groupBy(*KEY)
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum(F.coalesce(base, F.lit(False)).cast("long")).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("key_a", "key_b")
    )
