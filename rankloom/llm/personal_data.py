"""Personal data in texts: entities by form, and the terms that give them away.

Entities are e-mail addresses, network addresses, card numbers and phone numbers. How strongly a term reveals an entity is
estimated from the corpus: the pointwise mutual information of term and entity, as a share of the entity's own information
content, is 1 where the term never stands without the entity. Terms beyond a threshold are spans too, wherever they stand; they
are generalised, and beyond a second threshold removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bitmaps as bm
from rankloom.llm import bytewords as bw
from rankloom.llm.tables import pick, row_key, store

#: The order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match always begins at the first digit of its run, so no run is tried from its middle.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class PersonalData:
    """``reach`` characters on both sides of an entity are its context; a term of at least ``letters`` bytes counts from
    ``support`` different contexts of an entity on, so copies of one text show nothing. ``generalise`` and ``remove`` are the
    shares of the entity's information from which on a term is generalised or removed."""

    reach: int = 80
    letters: int = 3
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        before = _LOCAL_BACK.match(text[free:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if before else None
        if found:
            yield at - before, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed and then by start; per kind leftmost and without overlap. A match
    that its own rule rejects is dropped without another try. Time grows with the length of the text only."""
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _digest(value: str) -> int:
    return int.from_bytes(blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _entity(text: str, span: tuple[str, int, int]) -> int:
    """What tells entities apart: addresses without case, numbers by their digits."""
    kind, start, stop = span
    value = text[start:stop].translate(_ASCII_LOWER)
    return _digest(f"{kind}:{value if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}")


def _contexts(text: str, spans: list[tuple[str, int, int]], how: PersonalData) -> Iterator[tuple[int, int, str]]:
    """(entity, context, word): the different words near each entity, once for each place in the text and entity."""
    blank, end = [], 0
    for _, start, stop in sorted(spans, key=lambda s: s[1]):
        if stop > end:
            blank += [text[end : max(start, end)], " " * (stop - max(start, end))]
            end = stop
    clean = "".join([*blank, text[end:]])
    seen: dict[int, set[int]] = {}
    for kind, start, stop in spans:
        entity = _entity(text, (kind, start, stop))
        low, high = max(0, start - how.reach), min(len(clean), stop + how.reach)
        near = []
        for m in _WORD.finditer(clean, low, high):
            cut = m.start() == low > 0 and _WORD.match(clean[low - 1]) or m.end() == high < len(clean) and _WORD.match(clean[high])
            if not cut:
                near.append((m.start(), m.group().translate(_ASCII_LOWER)))
        context, places = _digest(" ".join(w for _, w in near)), seen.setdefault(entity, set())
        for place, word in near:
            if place not in places and len(word.encode()) >= how.letters:
                places.add(place)
                yield entity, context, word


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``bytewords`` gives these words, each of which is one word."""
    out = [bw.word_hashes(bw.find_words(block, bw.ALNUM)) for block in bw.blocks(pa.array([" ".join(words)]))]
    return np.concatenate([np.zeros(0, np.uint64), *out])


def scan(docs: DataFrame, how: PersonalData) -> DataFrame:
    """Per row: the number of entities of each kind, ``base`` (their spans, joined), and the words near them."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, counts, near, sizes, named = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                spans = entities(text or "")
                base.append(_joined(spans))
                counts.append([sum(s[0] == k for s in spans) for k in KINDS[:4]])
                found = list(_contexts(text, spans, how)) if spans else []
                near += found
                sizes.append(len(found))
                named.append([_entity(text, span) for span in spans])
            at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            words = _hashes([w for _, _, w in near]).view(np.int64)
            lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int64())) for v in ([e for e, _, _ in near], [c for _, c, _ in near], words)]
            numbers = np.array(counts, dtype=np.int64).reshape(-1, 4)
            names = ["doc_id", "key_a", "key_b"]
            lists.append(pa.array(named, pa.list_(pa.int64())))
            columns = [*(batch.column(c) for c in names), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(base, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_email", "n_ip", "n_card", "n_phone", "base", "entity", "context", "word", "named"])

    schema = "doc_id long, key_a long, key_b long, n_email long, n_ip long, n_card long, n_phone long, base string"
    return docs.mapInArrow(per_batch, f"{schema}, entity array<long>, context array<long>, word array<long>, named array<long>")


def _chosen(block: bw.TextBlock, known: np.ndarray, how: PersonalData) -> tuple[bw.Words, np.ndarray, np.ndarray]:
    """The words of a block, their hashes, and the places of those long enough whose bit is set."""
    words = bw.find_words(block, bw.ALNUM)
    hashes = bw.word_hashes(words)
    hit = known[bm.slots(hashes)] & (words.ends - words.starts >= how.letters)
    return words, hashes.view(np.int64), np.flatnonzero(hit)


def occurrences(docs: DataFrame, words: DataFrame, how: PersonalData) -> DataFrame:
    """(word, n): how often each of ``words`` stands in the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(bm.bitmap(words.select("word")))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bm.known(bits.value)
        for batch in batches:
            for block in bw.blocks(batch.column("text")):
                _, hashes, at = _chosen(block, known, how)
                word, n = np.unique(hashes[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(per_batch, "word long, n long").groupBy("word").agg(F.sum("n").alias("n_term"))


def revealing_terms(docs: DataFrame, scanned: DataFrame, how: PersonalData) -> DataFrame:
    """(word, share): terms that reveal an entity, and the largest share of an entity's information that they give away.

    With N documents, an entity in n_e places and a term in n_t places, n_te of them near the entity: the entity's information is
    log2(N / n_e), that shared with the term log2(n_te * N / (n_t * n_e)). Entities as frequent as documents have none.
    """
    near = scanned.select(F.explode(F.arrays_zip("entity", "context", "word")).alias("x")).select("x.*")
    near = store(near)
    pairs = near.groupBy("entity", "word", "context").agg(F.count("*").alias("n")).groupBy("entity", "word")
    pairs = store(pairs.agg(F.sum("n").alias("n_near"), F.count("*").alias("contexts")).filter(F.col("contexts") >= how.support))
    entity = scanned.select(F.explode("named").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_docs = docs.count()
    terms = occurrences(docs, pairs.select("word"), how)
    own = F.log2(F.lit(float(n_docs)) / F.col("n_entity"))
    shared = F.log2(F.least("n_near", "n_term") * F.lit(float(n_docs)) / (F.col("n_term") * F.col("n_entity")))
    found = pairs.join(entity, "entity").join(terms, "word").filter(own > 0).withColumn("share", shared / own)
    return found.filter(F.col("share") >= how.generalise).groupBy("word").agg(F.max("share").alias("share"))


def term_spans(docs: DataFrame, terms: DataFrame, how: PersonalData) -> DataFrame:
    """(key_a, key_b, terms): per text with such terms their spans (start, stop, share) by start, outside its entities."""
    bits = docs.sparkSession.sparkContext.broadcast(bm.bitmap(terms.select("word")))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bm.known(bits.value)
        for batch in batches:
            for block in bw.blocks(batch.column("text")):
                words, hashes, at = _chosen(block, known, how)
                begins = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))  # code points before each byte
                here = words.row[at]
                shift = begins[block.offsets[here]]
                start, stop = begins[words.starts[at]] - shift, begins[words.ends[at]] - shift
                outside = np.ones(at.size, dtype=bool)
                for r in np.unique(here).tolist():
                    own = here == r
                    for _, low, high in entities(batch.column("text")[block.first + r].as_py()):
                        outside &= ~(own & (start < high) & (stop > low))
                rows = pa.array(here[outside] + block.first)
                keys = [batch.column(c).take(rows) for c in ("key_a", "key_b")]
                numbers = [pa.array(x[outside]) for x in (hashes[at], start, stop)]
                yield pa.RecordBatch.from_arrays([*keys, *numbers], names=["key_a", "key_b", "word", "start", "stop"])

    found = docs.select("key_a", "key_b", "text").mapInArrow(per_batch, "key_a long, key_b long, word long, start long, stop long")
    found = found.join(terms, "word").select("key_a", "key_b", "start", "stop", "share").distinct()
    return found.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "share"))).alias("terms"))


def personal_data(documents: DataFrame, how: PersonalData = PersonalData()) -> DataFrame:
    """One row per document: doc_id, key_a, key_b (digests of the text), n_email, n_ip, n_card, n_phone, base, terms, spans.

    ``base`` are the entities as kind:start:end (code points), ``terms`` the revealing terms with their shares, ``spans`` both.
    A null text is empty and has none; repeated rows each give a row; an empty table gives no rows. Rows with one doc_id keep
    each their own text's spans. Further columns are ignored.
    """
    docs = pick(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", *row_key(F.col("text")))
    scanned = store(scan(docs, how))
    terms = store(revealing_terms(docs, scanned, how))
    marked = term_spans(docs, terms, how).withColumnsRenamed({"key_a": "a", "key_b": "b"})
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    rows = scanned.select("doc_id", "key_a", "key_b", *counts, "base")
    rows = rows.join(marked, (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b")), "left").drop("a", "b")
    said = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["stop"].cast("string")))
    base = F.when(F.col("base") != "", F.array("base")).otherwise(F.array().cast("array<string>"))
    spans = F.array_join(F.concat(base, F.coalesce(said, F.array().cast("array<string>"))), ",")
    return rows.withColumn("spans", spans)


def sanitised(documents: DataFrame, found: DataFrame, how: PersonalData = PersonalData()) -> DataFrame:
    """doc_id, text: every entity becomes ``[kind]``, a revealing term its class (``[number]``, ``[name]`` or ``[word]``), or goes
    where its share is ``remove`` or more. ``found`` is the result of ``personal_data`` on the same documents; a null text stays."""
    docs = pick(documents, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    docs = docs.withColumns(dict(zip(("_a", "_b"), row_key(F.coalesce("text", F.lit(""))), strict=True)))
    marks = found.filter("spans != ''").select("key_a", "key_b", "base", "terms").dropDuplicates(["key_a", "key_b"])
    rows = docs.join(marks, (F.col("_a") == F.col("key_a")) & (F.col("_b") == F.col("key_b")), "left").select("doc_id", "text", "base", "terms")

    def clean(text: str, base: str | None, terms: list | None) -> str:
        spans = [(int(s), int(e), f"[{kind}]") for kind, s, e in (x.split(":") for x in (base or "").split(",") if x)]
        for t in terms or []:
            word = text[t["start"] : t["stop"]]
            kind = "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[word]"
            spans.append((t["start"], t["stop"], "" if t["share"] >= how.remove else kind))
        out, end = [], 0
        for start, stop, mark in sorted(spans):
            if start >= end:
                out += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*out, text[end:]])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else clean(t, b, m) for t, b, m in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(per_batch, "doc_id long, text string")
