"""Text operators against plain Python and full encodings, with nulls, empty and repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import edit_counts as ec
from rankloom.llm import pieces
from rankloom.llm.language_id import LanguageModel, _sample, language_id
from rankloom.llm.license_scan import license_scan
from rankloom.llm.mixing import Mixing, mix, rake
from rankloom.llm.near_duplicates import _set_parity, near_duplicates
from rankloom.llm.queries import BYTE_RANKS, PIECE_MODEL
from rankloom.llm.secret_scan import findings, redacted, secret_scan
from rankloom.llm.substring_dedup import repeated_spans, without_spans
from rankloom.llm.tables import store

WORDS = "the of and to in for with on at by from data work text line page old new red blue green long short high low".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_a string, n_words int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing", "ed"]) for _ in range(n))


def table(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "s", len(t or ""), "x", 1) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, a long text, an id with two texts, and columns with names in use."""
    long = "word " * 60_000
    rows = [(1, "a b c d e f g h", "en"), (1, "a b c d e f g h", "en"), (None, "a b c d e f g h", None), (2, None, "en"), (3, "", None),
            (4, "  \n ", "en"), (5, long, "en"), (6, "A B c d e f g h", "en"), (1, "quite another text of its own here", "en"), (None, None, None)]
    return spark.createDataFrame([(i, t, x, None, None, "x", 1) for i, t, x in rows], SCHEMA)


def every_operator():
    return {
        "secrets": secret_scan,
        "substring": repeated_spans,
        "language": language_id,
        "edits": lambda d: ec.edit_counts(d, BYTE_RANKS),
        "mixing": mix,
        "license": license_scan,
        "pieces": lambda d: pieces.decode_ids(pieces.encode(d, PIECE_MODEL), PIECE_MODEL),
        "near": near_duplicates,
    }


@pytest.mark.parametrize("name", sorted(every_operator()))
def test_empty_tables_give_no_rows(spark, name):
    assert every_operator()[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", sorted(every_operator()))
def test_odd_rows_have_a_result(odd_rows, name):
    out = every_operator()[name](odd_rows).collect()
    assert len(out) == (10 if name in ("language", "edits", "mixing", "pieces", "near") else 9)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    base = prose(rng, 120).split()
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), "one two", "one two", "", None, None]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if union and 100 * common >= 75 * union:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    found = {r.doc_id: r for r in near_duplicates(table(spark, texts)).collect()}
    assert {i: r.component_id for i, r in found.items()} == {i: root(i) for i in range(len(texts))}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (root(i) == i) for i, r in found.items())


def test_near_duplicates_of_odd_rows(odd_rows):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_rows).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True),
         (6, 4, 1, False), (1, 3, 1, True), (None, 0, None, True)], key=str)


def test_repeated_passages(spark):
    passage = "First of all comes this long sentence. Then there is one more sentence here. And at the end a last one follows."
    texts = [f"Zero words. Something else stands in front of it {passage} Tail", f"Own line of six words here.\n{passage}\nThe end",
             "Nothing in here is ever said twice by anyone.", "Short one. Short one. Short one.", f"{passage.upper()}"]
    docs = table(spark, texts)
    spans = repeated_spans(docs)
    found = {r.doc_id: [(s.start, s.stop) for s in r.removed] for r in spans.collect()}
    cut = {i: [texts[i][a:b] for a, b in s] for i, s in found.items()}
    sentences = passage.split(". ")
    assert found[0] == [] and found[2] == [] and found[3] == []
    assert cut[1] == [sentences[1] + ".", sentences[2]] and len(cut[4]) == 3
    clean = {r.doc_id: r for r in without_spans(docs, spans).collect()}
    assert sentences[1] not in clean[1].text and sentences[0] in clean[1].text
    assert "".join(texts[1][p.start : p.stop] for p in clean[1].kept) == clean[1].text and clean[2].text == texts[2]


def test_license_findings(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files (the Software) to deal in the software without restriction"
    texts = ["All rights reserved. cc by, CC-BY", "Licensed under the Apache License, Version 2.0.", notice, "nothing at all", None,
             "the GNU general public license and the general-public-license", "rights all reserved"]
    rows = {r.doc_id: r for r in license_scan(table(spark, texts)).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (7, 3, 0, 5, "cc-by,reserved")
    assert (rows[1].labels, rows[1].base_labels, rows[1].n_base, rows[1].first_word) == ("apache-2.0", "", 0, None)
    assert rows[2].labels == "mit" and 0.6 <= rows[2].score < 1
    assert (rows[3].labels, rows[3].score, rows[4].n_words, rows[5].n_base, rows[6].labels) == ("", 0.0, 0, 2, "")


def test_license_spans_are_verified_word_by_word(spark):
    cases = [
        ("Licensed under the very Apache License, Version 2.0", "apache-2.0"),
        ("Licensed under the Apache Software License, Version 2.0", "apache-2.0"),
        ("Licensed under the GNU General Public License, Version 2", "gpl"),
        ("Licensed under the new GNU General Public License, Version 3", "gpl,gpl-3.0"),
        ("Licensed under the GNU Lesser General Public License, Version 3", "gpl,lgpl"),
        ("Licensed under the GNU Lesser open General Public License", "gpl,lgpl"),
        ("Licensed under the CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by"),
        ("Licensed under CC BY 4.0", "cc-by"),
        ("Permission is hereby granted, free of charge, to any person", ""),
        ("This source code form is subject to the terms of the Public License v. 2.0", ""),
        ("Licensed under the Apache License, Version 2.0. " * 300, "apache-2.0"),
    ]
    rows = {r.doc_id: r.labels for r in license_scan(table(spark, [t for t, _ in cases])).collect()}
    assert [rows[i] for i in range(len(cases))] == [labels for _, labels in cases]


def test_language_held_out_accuracy(spark):
    kinds = {"en": "the of and ing tion er th wh", "de": "der und sch ung ei zu ver ch", "fr": "le de que eau oux ment ai", "es": "el que ción ado ar os ll"}
    rng = random.Random(1)
    texts, langs = [], []
    for lang, parts in kinds.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choices(parts.split(), k=rng.randint(1, 3))) for _ in range(40)))
            langs.append(lang)
    texts += ["12 34 !", None, ""]
    langs += ["en", "en", "en"]
    rows = {r.doc_id: r for r in language_id(table(spark, texts, langs), LanguageModel(sample=50)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert sum(rows[i].lang_pred == langs[i] for i in held) >= 0.95 * len(held)
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (240, 241, 242)) and all(0 <= r.score <= 1 for r in rows.values())


@pytest.fixture(scope="module")
def counter():
    with open(BYTE_RANKS, "rb") as file:
        return ec.Counter(file.read())


def random_edits(rng, text, letters):
    places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3))))
    return [(a, b, "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))) for a, b in zip(places[::2], places[1::2])]


@pytest.mark.parametrize(("block", "crowded"), [(64, 256), (2, 6), (1, 1000)])
def test_rounds_of_edits_equal_full_encoding(monkeypatch, counter, block, crowded):
    monkeypatch.setattr(ec, "BLOCK", block)
    monkeypatch.setattr(ec, "CROWDED", crowded)
    rng = random.Random(3)
    letters = "ab 's\n\t .,1é  x　😀'll"
    for _ in range(1000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        tree = ec.CountTree.of(text, counter)
        for _ in range(4):
            edits = random_edits(rng, text, letters)
            after, _ = ec.follow(tree, text, edits, counter)
            assert after == ec.apply_edits(text, edits)
            words = counter.split(after)
            row = tree.row()
            assert (row["chars"], row["counts"]) == (list(map(len, words)), counter.count(words)), (text, edits)
            assert tree.total == len(counter.coder.encode_ordinary(after))
            assert tree.token_sums == ec._sums([sum(n) for _, n in tree.blocks]) and tree.char_sums == ec._sums([sum(c) for c, _ in tree.blocks])
            text, tree = after, ec.CountTree.read(row)


def test_edits_renew_a_small_part(counter):
    text = "plain words and more of them " * 500 + "mail me@there.org now" + " and on it goes" * 500
    tree = ec.CountTree.of(text, counter)
    after, renewed = ec.follow(tree, text, ec.redactions(text), counter)
    assert renewed < 12 and tree.total == len(counter.coder.encode_ordinary(after))


def test_tables_of_edits_follow_stored_trees(spark, odd_rows, counter):
    rng = random.Random(4)
    trees = store(ec.plant(odd_rows, BYTE_RANKS))
    texts = {(r.doc_id, r.key_a, r.key_b): r.text or "" for r in trees.collect()}
    copies = Counter((r.doc_id, r.key_a, r.key_b) for r in trees.collect())
    for _ in range(2):
        edits = {k: random_edits(rng, t, "ab 1.") for k, t in texts.items()}
        edits[max(texts, key=lambda k: len(texts[k]))] = [(9, 9, " of many words" * 200), (70, 90, ""), (250_000, 260_000, "x")]
        rows = [(*k, *e) for k, found in edits.items() for e in found] + [(*next(iter(texts)), None, 3, "y"), (*next(iter(texts)), 10**7, 10**8, "z")]
        table = spark.createDataFrame(rows, "doc_id long, key_a long, key_b long, start long, stop long, new string")
        trees = store(ec.edited(trees, BYTE_RANKS, table))
        texts = {k: ec.apply_edits(t, edits[k]) for k, t in texts.items()}
        found = trees.withColumn("n_tokens", ec.total()).collect()
        assert Counter((r.doc_id, r.key_a, r.key_b) for r in found) == copies
        for r in found:
            k = (r.doc_id, r.key_a, r.key_b)
            assert (r.text or "", r.n_edits, r.n_tokens) == (texts[k], len(edits[k]), len(counter.coder.encode_ordinary(texts[k])))


def test_edit_counts_equal_full_encoding(spark, counter):
    texts = ["mail a.b@c.org and call 0123456789 now", "nothing here", "", None, "x@y.zz" + " 999999999" * 400]
    whole = lambda t: len(counter.coder.encode_ordinary(t))
    rows = {r.doc_id: r for r in ec.edit_counts(table(spark, texts), BYTE_RANKS).collect()}
    for i, text in enumerate(texts):
        edits = ec.redactions(text or "")
        after = ec.apply_edits(text or "", edits)
        assert (rows[i].n_tokens, rows[i].n_edits, rows[i].n_tokens_after) == (whole(text or ""), len(edits), whole(after))


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choice(" abcdehilnorstuAZ.,\n\té日本😀▁0129<>") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [prose(rng, 400), "x" * 5000, None, ""]
    rows = {r.doc_id: r for r in pieces.decode_ids(pieces.encode(table(spark, texts), PIECE_MODEL), PIECE_MODEL).collect()}
    for i, text in enumerate(texts):
        assert rows[i].ids == library.encode(text or "") and rows[i].decoded == (text or "").replace("▁", " ")


def test_pieces_words_end_where_no_piece_goes_on():
    encoder = pieces.Encoder(pieces.read_model(PIECE_MODEL))
    rng, kept, ends = random.Random(6), {}, ["", ",", ".", ";", ".\n", ".\nword"]
    stems = ["".join(rng.choices("abcdehilnorstu", k=7)) for _ in range(200)]
    texts = [" ".join(stem + end for stem in stems) for end in ends]
    got = pieces.encode_texts(texts, encoder, kept)
    for text, ids in zip(texts, got, strict=True):
        words = pieces._WORD.findall(pieces.marked(text, encoder.model))
        assert ids.tolist() == [i for w in words for i in encoder._ids(encoder.merged(w))]
    assert len(kept) < 1.1 * len(stems)


def test_pieces_borders_equal_the_merges(monkeypatch):
    encoder = pieces.Encoder(pieces.read_model(PIECE_MODEL))
    rng, all_pieces = random.Random(7), sorted(encoder.ids)
    pairs = [(rng.choice(all_pieces), rng.choice(all_pieces)) for _ in range(2000)]
    for word in rng.sample(all_pieces, 2000):
        parts = encoder.merged(word + rng.choice(all_pieces)[:3])
        pairs += [(a[rng.randrange(len(a)) :], b) for a, b in zip(parts, parts[1:])]  # noqa: B905
    pairs = [(a, b) for a, b in pairs if a in encoder.ids and "▁▁" not in a + b]
    want = [encoder.merged(a + b) == [a, b] for a, b in pairs]
    assert len(set(want)) == 2
    assert [encoder.together(a, b) for a, b in pairs] == want
    # A border is judged by the pieces at it; the two sides are not merged anew for each pair.
    calls, plain = [], encoder.merged
    monkeypatch.setattr(encoder, "merged", lambda *a: calls.append(a) or plain(*a))
    assert [encoder.together(a, b) for a, b in pairs] == want and not calls


def test_decoded_columns_equal_single_rows(spark):
    model, rng = pieces.read_model(PIECE_MODEL), random.Random(8)
    rows = [None if i % 9 == 0 else [rng.randrange(len(model.pieces)) for _ in range(i % 7)] for i in range(300)]
    rows += [[], [model.byte_ids[b] for b in "▁".encode()], [model.byte_ids[b] for b in " ".encode()] * 2, [model.byte_ids[255]]]
    table_of_ids = spark.createDataFrame(list(enumerate(rows)), "n int, ids array<int>")
    for row in pieces.decode_ids(table_of_ids, PIECE_MODEL).collect():
        assert row.decoded == (None if row.ids is None else pieces.decode(row.ids, model))


def test_unigram_forward_pass_finds_the_best_sum():
    pieces_of = ("<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab")
    scores = (0.0, -2.0, -2.1, -2.2, -2.3, -3.0, -2.9, -5.5, -3.9, -5.2)
    model = pieces.PieceModel(pieces.UNIGRAM, pieces_of, scores, tuple(p != "<unk>" for p in pieces_of), (), 0, True)
    encoder, ids = pieces.Encoder(model), {p: i for i, p in enumerate(pieces_of)}

    def best(word):
        if not word:
            return 0.0
        return max(scores[ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in ids)

    words = sorted({"▁" + "".join(random.Random(i).choices("abc", k=i % 7)) for i in range(80)})
    for word, got in zip(words, encoder.words(words), strict=True):
        assert sum(scores[i] for i in got) == pytest.approx(best(word)) and "".join(pieces_of[i] for i in got) == word


def test_raking_meets_the_margins(spark):
    rng = random.Random(2)
    cells = [((a, b, c), rng.uniform(1, 9)) for a in "xyz" for b in "pq" for c in "uv"]
    whole = sum(t for _, t in cells)
    targets = [{"x": 0.2, "y": 0.3, "z": 0.5}, {"p": 0.6, "q": 0.4}, {"u": 0.1, "v": 0.9}]
    factors = rake([(k, t / whole) for k, t in cells], targets, 80)
    for i, wanted in enumerate(targets):
        sums = defaultdict(float)
        for key, tokens in cells:
            sums[key[i]] += tokens / whole * factors[key]
        assert all(sums[v] == pytest.approx(share, abs=1e-9) for v, share in wanted.items())
    texts = [prose(rng, 20) for _ in range(400)]
    docs = table(spark, texts, ["en"] * 300 + ["de"] * 100)
    rows = mix(docs, Mixing(targets={"lang": {"en": 0.5, "de": 0.5}})).collect()
    assert {r.lang: round(r.probability, 6) for r in rows} == {"en": pytest.approx(1 / 3, abs=1e-6), "de": 1.0}
    drawn = [r for r in rows if r.kept]
    assert all(r.kept for r in rows if r.lang == "de") and 60 < sum(r.lang == "en" for r in drawn) < 140


def test_secrets_and_their_redaction(spark):
    rng = random.Random(9)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    texts = []
    for i in range(120):
        tail = [f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))][i % 3]
        texts.append(f"{prose(rng, 15)} {tail} {prose(rng, 5)}" if i % 2 else f"{prose(rng, 15)} card {rng.randrange(10**15, 10**16)} and commit {hexes(40)} {prose(rng, 4)}")
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in secret_scan(docs).collect()}
    assert all((rows[i].n_findings > 0) == (i % 2 == 1) for i in range(120))
    clean = {r.doc_id: r for r in redacted(docs, findings(docs)).collect()}
    for i, text in enumerate(texts):
        for span in filter(None, rows[i].spans.split(",")):
            a, b = map(int, span.split("-"))
            assert text[a:b] not in clean[i].text and "[secret]" in clean[i].text
        assert i % 2 or clean[i].text == text
        assert clean[i].n_chars == len(clean[i].text)
    assert clean[1].source == "s" and len(clean) == 120


def test_secret_scan_plan_has_no_python(spark):
    plan = secret_scan(table(spark, ["token = abcdef0123456789abcd", "x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_are_found_by_their_exact_names(spark):
    docs = table(spark, ["a b c d e f", "b c"]).withColumnRenamed("source", "TEXT").withColumn("node", F.lit(1))
    assert near_duplicates(docs).count() == 2 and license_scan(docs).count() == 2


def test_parity_bits_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 30, 400, 9000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[a.size // 8 :], rng.integers(0, 2**63, size // 8, dtype=np.uint64)]))
        bits = int(np.unpackbits((_set_parity(a) ^ _set_parity(b)).view(np.uint8)).sum())
        assert bits <= np.setxor1d(a, b).size
        assert not (_set_parity(a) ^ _set_parity(a)).any()


def test_languages_are_learned_from_each_text_once(spark):
    rows = [("the same text", "en")] * 300 + [(f"text number {i}", "en") for i in range(200)] + [("un texte", "fr")]
    usable = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "xxhash64(text) as digest")
    drawn = _sample(usable, {"en": 201, "fr": 1}, LanguageModel(sample=20)).collect()
    assert sorted(r.lang for r in drawn) == ["en"] * 20 + ["fr"]
    assert len({r.text for r in drawn}) == 21
